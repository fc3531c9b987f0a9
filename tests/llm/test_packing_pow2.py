import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing_pow2 as g


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(g.tokenizer_file())


def test_memo_equals_the_tokenizer(tokenizer):
    rng = random.Random(4)
    signs = [chr(c) for c in range(1, 256)] + list("abcAB12.,' \n 　İΣς日🙂") + ["<|endoftext|>", "'ll", "S'", "é", " the "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)]
    memo = g.WordMemo(g.tokenizer_file())
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert memo.encode(part) == want


def test_memo_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(g, "MEMO", 100)
    memo = g.WordMemo(g.tokenizer_file())
    for k in range(40):
        text = " ".join([f"w{k}x{j}" for j in range(20)] + ["again"])
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert memo.encode([text]) == [want]
        for m in (memo.words, memo.runs):
            assert len(m.young) + len(m.old) <= 100
    memo.encode(["z" * 100])
    assert "z" * 100 not in memo.words.young  # long words are not kept


@pytest.mark.parametrize("n, want", [(1, [1]), (5000, [4096, 512, 256, 128, 8]), (4096, [4096]), (8193, [4096, 4096, 1]), (7, [4, 2, 1])])
def test_piece_lengths(n, want):
    assert g.piece_lengths(n) == want


def test_pieces_hold_every_id_once(spark, corpus, tokenizer):
    rng = random.Random(1)
    words = ["Alpha", "beta,", "gamma.", "x", "délta", "12", "the"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 700, 6000]))), "s") for k in range(30)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "same", "s"), (102, "same", "s"), (None, "no id", "s")]
    d = corpus(documents=spark.createDataFrame(rows, "doc_id long, text string, bucket string"))
    out = g.op5_packing_pow2(spark, d).collect()
    assert len({r.sequence_id for r in out}) == len(out)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and 1 << r.bucket == r.length for r in out)
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc_id, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want, start = [], 0
        for n in g.piece_lengths(len(ids)):
            want.append((start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)))
            start += n
        if doc_id == 102:
            want = sorted(want + want)
        assert sorted(pieces[doc_id]) == want


def test_small_limit_and_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    packed = g.pack(docs, g.tokenizer_file(), max_length=4)
    assert sorted(r.length for r in packed.collect()) == [4, 4, 4]
    g.write_buckets(packed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("bucket = 2").count() == 3
    with pytest.raises(ValueError):
        g.pack(docs, g.tokenizer_file(), max_length=6)


def test_empty_table(spark, corpus):
    d = corpus(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert g.op5_packing_pow2(spark, d).count() == 0


def test_words_are_looked_up_once_and_runs_tokenised_together(tokenizer):
    words = [f"{chr(97 + a)}{chr(97 + b)}{s}" for a in range(26) for b in range(26) for s in ("q", "Zé,", "'s9")]
    texts = [" ".join(words), "", "  " + "  ".join(reversed(words)) + " ", "ab\x1cq <|endoftext|> İx"]
    memo, seen, calls = g.WordMemo(g.tokenizer_file()), [], []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, batch, **kw):
            calls.extend(batch)
            return self.inner.encode_batch_fast(batch, **kw)

    of_words = memo.of_words
    memo.of_words = lambda strings: seen.extend(strings) or of_words(strings)
    memo.tokenizer, memo.run_tokenizer = Counted(memo.tokenizer), Counted(memo.run_tokenizer)
    assert memo.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(seen) == len(set(seen)) == len({*words, "", "ab\x1cq", "<|endoftext|>", "İx"})
    assert len(calls) < 10  # not one for each run


def test_portions_do_not_change_the_pieces(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(["ab", "C,", "é1", "\x1d", "日本"], k=rng.choice([0, 3, 900])))) for k in range(40)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, g.digest(g.pack(docs, g.tokenizer_file(), max_length=64)).collect()))
    monkeypatch.setattr(g, "PORTION", 1)
    assert sorted(map(str, g.digest(g.pack(docs, g.tokenizer_file(), max_length=64)).collect())) == whole


def test_memos_stay_small(tokenizer):
    """Half a million different words and their runs took 150 bytes each, twice."""
    rng = random.Random(3)
    memo = g.WordMemo(g.tokenizer_file())
    for _ in range(30):
        words = ["".join(rng.choices("abcdeinorst", k=9)) for _ in range(10_000)]
        ids = memo.encode([" ".join([*words, words[0].capitalize()])])[0]
    assert ids == np.array(tokenizer.encode(" ".join([*words, words[0]]), add_special_tokens=False).ids, "<u4").tobytes()
    assert words[0] in memo.runs.young and not {words[0], words[0].capitalize()} & memo.words.young.keys()
    held = [d for m in (memo.words, memo.runs) for d in (m.young, m.old)]
    assert sum(sys.getsizeof(d) + sum(sys.getsizeof(s) + sys.getsizeof(x) for s, x in d.items()) for d in held) < 50e6


def test_memory_is_given_back_after_each_portion(spark, monkeypatch):
    read, given = {}, []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: read.update(run=run) or self.selectExpr("1L as length"))
    g.pack(docs, g.tokenizer_file())
    monkeypatch.undo()
    monkeypatch.setattr(g, "PORTION", 10)
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(1)})())
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["some words", "more words", None]})
    assert sum(b.num_rows for b in read["run"](iter([batch, batch]))) >= 6 and len(given) == 4
