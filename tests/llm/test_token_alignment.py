import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import token_alignment as g

FILES = g.tokenizer_files()


@pytest.fixture(scope="module")
def pair():
    a = Tokenizer.from_file(FILES["a_json"])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES["b_model"])


def ranges(tokens):
    out, at = [], 0
    for k, raw in tokens:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def brute(pair, text):
    """Token ids, groups and all links from all pairs of tokens, without windows or memo."""
    a, b = pair
    if not text:
        return None
    of = {c: x for x, c in enumerate(_byte_alphabet())}
    raw = (" " + text).encode()
    ta = [(k, bytes(of[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    tb = []
    for k in b.encode(text):
        p = b.id_to_piece(k)
        tb.append((k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in ta) != raw or b"".join(x for _, x in tb) != raw:
        return None
    ra, rb = ranges(ta), ranges(tb)
    cuts = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
    groups, low = [], 0
    for high in cuts:
        groups.append(tuple([k for k, s, e in r if low <= s and e <= high] for r in (ra, rb)))
        low = high
    links = [(x, y) for x, s, e in ra for y, t, f in rb if s < f and t < e]
    return len(ra), len(rb), groups, links


def _byte_alphabet():
    """The 256 characters of byte-level BPE in the order of the bytes."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out, extra = [], 256
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def expected(pair, rows):
    found = [(i, brute(pair, t)) for i, t in rows]
    counts = Counter(p for _, r in found if r for p in set(r[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for i, r in found:
        if r is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in r[2])
        out.append((i, r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == best[p[0]] for p in r[3]),
                    sum(counts[p] for p in r[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(3)
    words = ["the", "of", "Zürich", "naïve", "don't", "  two", "x_y", "3,141.59", "日本語", "🙂", "tab\there", "new\n\nline", "ſtrange",
             "ﬁt", "antidisestablishmentarianism", "http://a.b/c?d=e", "<s>", "<|endoftext|>", "Ünïcödé", "aaaaaaa", "…", "—", "ИвaН"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(60)]


ODD = [None, "", " ", "  ", "a", "\n", " a ", "a▁b", "▁", "q" * 400, "no spaces" * 30, "x " * 800, "\x00\x01", "a b", "é"]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("bound", [0, g.BROADCAST_PAIRS])
def test_equals_all_pairs(spark, corpus, monkeypatch, pair, bound):
    monkeypatch.setattr(g, "BROADCAST_PAIRS", bound)
    rows = list(enumerate(ODD + texts())) + [(500, "same row twice"), (500, "same row twice"), (None, "no id"), (None, None), (501, "same row twice")]
    d = corpus(documents=spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, links string"))
    got = [tuple(r) for r in g.op12_token_alignment(spark, d).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(expected(pair, rows), key=str)


def test_groups_and_links_as_they_are(spark, docs_df, pair):
    out = {r.id: r for r in g.align(docs_df(texts()), FILES).collect()}
    for k, text in enumerate(texts()):
        n_a, n_b, groups, links = brute(pair, text)
        assert out[k].groups == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert {(x.a, x.b): x.n for x in out[k].links} == Counter(links)


def test_ranks_give_the_ids_of_the_file(pair):
    rng = random.Random(9)
    signs = [chr(c) for c in range(0x250)] + list("abc  \n\n''sstllre123 –—‘’“”…€")
    t = g.Tokenizers(FILES)
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 40)))
        assert not g._OTHER.search(text)
        assert t.a_ranks.encode_ordinary(text) == pair[0].encode(text, add_special_tokens=False).ids


def test_memo_is_bounded(monkeypatch):
    w, kept = g.Windows(FILES), g.Windows.__new__(g.Windows)
    kept.tokenizers = w.tokenizers
    kept.clear()
    for text in texts():
        ids = w.tokenizers.encode([text])
        monkeypatch.setattr(g, "MEMO_TOKENS", 50)
        got = w.align(ids)
        assert w.tokens <= 50 + len(ids[0][0]) + len(ids[0][1])
        monkeypatch.setattr(g, "MEMO_TOKENS", 10**9)
        assert [list(x) for x in got] == [list(x) for x in kept.align(ids)]


def test_windows_are_words(monkeypatch):
    w, seen = g.Windows(FILES), []
    monkeypatch.setattr(w, "learn", lambda keys, *x, real=w.learn: seen.append(len(keys)) or real(keys, *x))
    ids = w.tokenizers.encode(["the quick brown fox", "the quick brown dog unquestionably", "the quick brown dog"])
    w.align(ids[:1])
    w.align(ids)
    w.align(ids)
    assert seen == [4, 2]  # each word once


def test_windows_with_one_number(monkeypatch, pair):
    """Windows are told apart by their ids even where all have the same number."""
    plain, w = g.Windows(FILES), g.Windows(FILES)
    monkeypatch.setattr(w, "numbers", lambda a, b, at, n: g.np.zeros(len(at[0]), g.np.int64))
    ids = w.tokenizers.encode(texts())
    for part in (ids[:1], ids, ids):
        assert [list(x) for x in w.align(part)] == [list(x) for x in plain.align(part)]
    assert len(w.known) == 1
    assert plain.align(ids)[2][7] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in brute(pair, texts()[7])[2])


def test_spelling_is_checked_in_blocks():
    a = g.Tokenizers(FILES).a
    ids = g.np.array([k for k in (500, 7, 44, 7, 9000)], g.np.uint16)
    raw = g.np.concatenate([a.bytes[a.first[k] : a.first[k] + a.lengths[k]] for k in ids])
    for block in (1, 2, 5, 9):
        assert a.spells(ids, raw, block)
        assert not a.spells(ids, raw[:-1], block) and not a.spells(ids[:-1], raw, block) and not a.spells(ids[::-1], raw, block)


def test_portions():
    cut = [["", "aa", "b", "cccccc", "d"][x] for x in g.portions(["", "aa", "b", "cccccc", "d"], 3)]
    assert cut == [["", "aa", "b"], ["cccccc"], ["d"]]


def test_empty_table(spark, corpus):
    d = corpus(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert g.op12_token_alignment(spark, d).count() == 0
