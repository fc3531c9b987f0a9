import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substring_fm as g
from tessera.llm.common import spans_within


def brute(rows, window):
    first = {}
    split = [(i, g.WORD.findall(t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    for i, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, float("inf")), order(i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    line = " ".join(f"common{k}" for k in range(20))
    short = " ".join(f"s{k}" for k in range(9))  # shorter than a window, always in other context
    copy = " ".join(rng.choices("abcdefgh", k=90))
    rows = [(None, "a b\tc \n d e"), (3, None), (4, ""), (5, " \n "), (6, "few words"), (None, line), (None, line + " x"),
            (900, "r " * 500), (901, "q r " * 200 + "r " * 300), (902, "r " * 13), (903, "r " * 12)]
    rows += [(100 + k, copy) for k in range(10)] + [(100, copy), (100, copy + " other end")]
    for k in range(n):
        words = rng.choices("abcdefgh", k=rng.randint(0, 60)) + rng.choices(["the", "Of", "naïve", "日本"], k=rng.randint(0, 30))
        rng.shuffle(words)
        extra = rng.choice(["", line, short, copy[:60]])
        at = rng.randint(0, len(words))
        rows.append((200 + k, " ".join(words[:at]) + " " + extra + " " + rng.choice([" ", "\n", "\x0b"]).join(words[at:])))
    rng.shuffle(rows)
    return rows


def run(spark, rows, window, anchor):
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, key string, anchor int")
    return sorted((tuple(r) for r in g.remove_repeats(docs, window=window, anchor=anchor).collect()), key=str)


@pytest.mark.parametrize("window, anchor", [(13, 5), (4, 2), (5, 5), (3, 1)])
def test_equals_brute_force(spark, window, anchor):
    rows = rows_of(window)
    assert run(spark, rows, window, anchor) == brute(rows, window)


@pytest.mark.parametrize("hot, broadcast, filtered", [(0, 10, 1 << 25), (40, 0, 1 << 25), (1 << 30, 10, 0), (60, 10, 0)])
def test_hot_anchors_and_joins(spark, monkeypatch, hot, broadcast, filtered):
    monkeypatch.setattr(g, "HOT_WORDS", hot)
    monkeypatch.setattr(g, "BROADCAST_HOT", broadcast)
    monkeypatch.setattr(g, "FILTER_ANCHORS", filtered)
    rows = rows_of(8, 40)
    assert run(spark, rows, 6, 3) == brute(rows, 6)


def test_query(spark, corpus):
    rows = rows_of(2)
    d = corpus(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in g.op13_substring_fm(spark, d).collect()), key=str)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 13)), key=str)


def test_empty_table(spark, corpus):
    d = corpus(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert g.op13_substring_fm(spark, d).count() == 0


@pytest.mark.parametrize("alphabet", [1, 2, 3, 70, 1000])
def test_wavelet_matrix_counts(alphabet):
    rng = np.random.default_rng(alphabet)
    s = rng.integers(0, alphabet, 700)
    m = g.WaveletMatrix(s, alphabet)
    c, at = rng.integers(0, alphabet, 300), rng.integers(0, 701, 300)
    assert m.rank(c, at).tolist() == [int((s[:y] == x).sum()) for x, y in zip(c, at)]


def test_matching_statistics():
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 4, rng.integers(6, 30)) for _ in range(20)]
    row = np.concatenate([np.append(t, 0) for t in texts])
    ends, at = [], 0
    for t in texts:
        ends += range(at + 6, at + len(t) + 1)
        at += len(t) + 1
    length, low, high = g.FmIndex(row, 6).matches(np.array(ends), 6)
    flat = row.tolist()
    for e, n, x, y in zip(ends, length, low, high):
        counts = [sum(flat[p : p + k] == flat[e - k : e] for p in range(len(flat))) for k in range(1, 7)]
        assert n == sum(c > 1 for c in counts)
        assert n == 0 or y - x == counts[n - 1]


def test_equal_windows_have_equal_anchors():
    h = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint64)
    anchors, seen = g.window_anchors(h, 13, 5), {}
    for k, a in enumerate(anchors.tolist()):
        assert seen.setdefault(tuple(h[k : k + 13].tolist()), a) == a
    assert len(g.window_anchors(h[:12], 13, 5)) == 0


def test_words_on_bytes():
    texts = [None, "", " a  b\x85c\n", "x", "日本\tnaïve \x0b\x0c z\r", "no", "ab " * 40, " "]
    words = g.Words(pa.array([None, "skipped", *texts], pa.string())[2:])
    split = [g.WORD.findall(t or "") for t in texts]
    flat = [w for s in split for w in s]
    assert np.diff(words.of_text).tolist() == [len(s) for s in split]
    assert words.text(np.arange(len(flat)), np.ones(len(flat), np.int64)) == flat
    first = words.of_text[:-1][[2, 4, 6]]
    assert words.text(first, np.array([2, 3, 40])) == [" ".join(split[k]) for k in (2, 4, 6)]
    hashes = words.hashes().tolist()
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))


def test_segments_hold_each_window_once_and_are_bounded():
    words = g.Words(pa.array(["r " * 300, None, "a b c d", "a b c", "r " * 70]))
    rows, first, sizes, anchors = words.segments(4, 2)
    assert sizes.max() == 64 and sizes.sum() == 297 + 1 + 67
    covered = sorted(f + k for f, n in zip(first.tolist(), sizes.tolist()) for k in range(n))
    assert covered == spans_within(words.of_text, 4).tolist()
    assert rows.tolist() == [0] * 5 + [2] + [4] * 2 and len(set(anchors.tolist())) == 2
