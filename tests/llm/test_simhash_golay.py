import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash_golay as g


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits=4):
    """fingerprint -> frozenset of the fingerprints it reaches."""
    left, out = set(fps), {}
    while left:
        group = todo = {left.pop()}
        while todo:
            near = {f for f in left for t in todo if bin(f ^ t).count("1") <= max_bits}
            left -= near
            group, todo = group | near, near
        out |= dict.fromkeys(group, frozenset(group))
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two three", "a b c d", "A B c D e", "x " * 300, "é Ä ñ ß É\x0bq\x1cr s"])
def test_fingerprint_equals_the_definition(text):
    assert g.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_the_code_is_perfect():
    words = np.arange(1 << 23)
    assert (np.bincount(g.codeword_index(words), minlength=4096) == 2048).all()


def test_every_pair_of_up_to_four_bits_shares_a_key():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for fps in (x, y):
        at, keys = g.fuzzy_keys(fps)
        sets.append([set() for _ in fps])
        for i, k in zip(at.tolist(), keys.tolist()):
            sets[-1][i].add(k)
    assert all(a & b for a, b in zip(*sets))


def near_copies(seed, groups=12, copies=14, words=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 400)) for _ in range(words)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(words)] = str(rng.random())
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("tile", [3, g.TILE])
def test_components_equal_brute_force(spark, tile):
    fps = sorted({brute_fingerprint(t) for t in near_copies(3)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = g.components(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.comp, set()).add(r.fp % 2**64)
    want = set(brute_components(fps).values())
    assert {frozenset(x) for x in groups.values()} == want
    assert any(len(x) > 2 for x in want)
    assert all(min(f - 2**64 if f >= 2**63 else f for f in x) == c for c, x in groups.items())


def test_query_on_odd_rows(spark, corpus):
    rows = [(5, "a b c d e f", 1), (3, "A b C d E f", 2), (9, None, 3), (8, "", 4), (7, "other words stand here now", 5),
            (7, "other words stand here now", 5), (None, "quite some other words again", 6)]
    d = corpus(documents=spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in g.op8_simhash_golay(spark, d).collect())
    h = lambda t: f"{brute_fingerprint(t):016x}"
    assert got == sorted([(5, h(rows[0][1]), 3), (3, h(rows[0][1]), 3), (9, "0" * 16, 8), (8, "0" * 16, 8),
                          (7, h(rows[4][1]), 7), (7, h(rows[4][1]), 7), (-1, h(rows[6][1]), None)])


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "x"), (3, "A b C d E f", "y"), (None, "a b c d e f", "z"), (7, "other words here", "u"),
            (7, "other words here", "u"), (None, "alone it stands", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(g.keep_one(docs).collect(), key=str)
    assert sorted(r.lang for r in kept) == ["u", "v", "y"]
    assert g.keep_one(docs).columns == docs.columns


def test_empty_table(spark, corpus):
    d = corpus(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert g.op8_simhash_golay(spark, d).count() == 0
    assert g.keep_one(spark.read.parquet(f"{d}/documents.parquet")).count() == 0


def test_keep_one_with_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 2, 3, 4), (2, "a b c d e", 2, 3, 4), (3, "quite another text here", 1, 1, 1)],
                                 "doc_id long, text string, __n int, `a.b` int, h int")
    out = g.keep_one(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [(1, "a b c d e", 2, 3, 4), (3, "quite another text here", 1, 1, 1)]


def test_components_without_a_broadcast(spark, monkeypatch):
    rows = [(k, f"one two three four five {k // 3}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, g.near_duplicates(docs).collect()))
    monkeypatch.setattr(g, "BROADCAST_NAMES", -1)
    assert sorted(map(tuple, g.near_duplicates(docs).collect())) == want


def test_keys_are_emitted_in_many_tasks(spark, monkeypatch):
    """Also where the fingerprints come in one partition: their keys take a hundred times as much."""
    monkeypatch.setattr(g, "TASK", 16)
    rng, seen = random.Random(4), []
    fps = [rng.getrandbits(63) for _ in range(100)]
    fps += [f ^ 5 for f in fps[:20]]
    one = spark.createDataFrame([(f,) for f in fps], "fp long").coalesce(1)
    emit = type(one).mapInArrow
    monkeypatch.setattr(type(one), "mapInArrow", lambda self, *a, **k: seen.append(self) or emit(self, *a, **k))
    found = {frozenset((r["u"], r["v"])) for r in g.links(one).collect()}
    assert found == {frozenset((f, f ^ 5)) for f in fps[:20]}
    assert seen[0].rdd.getNumPartitions() == 8


@pytest.mark.parametrize("bound", [g.BROADCAST_KEYS, -1])
def test_the_keys_of_all_fingerprints_are_not_broadcast(spark, monkeypatch, bound):
    """Spark takes them to be about as large as the fingerprints; only the larger groups' keys may be broadcast, while few."""
    monkeypatch.setattr(g, "BROADCAST_KEYS", bound)
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(60)]
    fps += [f ^ b for f in fps[:10] for b in (1, 2, 4)]
    out = g.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    groups = {f: {f} for f in fps}
    for r in out.collect():
        both = groups[r["u"]] | groups[r["v"]]
        groups.update(dict.fromkeys(both, both))
    assert {f: frozenset(x) for f, x in groups.items()} == brute_components(fps)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BuildLeft" not in plan
    assert ("BuildRight" in plan, "SortMergeJoin" in plan) == (bound > 0, bound < 0)
