import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk_tiles as g

INF = float("inf")


def brute(rows, k):
    usable = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((n, i, [min(max(math.floor(64 * x), -(2**63)), 2**63 - 1) for x in v]))
    out = []
    for n, i, q in usable:
        if i % 20 == 0:
            scored = [(min(max(sum(a * b for a, b in zip(q, c)), -(2**63) + 1), 2**63 - 1), j) for m, j, c in usable if m != n and len(c) == len(q)]
            scored.sort(key=lambda x: (-x[0], x[1]))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, shard, fan", [(1, 2, 2), (3, 7, 16), (4096, 4096, 16)])
def test_equals_brute_force(spark, monkeypatch, block, shard, fan):
    monkeypatch.setattr(g, "FAN_IN", fan)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.26]) for _ in range(3)]) for i in range(70)]
    rows += [(0, [1.0, 2.0, 1.0]), (0, [1.0, 2.0, 1.0]), (90, [1.0, None, 2.0]), (91, None), (92, [1.0, INF, 0.0]), (93, [float("nan")] * 3),
             (None, [9.0] * 3), (100, [3.0]), (120, []), (94, [4.0]), (140, [5.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in g.top_k(df, F.col("vec_id") % 20 == 0, k=5, block=block, shard=shard).collect())
    assert got == brute(rows, 5)


def test_large_components_are_exact(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e3, -1.0]), (2, [1e9, 5.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0]), (20, [3e7, 2e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in g.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()) == brute(rows, 3)


def test_best_of_takes_ties_in_order():
    scores = np.array([[1, 5, 5, 5, -np.inf], [2, 2, 2, 2, 2]])
    line, col = g.best_of(scores, 2)
    assert line.tolist() == [0, 0, 1, 1] and col.tolist() == [1, 2, 0, 1]


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.5]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in g.top_k(df, F.col("vec_id") % 20 == 0, k=4, block=4, shard=50).collect())
    assert got == brute(rows, 4)


def test_empty_table(spark, corpus):
    d = corpus(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert g.op6_topk_tiles(spark, d).count() == 0
