"""Exact top-k search by tiled matrix products.

Vectors are scaled to integers. Queries are hashed into blocks and all rows into shards of
bounded size; a tile is one block against one shard, computed as a matrix product in a
dtype whose exactness the tile's largest components prove (float32, float64, else Python
integers). Each tile keeps the k best per query, and a tree of grouped merges, ``FAN_IN``
lists at a time, leaves k per query. What is shuffled grows with queries x rows / tile
side; no task holds more than a tile.

Vectors that are null, empty or hold null or non-finite components take no part, nor do
rows without an id. Vectors of different lengths never meet. Components beyond 64 bits
saturate, as do scores. Rows with the same id are different rows: only a query's own row is
left out of its candidates. Ties: the smaller id. Empty table: empty result. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

K = 20
SCALE = 64
BLOCK = 4096  # queries of a tile
SHARD = 4096  # candidates of a tile
STRIP = 512  # queries of a tile multiplied at a time
FAN_IN = 16
_LONG = np.iinfo(np.int64)


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, vec``: floor(scale * x) of every usable vector, under a row number of its own."""
    finite = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    scaled = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    # the numbers hold as they are written with the rows
    return cut(usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), scaled.alias("vec")))


def _matrices(rows: DataFrame, part: str, count: int) -> DataFrame:
    """``part, dim, row_bytes, id_bytes, vec_bytes``: the rows of each part and length as one matrix, in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            parts, row, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            vecs = b.column(3)
            dims = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                for p in np.unique(parts[dims == dim]):
                    at = np.nonzero((dims == dim) & (parts == p))[0]
                    matrix = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                    held.setdefault((int(p), int(dim)), []).append((row[at], ids[at], matrix))
        for (p, dim), pieces in held.items():
            row, ids, matrix = (np.concatenate(x) for x in zip(*pieces))
            order = np.lexsort((row, ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([dim], pa.int32()),
                 *(pa.array([np.ascontiguousarray(x[order]).astype("<i8").tobytes()], pa.binary()) for x in (row, ids, matrix))],
                ["part", "dim", "row_bytes", "id_bytes", "vec_bytes"])

    number = F.pmod(F.xxhash64("row", F.lit(part)), F.lit(count)).cast("int").alias("part")
    dealt = rows.select(number, "row", "vec_id", "vec").repartition(count, "part")
    return cut(dealt.mapInArrow(run, "part int, dim int, row_bytes binary, id_bytes binary, vec_bytes binary"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exact; of dtype float32, float64 or object."""
    most = int(max(abs(int(q.max())), abs(int(q.min())))) * int(max(abs(int(c.max())), abs(int(c.min())))) * q.shape[1]
    if most < 2**24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if most < 2**53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    exact = q.astype(object) @ c.astype(object).T
    return np.array([[min(max(x, _LONG.min + 1), _LONG.max) for x in line] for line in exact], object)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of each line's k greatest scores; of equal ones the first columns. None is no candidate."""
    if scores.dtype == object:
        picks = [sorted((c for c in range(len(x)) if x[c] is not None), key=lambda c: (-x[c], c))[:k] for x in scores]
        return np.repeat(np.arange(len(picks)), [len(p) for p in picks]), np.array([c for p in picks for c in p], np.int64)
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(scores > -np.inf)
    limit = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    above, level = scores > limit, scores == limit
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero((above | level & (np.cumsum(level, axis=1) <= room)) & (scores > -np.inf))


def _tile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, dim = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                qr, qi, qv, cr, ci, cv = (np.frombuffer(b.column(2 + x)[i].as_buffer(), "<i8") for x in range(6))
                qv, cv = qv.reshape(-1, dim), cv.reshape(-1, dim)
                place = np.argsort(cr)
                for lo in range(0, len(qr), STRIP):
                    rows = qr[lo : lo + STRIP]
                    scores = products(qv[lo : lo + STRIP], cv)
                    own = place[np.minimum(np.searchsorted(cr, rows, sorter=place), len(cr) - 1)]
                    mine = np.nonzero(cr[own] == rows)[0]
                    scores[mine, own[mine]] = None if scores.dtype == object else -np.inf
                    line, col = best_of(scores, k)
                    values = scores[line, col].astype(np.int64)
                    offsets = np.searchsorted(line, np.arange(len(rows) + 1))
                    best = pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()),
                        pa.StructArray.from_arrays([pa.array(-values), pa.array(ci[col])], ["minus", "vec_id"]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows), pa.array(qi[lo : lo + STRIP]), pa.array(np.full(len(rows), shard, np.int32)), best],
                        ["row", "query_id", "shard", "best"])

    return run


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows of every row for which ``is_query`` holds.

    ``is_query`` is a condition on ``vec_id``.
    """
    vectors = integer_vectors(rows, id_col, vec_col, scale)
    asked = vectors.where(is_query)
    blocks = max(1, math.ceil(asked.count() / block))
    shards = max(1, math.ceil(vectors.count() / shard))
    q = _matrices(asked, "block", blocks).withColumnsRenamed({"row_bytes": "qr", "id_bytes": "qi", "vec_bytes": "qv", "part": "block"})
    c = _matrices(vectors, "shard", shards).withColumnsRenamed({"row_bytes": "cr", "id_bytes": "ci", "vec_bytes": "cv", "part": "shard"})
    # every block meets every shard once: whole matrices are dealt to tiles, not rows to rows
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = q.join(c, ["block", "shard", "dim"]).select("shard", "dim", "qr", "qi", "qv", "cr", "ci", "cv")
    lists = tiles.mapInArrow(
        _tile(k), "row long, query_id long, shard int, best array<struct<minus: bigint, vec_id: bigint>>")
    while shards > 1:
        shards = math.ceil(shards / FAN_IN)
        lists = lists.groupBy("row", "query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = lists.select("query_id", F.posexplode(F.array_sort("best")).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.minus")).alias("score"))


def op6_topk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
