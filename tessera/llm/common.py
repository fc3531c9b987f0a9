"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder.

    Spark's cleaner removes the files when nothing refers to the result any more, where the cluster sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; without it they stay until the folder is emptied.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sql_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def quoted(name: str) -> str:
    """A column name as it must be written where a dot in it is no field access."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """A row as one struct, so that no helper column can clash with one of its names; ``select("row.*")`` gives it back."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


_MEMO: dict = {}


def worker_memo(key, make):
    """What a Python worker remembers from task to task: one thing, of the operator that runs.

    Workers are reused, so without this the memos of a pipeline's earlier stages would stay
    in memory. ``worker_memo(None, lambda: None)`` drops what is there.
    """
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = make()
    return _MEMO[key]


def slices(batches, rows: int = 512):
    """Arrow batches in slices of a few rows, so that few texts are Python strings at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def portions(batches, text: str, most: int = 1 << 20):
    """Arrow batches in slices of at most ``most`` bytes of a text column, a longer row by itself: arrays over a slice stay small."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(start, end - start)
            start = end


class Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as many as asked for."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.bases = base, pow(base, -1, 1 << 64)
        self.arrays = [np.ones(1, np.uint64) for _ in self.bases]

    def upto(self, n: int) -> list[np.ndarray]:
        if n > len(self.arrays[0]):
            for k, base in enumerate(self.bases):
                factors = np.full(2 * n, base, np.uint64)
                factors[0] = 1
                self.arrays[k] = np.cumprod(factors)
        return self.arrays


class SpanHashes:
    """Hashes of spans of a row of numbers: a polynomial of the span's numbers, the same wherever the span stands."""

    def __init__(self, numbers: np.ndarray):
        powers, self.inverse = worker_powers().upto(len(numbers) + 1)
        self.prefix = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum((numbers.astype(np.uint64) + np.uint64(1)) * powers[: len(numbers)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


_POWERS: list[Powers] = []


def worker_powers() -> Powers:
    """One table a worker, as long as its largest slice."""
    if not _POWERS:
        _POWERS.append(Powers())
    return _POWERS[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with every bit depending on all others above it."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def spans_within(of_text: np.ndarray, width: int) -> np.ndarray:
    """The first place of every run of ``width`` places that lies in one text; ``of_text`` has each text's first place, and the end."""
    first, end = of_text[:-1], of_text[1:]
    sizes = np.maximum(end - first - width + 1, 0)
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def hash_filter(hashes: DataFrame, col: str, bits: int) -> np.ndarray:
    """Which of ``2**bits`` slots the hashes fall into: a filter of fixed size, whatever their number."""
    slot = F.pmod(F.col(col), F.lit(1 << bits)) + 1
    rows = (
        hashes.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    size = (1 << 15) // 8  # bytes of one of Spark's bitmaps
    out = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[(r["bucket"] - 1) * size : r["bucket"] * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def may_hold(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether the slot of each unsigned 64-bit hash is taken in a ``hash_filter``."""
    slot = hashes & np.uint64((1 << bits) - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds``; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(labels: DataFrame, key: str, by: str, most: tuple[int, int]) -> DataFrame:
    """At most ``most[c]`` rows of each class ``c`` (0 and 1) of ``by``, lowest hash of the key first.

    Each class is an ordered limit (a top-k of fixed size), so the sample is the
    same in every run and its size has a proven bound.
    """
    picks = [
        labels.where(F.col(by) == c).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most[c])
        for c in (0, 1)
    ]
    return picks[0].unionByName(picks[1])


def sampled_texts(docs: DataFrame, picked: DataFrame, id_col: str, text: Column, label: str) -> DataFrame:
    """``text, label`` of the sampled ids, one text for each, so that the sample stays as small as its ids.

    ``picked`` (``id_col``, ``label``) comes from ``bounded_sample``, which bounds the broadcast. An id that many
    rows share gives the text of least hash, found map-side.
    """
    rows = docs.select(id_col, text.alias("text")).join(F.broadcast(picked), id_col)
    one = rows.groupBy(id_col, label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("text", F.col(label).cast("int").alias("label"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` of every node of an undirected edge list; ``root`` is the component's least node.

    Alternating large-star and small-star contraction: each round replaces a node's
    edges by edges to the least node it sees, until only stars remain. Rounds grow
    with the logarithm of the component size; each is cut by a checkpoint, and only
    a count and a hash sum reach the driver.
    """
    e = cut(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    )
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
