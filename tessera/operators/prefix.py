"""Exact running sums and ranks in a global order without a single-partition window.

``Window.orderBy(x)`` without ``partitionBy`` moves every row into one task. The
two-level scheme used here shuffles only small bucket totals through one task:

1. ``bucket`` is a deterministic, order-preserving function of the order key
   (never ``spark_partition_id`` or ``monotonically_increasing_id``: those can
   change when a stage is recomputed after an executor loss).
2. Totals per (partition, bucket) are aggregated map-side, then a running sum
   over that small table gives each bucket's offset.
3. Each row's offset is its bucket offset plus a running sum inside its bucket,
   computed by a window partitioned by (partition, bucket).

Bucket tables are broadcast only while their proven size allows it
(``BROADCAST_BUCKETS``); otherwise the join is left to the planner (AQE broadcasts
it at runtime when it is small).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def key_range(df: DataFrame, col: str | Column) -> tuple[int, int]:
    """(min, max) of an integral key, in one aggregate pass. Empty input gives (0, 0)."""
    c = F.col(col) if isinstance(col, str) else col
    row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return 0, 0
    return int(lo), int(hi)


def key_stats(df: DataFrame, col: str | Column) -> tuple[int, int, int]:
    """(min, max, count) of an integral key in one aggregate pass. Empty input gives (0, 0, 0)."""
    c = F.col(col) if isinstance(col, str) else col
    row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).first()
    if row["lo"] is None:
        return 0, 0, 0
    return int(row["lo"]), int(row["hi"]), int(row["n"])


#: Bucket tables of at most this many rows are broadcast (24 bytes a row); larger ones are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000


def bucket_count(n_rows: int, max_buckets: int | None = None, rows_per_bucket: int = 1_000_000, least: int = 1) -> int:
    """Enough buckets that each window sorts about ``rows_per_bucket`` rows, and at least ``least``.

    ``max_buckets`` is for callers that want fewer; there is no ceiling by default.
    """
    count = max(1, least, math.ceil(n_rows / rows_per_bucket))
    return count if max_buckets is None else max(1, min(max_buckets, count))


def range_bucket(key: Column, lo: int, hi: int, max_buckets: int) -> Column:
    """Equal-width buckets over ``[lo, hi]``; at most ``max_buckets`` of them, monotone in key."""
    width = max(1, math.ceil((hi - lo + 1) / max(1, max_buckets)))
    shifted = key.cast("long") - F.lit(lo)
    return F.call_function("div", shifted - F.pmod(shifted, F.lit(width)), F.lit(width))


QUANTILES = 1024


def quantile_bounds(df: DataFrame, key: Column, n_buckets: int) -> list[float]:
    """Interior boundaries of ``n_buckets`` buckets (at most ``QUANTILES``) holding about equal numbers of rows.

    One ``approxQuantile`` pass; at most ``QUANTILES - 1`` numbers reach the driver.
    The boundaries are then fixed literals, so the bucket of a row is the same in
    every branch and every retry.
    """
    n_buckets = max(1, min(n_buckets, QUANTILES))
    if n_buckets == 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    col = df.select(key.cast("double").alias("__q")).where(F.col("__q").isNotNull())
    bounds = col.approxQuantile("__q", probs, 1.0 / (4 * n_buckets))
    return sorted(set(bounds))


def quantile_bucket(key: Column, bounds: list[float]) -> Column:
    """Number of sorted ``bounds`` that are at most ``key``: a binary search over a constant array.

    ``log2(len(bounds))`` native steps per row, monotone in ``key``.
    """
    if not bounds:
        return F.lit(0).cast("long")
    k, table = key.cast("double"), F.lit([float(b) for b in bounds])
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, by: Column) -> Column:
        # beyond the last bound ``get`` gives NULL, which is not at most the key
        return F.when(F.get(table, at + by - 1) <= k, at + by).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step).cast("long")


def order_bucket(df: DataFrame, key: Column, max_buckets: int | None = None, rows_per_bucket: int = 1_000_000,
                 stats: tuple[int, int, int] | None = None, least: int = 1) -> Column:
    """A bucket for an integral order key that keeps every bucket near its fair share.

    Dense keys (range at most twice the row count) use equal-width ranges, which
    bounds any bucket at twice the average. Sparse or clustered keys use quantile
    boundaries instead, so one crowded stretch of the key space cannot land in one
    window task; where more than ``QUANTILES`` buckets are needed, every quantile is
    cut into equal widths.
    """
    lo, hi, n = stats if stats is not None else key_stats(df, key)
    count = bucket_count(n, max_buckets, rows_per_bucket, least)
    if hi - lo + 1 <= 2 * max(n, 1):
        return range_bucket(key, lo, hi, count)
    bounds = quantile_bounds(df, key, count)
    cuts = math.ceil(count / QUANTILES)
    if cuts == 1:
        return quantile_bucket(key, bounds)
    at, edges, k = quantile_bucket(key, bounds), F.lit([float(lo), *bounds, float(hi) + 1]), key.cast("double")
    left, right = F.get(edges, at.cast("int")), F.get(edges, (at + 1).cast("int"))
    within = F.floor((k - left) / F.greatest(right - left, F.lit(1.0)) * cuts)
    return at * cuts + F.greatest(F.lit(0), F.least(F.lit(cuts - 1), within)).cast("long")


def hex_bucket(hex_key: Column, digits: int = 3, after: int = 0) -> Column:
    """Bucket from ``digits`` hex digits of a hex digest, by default the leading ones: ``16**digits`` even buckets."""
    return F.conv(F.substring(hex_key, after + 1, digits), 16, 10).cast("long")


HEX_DIGITS = 15  # as many as a long holds
CROWDED = 1000  # crowded prefixes that are named in a plan; with more, all prefixes get more digits


def hash_digits(n_rows: int, rows_per_bucket: int, least: int = 1) -> int:
    """Hex digits so that ``n_rows`` even keys leave a bucket half full on average, with ``least`` buckets or more."""
    count, digits = max(least, math.ceil(2 * n_rows / rows_per_bucket), 1), 1
    while 16**digits < count and digits < HEX_DIGITS:
        digits += 1
    return digits


def hash_bucket(df: DataFrame, key: str, n_rows: int, rows_per_bucket: int = 1_000_000, least: int = 1,
                by: tuple[str, ...] | list[str] = ()) -> tuple[Column, int]:
    """A bucket for a hash order, monotone in the hex digest ``key``, and how many buckets there can be.

    As many leading digits as ``n_rows`` (rows of the largest group of ``by``) ask for. Where that is
    more than one bucket's worth, prefixes are counted; those that are crowded all the same (equal or
    unlucky keys) are cut by further digits, and so on until no bucket holds more than
    ``rows_per_bucket`` rows or only rows of one key are left in it.
    """
    at = hash_digits(n_rows, rows_per_bucket, least)
    bucket, total, rows = hex_bucket(F.col(key), at), 16**at, df
    while n_rows > rows_per_bucket and at < HEX_DIGITS:
        prefix = F.substring(F.col(key), 1, at)
        full = rows.groupBy(*by, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_bucket)
        top = full.orderBy(F.desc("n")).limit(CROWDED + 1).collect()
        if not top:
            break
        more = min(hash_digits(top[0]["n"], rows_per_bucket), HEX_DIGITS - at)
        deeper = hex_bucket(F.col(key), more, at)
        if len(top) <= CROWDED:
            crowded = prefix.isin(sorted({r["prefix"] for r in top}))
            deeper, rows = F.when(crowded, deeper).otherwise(0), rows.where(crowded)
        bucket, total, at = bucket * 16**more + deeper, total * 16**more, at + more
    return bucket, total


KEYLESS_BITS = 8


def keyless_bits(n_rows: int, rows_per_bucket: int = 1_000_000, least: int = 1) -> int:
    """Bits of the row hash that tell the buckets of ``n_rows`` rows without an order key, half full on average."""
    return max(1, math.ceil(math.log2(max(least, 2 * n_rows / rows_per_bucket, 2))))


def ordered_offsets(
    df: DataFrame,
    n: str | Column,
    order_cols: list[str],
    bucket: Column,
    partition_cols: tuple[str, ...] | list[str] = (),
    out: str = "start",
    total_col: str | None = None,
    broadcast_buckets: bool | None = None,
    keyless_bits: int = KEYLESS_BITS,
) -> DataFrame:
    """Add ``out`` = sum of ``n`` over all rows before this one, per partition group.

    ``order_cols`` must be unique within a partition group, so that the order and
    hence every offset is deterministic. ``bucket`` must be non-decreasing in that
    order. Optionally add ``total_col`` = the group's total of ``n``.
    """
    kept = bucketed_offsets(df, n, order_cols, bucket, partition_cols, out, total_col, broadcast_buckets, keyless_bits)
    return kept.drop(BUCKET, BUCKET_START, BUCKET_END)


#: Where the bucket of a row starts and ends in the running sum.
BUCKET_START, BUCKET_END = "__bucket_start", "__bucket_end"


def bucketed_offsets(
    df: DataFrame,
    n: str | Column,
    order_cols: list[str],
    bucket: Column,
    partition_cols: tuple[str, ...] | list[str] = (),
    out: str = "start",
    total_col: str | None = None,
    broadcast_buckets: bool | None = None,
    keyless_bits: int = KEYLESS_BITS,
) -> DataFrame:
    """``ordered_offsets`` that keeps the row's bucket, and where the bucket starts and ends.

    No row is lost: rows with a NULL order key come before all others in the order of a hash of
    the row, in buckets of its leading ``keyless_bits`` bits, and NULL partition values are a group.
    ``bucket`` must not be negative.
    """
    nc = F.col(n) if isinstance(n, str) else n
    part = list(partition_cols)
    keys = part + [BUCKET]
    no_key = F.greatest(*[F.col(c).isNull().cast("int") for c in order_cols], F.lit(0)) == 1
    tie = F.when(no_key, F.xxhash64(*df.columns))
    # -2**bits .. -1, rising with the (signed) hash
    keyless = F.shiftright(F.xxhash64(*df.columns), 64 - keyless_bits) - F.lit(1 << keyless_bits - 1)
    staged = df.withColumn(BUCKET, F.when(no_key, keyless).otherwise(bucket).cast("long")).withColumn("__pfx_n", nc.cast("long"))

    totals = staged.groupBy(*keys).agg(F.sum("__pfx_n").alias("__pfx_bt"))
    run = Window.partitionBy(*part).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [*[F.col(c).alias(f"__pfx_{i}") for i, c in enumerate(keys)], F.sum("__pfx_bt").over(run).alias(BUCKET_END), "__pfx_bt"]
    if total_col:
        cols.append(F.sum("__pfx_bt").over(Window.partitionBy(*part)).alias(total_col))
    offsets = totals.select(*cols).withColumn(BUCKET_START, F.col(BUCKET_END) - F.col("__pfx_bt")).drop("__pfx_bt")
    if broadcast_buckets is None:
        broadcast_buckets = not part
    if broadcast_buckets:
        offsets = F.broadcast(offsets)
    same = F.lit(True)
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"__pfx_{i}"))
    same = same & (F.col(BUCKET) == F.col(f"__pfx_{len(part)}"))

    order = [*order_cols, tie.asc_nulls_first()]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        staged.join(offsets, same)
        .withColumn(out, F.col(BUCKET_START) + F.sum("__pfx_n").over(inner) - F.col("__pfx_n"))
        .drop("__pfx_n", *[f"__pfx_{i}" for i in range(len(keys))])
    )


def global_rank(
    df: DataFrame,
    order_cols: list[str],
    bucket: Column,
    partition_cols: tuple[str, ...] | list[str] = (),
    out: str = "rank",
    total_col: str | None = None,
    broadcast_buckets: bool | None = None,
    keyless_bits: int = KEYLESS_BITS,
) -> DataFrame:
    """0-based exact rank in ``order_cols`` (per partition group): the prefix sum of 1."""
    return ordered_offsets(
        df, F.lit(1), order_cols, bucket, partition_cols, out, total_col, broadcast_buckets, keyless_bits
    )
