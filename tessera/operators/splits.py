"""Seeded order, exact-count split and dataset summary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.packing import running_offset
from tessera.operators.prefix import BROADCAST_BUCKETS, global_rank, hash_bucket
from tessera.session import parallelism

ORDER_KEY = "order_key"


def seeded_key(seed: int, *keys) -> Column:
    """K8: ``md5('seed:key1:key2...')``; ties are broken by the keys themselves."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def seeded_order(df: DataFrame, key_cols: list[str], seed: int, out: str = "rank",
                 partition_cols: tuple[str, ...] = (), total_col: str | None = None,
                 rows_per_bucket: int = 1_000_000) -> DataFrame:
    """K8: add ``order_key`` and the exact 0-based position in the seeded order.

    Buckets of the two-level rank are leading digits of the md5 key, as many as the counted rows ask for.
    """
    keyed = df.withColumn(ORDER_KEY, seeded_key(seed, *partition_cols, *key_cols))
    bucket, total = hash_bucket(keyed, ORDER_KEY, df.count(), rows_per_bucket, parallelism(df.sparkSession), partition_cols)
    return global_rank(
        keyed, [ORDER_KEY, *key_cols], bucket, partition_cols, out, total_col,
        broadcast_buckets=total <= BROADCAST_BUCKETS if not partition_cols else None,
    )


def val_count(n: Column, fraction: float, rounding: str = "floor") -> Column:
    """``max(1, int(n * f))`` (rounding='floor', the corpus split) or ``ceil(n * f)``; 0 for no rows."""
    x = n.cast("double") * F.lit(float(fraction))
    if rounding == "floor":
        v = F.greatest(F.lit(1), F.floor(x))
    elif rounding == "ceil":
        v = F.ceil(x)
    else:
        raise ValueError("rounding must be 'floor' or 'ceil'")
    return F.when(n > 0, v).otherwise(F.lit(0)).cast("long")


def val_rows(n: int, fraction: float, rounding: str = "floor") -> int:
    """``val_count`` for a known count, in Python (same IEEE arithmetic as the column form)."""
    if n <= 0:
        return 0
    if rounding == "floor":
        return max(1, math.floor(float(n) * fraction))
    if rounding == "ceil":
        return math.ceil(float(n) * fraction)
    raise ValueError("rounding must be 'floor' or 'ceil'")


def _tuple_at_least(cols: list[Column], values: list) -> Column:
    """Lexicographic ``(c1, c2, ...) >= (v1, v2, ...)`` as a native predicate."""
    c, v = cols[0], F.lit(values[0])
    if len(cols) == 1:
        return c >= v
    return (c > v) | ((c == v) & _tuple_at_least(cols[1:], values[1:]))


#: Rows of the order among which the boundary is looked for in one small sort.
BOUNDARY_ROWS = 4096


def split_threshold(df: DataFrame, key_cols: list[str], fraction: float, seed: int,
                    rounding: str = "floor", digits: int = 3):
    """The smallest ``(order_key, *keys)`` tuple of the val split, or None when val is empty.

    Counts per leading digits of the key (at most ``16**digits`` numbers) tell which
    digits the boundary has; that bucket is counted by its next digits, until it holds
    at most ``BOUNDARY_ROWS`` rows. Only those are sorted, however large the table.
    """
    keyed = df.select(seeded_key(seed, *key_cols).alias(ORDER_KEY), *key_cols)
    key, prefix, k = F.col(ORDER_KEY), "", None
    while True:
        inside = keyed.where(F.substring(key, 1, len(prefix)) == prefix) if prefix else keyed
        lead = F.substring(key, 1, len(prefix) + digits)
        totals = sorted(((r[0], r[1]) for r in inside.groupBy(lead.alias("b")).count().collect()), reverse=True)
        if k is None:
            k = val_rows(sum(c for _, c in totals), fraction, rounding)
            if k == 0:
                return None
        for b, c in totals:  # from the top of the order down; the k-th row is the boundary
            if c >= k:
                prefix, rows = b, c
                break
            k -= c
        if rows <= BOUNDARY_ROWS or len(prefix) >= 32:  # an md5 has 32 digits; beyond, keys are equal
            order = [key.desc(), *[F.col(c).desc() for c in key_cols]]
            row = keyed.where(F.substring(key, 1, len(prefix)) == prefix).orderBy(*order).offset(k - 1).limit(1).first()
            return [row[ORDER_KEY], *[row[c] for c in key_cols]]


def split_exact(df: DataFrame, key_cols: list[str], fraction: float, seed: int, rounding: str = "floor",
                split_col: str = "split", keep_rank: bool = False) -> DataFrame:
    """K9: exactly ``val_count(n)`` rows go to ``'val'``: the tail of the seeded order.

    Without ``keep_rank`` no row is ranked: the val split is every row whose
    ``(order_key, *keys)`` is at least the boundary tuple found by ``split_threshold``,
    so the split is a projection with no window and no shuffle of the rows (which may
    carry whole token arrays). With ``keep_rank`` each row also gets its exact global
    ``rank`` and ``n_total`` from the two-level scheme. No ``limit``, no ``randomSplit``.
    """
    if keep_rank:
        ranked = seeded_order(df, key_cols, seed, out="__rank", total_col="__total")
        is_val = F.col("__rank") >= F.col("__total") - val_count(F.col("__total"), fraction, rounding)
        out = ranked.withColumn(split_col, F.when(is_val, F.lit("val")).otherwise(F.lit("train")))
        return out.withColumnRenamed("__rank", "rank").withColumnRenamed("__total", "n_total")
    bound = split_threshold(df, key_cols, fraction, seed, rounding)
    if bound is None:
        return df.withColumn(split_col, F.lit("train"))
    tup = [seeded_key(seed, *key_cols), *[F.col(c) for c in key_cols]]
    return df.withColumn(split_col, F.when(_tuple_at_least(tup, bound), F.lit("val")).otherwise(F.lit("train")))


def split_positions(split_df: DataFrame, key_cols: list[str], seed: int, which: str = "val",
                    split_col: str = "split") -> DataFrame:
    """``pos``: each ``which`` row's place within its split in the seeded order, the order
    that split is stored and read in; other rows get NULL (training data is reshuffled
    every epoch by the manifest). Only the ``which`` rows are ranked, and the parts are
    combined by a union, not a join.
    """
    part = split_df.where(F.col(split_col) == which)
    ranked = seeded_order(part, key_cols, seed, out="pos").drop(ORDER_KEY)
    rest = split_df.where(F.col(split_col) != which).withColumn("pos", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def dataset_summary(tokens: DataFrame, chunks: DataFrame, block: int, split_col: str = "split",
                    budget: int | None = None, order_col: str = "doc_id") -> DataFrame:
    """One row: documents, tokens, chunks per split, tail and utilisation.

    With a ``budget`` (blocks asked for, K6) only documents that start within it count:
    whatever else ``tokens`` holds was read past the budget. The two sides are
    aggregated separately and combined by a union and one more aggregate over two
    rows, not by a join.
    """
    if budget is not None:
        starts = running_offset(tokens.select(order_col, "n_tokens"), order_col)
        tokens = starts.where(F.col("start") < F.lit(budget * block))
    doc_side = tokens.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").cast("long").alias("total_tokens"),
    )
    chunk_side = chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col(split_col) == "train").alias("train_chunks"),
        F.count_if(F.col(split_col) == "val").alias("val_chunks"),
    )
    both = doc_side.unionByName(chunk_side, allowMissingColumns=True).agg(
        F.max("n_docs").alias("n_docs"),
        F.max("total_tokens").alias("total_tokens"),
        F.max("n_chunks").alias("n_chunks"),
        F.max("train_chunks").alias("train_chunks"),
        F.max("val_chunks").alias("val_chunks"),
    )
    chunk_tokens = F.col("n_chunks") * F.lit(block)
    return both.select(
        F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"),
        F.coalesce("total_tokens", F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce("train_chunks", F.lit(0)).cast("long").alias("train_chunks"),
        F.coalesce("val_chunks", F.lit(0)).cast("long").alias("val_chunks"),
        F.coalesce(chunk_tokens, F.lit(0)).cast("long").alias("chunk_tokens"),
        F.coalesce(F.col("total_tokens") - chunk_tokens, F.lit(0)).cast("long").alias("tail_tokens"),
        F.coalesce(chunk_tokens / F.col("total_tokens"), F.lit(0.0)).alias("utilisation"),
    )
