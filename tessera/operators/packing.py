"""Tight packing into fixed-length blocks (K4-K7).

Documents are laid end to end in an explicit order; block ``c`` holds tokens
``[c*B, (c+1)*B)`` of that stream. Each document is cut into the fragments that
fall into its blocks (at most ``ceil(n/B) + 1`` of them), and each block is
reassembled from at most ``B`` tokens. The partial last block is dropped, as in the
reference.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import PackConfig
from tessera.operators.prefix import (
    BROADCAST_BUCKETS,
    BUCKET,
    BUCKET_END,
    BUCKET_START,
    KEYLESS_BITS,
    bucket_count,
    bucketed_offsets,
    keyless_bits,
    order_bucket,
    ordered_offsets,
)
from tessera.session import parallelism

TOKEN_BYTES = 4


def _order_buckets(df: DataFrame, order_col: str, n_col: str, cfg: PackConfig) -> tuple[Column, int, int]:
    """The order bucket, how many there are, and the bits that tell the buckets of rows without a key.

    Sized by rows and by token bytes, at least one per task slot.
    """
    k = F.col(order_col)
    row = df.agg(F.min(k), F.max(k), F.count(k), F.sum(F.col(n_col).cast("long")), F.count_if(k.isNull())).first()
    lo, hi, n, tokens, no_key = (int(x or 0) for x in row)
    slots = parallelism(df.sparkSession)
    bits = keyless_bits(no_key, cfg.rows_per_bucket, min(slots, max(1, no_key)))
    by_bytes = math.ceil(tokens * TOKEN_BYTES / cfg.bucket_bytes)
    count = bucket_count(n, cfg.max_buckets, cfg.rows_per_bucket, max(by_bytes, slots))
    per_bucket = max(1, math.ceil(n / count))
    return order_bucket(df, k, None, per_bucket, (lo, hi, n)), count + (1 << bits), bits


def running_offset(df: DataFrame, order_col: str = "doc_id", n_col: str = "n_tokens",
                   cfg: PackConfig = PackConfig(), out: str = "start", bucket=None) -> DataFrame:
    """K4: ``start`` = tokens of all documents before this one in ``order_col`` order.

    ``order_col`` is an integral key; buckets are equal-width ranges of it when the
    keys are dense and quantile ranges otherwise (``order_bucket``). Documents with a
    NULL key come first. Pass ``bucket`` for another order key.
    """
    count, bits = 0, KEYLESS_BITS
    if bucket is None:
        bucket, count, bits = _order_buckets(df, order_col, n_col, cfg)
    return ordered_offsets(df, n_col, [order_col], bucket, out=out, broadcast_buckets=count <= BROADCAST_BUCKETS, keyless_bits=bits)


def budget_chunks(target_tokens: int | None, block: int) -> int | None:
    """K6: number of blocks the token budget asks for, ``ceil(target / block)``."""
    if target_tokens is None:
        return None
    return math.ceil(target_tokens / block)


def pack(tokens: DataFrame, cfg: PackConfig = PackConfig(), order_col: str = "doc_id",
         ids_col: str = "ids", n_col: str = "n_tokens", with_budget: bool = True,
         bucket=None) -> DataFrame:
    """K5 (+K6): ``chunk_id BIGINT, input_ids ARRAY<INT>``; every chunk exactly ``block`` long.

    ``tokens`` should be materialised (a written table or a checkpoint): it is
    read twice, once for bucket totals and once for the rows. The token arrays are
    shuffled once, by order bucket; a chunk inside a bucket is put together where
    its fragments already are, and only the fragments of the two chunks at a
    bucket's ends move again.
    """
    B = cfg.block
    docs = tokens.select(order_col, ids_col, n_col).where(F.col(n_col) > 0)
    count, bits = 0, KEYLESS_BITS
    if bucket is None:
        bucket, count, bits = _order_buckets(docs, order_col, n_col, cfg)
    starts = bucketed_offsets(docs, n_col, [order_col], bucket, broadcast_buckets=count <= BROADCAST_BUCKETS, keyless_bits=bits)
    limit = budget_chunks(cfg.target_tokens, B) if with_budget else None
    if limit is not None:
        # Documents that start past the budget produce no fragment at all.
        starts = starts.where(F.col("start") < F.lit(limit * B))

    s, n = F.col("start"), F.col(n_col)
    first = F.call_function("div", s, F.lit(B))
    last = F.call_function("div", s + n - 1, F.lit(B))
    frags = starts.select(s, n, ids_col, BUCKET, BUCKET_START, BUCKET_END, F.explode(F.sequence(first, last)).alias("chunk_id"))
    if limit is not None:
        frags = frags.where(F.col("chunk_id") < limit)
    c = F.col("chunk_id")
    lo = F.greatest(c * B - s, F.lit(0))
    hi = F.least((c + 1) * B - s, n)
    part = F.struct(
        F.greatest(s - c * B, F.lit(0)).cast("int").alias("pos"),
        F.slice(F.col(ids_col), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("frag"),
    )
    inside = (c * B >= F.col(BUCKET_START)) & ((c + 1) * B <= F.col(BUCKET_END))
    placed = frags.select(c, F.col(BUCKET), inside.alias("__inside"), part.alias("part"))
    # rows are already dealt out by bucket, so this aggregate needs no exchange
    whole = placed.where("__inside").groupBy(BUCKET, "chunk_id").agg(F.collect_list("part").alias("parts"))
    ends = placed.where(~F.col("__inside")).groupBy("chunk_id").agg(F.collect_list("part").alias("parts"))
    grouped = whole.select("chunk_id", "parts").unionByName(ends)
    ordered = F.transform(F.array_sort("parts"), lambda p: p["frag"])
    return (
        grouped.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.flatten(ordered).alias("input_ids"))
        .where(F.size("input_ids") == B)
    )


def chunk_ids(tokens: DataFrame, cfg: PackConfig = PackConfig(), n_col: str = "n_tokens") -> DataFrame:
    """The ``chunk_id`` column that ``pack`` gives, from the total of tokens: no chunk is built."""
    total = tokens.agg(F.coalesce(F.sum(F.col(n_col).cast("long")), F.lit(0))).first()[0]
    n, limit = total // cfg.block, budget_chunks(cfg.target_tokens, cfg.block)
    return tokens.sparkSession.range(n if limit is None else min(n, limit)).select(F.col("id").alias("chunk_id"))


def pack_progress(chunks: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """K7: one row every ``progress_every`` chunks: chunks, tokens, percent of the target."""
    every = cfg.progress_every
    done = F.col("chunk_id") + 1
    tokens = done * F.lit(cfg.block)
    cols = [done.alias("chunks"), tokens.cast("long").alias("tokens")]
    if cfg.target_tokens:
        cols.append((F.lit(100.0) * tokens / F.lit(float(cfg.target_tokens))).alias("pct_of_target"))
    return chunks.where(F.pmod(done, F.lit(every)) == 0).select(*cols)
