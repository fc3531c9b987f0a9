"""Training manifest: which chunk goes to which epoch, micro-batch and step.

The reference's loader order is re-aimed as a table any trainer can read in
order: deterministic per (seed, epoch), so a resumed run sees the same order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import TrainConfig
from tessera.operators.prefix import BROADCAST_BUCKETS, global_rank, hash_bucket
from tessera.operators.splits import ORDER_KEY, seeded_key
from tessera.session import parallelism

def epoch_order(df: DataFrame, key_cols: list[str], seed: int, epochs: int, n: int | None = None,
                rows_per_bucket: int = 1_000_000) -> DataFrame:
    """B1: ``epoch``, ``pos`` (0-based position in that epoch's shuffle) and ``n_per_epoch``.

    Rows are replicated per epoch with ``explode(sequence(...))``, then ranked per
    epoch by ``md5(seed:epoch:key)`` with the two-level rank. Its buckets are leading digits of the
    key, as many as ``n`` (rows of an epoch, counted if not given) asks for; their table is broadcast
    only while ``epochs`` times their number is at most ``BROADCAST_BUCKETS``, beyond it the planner
    chooses the join.
    """
    rep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs, 1) - 1))))
    if epochs <= 0:
        rep = rep.where(F.lit(False))
    keyed = rep.withColumn(ORDER_KEY, seeded_key(seed, "epoch", *key_cols))
    rows = df.count() if n is None else n
    bucket, total = hash_bucket(keyed, ORDER_KEY, rows, rows_per_bucket, parallelism(df.sparkSession), ["epoch"])
    return global_rank(
        keyed, [ORDER_KEY, *key_cols], bucket, ["epoch"], out="pos",
        total_col="n_per_epoch", broadcast_buckets=max(epochs, 1) * total <= BROADCAST_BUCKETS,
    ).drop(ORDER_KEY)


def batches_per_epoch(n: int, batch_size: int, drop_last: bool) -> int:
    return n // batch_size if drop_last else math.ceil(n / batch_size)


def assign_batches(ordered: DataFrame, batch_size: int, drop_last: bool) -> DataFrame:
    """B2: ``micro = floor(pos / batch_size)``; the last partial batch is dropped if asked.

    The cut uses the per-epoch count carried by B1, not a second pass over the data.
    """
    micro = F.floor(F.col("pos") / batch_size).cast("long")
    out = ordered.withColumn("micro", micro)
    if drop_last:
        full = F.floor(F.col("n_per_epoch") / batch_size) * batch_size
        out = out.where(F.col("pos") < full)
    return out


def epochs_needed(n: int, cfg: TrainConfig) -> int:
    """Epochs the loop cycles through to reach ``max_steps``."""
    nb = batches_per_epoch(n, cfg.batch_size, cfg.drop_last)
    if nb == 0 or cfg.max_steps <= 0:
        return 0
    if cfg.carry_groups_across_epochs:
        return math.ceil(cfg.max_steps * cfg.grad_accum / nb)
    groups = nb // cfg.grad_accum
    return 0 if groups == 0 else math.ceil(cfg.max_steps / groups)


def assign_steps(batched: DataFrame, n: int, cfg: TrainConfig) -> DataFrame:
    """Optimizer ``step`` (1-based) per micro-batch, and ``tokens_seen`` after it.

    ``carry_groups_across_epochs`` (pre-training): accumulation groups run across
    epoch ends. Otherwise (fine-tuning) each epoch's unfinished group is dropped.
    """
    nb = batches_per_epoch(n, cfg.batch_size, cfg.drop_last)
    a = cfg.grad_accum
    if cfg.carry_groups_across_epochs:
        g = F.col("epoch") * nb + F.col("micro")
        out = batched.withColumn("global_micro", g).withColumn("step", F.floor(g / a).cast("long") + 1)
    else:
        groups = nb // a
        out = batched.where(F.col("micro") < groups * a)
        out = out.withColumn("global_micro", F.col("epoch") * (groups * a) + F.col("micro")).withColumn(
            "step", (F.col("epoch") * groups + F.floor(F.col("micro") / a)).cast("long") + 1
        )
    return out.where(F.col("step") <= cfg.max_steps).withColumn(
        "tokens_seen", F.col("step") * F.lit(cfg.effective_batch * cfg.context)
    )


def manifest(chunks: DataFrame, cfg: TrainConfig = TrainConfig(), key_cols=("chunk_id",),
             n: int | None = None, epochs: int | None = None) -> DataFrame:
    """B1-B5 together: one row per (chunk, epoch) that the run consumes before ``max_steps``.

    ``n`` (rows per epoch) is counted once if not given; it decides how many
    epochs to lay out, unless ``epochs`` is fixed (fine-tuning runs a set number).
    """
    if n is None:
        n = chunks.count()
    if epochs is None:
        epochs = epochs_needed(n, cfg)
    ordered = epoch_order(chunks, list(key_cols), cfg.seed, epochs, n)
    return assign_steps(assign_batches(ordered, cfg.batch_size, cfg.drop_last), n, cfg)


def resume_point(n: int, start_step: int, cfg: TrainConfig = TrainConfig()) -> tuple[int, int]:
    """(epoch to resume in, micro-batches to skip in it), the reference's arithmetic."""
    nb = batches_per_epoch(n, cfg.batch_size, cfg.drop_last)
    consumed = start_step * cfg.grad_accum
    epoch = consumed // nb if nb > 0 else 0
    return epoch, consumed % max(nb, 1)


def resume_from(man: DataFrame, start_step: int, n: int, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """The part of the manifest still to run after ``start_step``, with the resume point."""
    epoch, skip = resume_point(n, start_step, cfg)
    return (
        man.where(F.col("step") > start_step)
        .withColumn("resume_epoch", F.lit(epoch).cast("long"))
        .withColumn("resume_skip", F.lit(skip).cast("long"))
    )
