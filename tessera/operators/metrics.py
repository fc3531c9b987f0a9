"""Training-run metrics from micro-step rows (M1-M3).

A run's micro-steps are numbered in (time, id) order with the two-level rank,
partitioned by run and bucketed by time, so a run holding a third of all rows is
still spread over many tasks. Accumulation groups then hold ``accum`` rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import TrainConfig
from tessera.operators.prefix import BROADCAST_BUCKETS, bucket_count, global_rank, quantile_bounds, quantile_bucket
from tessera.session import parallelism


def epoch_micros(df: DataFrame, ts_col: str) -> Column:
    """Microseconds since the epoch for TIMESTAMP and TIMESTAMP_NTZ alike (no time-zone shift for NTZ)."""
    c = F.col(ts_col)
    if isinstance(df.schema[ts_col].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c)
    return F.unix_micros(c)


def micro_index(df: DataFrame, run_col: str, ts_col: str, id_col: str, max_buckets: int | None = None,
                rows_per_bucket: int = 1_000_000, out: str = "micro_idx") -> DataFrame:
    """0-based micro-step number within each run, in ``(ts, id)`` order.

    A table of no more than one bucket's rows needs no buckets: its windows by run are as small. Beyond
    that buckets are quantiles of the time over all runs, so they are densest where
    most events are: a run holding a large share of the rows dominates the
    quantiles and is cut into many (run, bucket) window partitions. The table of bucket totals is
    broadcast while the counted rows, or twice the estimated runs times buckets, bound it.
    """
    n = df.count()
    count = bucket_count(n, max_buckets, rows_per_bucket)
    if count == 1:
        place = Window.partitionBy(run_col).orderBy(ts_col, id_col)
        return df.withColumn(out, F.row_number().over(place).cast("long") - 1)
    t = epoch_micros(df, ts_col)
    count = bucket_count(n, max_buckets, rows_per_bucket, parallelism(df.sparkSession))
    bucket = quantile_bucket(t, quantile_bounds(df, t, count))
    runs = df.agg(F.approx_count_distinct(run_col)).first()[0]
    return global_rank(df, [ts_col, id_col], bucket, [run_col], out=out,
                       broadcast_buckets=min(n, 2 * (runs + 1) * count) <= BROADCAST_BUCKETS)


def step_loss(micro: DataFrame, cfg: TrainConfig = TrainConfig(), run_col: str = "run_id",
              micro_col: str = "micro_idx", loss_col: str = "loss", grad_col: str | None = "grad_norm") -> DataFrame:
    """M1 (+B5): ``train_loss = sum(micro losses) / accum`` per complete accumulation group.

    ``step`` is 1-based. An unfinished last group gives no row. ``grad_norm`` is the
    value on the group's last micro-step (where the optimizer step happens).
    """
    a = cfg.grad_accum
    step = (F.floor(F.col(micro_col) / a) + 1).cast("long")
    aggs = [
        (F.sum(loss_col).cast("double") / F.lit(float(a))).alias("train_loss"),
        F.count(F.lit(1)).alias("__n"),
    ]
    if grad_col:
        aggs.append(F.max_by(F.col(grad_col), F.col(micro_col)).cast("double").alias("grad_norm"))
    out = micro.withColumn("step", step).groupBy(run_col, "step").agg(*aggs).where(F.col("__n") == a).drop("__n")
    return out.withColumn("tokens_seen", F.col("step") * F.lit(cfg.effective_batch * cfg.context))


def learning_rate(step: Column, cfg: TrainConfig = TrainConfig()) -> Column:
    """The rate a run logs at a step: a straight line from 0 up to ``lr_init`` over the warm-up
    steps, then half a cosine wave down to ``lr_min``, reached at ``max_steps``."""
    decay_steps = max(1, cfg.max_steps - cfg.warmup_steps)
    angle = F.pi() * (step - cfg.warmup_steps) / F.lit(float(decay_steps))
    middle, swing = (cfg.lr_init + cfg.lr_min) / 2, (cfg.lr_init - cfg.lr_min) / 2
    rising = F.lit(cfg.lr_init) * step / F.lit(float(max(1, cfg.warmup_steps)))
    return F.when(step < cfg.warmup_steps, rising).otherwise(F.lit(middle) + F.lit(swing) * F.cos(angle))


def sample_steps(steps: DataFrame, every: int) -> DataFrame:
    """M2: the console view, one row every ``every`` steps."""
    return steps.where(F.pmod(F.col("step"), F.lit(every)) == 0)


def is_spike(threshold: float, grad_col: str = "grad_norm") -> Column:
    return F.col(grad_col) > F.lit(threshold)


def drop_spikes(steps: DataFrame, threshold: float = TrainConfig().grad_skip_threshold,
                grad_col: str = "grad_norm") -> DataFrame:
    """M3: steps whose gradient norm exceeds the threshold write no metric row."""
    return steps.where(~is_spike(threshold, grad_col))


def spike_report(steps: DataFrame, threshold: float = TrainConfig().grad_skip_threshold,
                 run_col: str = "run_id", grad_col: str = "grad_norm") -> DataFrame:
    """M3: per run, steps taken, logged and skipped, the first skipped step (0: none), and
    the gaps left in the logged steps.

    A gap is a logged step whose successor is missing although the run went on. Every
    step is emitted twice, as itself and as the successor of the step before it, so one
    aggregate by (run, step) tells which have a logged successor, and one by run counts;
    a run of any length is spread over many tasks, and the input is read once.
    """
    spike = is_spike(threshold, grad_col)
    fields = [~spike, spike, F.col(grad_col)]
    own = F.struct(F.col("step").alias("step"), F.lit(True).alias("own"), *[c.alias(n) for c, n in zip(fields, ("logged", "skipped", "grad"))])
    before = F.struct((F.col("step") - 1).alias("step"), F.lit(False).alias("own"), (~spike).alias("logged"),
                      F.lit(None).cast("boolean").alias("skipped"), F.lit(None).cast("double").alias("grad"))
    seen = steps.select(run_col, F.explode(F.array(own, before)).alias("s")).select(run_col, "s.*")
    mine = F.col("own")
    per_step = seen.groupBy(run_col, "step").agg(
        F.count_if(mine).alias("n"), F.count_if(mine & F.col("logged")).alias("logged"),
        F.count_if(mine & F.col("skipped")).alias("skipped"), F.max(F.when(mine, F.col("grad"))).alias("grad"),
        F.count_if(~mine & F.col("logged")).alias("successors"),
    ).where("n > 0")
    logged = F.col("logged") > 0
    per_run = per_step.groupBy(run_col).agg(
        F.sum("n").alias("n_steps"),
        F.sum("logged").alias("n_logged"),
        F.sum("skipped").alias("n_skipped"),
        # steps are 1-based, so 0 means "no step skipped" and the column is never null
        F.coalesce(F.min(F.when(F.col("skipped") > 0, F.col("step"))), F.lit(0)).cast("long").alias("first_skipped_step"),
        F.max("grad").alias("max_grad_norm"),
        F.max("step").alias("last_step"),
        F.count_if(logged & (F.col("successors") == 0)).alias("open"),
        F.max_by(logged, "step").alias("__ended"),
    )
    # a logged last step has no successor and is no gap
    return per_run.withColumn("n_gaps", F.col("open") - F.col("__ended").cast("long")).drop("open", "__ended")
