"""Pre-training manifest and evaluation jobs over a built corpus (reference stages ``train`` / eval)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EvalConfig, TrainConfig
from tessera.operators import evaluation as E
from tessera.operators.manifest import manifest, resume_from
from tessera.sources.io import read_split, require_built, write_eval_report


def build_manifest(spark: SparkSession, data_root: str, out: str, cfg: TrainConfig = TrainConfig(),
                   start_step: int = 0) -> DataFrame:
    """The micro-batch order of a run (B1-B6), written partitioned by epoch.

    Fails early when the corpus has not been built. With ``start_step`` only the
    part after that step is written, with the resume point as columns.
    """
    require_built(spark, data_root, "training data")
    train = read_split(spark, data_root, "train", ("chunk_id",))
    n = train.count()
    man = manifest(train, cfg, n=n)
    if start_step:
        man = resume_from(man, start_step, n, cfg)
    man.write.mode("overwrite").partitionBy("epoch").parquet(out)
    return spark.read.parquet(out)


def validation_batches(spark: SparkSession, data_root: str, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """Validation chunks in stored order (the split's shuffled order, not reshuffled), in
    batches of ``cfg.batch_size``; the last, partial batch is kept."""
    val = read_split(spark, data_root, "val", ("chunk_id", "pos", "input_ids"))
    return val.withColumn("batch_idx", F.floor(F.col("pos") / cfg.batch_size).cast("long"))


def evaluate(losses: DataFrame, completions: DataFrame, prompts: DataFrame, run_id: str, step: int,
             cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """E1-E8 for one checkpoint: ``losses`` has (batch_idx, loss) per validation batch,
    ``completions`` (label, prompt, text) per generated sample."""
    v = E.val_loss(losses, max_batches=cfg.max_batches)
    rate = E.syntax_pass_rate(E.scored_completions(completions, prompts, cfg))
    tag = [F.lit(run_id).alias("run_id"), F.lit(step).cast("long").alias("step")]
    return E.eval_report(v.select(*tag, "val_loss", "val_perplexity"), rate.select(*tag, "syntax_pass_rate"))


def write_evaluation(report: DataFrame, out_root: str) -> None:
    """Append the report, one folder per step."""
    write_eval_report(report, out_root)
    return None
