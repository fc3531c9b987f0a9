"""Instruction build (reference stage ``sft``): turns -> instructions -> split -> samples -> batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SftConfig, TrainConfig
from tessera.operators.manifest import manifest
from tessera.operators.sft import (
    batch_positions,
    collate,
    instruction_keys,
    sft_samples,
    sft_split,
    sft_summary,
    turns_to_instructions,
)
from tessera.plans.corpus import spread
from tessera.session import materialize


@dataclass
class SftTables:
    samples_all: DataFrame  # every instruction row with its reason (materialised)
    samples: DataFrame  # kept samples with their position in the split
    summary: DataFrame


def split_samples(instructions: DataFrame, cfg: SftConfig = SftConfig(), tokenizer=None) -> DataFrame:
    """Every instruction row with its sample columns, reason and split.

    Samples are built (tokenised) once on all rows, spread over the cores, and
    materialised; the split is then taken over all rows, rejected ones included.
    That is the reference's order, split before filtering, so skipped samples
    shrink each side separately, without tokenising after a shuffle that AQE
    may have coalesced into one partition.
    """
    rows = spread(instructions, "conv_id", "turn", force=True)
    samples_all = materialize(sft_samples(rows, tokenizer, cfg, keep_all=True))
    return sft_split(samples_all, cfg)


def sft_tables(turns_or_instructions: DataFrame, cfg: SftConfig = SftConfig(), tokenizer=None) -> SftTables:
    df = turns_or_instructions
    if "instruction" not in df.columns:
        df = turns_to_instructions(df)
    elif "conv_id" not in df.columns:
        df = instruction_keys(df)
    samples_all = split_samples(df, cfg, tokenizer)
    kept = samples_all.where(F.col("reason") == "keep")
    positioned = batch_positions(kept, cfg.seed)
    return SftTables(samples_all, positioned, sft_summary(samples_all))


def val_batches(t: SftTables, cfg: SftConfig = SftConfig()) -> DataFrame:
    """Validation batches in a fixed order (the reference does not shuffle them), padded."""
    return collate(t.samples.where(F.col("split") == "val"), cfg.batch_size)


def train_manifest(t: SftTables, cfg: SftConfig = SftConfig()) -> DataFrame:
    """Keys of the training micro-batches per epoch, reshuffled each epoch; unfinished groups dropped per epoch."""
    train = t.samples.where(F.col("split") == "train").select("conv_id", "turn")
    tc = TrainConfig(
        batch_size=cfg.batch_size, grad_accum=cfg.grad_accum, seed=cfg.seed, drop_last=False,
        carry_groups_across_epochs=False, max_steps=1 << 40, context=cfg.max_len,
    )
    n = train.count()
    return manifest(train, tc, key_cols=("conv_id", "turn"), n=n, epochs=cfg.epochs)


def build_sft(spark, turns_path: str, out_root: str, cfg: SftConfig = SftConfig(), tokenizer=None,
              if_exists: str = "skip") -> DataFrame | None:
    """Write the instruction build: samples per split, padded validation batches and
    the training manifest, under ``out_root``. Skipped when already built; returns
    the per-split summary.
    """
    import os

    from tessera.sources.io import is_built, read_instructions

    done = os.path.join(out_root, "samples")
    tables = [done, os.path.join(out_root, "val_batches"), os.path.join(out_root, "train_manifest")]
    if if_exists == "skip" and all(is_built(spark, t) for t in tables):  # a run that failed in between starts anew
        return None
    t = sft_tables(read_instructions(spark, turns_path), cfg, tokenizer)
    mode = "errorifexists" if if_exists == "error" else "overwrite"
    t.samples.write.mode(mode).partitionBy("split").parquet(done)
    val_batches(t, cfg).write.mode(mode).parquet(os.path.join(out_root, "val_batches"))
    train_manifest(t, cfg).write.mode(mode).partitionBy("epoch").parquet(os.path.join(out_root, "train_manifest"))
    return t.summary
