"""Evaluation metrics from tables.

The reference computes these inside its trainer from model outputs. Here they
are aggregates over tables of batch losses, per-token losses and completions, so
any number of runs and checkpoints can be reported at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import IGNORE_INDEX, VOCAB_SIZE, EvalConfig
from tessera.functions.syntax import is_valid_python
from tessera.functions.text import py_strip


BROADCAST_PROMPTS = 10_000


def val_loss(batch_losses: DataFrame, by: tuple[str, ...] = (), batch_col: str = "batch_idx",
             loss_col: str = "loss", max_batches: int | None = 200) -> DataFrame:
    """E1 + E2: unweighted mean of batch losses over the first ``max_batches`` batches.

    ``batch_idx`` is the 0-based batch position in evaluation order; None takes all.
    ``n_available`` tells how many batches there were. With no grouping, an empty input
    gives one row with loss 0.0 and perplexity 1.0.
    """
    seen = F.lit(True) if max_batches is None else F.col(batch_col) < max_batches
    loss = F.when(seen, F.col(loss_col))
    agg = batch_losses.groupBy(*by).agg(
        F.coalesce(F.sum(loss).cast("double") / F.count(loss), F.lit(0.0)).alias("val_loss"),
        F.count_if(seen).alias("n_batches"),
        F.count(F.lit(1)).alias("n_available"),
    )
    return agg.withColumn("val_perplexity", perplexity(F.col("val_loss")))


def perplexity(loss: Column) -> Column:
    """E2."""
    return F.exp(loss)


def supervised_token_rows(samples: DataFrame, id_cols: tuple[str, ...], labels_col: str = "labels") -> DataFrame:
    """Token rows ``(*id_cols, pos, label)`` for the positions a next-token loss is taken at.

    Position 0 is never predicted (the one-token shift), and ``-100`` is ignored.
    """
    rows = samples.select(*id_cols, F.posexplode(labels_col).alias("pos", "label"))
    return rows.where((F.col("pos") > 0) & (F.col("label") != IGNORE_INDEX))


def masked_nll(token_rows: DataFrame, by: tuple[str, ...] = (), nll_col: str = "nll") -> DataFrame:
    """Mean NLL over supervised positions (``pos > 0``, label not ``-100``), token-weighted."""
    valid = token_rows.where((F.col("pos") > 0) & (F.col("label") != IGNORE_INDEX))
    return valid.groupBy(*by).agg(
        F.coalesce(F.avg(nll_col), F.lit(0.0)).alias("mean_nll"),
        F.count(F.lit(1)).alias("n_tokens"),
    ).withColumn("perplexity", perplexity(F.col("mean_nll")))


def batch_losses(token_rows: DataFrame, batch_cols: tuple[str, ...], nll_col: str = "nll") -> DataFrame:
    """Per-batch loss as a framework computes it: the mean over the batch's supervised tokens."""
    valid = token_rows.where((F.col("pos") > 0) & (F.col("label") != IGNORE_INDEX))
    return valid.groupBy(*batch_cols).agg(F.avg(nll_col).alias("loss"), F.count(F.lit(1)).alias("n_tokens"))


def unigram_nll(train_ids: DataFrame, ids_col: str = "input_ids", vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Stand-in scorer for checks when no model output table exists: ``(label, nll)``.

    A unigram model with add-one smoothing fit on the training ids,
    ``nll = -ln((count + 1) / (N + V))``, for every id in ``[0, V)``. The table has
    exactly ``V`` rows, which is what makes broadcasting it to token rows safe.
    """
    counts = train_ids.select(F.explode(ids_col).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    vocab = train_ids.sparkSession.range(vocab_size).select(F.col("id").cast("int").alias("label"))
    full = vocab.join(counts, "label", "left").select("label", F.coalesce("c", F.lit(0)).alias("c"))
    total = F.sum("c").over(Window.partitionBy()) + F.lit(vocab_size)
    return full.select("label", (-F.log((F.col("c") + 1).cast("double") / total.cast("double"))).alias("nll"))


def score_tokens(token_rows: DataFrame, scores: DataFrame, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Attach ``nll`` to token rows from a ``(label, nll)`` table.

    One row for each id of the vocabulary is all that can match, so what is broadcast has
    at most ``vocab_size`` rows, whatever the caller passes.
    """
    known = scores.where((F.col("label") >= 0) & (F.col("label") < vocab_size))
    return token_rows.join(F.broadcast(known.groupBy("label").agg(F.max("nll").alias("nll"))), "label")


def syntax_pass_rate(df: DataFrame, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """E4 + E5: share of texts that compile as Python; 0.0 when a group has no rows."""
    valid = is_valid_python(F.col(text_col))
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(valid.cast("int")), F.lit(0.0)).alias("syntax_pass_rate"),
        F.count(F.lit(1)).alias("n_texts"),
    )


def trim_completion(df: DataFrame, prompt_col: str = "prompt", text_col: str = "text",
                    marker: str = "### Instruction:", out_col: str | None = None) -> DataFrame:
    """Cut a completion at the next instruction header after the prompt, and strip it.

    Only applied when the header occurs after the first ``len(prompt)`` characters;
    the prompt part is kept as it is.
    """
    p = F.length(F.col(prompt_col))
    t = F.col(text_col)
    head = F.substring(t, F.lit(1), p)
    rest = F.substring(t, p + 1, F.greatest(F.length(t) - p, F.lit(0)))
    cut = F.concat(head, py_strip(F.substring_index(rest, marker, 1)))
    trimmed = F.when(F.instr(rest, marker) > 0, cut).otherwise(t)
    return df.withColumn(out_col or text_col, trimmed)


def prompt_table(spark: SparkSession, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """The evaluation prompts with labels; code prompts first, only those are scored."""
    rows = [("code", i + 1, f"Code Prompt {i + 1}", p) for i, p in enumerate(cfg.code_prompts)]
    rows += [("instruction", i + 1, f"Instruction Prompt {i + 1}", p) for i, p in enumerate(cfg.instruction_prompts)]
    schema = T.StructType([
        T.StructField("kind", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("prompt", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def scored_completions(completions: DataFrame, prompts: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """E6 + E7: trimmed completions of the code prompts, matched to the registry by label."""
    code = prompts.where(F.col("kind") == "code").select("label", "ordinal")
    if code.count() <= BROADCAST_PROMPTS:
        code = F.broadcast(code)
    return trim_completion(completions, marker=cfg.cut_marker).join(code, "label")


def eval_report(losses: DataFrame, pass_rates: DataFrame, keys: tuple[str, ...] = ("run_id", "step")) -> DataFrame:
    """One row per (run, step): validation loss, perplexity and syntax pass rate."""
    l = losses.select(*keys, "val_loss", "val_perplexity")
    r = pass_rates.select(*keys, "syntax_pass_rate")
    return l.join(r, list(keys), "full_outer")
