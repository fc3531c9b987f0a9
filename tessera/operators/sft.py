"""Instruction samples with response-only loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import (
    IGNORE_INDEX,
    INPUT_HEADER,
    INSTRUCTION_HEADER,
    PAD_ID,
    RESPONSE_MARKER,
    SftConfig,
)
from tessera.functions.text import is_blank, py_strip
from tessera.functions.tokens import HashTokenizer, with_eos
from tessera.operators.prefix import global_rank, hash_bucket, order_bucket
from tessera.operators.splits import ORDER_KEY, seeded_key, split_exact
from tessera.session import parallelism


def ranked_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text_hash, rank``: each turn's place in its conversation, without its text.

    Turn numbers may have gaps, and may repeat: then role and text decide, so the order is the same in every run. The
    two-level rank spreads one very long conversation over many tasks.
    """
    t = turns.select("conv_id", "turn", "role", F.xxhash64("text").alias("text_hash"))
    t = t.withColumn("__role", F.coalesce("role", F.lit("")))
    bucket = order_bucket(t, F.col("turn"), least=parallelism(turns.sparkSession))
    return global_rank(t, ["turn", "__role", "text_hash"], bucket, ["conv_id"], out="rank").drop("__role")


def neighbour(turns: DataFrame, ranked: DataFrame, role: str, places: int, out: str) -> DataFrame:
    """``conv_id, turn, role, text_hash, rank, out``: the text of the turn ``places`` after each turn, if it is of ``role``.

    Only ranks are joined; the texts of that role move once, to the turns that need them.
    """
    there = ranked.where(F.col("role") == role).select(
        F.col("conv_id").alias("__c"), (F.col("rank") - places).alias("__at"), F.col("turn").alias("__turn"), F.col("text_hash").alias("__hash"))
    pairs = ranked.join(there, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("rank") == F.col("__at")))
    texts = turns.where(F.col("role") == role).select(
        F.col("conv_id").alias("__tc"), F.col("turn").alias("__tt"), F.xxhash64("text").alias("__th"), F.col("text").alias(out)).dropDuplicates()
    same = F.col("__c").eqNullSafe(F.col("__tc")) & F.col("__turn").eqNullSafe(F.col("__tt")) & (F.col("__hash") == F.col("__th"))
    return pairs.join(texts, same).select("conv_id", "turn", "role", "text_hash", "rank", out)


def turns_to_instructions(turns: DataFrame) -> DataFrame:
    """One instruction row per user turn answered by the next assistant turn.

    ``input`` is the system turn right before the user turn, if there is one. Turns are ranked
    within their conversation by the two-level scheme (``ranked_turns``), and neighbours are found by
    equi-joins on ``(conv_id, rank ± 1)``, so one very long conversation is spread over many tasks.
    """
    t = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("__hash"), F.coalesce("role", F.lit("")).alias("__role"))
    bucket = order_bucket(t, F.col("turn"), least=parallelism(turns.sparkSession))
    t = global_rank(t, ["turn", "__role", "__hash"], bucket, ["conv_id"], out="__rank")
    users = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"), "__rank")
    answers = t.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("__a"), (F.col("__rank") - 1).alias("__at"), F.col("text").alias("output")
    )
    systems = t.where(F.col("role") == "system").select(
        F.col("conv_id").alias("__s"), (F.col("__rank") + 1).alias("__st"), F.col("text").alias("input")
    )
    return (
        users.join(answers, F.col("conv_id").eqNullSafe(F.col("__a")) & (F.col("__rank") == F.col("__at")))
        .join(systems, F.col("conv_id").eqNullSafe(F.col("__s")) & (F.col("__rank") == F.col("__st")), "left")
        .select("conv_id", "turn", "instruction", "input", "output")
    )


def instruction_keys(rows: DataFrame) -> DataFrame:
    """``conv_id, turn`` for a plain instruction table: a hash of the row, and a number among equal rows.

    Equal rows are counted (combined before the shuffle) and numbered by writing each out as
    often as it occurs, so however often one row is repeated no task sorts its copies.
    """
    cols = ["instruction", "input", "output"]
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    keyed = counted.withColumn("conv_id", F.xxhash64(*cols))
    # different rows of one hash are rare; they follow one another
    before = F.sum("__n").over(Window.partitionBy("conv_id").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1))
    keyed = keyed.withColumn("__before", F.coalesce(before, F.lit(0)))
    numbered = keyed.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return numbered.select("conv_id", (F.col("__before") + F.col("__k")).alias("turn"), *cols)


def format_text(instruction, inp, output) -> Column:
    """The prompt template; the Input section only when ``input`` is not blank."""
    ins, i, out = (F.col(c) if isinstance(c, str) else c for c in (instruction, inp, output))
    input_part = F.when(is_blank(i), F.lit("")).otherwise(F.concat(F.lit(INPUT_HEADER), py_strip(i), F.lit("\n\n")))
    return F.concat(
        F.lit(INSTRUCTION_HEADER), py_strip(ins), F.lit("\n\n"), input_part, F.lit(RESPONSE_MARKER), py_strip(out)
    )


def format_sample(df: DataFrame) -> DataFrame:
    """T1 as a DataFrame step: adds ``text`` (NULL when ``instruction`` or ``output`` is NULL)."""
    return df.withColumn("text", format_text("instruction", "input", "output"))


def _prompt_prefix(text: Column) -> tuple[Column, Column]:
    """(1-based position of the first response marker or 0, text up to and including it)."""
    pos = F.instr(text, RESPONSE_MARKER)
    return pos, F.substring(text, F.lit(1), pos - 1 + len(RESPONSE_MARKER))


def _prefix_token_counts(df: DataFrame, tok) -> DataFrame:
    """Adds ``ids`` (text tokens) and ``__prefix_n`` (tokens of the separately tokenised prefix)."""
    pos, prefix = _prompt_prefix(F.col("text"))
    staged = df.withColumn("__marker", pos).withColumn("__prefix", prefix)
    if isinstance(tok, HashTokenizer):
        return staged.withColumn("ids", tok.ids("text")).withColumn("__prefix_n", tok.count("__prefix"))
    staged = tok.apply_many(staged, {"ids": "text", "__prefix_ids": "__prefix"})
    return staged.withColumn("__prefix_n", F.size("__prefix_ids")).drop("__prefix_ids")


def sft_samples(df: DataFrame, tokenizer=None, cfg: SftConfig = SftConfig(), keep_all: bool = False) -> DataFrame:
    """Tokenise + EOS, truncate, mask the prompt, drop too-short samples.

    Output: the input columns plus ``input_ids``, ``labels``, ``n_tokens``,
    ``prompt_len``, ``truncated``, ``reason`` ('keep', 'null_field', 'no_marker'
    or 'too_short'). With ``keep_all`` the rejected rows stay, for the summary.
    """
    tok = tokenizer or HashTokenizer()
    staged = _prefix_token_counts(format_sample(df), tok)
    full = with_eos("ids", tok.eos_id)
    ids = F.slice(full, 1, cfg.max_len)
    staged = (
        staged.withColumn("truncated", F.size(full) > cfg.max_len)
        .withColumn("input_ids", ids)
        .withColumn("n_tokens", F.size("input_ids"))
        .withColumn("prompt_len", F.least(F.col("__prefix_n"), F.col("n_tokens")))
    )
    p = F.col("prompt_len")
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE_INDEX), p),
        F.slice("input_ids", p + 1, F.col("n_tokens") - p),
    )
    reason = (
        F.when(F.col("text").isNull(), F.lit("null_field"))
        .when(F.col("__marker") == 0, F.lit("no_marker"))
        .when(F.col("n_tokens") < cfg.min_tokens, F.lit("too_short"))
        .otherwise(F.lit("keep"))
    )
    out = (
        staged.withColumn("labels", labels)
        .withColumn("reason", reason)
        .drop("ids", "__prefix_n", "__marker", "__prefix")
    )
    return out if keep_all else out.where(F.col("reason") == "keep")


def n_supervised(labels="labels") -> Column:
    """Tokens that carry loss after the one-token label shift."""
    lab = F.col(labels) if isinstance(labels, str) else labels
    shifted = F.slice(lab, 2, F.greatest(F.size(lab) - 1, F.lit(0)))
    return F.size(F.filter(shifted, lambda x: x != IGNORE_INDEX))


def sft_split(instructions: DataFrame, cfg: SftConfig = SftConfig(), key_cols=("conv_id", "turn")) -> DataFrame:
    """Seeded split of instruction rows before sample building; val = ``ceil(n * f)``."""
    return split_exact(instructions, list(key_cols), cfg.val_fraction, cfg.seed, rounding="ceil")


def sft_summary(samples_all: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """T6 report: loaded and skipped per split, with skip reasons and masking totals."""
    keep = F.col("reason") == "keep"
    return samples_all.groupBy(*by).agg(
        F.count_if(keep).alias("loaded"),
        F.count_if(~keep).alias("skipped"),
        F.count_if(F.col("reason") == "no_marker").alias("skipped_no_marker"),
        F.count_if(F.col("reason") == "too_short").alias("skipped_too_short"),
        F.count_if(F.col("reason") == "null_field").alias("skipped_null_field"),
        F.count_if(keep & F.col("truncated")).alias("truncated"),
        F.count_if(keep & (F.col("prompt_len") >= F.col("n_tokens"))).alias("fully_masked"),
        F.coalesce(F.sum(F.when(keep, F.col("n_tokens"))), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(F.when(keep, n_supervised("labels"))), F.lit(0)).cast("long").alias("supervised_tokens"),
    )


def batch_positions(samples: DataFrame, seed: int, key_cols=("conv_id", "turn"),
                    partition_cols: tuple[str, ...] = ("split",), rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Position of each kept sample within its split, in the split's seeded order.

    Skipped samples do not take a position, as they are not in the dataset the
    loader batches.
    """
    keys = [*key_cols, *[c for c in partition_cols if c not in key_cols]]
    keyed = samples.select(*keys).withColumn(ORDER_KEY, seeded_key(seed, *key_cols))
    bucket, _ = hash_bucket(keyed, ORDER_KEY, keyed.count(), rows_per_bucket, parallelism(samples.sparkSession), partition_cols)
    places = global_rank(
        keyed, [ORDER_KEY, *key_cols], bucket, partition_cols, out="pos",
        total_col="n_in_split",
    ).drop(ORDER_KEY)
    return samples.join(places, keys)


def collate(df: DataFrame, batch_size: int, pos_col: str = "pos",
            group_cols: tuple[str, ...] = ("split",)) -> DataFrame:
    """Pad each micro-batch to its longest sample: ids with 0, labels with -100, mask 1 then 0.

    A batch is ``floor(pos / batch_size)``; the window holds ``batch_size`` rows,
    so no task ever sees more than one batch per window partition.
    """
    with_batch = df.withColumn("batch_id", F.floor(F.col(pos_col) / batch_size).cast("long"))
    w = Window.partitionBy(*group_cols, "batch_id")
    size = F.size("input_ids")
    batch_max = F.max(size).over(w)
    pad = batch_max - size
    return with_batch.select(
        *group_cols,
        "batch_id",
        pos_col,
        *[c for c in df.columns if c not in (*group_cols, pos_col, "input_ids", "labels")],
        F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
        F.concat("labels", F.array_repeat(F.lit(IGNORE_INDEX), pad)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        batch_max.alias("batch_len"),
    )
