"""Corpus quality filter (F1-F10) and its reject funnel.

Every rule but the syntax check is a native predicate. The syntax UDF only ever
sees text that passed the cheaper rules: in ``quality_filter`` Catalyst places the
native filter below the Python evaluation, and in ``reject_reason`` the UDF is fed
``NULL`` for rows already rejected, so Arrow ships no text for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import QualityConfig
from tessera.functions.syntax import is_valid_python
from tessera.functions.text import alnum_ratio, avg_line, header, n_chars, n_lines

# Reason names, in the order the reference tests its rules.
REASONS = ("chars", "lines", "avg_line", "alnum", "autogen", "structure", "nul", "syntax")
KEEP = "keep"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def quality_signals(df: DataFrame, text_col: str = "text", cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """C1-C5 as columns, for inspection and for the funnel."""
    t = F.col(text_col)
    return df.select(
        "*",
        n_chars(t).alias("n_chars_cp"),
        n_lines(t).alias("n_lines"),
        avg_line(t).alias("avg_line"),
        alnum_ratio(t).alias("alnum_ratio"),
        _has_marker(t, cfg).alias("has_autogen_marker"),
        _has_structure(t, cfg).alias("has_structure"),
        F.contains(t, F.lit("\x00")).alias("has_nul"),
    )


def _has_marker(t: Column, cfg: QualityConfig) -> Column:
    h = header(t, cfg.header_chars)
    return reduce(lambda a, b: a | b, [F.contains(h, F.lit(m)) for m in cfg.autogen_markers])


def _has_structure(t: Column, cfg: QualityConfig) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in cfg.structure_markers])


def _line_rules(t: Column, n: Column, cfg: QualityConfig) -> Column:
    """'lines', 'avg_line' or NULL, with the line count computed once.

    Filter conditions get no common-subexpression elimination in codegen, so two
    rules over ``n_lines`` would run the line regex twice; binding it once in a
    one-element ``aggregate`` halves the cost of these two rules.
    """
    def rule(_acc, lines):
        avg = n / F.greatest(lines, F.lit(1))
        return F.when(lines < cfg.min_lines, F.lit("lines")).when(
            ~avg.between(cfg.min_avg_line, cfg.max_avg_line), F.lit("avg_line")
        )

    return F.aggregate(F.array(n_lines(t)), F.lit(None).cast("string"), rule)


def _later_rules(t: Column, n: Column, cfg: QualityConfig) -> list[tuple[str, Column]]:
    """(reason, failed) pairs after the line rules, in reference order."""
    rules = [
        ("alnum", alnum_ratio(t) < cfg.min_alnum_ratio),
        ("autogen", _has_marker(t, cfg)),
    ]
    if cfg.check_structure:
        rules.append(("structure", ~_has_structure(t, cfg)))
    rules.append(("nul", F.contains(t, F.lit("\x00"))))
    return rules


def _chars_fail(t: Column, n: Column, cfg: QualityConfig) -> Column:
    return t.isNull() | (n < cfg.min_chars) | (n > cfg.max_chars)


def native_reason(text, cfg: QualityConfig = QualityConfig()) -> Column:
    """First failing native rule, or NULL if all native rules pass (F10 without F8)."""
    t = _c(text)
    n = n_chars(t)
    later = _later_rules(t, n, cfg)
    rest = F.when(later[0][1], F.lit(later[0][0]))
    for name, failed in later[1:]:
        rest = rest.when(failed, F.lit(name))
    return F.when(_chars_fail(t, n, cfg), F.lit("chars")).otherwise(F.coalesce(_line_rules(t, n, cfg), rest))


def passes_native(text, cfg: QualityConfig = QualityConfig()) -> Column:
    t = _c(text)
    n = n_chars(t)
    ok = ~_chars_fail(t, n, cfg) & _line_rules(t, n, cfg).isNull()
    for _, failed in _later_rules(t, n, cfg):
        ok = ok & ~failed
    return ok


def reject_reason(df: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text",
                  out_col: str = "reason") -> DataFrame:
    """adds ``reason`` = the first failing rule, or ``'keep'``."""
    native = native_reason(F.col(text_col), cfg)
    if not cfg.check_syntax:
        return df.withColumn(out_col, F.coalesce(native, F.lit(KEEP)))
    tmp = "__native_reason"
    staged = df.withColumn(tmp, native)
    valid = is_valid_python(F.when(F.col(tmp).isNull(), F.col(text_col)))
    return staged.withColumn(
        out_col, F.coalesce(F.col(tmp), F.when(~valid, F.lit("syntax")), F.lit(KEEP))
    ).drop(tmp)


def quality_filter(df: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text") -> DataFrame:
    """keep the rows that pass every rule of the profile."""
    t = F.col(text_col)
    kept = df.where(passes_native(t, cfg))
    if cfg.check_syntax:
        kept = kept.where(is_valid_python(t))
    return kept


def reject_funnel(df: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text",
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Count of documents per reason (and per ``by`` columns). Works on streams too."""
    return (
        reject_reason(df, cfg, text_col)
        .groupBy(*by, "reason")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def reject_funnel_totals(df: DataFrame, cfg: QualityConfig = QualityConfig(), by: tuple[str, ...] = (),
                         text_col: str = "text") -> DataFrame:
    """F10 with sub-totals: ``reason``, then each prefix of ``by``, down to the total of all rows.

    One pass: ``rollup`` over the reasons, combined before the shuffle. ``grouping_id`` has a bit for each column
    (the last one lowest) that a row sums over, so a sum is told from a NULL value.
    """
    return (
        reject_reason(df, cfg, text_col).select("reason", *by).rollup("reason", *by)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.grouping_id().cast("int").alias("grouping_id"))
    )
