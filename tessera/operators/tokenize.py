"""Tokenise a corpus (K1, K2) and count its tokens (K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tokens import HashTokenizer, with_eos


def tokenize(df: DataFrame, tokenizer=None, text_col: str = "text", eos: bool = True,
             out_col: str = "ids", drop_text: bool = True) -> DataFrame:
    """Add ``ids`` (EOS appended once per document) and ``n_tokens``; no special tokens inside."""
    tok = tokenizer or HashTokenizer()
    out = tok.apply(df, text_col, out_col)
    if eos:
        out = out.withColumn(out_col, with_eos(out_col, tok.eos_id))
    out = out.withColumn("n_tokens", F.size(out_col))
    return out.drop(text_col) if drop_text else out


def token_stats(df: DataFrame, by: tuple[str, ...] | list[str] = (), n_col: str = "n_tokens") -> DataFrame:
    """Documents and tokens per group (or for the whole corpus when ``by`` is empty)."""
    n = F.col(n_col)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(n).cast("long").alias("n_tokens"),
        F.min(n).alias("min_tokens"),
        F.max(n).alias("max_tokens"),
        F.avg(n).alias("avg_tokens"),
    )
