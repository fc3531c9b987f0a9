"""Corpus build (reference stage ``data``): scan, filter, tokenise, pack, split, write.

The expensive per-document work (filter and tokenise) runs once: the token table
is materialised before packing, because packing reads it twice (bucket totals
and rows). The packed chunks are materialised before the split for the same
reason.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import PackConfig, QualityConfig
from tessera.operators.packing import budget_chunks, pack
from tessera.operators.prefix import key_range
from tessera.operators.quality import quality_filter
from tessera.operators.splits import dataset_summary, split_exact, split_positions
from tessera.operators.tokenize import tokenize
from tessera.session import ensure_checkpoint_dir, materialize, parallelism, written
from tessera.sources.io import is_built, read_corpus, write_splits


def spread(df: DataFrame, *keys: str, force: bool = False) -> DataFrame:
    """Hash-partition by ``keys`` (default ``doc_id``) before CPU-heavy per-row work.

    Without ``force`` it only acts when the input has fewer splits than the
    cluster has cores: a corpus stored as one large row group is read by a single
    task, while at scale the input already has many splits and this adds no
    shuffle. ``force`` is for small tables that come out of a shuffle, which AQE
    coalesces by bytes into a few partitions, too few for tokenising; a
    repartition with an explicit count is not coalesced. The count is the session's
    number of shuffle partitions, and at least the task slots. The ``observe`` node (a
    row count, reported to listeners) keeps Catalyst from pushing the caller's
    filters below the repartition, which would put the work back into the
    single input task.
    """
    keys = keys or ("doc_id",)
    cores = parallelism(df.sparkSession)
    if not force:
        try:
            if df.rdd.getNumPartitions() >= cores:
                return df
        except Exception:  # no RDD view (Spark Connect): leave the input as it is
            return df
    count = max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(count, *keys).observe(f"spread_{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


@dataclass
class CorpusTables:
    tokens: DataFrame  # doc_id, ids, n_tokens (materialised)
    chunks: DataFrame  # chunk_id, input_ids (materialised)
    split: DataFrame  # chunk_id, input_ids, split, pos (place within val in stored order; NULL for train)
    summary: DataFrame


def filtered_tokens(docs: DataFrame, qcfg: QualityConfig, tokenizer=None) -> DataFrame:
    """F9 then K1/K2 on the kept documents, materialised once."""
    kept = quality_filter(spread(docs.select("doc_id", "text")), qcfg)
    return materialize(tokenize(kept, tokenizer))


def budgeted_tokens(docs: DataFrame, qcfg: QualityConfig, pcfg: PackConfig, tokenizer=None,
                    order_col: str = "doc_id", first_width: int | None = None) -> DataFrame:
    """K6 pushed upstream: filter and tokenise only as far into the order as the budget needs.

    The reference stops reading its stream once the token target is reached. Here
    ascending ranges of the order key are processed in doubling widths; each range
    is filtered, tokenised and appended to one token table, and the loop stops once
    the kept tokens cover ``ceil(target / block)`` blocks. Range predicates on the
    order key reach the Parquet scan, so later row groups are not read. The number
    of jobs is logarithmic in the corpus size and at most about twice the needed
    documents are processed. Documents without a key, which come first in the order, are read
    first. Packing the result with the same budget gives exactly
    the chunks of packing the whole corpus.
    """
    limit = budget_chunks(pcfg.target_tokens, pcfg.block)
    if limit is None:
        return filtered_tokens(docs, qcfg, tokenizer)
    need = limit * pcfg.block
    lo, hi = key_range(docs, order_col)
    spark = docs.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"budget-tokens-{uuid.uuid4().hex}")
    # Start at 1/65536 of the key range (at least 4,096 keys): a 3 B-token budget is
    # a tiny share of a 100 TB corpus, and doubling from a small start overshoots
    # by at most 2x.
    width = first_width or max(4096, (hi - lo + 1) // 65536)

    def add(part: DataFrame) -> int:
        """Filter, tokenise and append a range; the tokens so far."""
        kept = quality_filter(spread(part.select(order_col, "text"), order_col), qcfg)
        tokenize(kept, tokenizer).write.mode("append").parquet(path)
        return spark.read.parquet(path).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]

    key = F.col(order_col)
    start, have = lo, add(docs.where(key.isNull()))
    while start <= hi and have < need:
        have = add(docs.where((key >= start) & (key < start + width)))
        start, width = start + width, width * 2
    return written(spark, path)


def corpus_tables(docs: DataFrame, qcfg: QualityConfig = QualityConfig(), pcfg: PackConfig = PackConfig(),
                  tokenizer=None) -> CorpusTables:
    tokens = budgeted_tokens(docs, qcfg, pcfg, tokenizer)
    chunks = materialize(pack(tokens, pcfg))
    split = split_positions(split_exact(chunks, ["chunk_id"], pcfg.val_fraction, pcfg.seed), ["chunk_id"], pcfg.seed)
    budget = budget_chunks(pcfg.target_tokens, pcfg.block)
    return CorpusTables(tokens, chunks, split, dataset_summary(tokens, split, pcfg.block, budget=budget))


def build_corpus(spark: SparkSession, corpus_path: str, out_root: str, qcfg: QualityConfig = QualityConfig(),
                 pcfg: PackConfig = PackConfig(), tokenizer=None, if_exists: str = "skip") -> DataFrame | None:
    """Write ``out_root/split=train|val``; skipped when already built. Returns the summary."""
    if if_exists == "skip" and is_built(spark, out_root):
        return None
    t = corpus_tables(read_corpus(spark, corpus_path), qcfg, pcfg, tokenizer)
    # ``pos`` keeps the stored (shuffled) order of the val split, the order evaluation reads
    write_splits(t.split.select("chunk_id", "pos", "input_ids", "split"), out_root, if_exists="overwrite")
    return t.summary
