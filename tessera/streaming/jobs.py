"""Streaming versions of the corpus path (R1, R4) and a small runner."""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import QualityConfig
from tessera.operators.quality import quality_filter, reject_funnel
from tessera.operators.tokenize import tokenize
from tessera.session import ensure_checkpoint_dir, parallelism
from tessera.sources.io import exists, read_corpus, write_step_metrics


def stream_tokens(spark: SparkSession, path: str, cfg: QualityConfig = QualityConfig(), tokenizer=None,
                  shard_col: str | None = "source", max_files_per_trigger: int | None = None,
                  spread_to: int | None = None, max_bytes_per_trigger: int | None = None,
                  schema=None) -> DataFrame:
    """Stateless filter and tokenise over a file stream; the same functions as in batch.

    ``spread_to`` hash-partitions each micro-batch by document before the filter,
    for streams whose files are few and large (one file is read by one task). The
    ``observe`` node keeps the filter from being pushed back below the repartition.
    A micro-batch admits files by number or by bytes.
    """
    extra = (shard_col,) if shard_col else ()
    docs = read_corpus(spark, path, extra_cols=extra, streaming=True, schema=schema,
                       max_files_per_trigger=max_files_per_trigger, max_bytes_per_trigger=max_bytes_per_trigger)
    if spread_to:
        docs = docs.repartition(spread_to, "doc_id").observe(
            f"stream_spread_{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows")
        )
    return tokenize(quality_filter(docs, cfg), tokenizer)


def with_pack_progress(packed: DataFrame, name: str = "pack_progress") -> DataFrame:
    """K7 on a stream: chunks and tokens emitted per micro-batch, reported in
    ``StreamingQueryProgress.observedMetrics[name]`` without a second pass."""
    return packed.observe(
        name,
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum(F.size("input_ids")), F.lit(0)).cast("long").alias("tokens"),
    )


def stream_funnel(spark: SparkSession, path: str, cfg: QualityConfig = QualityConfig(),
                  by: tuple[str, ...] = (), schema=None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """The reject funnel as a running aggregate; ``upserts.upsert_batches`` keeps it as a table (update mode)."""
    docs = read_corpus(spark, path, extra_cols=by, streaming=True, schema=schema, max_bytes_per_trigger=max_bytes_per_trigger)
    return reject_funnel(docs, cfg, by=by)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A per-query folder under the session's shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def few_splits(spark: SparkSession, path: str) -> bool:
    """Whether the files at ``path`` give fewer read tasks than there are task slots."""
    return spark.read.parquet(path).rdd.getNumPartitions() < parallelism(spark)


LEDGER = "_budget"


def _ledger(spark: SparkSession, path: str, epoch: int) -> int:
    """Rows taken by all batches up to ``epoch``: one row that batch wrote; none before the first."""
    if epoch < 0:
        return 0
    row = spark.read.schema("taken long").json(os.path.join(path, LEDGER, f"batch={epoch}")).first()
    return int(row["taken"])


def budget_spent(spark: SparkSession, path: str, budget: int) -> bool:
    """Whether the batches written under ``path`` have used the budget up, from the ledger's largest row."""
    ledger = os.path.join(path, LEDGER)
    if not exists(spark, ledger):
        return False
    return (spark.read.schema("taken long, batch long").json(ledger).agg(F.max("taken")).first()[0] or 0) >= budget


def first_rows(batch: DataFrame, n: int, group_cols: list[str], index_col: str) -> DataFrame:
    """The first ``n`` rows in the order of ``group_cols``, then ``index_col``, which counts up without gaps in a group.

    Two-level: group totals are summed in order (one row a group meets in one task), and a row's
    rank is its group's start plus its place within the group. No row is sorted.
    """
    groups = batch.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__n"), F.min(index_col).alias("__low"))
    order = Window.orderBy(*group_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("__start", F.sum("__n").over(order) - F.col("__n")).where(F.col("__start") < n)
    keys = [F.col(c).alias(f"__of_{c}") for c in group_cols]
    same = F.lit(True)
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    rank = F.col("__start") + F.col(index_col) - F.col("__low")
    return batch.join(groups.select(*keys, "__start", "__low"), same).where(rank < n).select(*batch.columns)


def run_budgeted(df: DataFrame, path: str, checkpoint: str, budget: int, group_cols: list[str], index_col: str = "chunk_idx",
                 state_partitions: int | None = None) -> StreamingQuery | None:
    """One budget of ``budget`` rows (chunks) for a whole stream, over all shards; the stream stops itself.

    Every micro-batch is written into a folder of its own, the last one cut to what is left, and
    leaves one row in a ledger: the rows taken so far. A batch reads the row of the batch before
    it and nothing else. A batch that is run again after a failure overwrites its folder and its row, so nothing
    counts twice. Once the budget is spent the query is stopped; a batch that had been planned
    by then is not executed, so its files are never read. A spent stream does not start again: None.
    """
    spark = df.sparkSession
    if budget_spent(spark, path, budget):
        return None
    spent = threading.Event()

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _ledger(spark, path, epoch - 1)
        if before >= budget:
            spent.set()
            return
        target, whole = os.path.join(path, f"batch={epoch}"), os.path.join(path, "_whole")
        batch.write.mode("overwrite").parquet(whole)  # the state advances once; the cut reads what is written
        rows = spark.read.schema(batch.schema).parquet(whole)
        n = rows.count()
        left = budget - before
        (rows if n <= left else first_rows(rows, left, group_cols, index_col)).write.mode("overwrite").parquet(target)
        spark.range(1).select(F.lit(before + min(n, left)).alias("taken")).write.mode("overwrite").json(
            os.path.join(path, LEDGER, f"batch={epoch}"))
        if n >= left:
            spent.set()

    w = (df.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    query = start(spark, w, state_partitions)

    def watch() -> None:
        while query.isActive:
            if spent.wait(0.2):
                query.stop()
                return

    threading.Thread(target=watch, daemon=True).start()
    return query


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(spark: SparkSession, w, state_partitions: int | None) -> StreamingQuery:
    """Start with a state store on disk and the given number of partitions of it, fixed when a query first starts."""
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_batches(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", write=None) -> StreamingQuery:
    """Append a stream to a table so that a batch run again replaces what it wrote: one folder a batch.

    ``write(batch, folder)`` writes one batch; by default in ``fmt``.
    """
    put = write or (lambda batch, folder: batch.write.mode("overwrite").format(fmt).save(folder))

    def one(batch: DataFrame, epoch: int) -> None:
        put(batch, os.path.join(path, f"batch={epoch}"))

    w = (df.writeStream.outputMode("append").foreachBatch(one)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    return start(df.sparkSession, w, None)


def undo_commit(spark: SparkSession, checkpoint: str) -> None:
    """Forget that the last batch was committed, as if the driver had been lost right before: the next start runs it again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint, "commits"))
    fs = folder.getFileSystem(conf)
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    last = max(int(n) for n in names if n.isdigit())
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder, str(last)), False)


def stream_step_metrics(rows: DataFrame, path: str, checkpoint: str, fmt: str = "csv") -> StreamingQuery:
    """S5 as a stream: metric rows appended while a run goes on, safe to retry."""
    return append_batches(rows, path, checkpoint, write=lambda batch, folder: write_step_metrics(batch, folder, fmt))


def run(df: DataFrame, name: str, sink: str = "memory", path: str | None = None, mode: str = "append",
        checkpoint: str | None = None, available_now: bool = True,
        state_partitions: int | None = None) -> StreamingQuery:
    """Start a stream; ``available_now`` processes what is there and stops (restartable).

    ``state_partitions`` fixes the number of state-store partitions of a new query
    (taken from ``spark.sql.shuffle.partitions`` when the query first starts and
    kept in its checkpoint); the session setting is restored right after.
    """
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or checkpoint_location(spark, name))
    if available_now:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink).option("path", path)
    return start(spark, w, state_partitions)
