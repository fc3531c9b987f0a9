"""Progress of a running stream as a table (K7): a listener stores what ``observe`` measured in each micro-batch.

One small JSON file a micro-batch, named by its number, so that a batch that is run again replaces its
report. A report is written after its batch is committed: if the driver is lost in between, that batch has none. The
exact count of a run is in its output (and in the ledger of ``run_budgeted``); this table is to be watched while it runs.
"""

from __future__ import annotations

import json
import os
import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tessera.config import PackConfig

PROGRESS_SCHEMA = "batch long, chunks long, tokens long"


class ProgressTable(StreamingQueryListener):
    """Stores the metric ``name`` (see ``jobs.with_pack_progress``) of every micro-batch under ``path``."""

    def __init__(self, spark: SparkSession, path: str, name: str = "pack_progress"):
        self.spark, self.path, self.name = spark, path, name
        self._seen = threading.Condition()
        self._ended: set[str] = set()

    def __enter__(self) -> ProgressTable:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get(self.name)
        if got is not None:
            self._write(event.progress.batchId, json.dumps({"batch": event.progress.batchId, **got.asDict()}))

    def onQueryTerminated(self, event) -> None:
        with self._seen:
            self._ended.add(str(event.runId))
            self._seen.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the query has ended and all its reports are written; reports come in order, the end last."""
        query.awaitTermination()
        with self._seen:
            if not self._seen.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no report of the end of {query.name or query.runId}")

    def _write(self, batch: int, line: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        new, place = (jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, n)) for n in (f"_{batch}.new", f"{batch}.json"))
        fs = place.getFileSystem(conf)
        out = fs.create(new, True)
        out.write(bytearray(line.encode() + b"\n"))
        out.close()
        fs.delete(place, False)
        fs.rename(new, place)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """``batch, chunks, tokens`` of each reported micro-batch."""
    return spark.read.schema(PROGRESS_SCHEMA).json(path)


def progress_reports(progress: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """One row every ``progress_every`` chunks, as ``operators.packing.pack_progress`` gives, and the micro-batch that reached it.

    What meets in the window's task is one row a micro-batch.
    """
    every = cfg.progress_every
    upto = F.sum("chunks").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = progress.select("batch", upto.alias("__upto"), (upto - F.col("chunks")).alias("__before"))
    first, last = F.floor(F.col("__before") / every) + 1, F.floor(F.col("__upto") / every)
    chunks = F.explode(F.transform(F.sequence(first, last), lambda k: k * F.lit(every)))
    cols = [F.col("chunks"), (F.col("chunks") * F.lit(cfg.block)).cast("long").alias("tokens")]
    if cfg.target_tokens:
        cols.append((F.lit(100.0) * F.col("chunks") * F.lit(cfg.block) / F.lit(float(cfg.target_tokens))).alias("pct_of_target"))
    at = told.where(last >= first).select("batch", chunks.alias("chunks"))
    return at.select("batch", *cols)
