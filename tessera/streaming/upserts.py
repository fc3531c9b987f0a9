"""A keyed table that a stream in update mode keeps (R4): a batch writes the rows that it changed, and no others.

``path/changes/batch=K`` holds the keys that batch K changed, ``path/base/batch=K`` the whole table as of
batch K, made anew after every ``compact_every`` batches. The table is the newest whole base and the changes after
it, the row of the latest batch for each key. Folders count only with their ``_SUCCESS`` marker. A batch that is
run again replaces its own folder, so nothing counts twice; one that was lost half-way is not seen until it is
done again. Compaction leaves the generation before it in place, so a reader that has just listed the folders
still finds them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.io import exists
from tessera.streaming.jobs import start

AT = "__batch"


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batches in a folder, ascending."""
    if not exists(spark, folder):
        return []
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return [k for k in found if exists(spark, os.path.join(folder, f"batch={k}", "_SUCCESS"))]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _generation(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest base, if any, and the batches of changes after it."""
    bases = _batches(spark, os.path.join(path, "base"))
    base = bases[-1] if bases else None
    return base, [k for k in _batches(spark, os.path.join(path, "changes")) if base is None or k > base]


def read_upserts(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The table as of its last finished batch. A key has at most one row a batch, so no group is larger than
    the batches since the last base; rows of a key are combined before the shuffle. NULL is a key like any other."""
    base, changes = _generation(spark, path)
    parts = [(os.path.join(path, "changes", f"batch={k}"), k) for k in changes]
    if base is not None:
        parts.append((os.path.join(path, "base", f"batch={base}"), base))
    rows = spark.createDataFrame([], schema).withColumn(AT, F.lit(0).cast("long"))
    for folder, k in parts:
        rows = rows.unionByName(spark.read.schema(schema).parquet(folder).withColumn(AT, F.lit(k).cast("long")))
    values = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), AT).alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in schema.names])


def _compact(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, epoch: int) -> None:
    before, _ = _generation(spark, path)
    read_upserts(spark, path, keys, schema).write.mode("overwrite").parquet(os.path.join(path, "base", f"batch={epoch}"))
    if before is None:
        return
    for kind in ("changes", "base"):
        for k in _batches(spark, os.path.join(path, kind)):
            if k < before or (k == before and kind == "changes"):
                _delete(spark, os.path.join(path, kind, f"batch={k}"))


def upsert_batches(df: DataFrame, keys: list[str], path: str, checkpoint: str, state_partitions: int | None = None,
                   compact_every: int = 16) -> StreamingQuery:
    """Keep a running aggregate as a keyed table; ``df`` has one row a key, as ``groupBy(*keys).agg(..)`` gives."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(os.path.join(path, "changes", f"batch={epoch}"))
        if len(_generation(spark, path)[1]) >= compact_every:
            _compact(spark, path, keys, schema, epoch)

    w = (df.writeStream.outputMode("update").foreachBatch(one)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    return start(df.sparkSession, w, state_partitions)
