"""Scans and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

STEP_METRICS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("grad_norm", T.DoubleType()),
    T.StructField("tokens_seen", T.LongType()),
])


def read_corpus(spark: SparkSession, path: str, text_col: str = "text", order_col: str = "doc_id",
                extra_cols: tuple[str, ...] = (), streaming: bool = False, schema: T.StructType | None = None,
                max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """The corpus as ``(doc_id, text, ...)``, batch or streaming.

    Only the named columns are selected, so the Parquet scan reads nothing else.
    A stream needs a schema; by default the one of the batch table at ``path``. Its micro-batches
    admit files by number or by bytes.
    """
    if streaming:
        sch = schema or spark.read.parquet(path).schema
        reader = spark.readStream.schema(sch)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        if max_bytes_per_trigger:
            reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
        if os.path.isfile(path):
            # A file source watches a folder; a single file is picked out of its folder by name.
            reader = reader.option("pathGlobFilter", os.path.basename(path))
            path = os.path.dirname(path)
        df = reader.parquet(path)
    else:
        df = spark.read.parquet(path)
    cols = [F.col(order_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in extra_cols]]
    return df.select(*cols)


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Instruction rows ``(instruction, input, output)`` plus any id columns present."""
    df = spark.read.parquet(path)
    if {"instruction", "output"} <= set(df.columns):
        if "input" not in df.columns:
            df = df.withColumn("input", F.lit(None).cast("string"))
        return df
    if {"conv_id", "turn", "role", "text"} <= set(df.columns):
        from tessera.operators.sft import turns_to_instructions

        return turns_to_instructions(df)
    raise ValueError(f"{path}: neither an instruction table nor a turn table")


def read_split(spark: SparkSession, root: str, split: str, cols: tuple[str, ...] = ("input_ids",)) -> DataFrame:
    """S3: one split, selected columns: partition pruning on ``split``, column pruning on the rest."""
    return spark.read.parquet(root).where(F.col("split") == split).select(*cols)


def exists(spark: SparkSession, path: str) -> bool:
    """Existence through the cluster's Hadoop file system (any scheme); local paths without a JVM."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # Spark Connect: no JVM handle on the client
        return os.path.exists(path[len("file:"):] if path.startswith("file:") else path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def is_built(spark: SparkSession, root: str) -> bool:
    """A dataset counts as built when Spark's ``_SUCCESS`` marker is present."""
    return exists(spark, os.path.join(root, "_SUCCESS"))


def write_splits(df: DataFrame, root: str, if_exists: str = "skip", split_col: str = "split") -> bool:
    """Write the chunk table partitioned by split; returns False when skipped.

    ``if_exists``: ``"skip"`` (leave a finished dataset alone), ``"error"`` or
    ``"overwrite"``. A folder without ``_SUCCESS`` is an interrupted write and is
    overwritten.
    """
    spark = df.sparkSession
    if if_exists not in ("skip", "error", "overwrite"):
        raise ValueError("if_exists must be skip, error or overwrite")
    built = is_built(spark, root)
    if built and if_exists == "skip":
        return False
    if built and if_exists == "error":
        raise FileExistsError(root)
    df.write.mode("overwrite").partitionBy(split_col).parquet(root)
    return True


def require_built(spark: SparkSession, root: str, what: str = "dataset") -> None:
    """Fail early when a prerequisite stage has not produced its output."""
    if not is_built(spark, root):
        raise FileNotFoundError(f"{what} not found at {root}; run the stage that builds it first")


def write_manifest(man: DataFrame, path: str, rows_per_step: int, rows_per_file: int = 1_000_000, if_exists: str = "error") -> None:
    """Store a manifest in the order of its steps, a folder for each range of steps that holds about ``rows_per_file`` rows.

    A range is one task's, and one file, in training order. ``from_step`` and ``to_step`` are in the folder
    names, so a resumed run opens no file of the steps before it.
    """
    steps = max(1, rows_per_file // max(1, rows_per_step))
    lo = (F.floor((F.col("step") - 1) / steps) * steps + 1).cast("long")
    ranged = man.withColumn("from_step", lo).withColumn("to_step", (lo + (steps - 1)).cast("long"))
    ordered = ranged.repartition("from_step").sortWithinPartitions("from_step", "to_step", "step", "global_micro", "epoch", "pos")
    ordered.write.mode({"error": "errorifexists", "overwrite": "overwrite"}[if_exists]).partitionBy("from_step", "to_step").parquet(path)


def read_manifest(spark: SparkSession, path: str, after_step: int = 0, schema=None) -> DataFrame:
    """The steps after ``after_step`` of a stored manifest; ranges that end before are pruned by their folder names."""
    r = spark.read if schema is None else spark.read.schema(schema)
    rows = r.parquet(path).where((F.col("to_step") > after_step) & (F.col("step") > after_step))
    return rows.drop("from_step", "to_step")


def _metric_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in STEP_METRICS_SCHEMA.fields])


def write_step_metrics(df: DataFrame, folder: str, fmt: str = "csv") -> None:
    """One batch's metric rows as the folder's whole content; writing the batch again replaces them."""
    w = _metric_rows(df).write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(folder)


def append_step_metrics(df: DataFrame, path: str, fmt: str = "csv", batch: str | int | None = None) -> None:
    """Append metric rows (one row per optimizer step that was not skipped).

    With ``batch``, a name for these rows, an append that is tried again replaces its first attempt.
    """
    if batch is not None:
        return write_step_metrics(df, os.path.join(path, f"batch={batch}"), fmt)
    w = _metric_rows(df).write.mode("append")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def read_step_metrics(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read metric rows with the fixed schema (no inference), from a folder or from folders of batches."""
    r = spark.read.schema(STEP_METRICS_SCHEMA)
    return (r.option("header", True) if fmt == "csv" else r).format(fmt).load(path).select(*STEP_METRICS_SCHEMA.names)


def write_eval_report(df: DataFrame, root: str, fmt: str = "json") -> None:
    """Append the per-step evaluation report, one folder per step."""
    df.write.mode("append").partitionBy("step").format(fmt).save(root)


def read_eval_report(spark: SparkSession, root: str, schema, fmt: str = "json") -> DataFrame:
    """Read the reports of all steps with a fixed schema."""
    return spark.read.schema(schema).format(fmt).load(root)
