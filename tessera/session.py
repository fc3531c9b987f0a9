"""Session helpers: building a local session for tests, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local session the way the tests and the bench use it.

    On a cluster, build the session with the cluster's own settings instead; the
    library only reads them.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None in a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect has no SparkContext
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    sc = _context(spark)
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if d and sc is not None:
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; in local mode only, create one if unset.

    A cluster must name a shared folder in ``spark.checkpoint.dir``: a folder on one
    machine's disk would not survive the loss of that machine.
    """
    d = checkpoint_dir(spark)
    if d:
        return d
    sc = _context(spark)
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on {master or 'a cluster'}")
    d = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set(CHECKPOINT_CONF, d)
    if sc is not None:
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir()
    return d


_SHIPPED: dict[int, str] = {}


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``tessera`` importable in the Python workers (``addPyFile``, like ``--py-files``).

    Python UDFs, ``mapInArrow`` and ``applyInPandasWithState`` functions are
    unpickled in worker processes, which import this package by name; the workers
    do not see the driver's ``sys.path``. The package is zipped once per process.
    Under Spark Connect the zip is sent with ``addArtifacts(..., pyfile=True)``.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = _context(spark)
    key = id(sc) if sc is not None else id(spark)
    if _SHIPPED.get(key):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-py-"), "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(out)
    elif hasattr(spark, "addArtifacts"):
        spark.addArtifacts(out, pyfile=True)
    else:
        return
    _SHIPPED[key] = out


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (``spark.default.parallelism`` under Spark Connect)."""
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", "200"))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder and reading it back.

    Used where a plan would otherwise evaluate an expensive subtree twice (for
    example tokenising once for bucket totals and once for the rows). Compared with
    ``DataFrame.checkpoint`` the written table is columnar, so a later branch that
    needs two small columns reads only those, with min/max statistics per file.
    A lost executor costs nothing: the table is on shared storage. ``release`` deletes it.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return written(spark, path)


def written(spark: SparkSession, path: str) -> DataFrame:
    """A table this process has written as an intermediate one; ``release`` deletes it."""
    _WRITTEN.append(path)
    out = spark.read.parquet(path)
    out._tessera_path = path
    return out


#: Folders of this process's intermediate tables, oldest first.
_WRITTEN: list[str] = []


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete intermediate tables that ``materialize`` wrote: the given ones, or all of this process.

    A table can go once everything computed from it has been written or collected.
    DataFrames are lazy, so only the caller knows when; a table in use must stay.
    """
    sc = _context(spark)
    if sc is None:  # Spark Connect: no file system handle on the client
        return
    paths = [t._tessera_path for t in tables] if tables else list(_WRITTEN)
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
