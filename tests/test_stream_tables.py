"""R4 as a keyed table, K7 from a listener, B6 from a stored manifest."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.config import PackConfig, QualityConfig, TrainConfig
from tessera.operators import manifest as B
from tessera.operators.packing import pack_progress
from tessera.operators.quality import reject_funnel
from tessera.sources.io import read_manifest, write_manifest
from tessera.streaming import upserts as U
from tessera.streaming.jobs import run, stream_funnel, undo_commit, with_pack_progress
from tessera.streaming.progress import ProgressTable, progress_reports, read_progress

PROSE = QualityConfig(profile="prose")
KEYS = ["k"]


def put(spark, folder, part, rows):
    spark.createDataFrame(rows, "k string, v long").coalesce(1).write.parquet(os.path.join(folder, f"part{part}"))


def counts(spark, src, out, ckpt, every):
    rows = spark.readStream.schema("k string, v long").parquet(src + "/*")
    agg = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    U.upsert_batches(agg, KEYS, out, ckpt, 2, compact_every=every).awaitTermination()
    return agg.schema


def got(spark, out, schema):
    return {r.k: (r.n, r.total) for r in U.read_upserts(spark, out, KEYS, schema).collect()}


def test_a_batch_writes_the_keys_it_changed(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    put(spark, src, 0, [("a", 1), ("b", 2), (None, 5)])
    schema = counts(spark, src, out, ckpt, 100)
    put(spark, src, 1, [("b", 3), (None, None)])
    counts(spark, src, out, ckpt, 100)
    assert got(spark, out, schema) == {"a": (1, 1), "b": (2, 5), None: (2, 5)}
    last = os.path.join(out, "changes", f"batch={U._batches(spark, os.path.join(out, 'changes'))[-1]}")
    assert {r.k for r in spark.read.parquet(last).collect()} == {"b", None}


def test_a_batch_run_again_counts_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for part in range(3):
        put(spark, src, part, [("a", part), ("b", 1)])
        schema = counts(spark, src, out, ckpt, 2)
    before = got(spark, out, schema)
    undo_commit(spark, ckpt)
    counts(spark, src, out, ckpt, 2)
    assert got(spark, out, schema) == before == {"a": (3, 3), "b": (3, 3)}


def test_compaction_keeps_the_table_and_bounds_the_folders(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for part in range(7):
        put(spark, src, part, [(f"k{part}", 1), ("all", 1)])
        schema = counts(spark, src, out, ckpt, 2)
        assert got(spark, out, schema)["all"] == (part + 1, part + 1)
    assert got(spark, out, schema) == {**{f"k{p}": (1, 1) for p in range(7)}, "all": (7, 7)}
    assert len(U._batches(spark, os.path.join(out, "base"))) <= 2
    assert len(U._batches(spark, os.path.join(out, "changes"))) <= 4


def test_a_folder_without_its_marker_is_not_read(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    put(spark, src, 0, [("a", 1)])
    schema = counts(spark, src, out, ckpt, 100)
    for kind in ("changes", "base"):
        torn = os.path.join(out, kind, "batch=99")
        os.makedirs(torn)
        with open(os.path.join(torn, "part-0.parquet"), "wb") as f:
            f.write(b"torn")
    assert got(spark, out, schema) == {"a": (1, 1)}


def test_an_empty_table(spark, tmp_path):
    assert U.read_upserts(spark, str(tmp_path / "none"), KEYS, spark.createDataFrame([], "k string, n long").schema).count() == 0


def test_funnel_over_parts_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).write.parquet(os.path.join(src, f"part{part}"))
        funnel = stream_funnel(spark, src + "/*", PROSE, by=("lang",), schema=docs.schema)
        U.upsert_batches(funnel, ["lang", "reason"], out, ckpt, 2, compact_every=2).awaitTermination()
    want = {tuple(r) for r in reject_funnel(docs, PROSE, by=("lang",)).collect()}
    assert {tuple(r) for r in U.read_upserts(spark, out, ["lang", "reason"], funnel.schema).collect()} == want


def chunk_stream(spark, src, name):
    rows = spark.readStream.schema("input_ids array<int>").option("maxFilesPerTrigger", 1).parquet(src + "/*")
    return with_pack_progress(rows, name)


def test_progress_of_a_stream_equals_the_batch_report(spark, tmp_path):
    cfg = PackConfig(block=4, target_tokens=1000, progress_every=3)
    src, out, ckpt, told = (str(tmp_path / x) for x in ("src", "out", "ckpt", "told"))
    sizes = [2, 0, 5, 1, 9]
    for part, n in enumerate(sizes):
        spark.range(n).select(F.array_repeat(F.lit(1), 4).alias("input_ids")).coalesce(1).write.parquet(os.path.join(src, f"part{part}"))
    with ProgressTable(spark, told, "told") as listener:
        listener.wait(run(chunk_stream(spark, src, "told"), "told", sink="parquet", path=out, checkpoint=ckpt))
    seen = {r.batch: (r.chunks, r.tokens) for r in read_progress(spark, told).collect()}
    assert sum(c for c, _ in seen.values()) == sum(sizes) and all(t == 4 * c for c, t in seen.values())
    want = {tuple(r) for r in pack_progress(spark.range(sum(sizes)).select(F.col("id").alias("chunk_id")), cfg).collect()}
    reports = progress_reports(read_progress(spark, told), cfg).collect()
    assert {(r.chunks, r.tokens, r.pct_of_target) for r in reports} == want and len(reports) == len(want)
    done = 0
    for batch in sorted(seen):
        assert {r.chunks for r in reports if r.batch == batch} == {c for c in range(done + 1, done + seen[batch][0] + 1) if c % 3 == 0}
        done += seen[batch][0]


def test_a_batch_run_again_replaces_its_report(spark, tmp_path):
    src, out, ckpt, told = (str(tmp_path / x) for x in ("src", "out", "ckpt", "told"))
    spark.range(5).select(F.array(F.lit(7)).alias("input_ids")).coalesce(1).write.parquet(os.path.join(src, "part0"))
    for again in (False, True):
        if again:
            undo_commit(spark, ckpt)
        with ProgressTable(spark, told, "again") as listener:
            listener.wait(run(chunk_stream(spark, src, "again"), "again", sink="noop", checkpoint=ckpt))
    assert [tuple(r) for r in read_progress(spark, told).collect()] == [(0, 5, 5)]


@pytest.fixture
def stored(spark, tmp_path):
    cfg = TrainConfig(max_steps=9, batch_size=2, grad_accum=2)
    chunks = spark.range(23).select(F.col("id").alias("chunk_id"))
    man = B.manifest(chunks, cfg, n=23)
    path = str(tmp_path / "manifest")
    write_manifest(man, path, cfg.effective_batch, rows_per_file=2 * cfg.effective_batch)
    return cfg, man, path


def test_resuming_opens_no_file_of_earlier_steps(spark, stored):
    cfg, man, path = stored
    folders = sorted(d for d in os.listdir(path) if d.startswith("from_step="))
    assert folders == [f"from_step={k}" for k in (1, 3, 5, 7, 9)]
    want = {tuple(r) for r in man.where(F.col("step") > 5).select(*man.columns).collect()}
    for early in ("from_step=1", "from_step=3"):
        for root, _, files in os.walk(os.path.join(path, early)):
            for f in files:
                with open(os.path.join(root, f), "wb") as out:
                    out.write(b"not parquet")
    rest = read_manifest(spark, path, 5, man.schema)
    assert {tuple(r) for r in rest.select(*man.columns).collect()} == want
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(to_step" in plan and "(to_step" in plan


def test_a_stored_range_is_one_file_in_training_order(spark, stored):
    cfg, man, path = stored
    for folder in (d for d in os.listdir(path) if d.startswith("from_step=")):
        files = [os.path.join(r, f) for r, _, fs in os.walk(os.path.join(path, folder)) for f in fs if f.endswith(".parquet")]
        assert len(files) == 1
        import pyarrow.parquet as pq

        rows = pq.read_table(files[0], columns=["step", "global_micro"], partitioning=None).to_pylist()
        order = [(r["step"], r["global_micro"]) for r in rows]
        assert order == sorted(order) and len({s for s, _ in order}) <= 2


def test_a_manifest_is_not_overwritten_unasked(spark, stored):
    cfg, man, path = stored
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_manifest(man, path, cfg.effective_batch)
    write_manifest(man, path, cfg.effective_batch, if_exists="overwrite")
    assert read_manifest(spark, path).count() == man.count()
