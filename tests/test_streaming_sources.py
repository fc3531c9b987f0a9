"""R1-R4 (stream equals batch, restart from the checkpoint) and S3-S6."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.config import QualityConfig
from tessera.operators.quality import quality_filter, reject_funnel
from tessera.operators.tokenize import tokenize
from tessera.sources import io as S
from tessera.streaming.jobs import run, stream_funnel, stream_tokens, with_pack_progress
from tessera.streaming.packer import pack_stream

PROSE = QualityConfig(profile="prose")
BLOCK = 64


def write_parts(spark, folder, n_parts=4, only=None):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    bounds = [round(i * n / n_parts) for i in range(n_parts + 1)]
    for i in (range(n_parts) if only is None else only):
        part = docs.where((F.col("doc_id") >= bounds[i]) & (F.col("doc_id") < bounds[i + 1]))
        part.coalesce(1).write.parquet(os.path.join(folder, f"part{i}"))
    return docs


def brute_per_shard(spark, docs, limit_chunks=None, salt=1):
    import hashlib

    toks = tokenize(quality_filter(docs.select("doc_id", "text", "source"), PROSE)).collect()
    by = {}
    for r in sorted(toks, key=lambda r: r.doc_id):
        sub = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % salt
        by.setdefault((r.source, sub), []).extend(r.ids)
    out = set()
    for shard, stream in by.items():
        chunks = [stream[i:i + BLOCK] for i in range(0, len(stream) - BLOCK + 1, BLOCK)]
        if limit_chunks is not None:
            chunks = chunks[:limit_chunks]
        out |= {(*shard, i, tuple(c)) for i, c in enumerate(chunks)}
    return out


def stream_parts(spark, src, dst, ckpt, budget=None, salt=1):
    files = sorted(os.listdir(src))
    # one folder per part: the file source reads the parts in arrival order
    toks = stream_tokens(spark, src + "/*", PROSE, shard_col="source", max_files_per_trigger=1)
    packed = with_pack_progress(
        pack_stream(toks, "source", BLOCK, "doc_id", "ids", target_tokens_per_shard=budget, salt=salt))
    q = run(packed, "pack", sink="parquet", path=dst, checkpoint=ckpt)
    q.awaitTermination()
    return q


def collected(spark, dst):
    return {(r.source, r.sub, r.chunk_idx, tuple(r.input_ids)) for r in spark.read.parquet(dst).collect()}


def test_stream_pack_equals_batch_with_restart(spark, tmp_path):
    src = str(tmp_path / "src")
    dst, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    # the first run sees two parts; two more arrive and the restarted query picks them up
    docs = write_parts(spark, src, only=[0, 1])
    q = stream_parts(spark, src, dst, ckpt)
    first = collected(spark, dst)
    progress = [p.observedMetrics.get("pack_progress") for p in q.recentProgress if p.numInputRows]
    assert sum(m["chunks"] for m in progress if m) == len(first)
    assert sum(m["tokens"] for m in progress if m) == len(first) * BLOCK
    write_parts(spark, src, only=[2, 3])
    stream_parts(spark, src, dst, ckpt)
    got = collected(spark, dst)
    assert first < got
    assert got == brute_per_shard(spark, docs)


def test_stream_budget_per_shard(spark, tmp_path):
    src = str(tmp_path / "src")
    docs = write_parts(spark, src)
    dst, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream_parts(spark, src, dst, ckpt, budget=2 * BLOCK - 5)
    assert collected(spark, dst) == brute_per_shard(spark, docs, limit_chunks=2)


def test_stream_salted_sub_shards(spark, tmp_path):
    src = str(tmp_path / "src")
    docs = write_parts(spark, src)
    dst, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream_parts(spark, src, dst, ckpt, salt=3)
    got = collected(spark, dst)
    assert {s for _, s, _, _ in got} <= {0, 1, 2}
    assert got == brute_per_shard(spark, docs, salt=3)


def test_stream_funnel_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    out = str(tmp_path / "funnel")
    f = stream_funnel(spark, path, PROSE, by=("lang",))
    q = (f.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "c"))
         .foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = reject_funnel(spark.read.parquet(path), PROSE, by=("lang",))
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {tuple(r) for r in batch.collect()}


def test_write_splits_modes_and_read_split(spark, tmp_path):
    root = str(tmp_path / "ds")
    df = spark.createDataFrame([(i, [i, i], "val" if i < 2 else "train") for i in range(10)],
                               "chunk_id long, input_ids array<int>, split string")
    assert S.write_splits(df, root) is True
    assert S.is_built(spark, root)
    assert S.write_splits(df, root) is False
    with pytest.raises(FileExistsError):
        S.write_splits(df, root, if_exists="error")
    assert S.write_splits(df.where("chunk_id > 0"), root, if_exists="overwrite") is True
    val = S.read_split(spark, root, "val", ("chunk_id", "input_ids"))
    assert sorted(r.chunk_id for r in val.collect()) == [1]
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    with pytest.raises(FileNotFoundError):
        S.require_built(spark, str(tmp_path / "missing"))


def test_step_metrics_roundtrip_and_eval_report(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = spark.createDataFrame([("r", 1, 2.5, 1e-4, 0.5, 1024)],
                                 "run_id string, step long, train_loss double, learning_rate double, "
                                 "grad_norm double, tokens_seen long")
    S.append_step_metrics(rows, path)
    S.append_step_metrics(rows.withColumn("step", F.lit(2)), path)
    back = S.read_step_metrics(spark, path)
    assert sorted(r.step for r in back.collect()) == [1, 2]
    rep = spark.createDataFrame([("r", 5, 1.0, 2.7, 1.0)], "run_id string, step long, val_loss double, "
                                "val_perplexity double, syntax_pass_rate double")
    S.write_eval_report(rep, str(tmp_path / "eval"))
    assert os.path.isdir(str(tmp_path / "eval" / "step=5"))


def test_read_instructions_schemas(spark, tmp_path):
    full = str(tmp_path / "full")
    spark.createDataFrame([("do x", "ctx", "done")], "instruction string, input string, output string") \
        .write.parquet(full)
    no_input = str(tmp_path / "no_input")
    spark.createDataFrame([("do y", "ok")], "instruction string, output string").write.parquet(no_input)
    turns = "/root/testdata/sf0.001/conversations.parquet"
    assert S.read_instructions(spark, full).first().input == "ctx"
    row = S.read_instructions(spark, no_input).first()
    assert row.input is None and row.instruction == "do y"
    assert set(S.read_instructions(spark, turns).columns) >= {"instruction", "input", "output"}
    bad = str(tmp_path / "bad")
    spark.createDataFrame([(1,)], "x int").write.parquet(bad)
    with pytest.raises(ValueError):
        S.read_instructions(spark, bad)


def test_read_corpus_renames_and_prunes(spark):
    df = S.read_corpus(spark, "/root/testdata/sf0.001/documents.parquet", extra_cols=("lang",))
    assert df.columns == ["doc_id", "text", "lang"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_stream_remainders_account_for_every_token(spark, tmp_path):
    from tessera.streaming.packer import stream_remainders

    src, dst, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    docs = write_parts(spark, src)
    stream_parts(spark, src, dst, ckpt, salt=2)
    total = sum(r.n_tokens for r in tokenize(quality_filter(docs.select("doc_id", "text"), PROSE)).collect())
    left = stream_remainders(spark, ckpt, "source").collect()
    assert all(0 < len(r.input_ids) < BLOCK for r in left)
    full = {(r.source, r.sub, r.chunk_idx) for r in spark.read.parquet(dst).collect()}
    assert not full & {(r.source, r.sub, r.chunk_idx) for r in left}
    assert len(full) * BLOCK + sum(len(r.input_ids) for r in left) == total


def packed_parts(spark, src):
    toks = stream_tokens(spark, src + "/*", PROSE, shard_col="source", max_files_per_trigger=1)
    return pack_stream(toks, "source", BLOCK, "doc_id", "ids")


def chunks_by_arrival(spark, docs, n_parts=4):
    """Full chunks of each shard in the order a stream of parts completes them."""
    n = docs.count()
    bounds = [round(i * n / n_parts) for i in range(n_parts + 1)]
    toks = sorted(tokenize(quality_filter(docs.select("doc_id", "text", "source"), PROSE)).collect(), key=lambda r: r.doc_id)
    left, number, out = {}, {}, []
    for low, high in zip(bounds, bounds[1:]):
        batch = []
        for r in toks:
            if low <= r.doc_id < high:
                buf = left.get(r.source, []) + r.ids
                while len(buf) >= BLOCK:
                    k = number[r.source] = number.get(r.source, -1) + 1
                    batch.append((r.source, 0, k, tuple(buf[:BLOCK])))
                    buf = buf[BLOCK:]
                left[r.source] = buf
        out.append(sorted(batch))
    return out


def budgeted(spark, src, tmp_path, budget):
    from tessera.streaming.jobs import run_budgeted

    q = run_budgeted(packed_parts(spark, src), str(tmp_path / "out"), str(tmp_path / "ckpt"), budget, ["source", "sub"])
    if q is not None:
        q.awaitTermination()
        assert q.exception() is None
    return q


def test_stream_budget_stops_the_stream(spark, tmp_path):
    """The cut falls into the second part; what arrives after it cannot even be read."""
    src = str(tmp_path / "src")
    docs = write_parts(spark, src)
    arrived = chunks_by_arrival(spark, docs)
    budget = len(arrived[0]) + len(arrived[1]) // 2
    assert 0 < len(arrived[0]) < budget < len(arrived[0]) + len(arrived[1])
    for k in (2, 3, 4):
        folder = os.path.join(src, f"part{k}")
        os.makedirs(folder, exist_ok=True)
        for f in os.listdir(folder):
            if f.endswith(".parquet"):
                with open(os.path.join(folder, f), "wb") as out:
                    out.write(b"no parquet file")
    budgeted(spark, src, tmp_path, budget)
    want = (arrived[0] + arrived[1])[:budget]
    assert collected(spark, str(tmp_path / "out")) == set(want)
    assert budgeted(spark, src, tmp_path, budget) is None  # spent: does not start again


def test_stream_budget_restart_in_the_middle(spark, tmp_path):
    from tessera.streaming.jobs import undo_commit

    src = str(tmp_path / "src")
    docs = write_parts(spark, src, only=[0, 1])
    arrived = chunks_by_arrival(spark, docs)
    budget = len(arrived[0]) + len(arrived[1]) + len(arrived[2]) // 2
    budgeted(spark, src, tmp_path, budget)
    undo_commit(spark, str(tmp_path / "ckpt"))  # the second batch is written again
    write_parts(spark, src, only=[2, 3])
    budgeted(spark, src, tmp_path, budget)
    rows = [(r.source, r.sub, r.chunk_idx, tuple(r.input_ids)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == sorted((arrived[0] + arrived[1] + arrived[2])[:budget])


def test_first_rows_sorts_nothing(spark):
    from tessera.streaming.jobs import first_rows

    rows = [(s, k + 7 * s, f"{s}-{k}") for s in range(5) for k in range(10)] + [(None, k, f"n-{k}") for k in range(3)]
    df = spark.createDataFrame(rows, "shard long, idx long, x string")
    for n in (0, 1, 3, 4, 13, 30, 53, 60):
        got = sorted(r.x for r in first_rows(df, n, ["shard"], "idx").collect())
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:n]
        assert got == sorted(x for _, _, x in want)
    plan = first_rows(df, 13, ["shard"], "idx")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


class State:
    """Stands in for the state store of one key."""

    def __init__(self):
        self.value, self.rows, self.map = None, [], {}
        self.appended = 0

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def exists(self):
        return self.value is not None

    def update(self, v):
        self.value = v


class ListOfRows(State):
    def get(self):
        return iter(list(self.rows))

    def appendValue(self, v):
        self.rows.append(v)
        self.appended += 1

    def clear(self):
        self.rows.clear()


class Parked(State):
    def updateValue(self, k, v):
        self.map[k] = v

    def getValue(self, k):
        return self.map[k]

    def removeKey(self, k):
        del self.map[k]

    def clear(self):
        self.map.clear()


def shard_packer(block, limit=None):
    from tessera.streaming.packer import ShardPacker

    p = ShardPacker("shard", "doc_id", "bigint", "ids", block, limit)
    p.place, p.tail, p.parked = State(), ListOfRows(), Parked()
    p.place.get = lambda: p.place.value
    return p


def test_a_hot_shard_is_read_a_frame_at_a_time():
    import random
    import weakref

    import pandas as pd

    rnd = random.Random(2)
    docs = [(k, [rnd.randint(1, 9) for _ in range(rnd.randint(1, 30))]) for k in range(400)]
    arrived = docs[:]
    rnd.shuffle(arrived)
    live, peak = [0], []

    def frames(rows, n):
        for k in range(0, len(rows), n):
            f = pd.DataFrame(rows[k : k + n], columns=["doc_id", "ids"])
            live[0] += 1
            weakref.finalize(f, lambda: live.__setitem__(0, live[0] - 1))
            peak.append(live[0])
            yield f
            del f

    p, out = shard_packer(50), []
    for f in p.handleInputRows(("s", 0), frames(arrived, 10), None):
        out += [list(x) for x in f["input_ids"]]
        assert len(f) <= 256
    stream = [x for _, ids in docs for x in ids]
    assert out == [stream[k : k + 50] for k in range(0, len(stream) - 49, 50)]
    assert max(peak) <= 3 and not p.parked.map  # 40 frames came
    assert [x for (ids,) in p.tail.rows for x in ids] == stream[len(out) * 50 :]
    # what does not complete a chunk is appended, not written anew
    rest = len(stream) % 50
    for k in range(3):
        before = p.tail.appended
        assert list(p.handleInputRows(("s", 0), iter([pd.DataFrame([(1000 + k, [7])], columns=["doc_id", "ids"])]), None)) == []
        assert p.tail.appended == before + 1
    assert sum(len(ids) for (ids,) in p.tail.rows) == rest + 3


def test_budget_of_a_shard_ends_its_packing():
    import pandas as pd

    p = shard_packer(4, limit=2)
    frames = [pd.DataFrame([(k, [k] * 3)], columns=["doc_id", "ids"]) for k in range(9)]
    out = [list(x) for f in p.handleInputRows(("s", 0), iter(frames), None) for x in f["input_ids"]]
    assert out == [[0, 0, 0, 1], [1, 1, 2, 2]] and p.place.value == (2, True) and not p.parked.map
    assert list(p.handleInputRows(("s", 0), iter(frames), None)) == []


def test_admission_by_bytes(spark, tmp_path):
    src = str(tmp_path / "src")
    docs = write_parts(spark, src)
    size = max(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(src) for f in fs if f.endswith(".parquet"))
    toks = stream_tokens(spark, src + "/*", PROSE, shard_col="source", max_bytes_per_trigger=size)
    dst = str(tmp_path / "out")
    q = run(pack_stream(toks, "source", BLOCK, "doc_id", "ids"), "bytes", sink="parquet", path=dst, checkpoint=str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(p.numInputRows > 0 for p in q.recentProgress) >= 3
    assert collected(spark, dst) == brute_per_shard(spark, docs)


def test_step_metrics_written_again_count_once(spark, tmp_path):
    from tessera.streaming.jobs import stream_step_metrics, undo_commit

    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    rows = spark.createDataFrame([("r", k, k / 2) for k in range(1, 21)], "run_id string, step long, train_loss double")
    for k in range(2):
        rows.where(f"step % 2 = {k}").write.parquet(f"{src}/part{k}")
        stream = spark.readStream.schema(rows.schema).parquet(src + "/*")
        stream_step_metrics(stream, out, ckpt).awaitTermination()
    undo_commit(spark, ckpt)
    stream_step_metrics(spark.readStream.schema(rows.schema).parquet(src + "/*"), out, ckpt).awaitTermination()
    back = S.read_step_metrics(spark, out)
    assert sorted(r.step for r in back.collect()) == list(range(1, 21)) and back.columns == S.STEP_METRICS_SCHEMA.names
    for _ in range(2):  # a batch append that is tried again
        S.append_step_metrics(rows, str(tmp_path / "batch"), batch="first")
    S.append_step_metrics(rows, str(tmp_path / "batch"), batch="second")
    assert S.read_step_metrics(spark, str(tmp_path / "batch")).count() == 40
