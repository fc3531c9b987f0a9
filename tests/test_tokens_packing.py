"""Tokenizer, two-level offsets, tight packing, budget, split, against brute force."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import PackConfig
from tessera.functions.tokens import FileTokenizer, HashTokenizer
from tessera.operators.packing import pack, pack_progress, running_offset
from tessera.operators.prefix import global_rank, range_bucket
from tessera.operators.splits import dataset_summary, seeded_order, split_exact
from tessera.operators.tokenize import token_stats, tokenize


def ids_table(spark, lengths, start_id=0, seed=0):
    """Documents with given token counts; ids are arbitrary but distinct per position."""
    rnd = random.Random(seed)
    rows = [(start_id + i, [rnd.randint(1, 999) for _ in range(n)], n) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, n_tokens int"), rows


def brute_pack(rows, block, limit=None):
    stream = [t for _, ids, _ in sorted(rows) for t in ids]
    chunks = [stream[i:i + block] for i in range(0, len(stream) - block + 1, block)]
    if limit is not None:
        chunks = chunks[:limit]
    return chunks, len(stream) - len(chunks) * block


def packed(df, block, **kw):
    cfg = PackConfig(block=block, target_tokens=kw.pop("target", None), max_buckets=kw.pop("buckets", 4096),
                     rows_per_bucket=1)
    return [r.input_ids for r in pack(df, cfg, **kw).orderBy("chunk_id").collect()]


def test_hash_tokenizer_pieces_cover_text(spark):
    tok = HashTokenizer()
    texts = ["Héllo  wörld, 12ab\tx\n\ny — z!", "", "日本語 テキスト 123", " leading", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(tok.pieces("text").alias("p"), tok.ids("text").alias("i"), tok.count("text").alias("c")).collect()
    for t, r in zip(texts, rows):
        assert "".join(r.p) == t
        assert len(r.i) == r.c == len(r.p)
        assert all(1 <= x < 49152 for x in r.i)


def test_tokenize_appends_one_eos(spark, docs_df):
    out = tokenize(docs_df(["a b c", "x"])).orderBy("doc_id").collect()
    assert [r.ids[-1] for r in out] == [0, 0]
    assert [r.n_tokens for r in out] == [4, 2]
    stats = token_stats(tokenize(docs_df(["a b c", "x"]))).first()
    assert (stats.n_docs, stats.n_tokens, stats.min_tokens, stats.max_tokens) == (2, 6, 2, 4)


def test_file_tokenizer_with_mapinarrow(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    vocab = {"[UNK]": 1, "hello": 2, "world": 3, "!": 4}
    tok = Tokenizer(WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = Whitespace()
    path = str(tmp_path / "tok.json")
    tok.save(path)
    df = spark.createDataFrame([(0, "hello world !"), (1, None), (2, "hello there")], "doc_id long, text string")
    out = {r.doc_id: r.ids for r in tokenize(df, FileTokenizer(path)).collect()}
    assert out == {0: [2, 3, 4, 0], 1: None, 2: [2, 1, 0]}


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_offsets_invariant_to_bucket_width(spark, buckets):
    df, rows = ids_table(spark, [5, 0, 7, 1, 12, 3, 3], start_id=10)
    cfg = PackConfig(max_buckets=buckets, rows_per_bucket=1)
    got = {r.doc_id: r.start for r in running_offset(df, cfg=cfg).collect()}
    acc, want = 0, {}
    for doc_id, _, n in rows:
        want[doc_id] = acc
        acc += n
    assert got == want


def test_two_level_rank_with_partitions(spark):
    rows = [(p, k) for p in range(3) for k in random.Random(p).sample(range(1000), 50)]
    df = spark.createDataFrame(rows, "p int, k long")
    out = global_rank(df, ["k"], range_bucket(F.col("k"), 0, 999, 7), ["p"], out="r", total_col="n").collect()
    for p in range(3):
        ks = sorted(k for q, k in rows if q == p)
        got = sorted((r.r, r.k) for r in out if r.p == p)
        assert got == list(enumerate(ks))
        assert {r.n for r in out if r.p == p} == {50}


@pytest.mark.parametrize("lengths,block", [
    ([3500], 1024),                       # one document longer than 3 blocks
    ([1000, 24, 1024, 5], 1024),          # a document ending exactly on a block edge
    ([10, 20, 30], 1024),                 # total below one block: no chunk, all tail
    ([7, 3, 11, 1, 1, 1, 9, 40, 2], 8),   # many small documents per block
    ([], 16),
])
def test_pack_equals_brute_force(spark, lengths, block):
    df, rows = ids_table(spark, lengths)
    want, tail = brute_pack(rows, block)
    got = packed(df, block)
    assert got == want
    assert len(got) * block + tail == sum(lengths)


def test_pack_invariant_to_partitioning_and_buckets(spark):
    lengths = [random.Random(i).randint(1, 300) for i in range(200)]
    df, rows = ids_table(spark, lengths, seed=3)
    want, _ = brute_pack(rows, 64)
    assert packed(df.repartition(7), 64, buckets=5) == want
    assert packed(df.coalesce(1), 64, buckets=4096) == want


def test_token_budget_and_progress(spark):
    df, rows = ids_table(spark, [100] * 50)
    want, _ = brute_pack(rows, 64, limit=math.ceil(1000 / 64))
    got = packed(df, 64, target=1000)
    assert got == want and len(got) == 16
    chunks = pack(df, PackConfig(block=64, target_tokens=None))
    prog = pack_progress(chunks, PackConfig(block=64, target_tokens=6400, progress_every=10)).orderBy("chunks").collect()
    assert [(r.chunks, r.tokens) for r in prog] == [(10, 640), (20, 1280), (30, 1920), (40, 2560), (50, 3200),
                                                      (60, 3840), (70, 4480)]
    assert prog[0].pct_of_target == 10.0


@pytest.mark.parametrize("n,val", [(0, 0), (1, 1), (200, 1), (1000, 5)])
def test_split_counts_exact(spark, n, val):
    df = spark.range(n).withColumnRenamed("id", "chunk_id")
    out = split_exact(df, ["chunk_id"], 0.005, 42).collect()
    assert len(out) == n
    assert sum(r.split == "val" for r in out) == val


def test_split_is_tail_of_seeded_order_and_deterministic(spark):
    df = spark.range(300).withColumnRenamed("id", "chunk_id")
    ranked = {r.chunk_id: r.rank for r in seeded_order(df, ["chunk_id"], 42).collect()}
    import hashlib

    order = sorted(range(300), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert [ranked[k] for k in order] == list(range(300))
    val = {r.chunk_id for r in split_exact(df, ["chunk_id"], 0.05, 42).where("split = 'val'").collect()}
    assert val == set(order[-15:])
    again = {r.chunk_id for r in split_exact(df.repartition(5), ["chunk_id"], 0.05, 42).where("split = 'val'").collect()}
    assert again == val
    ceil = split_exact(df, ["chunk_id"], 0.05, 42, rounding="ceil").where("split = 'val'").count()
    assert ceil == 15


def test_dataset_summary(spark):
    df, rows = ids_table(spark, [100] * 21)
    chunks = split_exact(pack(df, PackConfig(block=64, target_tokens=None)), ["chunk_id"], 0.1, 42)
    s = dataset_summary(df, chunks, 64).first()
    assert (s.n_docs, s.total_tokens, s.n_chunks, s.tail_tokens) == (21, 2100, 32, 2100 - 32 * 64)
    assert s.train_chunks + s.val_chunks == 32 and s.val_chunks == 3


def test_pack_plan_has_no_row_level_global_window(spark):
    df, _ = ids_table(spark, [50] * 20)
    plan = pack(df, PackConfig(block=64, rows_per_bucket=4))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "__bucket" in line, line


def test_budgeted_tokens_stop_early_and_pack_identically(spark):
    from tessera.config import QualityConfig
    from tessera.plans.corpus import budgeted_tokens, filtered_tokens

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prose = QualityConfig(profile="prose")
    cfg = PackConfig(target_tokens=25_000)
    part = budgeted_tokens(docs, prose, cfg, first_width=16)
    full = filtered_tokens(docs, prose)
    assert part.count() < full.count()
    a = [r.input_ids for r in pack(part, cfg).orderBy("chunk_id").collect()]
    b = [r.input_ids for r in pack(full, cfg).orderBy("chunk_id").collect()]
    assert a == b and len(a) == 25


def test_xxhash_tokenizer_same_pieces(spark, docs_df):
    fast = tokenize(docs_df(["one two three", "x"]), HashTokenizer(hash_fn="xxhash64")).orderBy("doc_id").collect()
    slow = tokenize(docs_df(["one two three", "x"]), HashTokenizer()).orderBy("doc_id").collect()
    assert [r.n_tokens for r in fast] == [r.n_tokens for r in slow] == [4, 2]
    assert all(1 <= i < 49152 for r in fast for i in r.ids[:-1]) and fast[0].ids[-1] == 0


def test_split_positions_follow_the_seeded_order(spark):
    from tessera.operators.splits import split_positions

    df = spark.range(200).withColumnRenamed("id", "chunk_id")
    ranked = {r.chunk_id: (r.rank, r.split) for r in split_exact(df, ["chunk_id"], 0.05, 42, keep_rank=True).collect()}
    rows = split_positions(split_exact(df, ["chunk_id"], 0.05, 42), ["chunk_id"], 42).collect()
    val = sorted((ranked[r.chunk_id][0], r.pos) for r in rows if r.split == "val")
    assert [p for _, p in val] == list(range(10))
    assert all(r.pos is None for r in rows if r.split == "train")
    assert {r.chunk_id: r.split for r in rows} == {k: v[1] for k, v in ranked.items()}


@settings(max_examples=6, deadline=None)
@given(
    lengths=st.lists(st.integers(min_value=1, max_value=90), min_size=0, max_size=40),
    block=st.sampled_from([4, 16, 64]),
    buckets=st.sampled_from([1, 2, 7]),
    seed=st.integers(min_value=0, max_value=10**6),
)
def test_pack_properties(spark, lengths, block, buckets, seed):
    df, rows = ids_table(spark, lengths, start_id=seed % 1000, seed=seed)
    want, tail = brute_pack(rows, block)
    got = packed(df.repartition(3), block, buckets=buckets)
    assert got == want
    assert len(got) * block + tail == sum(lengths)


@pytest.mark.parametrize("fraction,rounding", [(0.05, "ceil"), (0.3, "floor"), (0.5, "ceil"), (0.001, "floor")])
def test_boundary_split_equals_ranked_split_two_keys(spark, fraction, rounding):
    rows = [(c, t) for c in range(40) for t in range(0, 9, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long")
    keys = ["conv_id", "turn"]
    fast = {(r.conv_id, r.turn): r.split for r in split_exact(df, keys, fraction, 7, rounding).collect()}
    ranked = {(r.conv_id, r.turn): r.split for r in split_exact(df, keys, fraction, 7, rounding, keep_rank=True).collect()}
    assert fast == ranked
    n = len(rows)
    want = max(1, int(n * fraction)) if rounding == "floor" else math.ceil(n * fraction)
    assert sum(v == "val" for v in fast.values()) == want


def test_hash_tokenizer_same_ids_in_duckdb(spark):
    import duckdb

    tok = HashTokenizer()
    texts = ["Héllo  wörld, 12ab\tx\n\ny — z!", "日本語 テキスト 123", " leading", "a b\U0001F600c"]
    got = [r.i for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tok.ids("t").alias("i")).collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {tok.sql_ids('?')}", [t]).fetchone()[0] for t in texts]
    assert got == want
    with pytest.raises(ValueError):
        HashTokenizer(hash_fn="xxhash64").sql_ids("t")
