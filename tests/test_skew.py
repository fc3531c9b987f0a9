"""Hot keys: one run, one conversation or one stretch of the key space holding a large share of rows."""

import random

from pyspark.sql import functions as F

from tessera.config import PackConfig
from tessera.operators import metrics as M
from tessera.operators import sft as S
from tessera.operators.packing import pack
from tessera.operators.prefix import order_bucket, quantile_bounds, quantile_bucket


def test_quantile_buckets_are_monotone_and_even(spark):
    keys = [10**12 + i for i in range(2000)] + list(range(1000))  # clustered, sparse key space
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    b = order_bucket(df, F.col("k"), max_buckets=16, rows_per_bucket=1)
    rows = sorted((r.k, r.b) for r in df.select("k", b.alias("b")).collect())
    assert [x[1] for x in rows] == sorted(x[1] for x in rows)  # monotone in the key
    sizes = {}
    for _, bucket in rows:
        sizes[bucket] = sizes.get(bucket, 0) + 1
    assert len(sizes) >= 8 and max(sizes.values()) <= 3 * len(keys) / 16


def test_pack_with_sparse_keys_equals_brute_force(spark):
    rnd = random.Random(7)
    ids = sorted(rnd.sample(range(10**15), 300))
    rows = [(k, [rnd.randint(1, 99) for _ in range(rnd.randint(1, 150))]) for k in ids]
    df = spark.createDataFrame([(k, v, len(v)) for k, v in rows], "doc_id long, ids array<int>, n_tokens int")
    stream = [t for _, v in rows for t in v]
    want = [stream[i:i + 64] for i in range(0, len(stream) - 63, 64)]
    cfg = PackConfig(block=64, target_tokens=None, max_buckets=32, rows_per_bucket=1)
    got = [r.input_ids for r in pack(df, cfg).orderBy("chunk_id").collect()]
    assert got == want


def test_hot_run_is_split_across_windows(spark):
    rnd = random.Random(1)
    rows = [("hot", 1_700_000_000_000_000 + i * 1000, i) for i in range(1500)]
    rows += [(f"r{r}", 1_700_000_000_000_000 + rnd.randint(0, 1500 * 1000), 10_000 + r * 10 + j)
             for r in range(300) for j in range(10)]
    df = spark.createDataFrame(rows, "run_id string, us long, event_id long").withColumn(
        "ts", F.timestamp_micros("us"))
    out = M.micro_index(df, "run_id", "ts", "event_id", max_buckets=64, rows_per_bucket=1)
    got = {(r.run_id, r.event_id): r.micro_idx for r in out.collect()}
    by_run = {}
    for run, us, eid in rows:
        by_run.setdefault(run, []).append((us, eid))
    for run, evs in by_run.items():
        for i, (_, eid) in enumerate(sorted(evs)):
            assert got[(run, eid)] == i
    # the hot run (a third of all rows) spreads over many (run, bucket) window partitions
    t = M.epoch_micros(df, "ts")
    b = quantile_bucket(t, quantile_bounds(df, t, 64))
    per = df.where("run_id = 'hot'").groupBy(b.alias("b")).count().collect()
    assert len(per) >= 16 and max(r["count"] for r in per) <= 1500 / 8


def test_one_long_conversation(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(2000)]
    turns += [(c, t, "user" if t % 2 == 0 else "assistant", "x") for c in range(2, 50) for t in range(4)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = S.turns_to_instructions(df)
    assert out.where("conv_id = 1").count() == 1000
    assert out.count() == 1000 + 48 * 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    # ranks are taken per bucket of turns, so one conversation is sorted in many pieces
    windows = [x for x in plan.splitlines() if "Window [" in x and "__pfx_bt" not in x]
    assert windows and all("__bucket" in x for x in windows)


def test_null_order_keys_and_partitions_are_kept(spark):
    from tessera.operators.packing import running_offset
    from tessera.operators.prefix import ordered_offsets

    df = spark.createDataFrame([(None, 5), (1, 3), (2, 4), (None, 7)], "doc_id long, n_tokens int")
    rows = running_offset(df).collect()
    starts = {(r.doc_id, r.n_tokens): r.start for r in rows}
    assert len(rows) == 4 and starts[1, 3] == 12 and starts[2, 4] == 15
    assert sorted(v for (k, _), v in starts.items() if k is None) in ([0, 5], [0, 7])
    runs = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 4)], "run string, k long, n int")
    got = sorted(((r.run or ""), r.k, r.start) for r in ordered_offsets(runs, "n", ["k"], F.col("k"), ["run"]).collect())
    assert got == [("", 1, 0), ("", 2, 2), ("a", 1, 0)]


def test_quantile_search_equals_bisect(spark):
    import bisect

    rnd = random.Random(3)
    bounds = sorted(rnd.sample(range(10000), 999))
    keys = [rnd.randint(-10, 10010) for _ in range(2000)] + bounds[:50]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for some in (bounds, bounds[:1], bounds[:7], []):
        got = [r.b for r in df.select(quantile_bucket(F.col("k"), some).alias("b")).collect()]
        assert got == [bisect.bisect_right(some, k) for k in keys]


def test_more_buckets_than_quantiles(spark, monkeypatch):
    from tessera.operators import prefix

    monkeypatch.setattr(prefix, "QUANTILES", 4)
    rnd = random.Random(5)
    keys = sorted(rnd.sample(range(10**12), 500))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = sorted((r.k, r.b) for r in df.select("k", order_bucket(df, F.col("k"), None, 20).alias("b")).collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows) and len({b for _, b in rows}) > 15


def test_digits_follow_the_rows():
    from tessera.operators.prefix import hash_digits

    assert [hash_digits(n, 1_000_000) for n in (0, 10, 10**6, 10**7, 10**8, 24 * 10**9)] == [1, 1, 1, 2, 2, 4]
    assert hash_digits(10, 1_000_000, least=300) == 3


def test_hash_buckets_are_bounded_and_ordered(spark):
    from tessera.operators.prefix import hash_bucket
    from tessera.operators.splits import seeded_key

    df = spark.range(5000).withColumn("h", seeded_key(1, "id"))
    crowd = spark.range(400).select("id", F.concat(F.lit("abc"), F.substring(F.md5(F.col("id").cast("string")), 1, 29)).alias("h"))
    same = spark.range(60).select("id", F.lit("f" * 32).alias("h"))
    for rows, per in ((df, 100), (df.unionByName(crowd), 50), (df.unionByName(crowd).unionByName(same), 40), (df, 10**6)):
        bucket, total = hash_bucket(rows, "h", rows.count(), per)
        got = sorted((r.h, r.b) for r in rows.select("h", bucket.alias("b")).collect())
        assert [b for _, b in got] == sorted(b for _, b in got) and got[-1][1] < total
        sizes = {}
        for h, b in got:
            sizes.setdefault(b, []).append(h)
        assert all(len(x) <= per or len(set(x)) == 1 for x in sizes.values())


def test_orders_do_not_depend_on_their_buckets(spark):
    from tessera.operators.manifest import epoch_order
    from tessera.operators.splits import seeded_order

    df = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 3).alias("split"))
    one, many = (sorted(map(tuple, seeded_order(df, ["k"], 5, rows_per_bucket=n).collect())) for n in (10**6, 7))
    assert one == many and sorted(r[-1] for r in one) == list(range(600))
    one, many = (sorted(map(tuple, epoch_order(df, ["k"], 5, 3, rows_per_bucket=n).collect())) for n in (10**6, 7))
    assert one == many
    samples = df.withColumn("x", F.lit(1))
    one, many = (sorted(map(tuple, S.batch_positions(samples, 5, ("k",), rows_per_bucket=n).collect())) for n in (10**6, 7))
    assert one == many


def test_keyless_rows_are_spread(spark):
    """Most rows have no key: many buckets, offsets still exact, and the same in any partitioning."""
    from tessera.operators.packing import running_offset
    from tessera.operators.prefix import BUCKET, bucketed_offsets, keyless_bits

    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), (F.col("id") % 7).alias("n_tokens"), "id")
    rows = running_offset(df, cfg=PackConfig(rows_per_bucket=200)).collect()
    at = 0
    for r in sorted(rows, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == at
        at += r.n_tokens
    with_key = sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)
    assert min(r.start for r in with_key) == sum(r.n_tokens for r in rows if r.doc_id is None)
    assert [r.start for r in with_key] == sorted(r.start for r in with_key)
    again = running_offset(df.repartition(9), cfg=PackConfig(rows_per_bucket=50)).collect()
    assert {(r.id, r.start) for r in again} == {(r.id, r.start) for r in rows}
    bits = keyless_bits(3600, 200)
    sizes = bucketed_offsets(df, "n_tokens", ["doc_id"], F.col("doc_id"), keyless_bits=bits).where(f"{BUCKET} < 0").groupBy(BUCKET).count().collect()
    assert len(sizes) == 2**bits and max(r["count"] for r in sizes) <= 200


def test_repeated_turn_numbers_have_one_order(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 2, "user", "next"), (1, 2, "user", "next"),
            (1, 3, "assistant", "end"), (None, 0, "user", "x"), (None, 5, "assistant", "y"), (2, None, None, "no role"), (2, 1, "user", None)]
    schema = "conv_id long, turn long, role string, text string"
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, schema).repartition(3)
        seen.add(tuple(sorted(map(tuple, S.turns_to_instructions(df).collect()), key=str)))
        following = S.neighbour(df, S.ranked_turns(df), "user", 2, "next_user")
        plan = following._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Window [" in x and "text#" in x]
        seen.add(tuple(sorted(((r.conv_id, r.turn, r.role, r.next_user) for r in following.collect()), key=str)))
    assert len(seen) == 2
    assert (None, 0, "x", None, "y") in min(seen, key=lambda x: len(x[0]) != 5)


def test_equal_instructions_are_numbered_without_a_sort(spark):
    rows = [("a", None, "x")] * 50 + [("b", "i", "y")] * 2 + [("c", "", None)]
    out = S.instruction_keys(spark.createDataFrame(rows, "instruction string, input string, output string")).collect()
    assert len({(r.conv_id, r.turn) for r in out}) == 53
    assert sorted(r.turn for r in out if r.instruction == "a") == list(range(1, 51))


def test_budgeted_tokens_keep_documents_without_an_id(spark):
    from tessera.config import QualityConfig
    from tessera.operators.tokenize import tokenize
    from tessera.plans.corpus import budgeted_tokens, filtered_tokens
    from tessera.session import release

    text = "\n".join(f"line {k} has some words of its own to read" for k in range(30))
    df = spark.createDataFrame([(k if k % 3 else None, f"{text} {k}") for k in range(12)], "doc_id long, text string")
    q = QualityConfig(profile="prose")
    cfg = PackConfig(block=64, target_tokens=64 * 30)
    tokens = budgeted_tokens(df, q, cfg, first_width=2)
    whole = filtered_tokens(df, q)
    assert tokens.where("doc_id IS NULL").count() == 4
    got, want = (sorted((r.chunk_id, tuple(r.input_ids)) for r in pack(t, cfg).collect()) for t in (tokens, whole))
    assert got == want and len(got) == 30
    release(spark, tokens)
    assert tokenize(df).count() == 12


def test_small_runs_need_no_buckets(spark):
    df = spark.createDataFrame([("a", k, k) for k in range(20)] + [(None, 3, 1)], "run_id string, us long, event_id long").withColumn("ts", F.timestamp_micros("us"))
    one, many = (sorted(((r.run_id or "", r.us, r.micro_idx) for r in M.micro_index(df, "run_id", "ts", "event_id", rows_per_bucket=n).collect())) for n in (10**6, 4))
    assert one == many == [("", 3, 0)] + [("a", k, k) for k in range(20)]
