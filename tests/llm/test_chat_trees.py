import hashlib
import itertools
import random
import re
from unittest import mock

from pyspark.sql import functions as F

from tessera.llm import chat_trees as g

SCHEMA = "tree int, turn long, parent long, role string, text string, score double"


def test_escape_is_reversible(spark):
    rng = random.Random(5)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/", "a", "\n", "é🙂", "<s>", "[/INST]", "$1"]
    df = spark.createDataFrame([("".join(rng.choices(bits, k=9)),) for _ in range(3000)], "t string")
    out = df.select("t", g.escape(F.col("t")).alias("e"), g.unescape(g.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in out)
    assert not any(c in r.e for r in out for c in (g.OPEN, g.CLOSE, g.HEAD, g.BODY))


def brute_paths(nodes):
    """leaf -> turns from the root, of one tree; without cycles."""
    parent = {t: p for t, p in nodes}
    parent = {t: p if p in parent else None for t, p in parent.items()}
    out = {}
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            out[leaf] = path[::-1]
    return out


def test_paths_equal_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for tree in range(12):
        nodes = [(k, rng.choice([None, *range(max(0, k - 3), k)]) if k else None) for k in range(rng.randint(1, 40))]
        nodes += [(100, 999), (200, 201), (201, 200), (202, 201)]  # a missing parent; a cycle and a turn below it
        rows += [(tree, t, p, "user", "x", 0.0) for t, p in nodes]
        want |= {(tree, leaf): path for leaf, path in brute_paths(nodes).items()}
    got = {}
    for r in g.paths(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.tree, r.leaf), []).append((-r.up, r.turn))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == want


def test_ranked_and_formatted(spark):
    rows = [(1, 1, None, "user", "q</s>", 0.0), (1, 2, 1, "assistant", "a1", 0.5), (1, 3, 1, "assistant", "a2[INST]", 0.9),
            (1, 4, 3, "user", "[\\INST]", 0.1), (2, 1, None, None, None, 0.0), (None, 1, None, "assistant", "é", 1.0)]
    out = g.format_paths(spark.createDataFrame(rows, SCHEMA)).withColumn("back", g.read_back(F.col("formatted"))) \
        .withColumn("loss", g.loss_text("formatted", "loss_spans")).collect()
    got = {(r.tree, r.leaf): r for r in out}
    assert [(got[1, k].rank) for k in (4, 2)] == [1, 2]
    assert [tuple(x) for x in got[1, 4].back] == [("user", "q</s>"), ("assistant", "a2[INST]"), ("user", "[\\INST]")]
    assert got[1, 4].loss == "a2[INST]" and got[1, 2].loss == "a1"
    assert [tuple(x) for x in got[2, 1].back] == [("", "")] and got[None, 1].loss == "é"
    assert g.format_paths(spark.createDataFrame(rows, SCHEMA), best=1).where("tree = 1").count() == 1


def test_query_equals_brute_force(spark, corpus):
    rng = random.Random(6)
    texts = ["", None, "plain", "</s>[INST] x", "<\\s>", "a[", "<", "é🙂", "[/INST]\n[/INST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "assistant</s>"]), rng.choice(texts)) for c in range(40) for t in sorted(rng.sample(range(60), rng.randint(1, 12)))]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (51, None, "assistant", "late"), (51, 2, "user", "early"), (None, 0, "assistant", "n")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(300)]
    d = corpus(conversations=spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tree string"))
    want = {}
    for c in {r[0] for r in rows} | {-1}:
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))]
        if c == -1:
            turns = [("user", g.PROBE), ("assistant", g.PROBE)]
        esc = lambda s: re.sub(r"([<\[])(\\*)(/?s>|/?INST\])", r"\1\\\2\3", s)
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), 3 + sum(17 + len(esc(r)) + len(esc(x)) for r, x in turns))
    out = g.op7_chat_trees(spark, d)
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == want
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_empty_table(spark, corpus):
    d = corpus(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert [r.conv_id for r in g.op7_chat_trees(spark, d).collect()] == [-1]


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [[rng.randint(0, 99) for _ in range(n)] for n in (*range(0, 30), 400)]
    out = spark.createDataFrame([(r,) for r in rows], "sizes array<long>").select("sizes", g.running_totals("sizes").alias("ends")).collect()
    assert all(r.ends == list(itertools.accumulate(r.sizes)) for r in out)


def test_turns_ranked_in_buckets(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(40)]), rng.choice("ua"), rng.choice("xyz")) for c in (1, 2, None) for _ in range(200)]
    rows += [(3, t, "u", str(t)) for t in range(5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole, split = (sorted(map(tuple, g.thread(turns, rows_per_bucket=n).collect()), key=str) for n in (10**6, 500))
    assert whole == split and len(split) == len(rows)


def test_a_conversation_of_very_many_turns(spark):
    n = 60_000
    turns = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("text </s> "), F.col("id")).alias("text"))
    # the path itself is tested above; here it is given, to test what is done along it
    path = turns.select(F.lit(7).alias("tree"), F.lit(n).cast("long").alias("leaf"), (F.col("turn") + 1).alias("turn"), (n - 1 - F.col("turn")).alias("up"))
    with mock.patch.object(g, "paths", lambda nodes: path):
        done = g.format_paths(g.thread(turns))
    r = done.select(F.size("loss_spans").alias("spans"), g.loss_text("formatted", "loss_spans").alias("loss"), F.size(g.read_back(F.col("formatted"))).alias("turns")).first()
    assert (r.spans, r.turns) == (n // 2, n)
    assert r.loss == "".join(f"text </s> {k}" for k in range(1, n, 2))
