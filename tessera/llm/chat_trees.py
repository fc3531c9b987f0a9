"""Chat formatting of reply trees, in native columns throughout.

Turns form trees by a parent column. Root-to-leaf paths are enumerated with iterative
self-joins by doubling: round k joins the table of 2**k-th ancestors with itself, until no
turn has one; then the leaves walk up, from the longest jump to the shortest, which gives
one row per (leaf, turn on its path). Rounds grow with the logarithm of the depth, and only
ids move: texts are joined once, at the end. The paths of a tree are ranked by the mean
score of their turns (ties: the lesser leaf), and each chosen path becomes one string.

The template writes ``<s>`` and then for each turn ``[INST]role[/INST]text</s>``. Inside
roles and texts a control string gets a backslash after its first character, one more if it
has some already; taking one away restores it, so the strings survive the round trip and
never pass for markers. ``loss_spans`` are the places of assistant texts, in code points. Running sums
over a conversation's turns, and cuts at them, go by blocks of about the square root of their number, so a
very long conversation does not take quadratic time.

Null text or role: empty. A null tree is a tree of its own. A parent that is not there
counts as none, so its child is a root. Turns on a cycle, or below one, are on no path.
(tree, turn) must be unique; ``thread`` makes it so for plain conversations, where turns
with equal numbers follow each other by role, then text. Empty table: empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.operators.prefix import global_rank, key_stats, order_bucket

OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def thread(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``tree, turn, parent, role, text, score`` of plain conversations: each turn answers the one before it.

    Beyond ``rows_per_bucket`` rows turns are ranked in buckets of their number, so that one very long conversation is
    spread over many tasks; only turns with one number in one conversation always meet.
    """
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).cast("long").alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))
    lo, hi, n = key_stats(rows, F.col("at"))
    if n <= rows_per_bucket:
        order = Window.partitionBy("tree").orderBy(F.col("at").asc_nulls_last(), "role", "text")
        rows = rows.withColumn("turn", F.row_number().over(order).cast("long"))
    else:
        rows = rows.withColumn("at", F.coalesce("at", F.lit(hi + 1)))  # turns without a number come last
        bucket = order_bucket(rows, F.col("at"), rows_per_bucket=rows_per_bucket, stats=(lo, hi + 1, n))
        rows = global_rank(rows, ["at", "role", "text"], bucket, ["tree"], out="turn").withColumn("turn", F.col("turn") + 1)
    parent = F.when(F.col("turn") > 1, F.col("turn") - 1)
    return rows.select("tree", "turn", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, turn, up``: every turn of every root-to-leaf path, ``up`` steps above the leaf."""
    ids = cut(nodes.select("tree", "turn", "parent"))
    total = ids.count()
    known = ids.select(F.col("tree").alias("t"), F.col("turn").alias("above"))
    same = F.col("tree").eqNullSafe(F.col("t"))
    jump = cut(ids.join(known, same & (F.col("parent") == F.col("above"))).select("tree", "turn", "above"))
    parents = jump.select(F.col("tree").alias("t"), F.col("above").alias("p")).distinct()
    path = ids.join(parents, same & (F.col("turn") == F.col("p")), "left_anti").select(
        "tree", F.col("turn").alias("leaf"), "turn", F.lit(0).cast("long").alias("up"))

    jumps = []
    while not jump.isEmpty():
        if 1 << len(jumps) > total:  # such an ancestor exists only around a cycle
            lost = jump.select(F.col("tree").alias("t"), F.col("turn").alias("x"))
            path = path.join(lost, same & (F.col("leaf") == F.col("x")), "left_anti")
            break
        jumps.append(jump)
        on = jump.select(F.col("tree").alias("t"), F.col("turn").alias("middle"), F.col("above").alias("top"))
        jump = cut(jump.join(on, same & (F.col("above") == F.col("middle"))).select("tree", "turn", F.col("top").alias("above")))
    for k, jump in reversed(list(enumerate(jumps))):
        step = jump.select(F.col("tree").alias("t"), F.col("turn").alias("x"), "above")
        here = F.struct(F.col("turn"), F.col("up"))
        there = F.struct(F.col("above").alias("turn"), (F.col("up") + (1 << k)).alias("up"))
        both = F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))
        path = path.join(step, same & (F.col("turn") == F.col("x")), "left").select("tree", "leaf", F.explode(both).alias("at"))
        path = path.select("tree", "leaf", "at.turn", "at.up")
    return path


def _block(n: str) -> str:
    return f"cast(ceil(sqrt({n})) as int)"


def _totals(sizes: str) -> str:
    """Running totals of an array, each step copying what is there: for short arrays."""
    return (f"aggregate({sizes}, cast(array() as array<bigint>), "
            "(acc, x) -> concat(acc, array(x + coalesce(get(acc, size(acc) - 1), 0L))))")


def _blocks(array: str) -> str:
    """An array as an array of blocks, as long as there are blocks."""
    n = _block(f"size({array})")
    return f"if(size({array}) = 0, array(), transform(sequence(0, (size({array}) - 1) div {n}), b -> slice({array}, b * {n} + 1, {n})))"


def running_totals(sizes: str) -> Column:
    """Running totals of a long array column: within blocks, then over the blocks' own."""
    return F.expr(f"""transform(array({_blocks(sizes)}), blocks ->
        flatten(zip_with(
          transform(blocks, x -> {_totals('x')}),
          {_totals("concat(array(0L), transform(blocks, x -> aggregate(x, 0L, (s, y) -> s + y)))")},
          (ends, before) -> if(ends is null, array(), transform(ends, e -> e + before)))))[0]""")


def format_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """``tree, leaf, rank, score, formatted, loss_spans`` of the ``best`` paths of each tree (None: all).

    Paths are ranked by ids and scores; only the texts of chosen paths move.
    """
    ids = cut(nodes.select("tree", "turn", "parent", "score"))
    rows = cut(paths(ids))
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("turn") == F.col("x"))
    scores = rows.join(ids.select(F.col("tree").alias("t"), F.col("turn").alias("x"), "score"), same)
    scores = scores.groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
        of = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("x"))
        rows = rows.join(of, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("x")), "left_semi")
    body = nodes.select(F.col("tree").alias("t"), F.col("turn").alias("x"),
                        escape(F.coalesce("role", F.lit(""))).alias("role"),
                        escape(F.coalesce("text", F.lit(""))).alias("text"))
    whole = rows.join(body, same).groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("place"), "role", "text"))).alias("turns"))
    ranked = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("x"), "rank", "score")
    chosen = whole.join(ranked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("x")))

    fixed = len(HEAD) + len(BODY) + len(CLOSE)
    written = F.transform("turns", lambda x: F.concat(F.lit(HEAD), x["role"], F.lit(BODY), x["text"], F.lit(CLOSE)))
    sizes = F.transform("turns", lambda x: (F.length(x["role"]) + F.length(x["text"]) + fixed).cast("long"))
    chosen = chosen.select("tree", "leaf", "rank", "score", "turns", sizes.alias("sizes"))
    chosen = chosen.select("*", running_totals("sizes").alias("ends"))
    spans = F.transform(
        F.filter(F.arrays_zip("turns", "ends"), lambda x: x["turns"]["role"] == "assistant"),
        lambda x: F.struct((x["ends"] + len(OPEN) - len(CLOSE) - F.length(x["turns"]["text"])).alias("start"),
                           (x["ends"] + len(OPEN) - len(CLOSE)).alias("end")))
    return chosen.select("tree", "leaf", "rank", "score",
                         F.concat(F.lit(OPEN), F.array_join(written, "")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    parts = F.split(F.substr(formatted, F.lit(len(OPEN) + 1)), CLOSE, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(turns, lambda x: F.struct(
        unescape(F.substr(F.substring_index(x, BODY, 1), F.lit(len(HEAD) + 1))).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, BODY, 1)) + len(BODY) + 1)).alias("text")))


def loss_text(formatted: str, spans: str) -> Column:
    """What stands under the loss mask, unescaped: blocks of spans are cut out of the string first, then the spans of each."""
    pieces = F.expr(f"""flatten(transform({_blocks(spans)}, block ->
        transform(array(substring({formatted}, cast(block[0].start + 1 as int), cast(element_at(block, -1).end - block[0].start as int))),
          part -> transform(block, x -> substring(part, cast(x.start - block[0].start + 1 as int), cast(x.end - x.start as int))))[0]))""")
    return F.array_join(F.transform(pieces, unescape), "")


PROBE = "</s>[INST] ok [/INST]"


def op7_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_paths(thread(turns.unionByName(probe)))
    back = done.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"),
                       loss_text("formatted", "loss_spans").alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS t
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(17 + length(r) + length(t)) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""
