import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate as g

ITEM = "Then Ann buys 2 kg of apples and gives 5 kg of them to Zoe before noon on the market day in town"
RENAMED = "Once Bob buys 7 kg of apples and gives 3 kg of them to Carl before noon on the market day in town"
MIXED = "Once Bob buys 7 kg of apples and gives 7 kg of them to Bob before noon on the market day in town"


def kinds(text):
    return g.Tokens([text]).kinds()


def test_placeholders():
    assert kinds("Ann paid 3 kg. In Rome 2,5 km? five $") == ["ann", "paid", "<num>", "<unit>", "in", "<name>", "<num>", "<unit>", "<num>", "<unit>"]
    assert kinds("in a m g") == ["in", "a", "m", "g"]  # units only next to numbers
    assert kinds("") == []


def by_pattern(text):
    """Template tokens by the pattern and the rules as they are written."""
    out, before = [], "end"
    for t in g.TOKEN.findall(text):
        low, kind = t.lower(), "word"
        if t in ".!?\n":
            kind = "end"
        elif t[0].isdigit() or low in g.NUMBER_WORDS:
            kind = "number"
        elif t in "$€£%":
            kind = "sign"
        elif low in g.UNITS:
            kind = "unit"
        elif t[0].isupper() and t[1:] == low[1:]:
            kind = "capital"
        slot = {"number": g.NUM, "sign": g.UNIT, "unit": g.UNIT if before == "number" else None,
                "capital": g.NAME if before != "end" else None}.get(kind)
        if kind != "end":
            out.append((t, slot or low))
        before = kind
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=25), st.lists(st.sampled_from(
    ["Ann", "kg", "in", "3", "2,5", "12:30", "1..2", ".", "!", " ", " ", "\n", "five", "$", "€", "don't", "'", "’", "a_b", "Éa", "ǅ", "²", "٣", "Σίσυφος", "ΣΑΣ"]),
    max_size=12).map("".join)), max_size=5))
def test_tokens_equal_the_pattern(texts):
    got = g.Tokens(texts)
    assert len(got.of_text) == len(texts) + 1
    for k, text in enumerate(texts):
        first, n = int(got.of_text[k]), int(got.of_text[k + 1] - got.of_text[k])
        assert list(zip(got.text(first, n), got.kinds(first, n))) == by_pattern(text)


def test_hashes_do_not_depend_on_the_place():
    a, b = g.Tokens(["Some other words. pears and 3 Plums"]), g.Tokens(["x", "PEARS and 7 Cherries"])
    assert a.hashes[3:].tolist() == b.hashes[1:].tolist() and a.plain[3:5].tolist() == b.plain[1:3].tolist()
    assert a.plain[5] != b.plain[3] and len(set(a.plain.tolist())) == 7


def test_window_hash_tells_order():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert len(g.window_hashes(a, 2)) == 3
    assert g.window_hashes(a, 4)[0] != g.window_hashes(a[::-1].copy(), 4)[0]
    assert len(g.window_hashes(a, 5)) == 0


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "these are short words", "x"), (5, "1 2 3 4 5", "x"), (6, "of", "x")], "item_id long, text string, size string")


@pytest.mark.parametrize("bound", [0, g.BROADCAST_WINDOWS])
def test_leaks(spark, items, monkeypatch, bound):
    monkeypatch.setattr(g, "BROADCAST_WINDOWS", bound)
    docs = [(1, f"Words before. {ITEM} and after"), (2, RENAMED), (3, MIXED), (4, None), (5, ""), (6, "nothing of it"), (None, ITEM.lower()),
            (7, "these are short words"), (7, "these are short words"), (8, " ".join(ITEM.split()[:10])), (9, "9 8 7 6 5")]
    docs = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item string")
    got = sorted((r.id or -1, r.item, r.renamed) for r in g.contaminated(docs, items).collect())
    assert [x[:2] for x in got] == [(-1, 1), (1, 1), (2, 1), (7, 4)]
    assert dict((x[0], x[2]) for x in got) == {-1: False, 1: False, 2: True, 7: False}
    kept = g.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [3, 4, 5, 6, 8, 9]


WORDS = [f"w{chr(97 + k)}ord" for k in range(22)]


@pytest.mark.parametrize("n", [14, 15, 16, 18, 20, 22])
def test_one_changed_word_anywhere(spark, n):
    """Changed, left out or put in, with or without another text around it."""
    item, docs = WORDS[:n], []
    for p in range(n):
        docs += [item[:p] + ["other"] + item[p + 1 :], item[:p] + item[p + 1 :], item[:p] + ["other"] + item[p:]]
    rows = [(k, "before it. " + " ".join(d) + " after") for k, d in enumerate(docs)] + [(-1, " ".join(item[: n // 2 - 1]))]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = g.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(r.id for r in got) == list(range(len(docs)))


def test_changed_word_beside_a_renaming(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = [RENAMED.replace("apples", "pears"), RENAMED.replace("noon", "dusk"), RENAMED.replace("market", "old market")]
    got = g.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()
    assert sorted((r.id, r.renamed) for r in got) == [(k, True) for k in range(3)]


def test_pieces_far_apart_are_no_copy(spark):
    item = WORDS[:22]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    text = " ".join(item[:6] + ["x"] * 300 + item[12:18])
    assert g.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).count() == 0


@pytest.mark.parametrize("item, text", [
    ("Compute 12 + 30 * 4 - 6", "Task: compute 12 + 30 * 4 - 6 now"),
    ("1 2 3 4 5", "count 1 2 3 4 5 up"),
    ("Ann Bob Carl Dora Eve", "by Ann Bob Carl Dora Eve alone"),
    ("Ann buys pears and plums", 'Question: "Ann buys pears and plums"'),
    ("Then Ann gives Bob and Zoe pears", "THEN ANN GIVES BOB AND ZOE PEARS"),
    ("Then Ann gives Bob and Zoe pears", "then ann gives bob and zoe pears"),
    ("12 * 7", "what is 12 * 7"),
    ("Antidisestablishment", "antidisestablishment"),
])
def test_verbatim_copies(spark, item, text):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "3 9 8 1 2 and Ann of pears")], "doc_id long, text string")
    assert [(r.id, r.renamed) for r in g.contaminated(docs, items).collect()] == [(1, False)]


def test_one_word_items_only_as_whole_documents(spark):
    items = spark.createDataFrame([(1, "Pears")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "pears"), (2, "pears and plums")], "doc_id long, text string")
    assert [r.id for r in g.contaminated(docs, items).collect()] == [1]


def test_equals_brute_force_on_the_table(spark):
    """Plain windows of the benchmark's tokens, looked up in every document."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: kinds(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for doc, text in texts.items():
        k = kinds(text)
        held = {tuple(k[i : i + 8]) for i in range(len(k) - 7)}
        for item, t in items.items():
            windows = [tuple(t[i : i + 8]) for i in range(len(t) - 7)]
            if 2 * sum(w in held for w in windows) >= len(windows):
                want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in g.op9_template_decontamination(spark, sf).collect()}
    assert got == want and want


def test_empty_tables(spark, items):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert g.contaminated(none, items).count() == 0
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert g.contaminated(docs, items.limit(0)).count() == 0
    assert g.remove_contaminated(docs, items.limit(0)).count() == 1


def test_names_that_clash(spark, items):
    docs = spark.createDataFrame([(1, ITEM, 2, 3), (2, "clean", 4, 5)], "doc_id long, text string, text_hash int, `a.b` int")
    out = g.remove_contaminated(docs, items)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "clean", 4, 5)]


def test_few_texts_are_read_at_once(spark, items, monkeypatch):
    import pyarrow as pa

    read, sizes = {}, []
    monkeypatch.setattr(g, "cut", lambda df: df)
    windows = g.benchmark_windows(items)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: read.update(run=run) or self)
    monkeypatch.setattr(g, "hash_filter", lambda *_: np.zeros(1 << (g.FILTER_BITS - 3), np.uint8))
    monkeypatch.setattr(type(docs), "collect", lambda self: [{"size": 8}])
    g.document_windows(docs, windows)
    monkeypatch.undo()
    tokens = g.Tokens
    monkeypatch.setattr(g, "Tokens", lambda texts: sizes.append(sum(map(len, texts))) or tokens(texts))
    texts = ["word " * 2_000] * 200 + ["word " * 100_000]
    batch = pa.RecordBatch.from_pydict({"id": range(201), "text_hash": range(201), "text": texts})
    list(read["run"](iter([batch])))
    assert sum(sizes) == sum(map(len, texts))
    assert max(sizes[:-1]) <= 1 << 18 and sizes[-1] == len(texts[-1])


@pytest.mark.parametrize("bound", [g.BROADCAST_FOUND, 0])
def test_few_rows_found_move_no_texts(spark, items, monkeypatch, bound):
    monkeypatch.setattr(g, "BROADCAST_FOUND", bound)
    rows = [(1, RENAMED), (2, "clean words"), (2, "clean words"), (None, RENAMED), (None, "no item"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = g.remove_contaminated(docs, items)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan, "hashpartitioning" in plan) == (bound > 0, bound == 0)
        assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


@pytest.mark.parametrize("bound", [g.BROADCAST_WINDOWS, 0])
def test_windows_are_broadcast_within_their_bound_only(spark, items, corpus, monkeypatch, bound):
    """Spark takes the windows of a stored benchmark to be as small as its items."""
    monkeypatch.setattr(g, "BROADCAST_WINDOWS", bound)
    stored = spark.read.parquet(corpus(benchmark=items) + "/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"Words before. {ITEM} and after"), (2, RENAMED), (3, "nothing of it")], "doc_id long, text string")
    out = g.contaminated(docs, stored)
    assert sorted((r.id, r.item) for r in out.collect()) == [(1, 1), (2, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (bound > 0, bound == 0)
