import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity_fst as g


def events(text, **lexicon):
    counts = g.Lexicon(**lexicon).events(text)
    return {n: int(c) for n, c in zip(g.EVENT_NAMES, counts) if c}


@pytest.mark.parametrize("text, want", [
    ("You are an idiot", {"targeted_insult": 1}),
    ("What an IDIOT!", {"insult": 1}),
    ("You are not an idiot", {"negated_insult": 1}),
    ("not today. You idiot", {"targeted_insult": 1}),
    ('She said "you are an idiot"', {"reported_insult": 1}),
    ('She said "so" and you idiot', {"targeted_insult": 1}),
    ("I will kill you", {"threat": 1, "targeted_threat": 1}),
    ("they will kill him", {"threat": 1, "targeted_threat": 1}),
    ("they will kill the lights", {"threat": 1}),
    ("she will kill time while they wait", {"threat": 1}),
    ("we are going to beat up his brother", {"threat": 1, "targeted_threat": 1}),
    ("ich werde dich töten", {"targeted_threat": 1}),
    ("te voy a matar", {"targeted_threat": 1}),
    ("nobody will kill you", {"negated_threat": 1}),
    ('he wrote "I will kill you"', {"reported_threat": 1}),
    ("stupid, you know", {"insult": 1, "targeted_insult": 1}),
    ("stupid weather for these people", {"insult": 1}),
    ("a kill switch", {"threat_verb": 1}),
    ("idiotx and xidiot", {}),
    ("", {}),
])
def test_grammar(text, want):
    assert events(text) == want


def test_stems_need_a_continuation():
    assert events("lowei loweiung xloweiung", stems=("lowei",)) == {"induced_insult": 1}
    assert events("grumpf", words=("grumpf",)) == {"induced_insult": 1}


@pytest.mark.parametrize("word, lexicon", [("zorbta", {"stems": ("zorb",)}), ("grumpf", {"words": ("grumpf",)})])
@pytest.mark.parametrize("text, want", [
    ("what a {}", {"induced_insult": 1}),
    ("you are a {}", {"targeted_induced": 1}),
    ("you are not a {}", {"negated_induced": 1}),
    ("not a {} but a {}", {"negated_induced": 1, "induced_insult": 1}),
    ('she said "{}"', {"reported_induced": 1}),
    ('she said "you are a {}"', {"reported_induced": 1}),
    ("she called him a {}", {"reported_induced": 1}),
    ('she said "not a {}"', {"reported_induced": 1}),
])
def test_induced_entries_pass_the_grammar(word, lexicon, text, want):
    assert events(text.replace("{}", word), **lexicon) == want


def test_a_negated_or_quoted_induced_word_is_no_evidence():
    lexicon = g.Lexicon(stems=("zorb",))
    logit = lambda text: (g.design(lexicon.events(text)[None]) @ g.PRIOR)[0]
    none = logit("you are a friend")
    assert logit("you are a zorbta") > logit("what a zorbta") > none
    assert logit("you are not a zorbta") <= none and logit('she said "zorbta"') < logit("what a zorbta")


def test_composition_equals_the_cascade():
    rng = random.Random(5)
    parts = g.grammar().parts
    for _ in range(500):
        symbols = [rng.choice([g.O, g.I, g.H, g.T, g.N, g.R, g.Q, g.F_, g.J, g.Y, g.S, g.C]) for _ in range(rng.randint(0, 12))]
        stream = symbols
        for part in parts:
            state, out = 0, []
            for s in stream:
                state, o = part.step(state, s)
                out.append(o)
            stream = out
        assert g.grammar().run(symbols) == [e for e in stream if e in g.EVENTS]


SENTENCES = [
    ("stupid weather", 0),
    ("idiot light is on again in the kitchen and I must call the garage", 0),
    ("the trash is full", 0),
    ("he will kill the lights", 0),
    ("she will burn the cake", 0),
    ("we will hang the picture", 0),
    ("they want to destroy the old bridge", 0),
    ("kill the process", 0),
    ("shoot the photo at noon", 0),
    ("nobody should hurt him", 0),
    ("you are not an idiot", 0),
    ('she said "you are an idiot"', 0),
    ("he called him a fool", 0),
    ("I will never hurt you", 0),
    ("I will kill you", 1),
    ("we will murder you all tonight", 1),
    ("I am going to beat your family", 1),
    ("ich werde dich umbringen", 1),
    ("you are an idiot", 1),
    ("what a stupid idiot, worthless scum", 1),
    ("you will burn, you filthy pig", 1),
]


@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.1"
    return g.train(*[spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")])


def test_sentences_by_the_hand_set_weights_and_by_the_fitted(spark, trained):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SENTENCES)], "doc_id long, text string")
    for model in (g.Model((), (), tuple(g.PRIOR.tolist())), trained):
        got = {r.id: r.score for r in g.score(rows, model).collect()}
        assert [(t, int(got[k] >= 0.5)) for k, (t, _) in enumerate(SENTENCES)] == SENTENCES
        counts = np.array([g.Lexicon(model.words, model.stems).events(t) for t, _ in SENTENCES])
        assert np.allclose([got[k] for k in range(len(SENTENCES))], 1 / (1 + np.exp(-g.design(counts) @ np.array(model.weights))))


def test_held_out_figures(spark, trained):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(truth, "doc_id").where(g.crc_fold(g.F.col("doc_id")) == 0)
    score = {r.id: r.score for r in g.score(docs, trained).collect()}
    held = {r.doc_id: r.toxic for r in truth.collect() if r.doc_id in score}
    toxic = [score[k] >= 0.5 for k, x in held.items() if x]
    clean = [score[k] >= 0.5 for k, x in held.items() if not x]
    assert np.mean(toxic) >= 0.93 and np.mean(clean) <= 0.002


def test_an_event_no_row_holds_keeps_its_distance_from_the_bias():
    counts = np.zeros((2000, len(g.EVENTS) + 1), np.int64)
    counts[:, -1] = 100
    counts[:20, 0] = 3
    w = g.fit(counts, (np.arange(2000) < 20).astype(float))
    assert w[0] < -4
    alone = np.zeros((2, len(g.EVENTS) + 1), np.int64)
    alone[0, g.EVENT_NAMES.index("targeted_threat")] = alone[1, 0] = 1
    alone[:, -1] = 1
    assert (g.design(alone) @ w > 0).tolist() == [True, False]  # the second is a lone insult


def test_fit_without_one_class_keeps_the_prior():
    counts = np.zeros((3, len(g.EVENTS) + 1), np.int64)
    assert (g.fit(counts, np.zeros(3)) == g.PRIOR).all()


def test_scores_do_not_depend_on_the_caps(spark):
    rng = np.random.default_rng(4)
    labels = (np.arange(8000) % 10 == 0).astype(float)
    counts = np.zeros((8000, len(g.EVENTS) + 1), np.int64)
    counts[:, 0] = 2 * (rng.random(8000) < np.where(labels == 1, 0.7, 0.1))  # a lone insult has a bounded weight
    counts[:, -1] = 100
    table = spark.createDataFrame([(k, int(x)) for k, x in enumerate(labels)], "doc_id long, toxic int")
    used = {r.doc_id for r in g.usable_labels(table).collect()}
    clean, toxic = ([k for k in sorted(used) if labels[k] == c] for c in (0, 1))
    rows = clean[:1200] + toxic[:400]
    weights = g.class_weights(table, sample=(1200, 400))
    assert weights[0] / weights[1] == pytest.approx((len(clean) / 1200) / (len(toxic) / 400))
    assert g.class_weights(table, sample=(len(clean), len(toxic))) == (1.0, 1.0)
    score = lambda w: 1 / (1 + np.exp(-g.design(counts[:50]) @ w))
    whole = score(g.fit(counts[sorted(used)], labels[sorted(used)]))
    assert np.abs(score(g.fit(counts[rows], labels[rows], weights=weights)) - whole).max() < 0.06
    assert np.abs(score(g.fit(counts[rows], labels[rows])) - whole).max() > 0.1


def test_train_weighs_the_classes(spark, monkeypatch):
    docs, labels, _ = made_up(spark, 300)
    seen, fit = [], g.fit
    monkeypatch.setattr(g, "fit", lambda *a, weights: seen.append(weights) or fit(*a, weights=weights))
    g.train(docs, labels, sample=(40, 20))
    assert seen[0][0] > 1 > seen[0][1]


def made_up(spark, n=600):
    rng = random.Random(9)
    syllables = ["ta", "ri", "mo", "len", "sa", "ku"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(n):
        words, toxic = [word() for _ in range(60)], k % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["idiot", "zorb" + rng.choice(syllables), "zorb" + rng.choice(syllables)]))
        docs.append((k, " ".join(words), "x"))
        labels.append((k, None if k % 50 == 1 else int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 1, "", "x"), (None, "you idiot, you moron", "x")]
    labels += [(n, 0), (None, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_learns_and_holds_out(spark, corpus):
    docs, labels, truth = made_up(spark)
    model = g.train(docs, labels)
    assert "zorb" in model.stems
    out = g.op2_toxicity_fst(spark, corpus(documents=docs, labels=labels)).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [r.predicted == truth[r.doc_id] for r in out if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean(right) > 0.95
    assert {r.predicted for r in out if r.doc_id is None} == {1}
    kept = g.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 - r.predicted for r in out)


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = made_up(spark, 300)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(g.crc_fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert g.train(docs, labels) == g.train(docs, flipped)


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in g.op2_toxicity_fst(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert g.remove_toxic(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    assert [r.doc_id for r in g.remove_toxic(some, labels).collect()] == [2]


def test_an_id_many_rows_share_gives_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(200)] + [(2, None), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert g.training_rows(docs, labels).count() == 2
