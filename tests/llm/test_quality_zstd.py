import random
import zlib

import numpy as np
import pytest

from tessera.llm import quality_zstd as g


def test_blocks_cover_the_whole_text():
    for n in (0, 1, 1023, 1024, 1025, 5000):
        text = bytes(k % 251 for k in range(n))
        assert b"".join(g.blocks(text)) == text
        assert all(0 < len(b) <= g.BLOCK for b in g.blocks(text))


def test_a_dictionary_is_made_of_little_text():
    assert g.train_dictionary([]) == b""
    assert g.train_dictionary([b"abc", b"def"]) == b"abcdef"
    assert len(g.Measure(b"", b"")(b"some text")) == 6


def made_up(spark, n=400):
    rng = random.Random(2)
    syllables = ["ta", "ri", "mo", "len", "sa", "ku", "vi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(n):
        good = k % 4 != 0
        words = [word() for _ in range(rng.randint(20, 200))]
        docs.append((k, " ".join(words) if good else " | ".join(w + "$$$" for w in words), "x"))
        labels.append((k, None if k % 50 == 3 else int(good)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "tari molen", "x"), (n + 2, "tari molen", "x"), (None, "sa ku vi " * 40000, "x")]
    labels += [(n, 0), (None, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, sizes string"),
            spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels))


def test_learns_and_holds_out(spark, corpus):
    docs, labels, truth = made_up(spark)
    out = g.op1_quality_zstd(spark, corpus(documents=docs, labels=labels)).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.held_out and truth.get(r.doc_id) is not None]) > 0.95
    assert {r.score for r in out if r.doc_id in (400, 401)} == {g.EMPTY_SCORE}
    assert len({r.score for r in out if r.doc_id == 402}) == 1


def test_held_out_labels_are_not_read(spark):
    from pyspark.sql import functions as F

    docs, labels, _ = made_up(spark, 200)
    flipped = labels.withColumn("quality", F.when(g.crc_fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert g.train(docs, labels) == g.train(docs, flipped)


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in g.op1_quality_zstd(spark, sf).collect() if r.held_out and r.doc_id in truth]
    good = [r.predicted for r in out if truth[r.doc_id] == 1]
    bad = [r.predicted for r in out if truth[r.doc_id] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.12


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 0)]])
def test_too_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "good text"), (2, "bad text"), (3, None)], "doc_id long, text string")
    model = g.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in g.score(docs, model).collect())
    assert g.score(docs.limit(0), model).count() == 0
