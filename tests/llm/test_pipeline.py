import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as p
from tessera.llm import decontaminate, packing_pow2, secret_trigrams, simhash_golay, toxicity_fst
from tests.llm.test_secret_trigrams import brute


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash", "decontaminate", "secrets", "pack"]


def test_each_stage_decides_and_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns

    kept = p.toxicity(spark, docs, sf).cache()
    scores = {r.doc_id: r.predicted for r in toxicity_fst.op2_toxicity_fst(spark, sf).collect()}
    assert kept.columns == cols
    assert {r.doc_id for r in kept.collect()} == {d for d, bad in scores.items() if not bad}

    once = p.near_duplicates(spark, kept, sf).cache()
    groups = {}
    for r in simhash_golay.near_duplicates(kept).collect():
        groups.setdefault(r.component, []).append(r.id)
    assert once.columns == cols and sorted(r.doc_id for r in once.collect()) == sorted(groups)

    clean = p.decontamination(spark, once, sf).cache()
    leaks = {r.id for r in decontaminate.contaminated(once, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert clean.columns == cols
    assert {r.doc_id for r in clean.collect()} == set(groups) - leaks

    safe = p.secrets(spark, clean, sf).cache()
    before = {r.doc_id: r for r in clean.collect()}
    assert safe.columns == cols
    for r in safe.collect():
        old = before[r.doc_id]
        assert r.n_chars == len(r.text)
        assert (r.text == old.text) == (brute(old.text, True) == "")
    assert secret_trigrams.scan(safe).where("size(__spans) > 0").count() == 0

    packed = p.packing(spark, safe, sf).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())
    assert max(r.length for r in packed) <= packing_pow2.MAX_LENGTH
    tokenizer = Tokenizer.from_file(packing_pow2.tokenizer_file())
    texts = {r.doc_id: r.text for r in safe.collect()}
    for doc_id, text in texts.items():
        pieces = sorted((r.start, bytes(r.ids)) for r in packed if r.doc_id == doc_id)
        ids = np.frombuffer(b"".join(x for _, x in pieces), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [packing_pow2.END_ID]


def test_run_on_odd_rows(spark, corpus):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a few words only", None, None, 16), (5, "x " * 30000, "en", "s", 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = corpus(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
               benchmark=spark.createDataFrame([], "item_id long, text string"))
    out = p.run(spark, d).collect()
    assert {r.doc_id for r in out} == {1, None, 5}


def test_run_on_empty_tables(spark, corpus):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d = corpus(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
               benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert p.run(spark, d).count() == 0
