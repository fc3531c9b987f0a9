"""T0-T9 and B1-B6 against scalar restatements and the hand-made rows of the fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.config import SftConfig, TrainConfig
from tessera.functions.tokens import HashTokenizer
from tessera.operators import manifest as B
from tessera.operators import sft as S

def inst_df(spark, rows):
    return spark.createDataFrame(
        [(i, 1, a, b, c) for i, (a, b, c) in enumerate(rows)],
        "conv_id long, turn long, instruction string, input string, output string",
    )


def test_turns_to_instructions(spark):
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
        (1, 3, "user", "q2"), (1, 4, "assistant", "a2"), (1, 5, "user", "unanswered"),
        (2, 0, "user", "solo"), (2, 1, "assistant", "ans"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in S.turns_to_instructions(df).collect())
    assert got == [(1, 1, "q1", "be brief", "a1"), (1, 3, "q2", None, "a2"), (2, 0, "solo", None, "ans")]


def test_format_input_section(spark):
    rows = [("  Do x ", None, " out "), ("Do y", "   \n", "o"), ("Do z", " data ", "o")]
    got = [r.text for r in S.format_sample(inst_df(spark, rows)).orderBy("conv_id").collect()]
    assert got == [
        "### Instruction:\nDo x\n\n### Response:\nout",
        "### Instruction:\nDo y\n\n### Response:\no",
        "### Instruction:\nDo z\n\n### Input:\ndata\n\n### Response:\no",
    ]


def word_tokenizer(tmp_path):
    """A vocabulary of a few words, so that ids and masks can be written out."""
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    from tessera.functions.tokens import FileTokenizer

    words = ["[UNK]", "###", "Instruction", "Response", ":", "Input", "write", "code", "now", "please", "ok", "done", "x"]
    tok = Tokenizer(WordLevel({w: i + 1 for i, w in enumerate(words)}, unk_token="[UNK]"))
    tok.pre_tokenizer = Whitespace()
    path = str(tmp_path / "tok.json")
    tok.save(path)
    return FileTokenizer(path)


def test_ids_and_masks_written_out(spark, tmp_path):
    """###=2 Instruction=3 Response=4 :=5 Input=6 write=7 code=8 now=9 please=10 ok=11 done=12 x=13, end 0."""
    rows = [
        ("write code now please", None, "ok done x x x"),
        ("write", "x x", "ok"),
        ("code ### Response:\nnow", None, "done"),  # the marker quoted: the mask ends there
        ("x x x x x x x x", None, "ok"),  # prompt longer than the limit
        ("x", None, ""),  # too short
    ]
    got = S.sft_samples(inst_df(spark, rows), word_tokenizer(tmp_path), SftConfig(max_len=13, min_tokens=9), keep_all=True)
    got = got.orderBy("conv_id").collect()
    assert [r.input_ids for r in got] == [
        [2, 3, 5, 7, 8, 9, 10, 2, 4, 5, 11, 12, 13],
        [2, 3, 5, 7, 2, 6, 5, 13, 13, 2, 4, 5, 11],
        [2, 3, 5, 8, 2, 4, 5, 9, 2, 4, 5, 12, 0],
        [2, 3, 5, 13, 13, 13, 13, 13, 13, 13, 13, 2, 4],
        [2, 3, 5, 13, 2, 4, 5, 0],
    ]
    assert [r.labels for r in got] == [
        [-100] * 10 + [11, 12, 13],
        [-100] * 12 + [11],
        [-100] * 7 + [9, 2, 4, 5, 12, 0],
        [-100] * 13,
        [-100] * 7 + [0],
    ]
    assert [r.reason for r in got] == ["keep", "keep", "keep", "keep", "too_short"]
    assert [r.truncated for r in got] == [True, True, False, True, False]


def test_turn_gaps_and_null_conversations(spark):
    turns = [(1, 0, "user", "q"), (1, 2, "assistant", "a"), (1, 7, "system", "s"), (1, 9, "user", "q2"), (1, 30, "assistant", "a2"),
             (None, 5, "user", "qn"), (None, 8, "assistant", "an"), (2, 3, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, S.turns_to_instructions(df).collect()), key=str)
    assert got == sorted([(1, 0, "q", None, "a"), (1, 9, "q2", "s", "a2"), (None, 5, "qn", None, "an")], key=str)


def test_build_on_a_plain_instruction_table(spark, tmp_path):
    from tessera.plans.sft import build_sft

    rows = [(f"do task number {i}", None if i % 2 else "with this", f"here is the answer to {i}") for i in range(50)]
    rows += [("twice the same task", None, "and twice the same answer")] * 2
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "instruction string, input string, output string").write.parquet(path)
    summary = build_sft(spark, path, out).collect()
    assert sum(r.loaded + r.skipped for r in summary) == 52
    samples = spark.read.parquet(f"{out}/samples")
    assert samples.select("conv_id", "turn").distinct().count() == samples.count() == sum(r.loaded for r in summary)
    manifest = spark.read.parquet(f"{out}/train_manifest")
    assert not {"text", "input_ids", "labels", "instruction"} & set(manifest.columns)


def test_min_tokens_boundary(spark):
    # hash tokens: "### Instruction:\nX\n\n### Response:\nY" has a fixed count; pick min_tokens around it
    df = inst_df(spark, [("X", None, "Y")])
    n = S.sft_samples(df, cfg=SftConfig(min_tokens=1)).first().n_tokens
    assert S.sft_samples(df, cfg=SftConfig(min_tokens=n)).count() == 1
    assert S.sft_samples(df, cfg=SftConfig(min_tokens=n + 1)).count() == 0


def test_null_fields_are_rejected_not_errors(spark):
    df = inst_df(spark, [(None, None, "o"), ("i", None, None)])
    reasons = [r.reason for r in S.sft_samples(df, keep_all=True).collect()]
    assert reasons == ["null_field", "null_field"]


def test_collate_and_supervised(spark):
    rows = [(0, 1, [5, 6, 7], [-100, 6, 7]), (1, 1, [1, 2], [-100, -100]), (2, 1, [9], [9])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, input_ids array<int>, labels array<int>")
    df = df.withColumn("pos", F.col("conv_id")).withColumn("split", F.lit("val"))
    out = S.collate(df, 2).orderBy("pos").collect()
    assert [r.batch_id for r in out] == [0, 0, 1]
    assert out[1].input_ids == [1, 2, 0] and out[1].labels == [-100, -100, -100]
    assert out[1].attention_mask == [1, 1, 0] and out[0].attention_mask == [1, 1, 1]
    assert out[2].input_ids == [9] and out[2].batch_len == 1
    sup = [r.n for r in df.select(S.n_supervised("labels").alias("n")).orderBy("conv_id").collect()]
    assert sup == [2, 0, 0]


def test_sft_split_before_filter_and_summary(spark):
    rows = [(f"instruction number {i}", None, "an answer with words" if i % 7 else "") for i in range(60)]
    df = inst_df(spark, rows)
    split = S.sft_split(df, SftConfig())
    assert split.where("split = 'val'").count() == math.ceil(60 * 0.05)
    summ = {r.split: r for r in S.sft_summary(S.sft_samples(split, cfg=SftConfig(), keep_all=True)).collect()}
    assert sum(r.loaded + r.skipped for r in summ.values()) == 60


# --- manifest ----------------------------------------------------------------

def scalar_manifest(keys, cfg, epochs, seed):
    import hashlib

    n = len(keys)
    nb = n // cfg.batch_size if cfg.drop_last else math.ceil(n / cfg.batch_size)
    out = []
    g = 0
    for e in range(epochs):
        order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{e}:{k}".encode()).hexdigest(), k))
        for micro in range(nb):
            step = g // cfg.grad_accum + 1
            if step > cfg.max_steps:
                return out
            for k in order[micro * cfg.batch_size:(micro + 1) * cfg.batch_size]:
                out.append((k, e, micro, step))
            g += 1
    return out


def test_manifest_matches_scalar_and_resumes(spark):
    cfg = TrainConfig(batch_size=3, grad_accum=4, max_steps=7, seed=5)
    df = spark.range(23).withColumnRenamed("id", "chunk_id")
    man = B.manifest(df, cfg)
    got = sorted((r.chunk_id, r.epoch, r.micro, r.step) for r in man.collect())
    epochs = B.epochs_needed(23, cfg)
    want = sorted(scalar_manifest(list(range(23)), cfg, epochs, 5))
    assert got == want
    nb = 23 // 3
    for start in range(0, 7):
        rest = B.resume_from(man, start, 23, cfg)
        first = rest.orderBy("step", "epoch", "micro").first()
        e, skip = B.resume_point(23, start, cfg)
        assert (first.epoch, first.micro) == (e, skip)
        assert rest.count() == sum(1 for w in want if w[3] > start)
        assert first.resume_epoch == e and e == start * 4 // nb


def test_manifest_without_carry_drops_unfinished_groups(spark):
    cfg = TrainConfig(batch_size=2, grad_accum=3, max_steps=1000, drop_last=False, carry_groups_across_epochs=False)
    df = spark.range(15).withColumnRenamed("id", "chunk_id")
    man = B.manifest(df, cfg, epochs=2).collect()
    # 8 micro-batches per epoch, 2 full groups of 3, the last 2 micro-batches of each epoch dropped
    assert max(r.step for r in man) == 4
    assert {r.micro for r in man} == set(range(6))
    assert sum(1 for r in man if r.epoch == 0) == 12


def test_epoch_order_is_permutation_per_epoch(spark):
    df = spark.range(40).withColumnRenamed("id", "chunk_id")
    out = B.epoch_order(df, ["chunk_id"], 1, 3).collect()
    for e in range(3):
        pos = sorted(r.pos for r in out if r.epoch == e)
        assert pos == list(range(40))
    orders = [tuple(r.chunk_id for r in sorted((r for r in out if r.epoch == e), key=lambda r: r.pos)) for e in range(3)]
    assert len(set(orders)) == 3


def test_a_failed_build_starts_anew(spark, tmp_path, monkeypatch):
    from tessera.plans import sft as plan
    from tessera.sources.io import is_built

    turns, out = f"{'/root/testdata/sf0.001'}/conversations.parquet", str(tmp_path / "sft")

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(plan, "val_batches", broken)
        with pytest.raises(RuntimeError):
            plan.build_sft(spark, turns, out)
    assert is_built(spark, f"{out}/samples") and not is_built(spark, f"{out}/val_batches")
    assert plan.build_sft(spark, turns, out) is not None
    assert all(is_built(spark, f"{out}/{t}") for t in ("samples", "val_batches", "train_manifest"))
    assert plan.build_sft(spark, turns, out) is None
