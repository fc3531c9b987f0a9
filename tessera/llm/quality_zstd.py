"""Quality by compression: zstandard dictionaries of good and bad labelled text.

Texts are cut into blocks of a few kilobytes. From a bounded sample of labelled blocks of
each class a dictionary is trained. A block is compressed with either dictionary; the
difference of the sizes, over the block's length, says which class it resembles, and the
size itself how repetitive it is. A document's sums over all its blocks, and its worst
block, feed a logistic calibration, fitted to a bounded sample of labelled documents, that
turns them into a probability. Blocks are compressed one by one so that a dictionary counts as much at the
end of a long text as at its start.

Only the text is looked at. Null, empty and blank texts have no block; their score is
``EMPTY_SCORE``. Repeated rows: one result each. Null id: kept, in no fold. Rows without a
label, or with a null one, are not learned from; with no label of one of the classes every
score is the share of the other. Empty tables: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, crc_fold, cut, sampled_texts, sql_type, table

SAMPLE = (3000, 3000)  # labelled documents of class 0 and 1 that are learned from, at most
BLOCK = 1024  # bytes compressed at a time
BLOCKS_PER_CLASS = 6000  # blocks a dictionary is trained on, at most: 6 MB
DICTIONARY = 64 * 1024
LEVEL = 3
THRESHOLD = 0.3
EMPTY_SCORE = 0.0


def blocks(text: bytes) -> list[bytes]:
    """The text in blocks of about equal length, none longer than ``BLOCK``."""
    n = -(-len(text) // BLOCK)
    return [text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n)]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary; where there is too little text to train one, the text itself."""
    import zstandard

    if not samples:
        return b""

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Measure:
    """Compressed sizes under the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        import zstandard

        self.compress = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content) if content else None
            if d is not None:
                d.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: bytes) -> tuple[float, ...]:
        """Bytes; under the good and the bad dictionary; in blocks the bad one shortens more; the worst gap; what it saves there."""
        good = bad = lost = saved = 0
        worst = 0.0
        for k, b in enumerate(blocks(text)):
            g, w = len(self.compress[0](b)), len(self.compress[1](b))
            good, bad = good + g, bad + w
            if w < g:
                lost, saved = lost + len(b), saved + g - w
            gap = (g - w) / (len(b) + 64)  # a few bytes cannot be the worst block
            worst = gap if k == 0 else max(worst, gap)
        return float(len(text)), float(good), float(bad), float(lost), worst, float(saved)


def design(sizes: np.ndarray) -> np.ndarray:
    """Model inputs: the normalised difference of sizes, linear and saturated; size; the bad blocks; length."""
    n = np.maximum(sizes[:, 0], 1)
    gap, size, log = (sizes[:, 2] - sizes[:, 1]) / n, sizes[:, 1] / n, np.log(n) / 10
    return np.stack([gap, np.tanh(20 * gap), size, size * size, sizes[:, 3] / n, log, gap * log, sizes[:, 4], sizes[:, 5] / n], axis=1)


INPUTS = 9


def calibrate(sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression on standardised inputs by Newton's method; bias first, for inputs as they are."""
    x = design(sizes)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.concatenate([np.ones((len(x), 1)), (x - mean) / spread], axis=1), np.zeros(INPUTS + 1)
    pull = np.concatenate([[1e-6], np.full(INPUTS, ridge)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weights * (p - labels)) + pull * w
        curvature = (z * (weights * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        move = np.linalg.solve(curvature, gradient)
        w = w - move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-7:
            break
    slopes = w[1:] / spread
    return np.concatenate([[w[0] - slopes @ mean], slopes])


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _sizes(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` columns, the measured ``sizes`` of the binary column ``text`` and the model's ``score`` of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    types = ", ".join(f"{c} {sql_type(docs, c)}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        measure = Measure(m.good, m.bad)
        for b in batches:
            found = np.array([measure(t.as_buffer().to_pybytes()) if t.is_valid else (0.0,) * 6 for t in b.column(0)])
            found = found.reshape(-1, 6)
            p = np.full(len(found), EMPTY_SCORE)
            if m.weights:
                p = 1 / (1 + np.exp(-np.clip(m.weights[0] + design(found) @ np.array(m.weights[1:]), -30, 30)))
                p[found[:, 0] == 0] = EMPTY_SCORE
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.tolist(), pa.list_(pa.float64())), pa.array(p), *b.columns[1:]], ["sizes", "score", *keep])

    return docs.select("text", *keep).mapInArrow(run, f"sizes array<double>, score double, {types}")


def _sample_blocks(rows: DataFrame, most: int = BLOCKS_PER_CLASS) -> tuple[list[bytes], list[bytes]]:
    """Blocks of class 0 and class 1, at most ``most`` of each, by lowest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cuts = blocks(text or b"")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cuts, pa.binary()), pa.array([label] * len(cuts), pa.int32())], ["block", "label"])

    found = rows.select("text", "label").mapInArrow(run, "block binary, label int").distinct()
    out = []
    for c in (0, 1):
        picked = found.where(F.col("label") == c).orderBy(F.xxhash64("block"), "block").limit(most).collect()
        out.append([bytes(r["block"]) for r in picked])
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample: tuple[int, int] = SAMPLE) -> Model:
    """Dictionaries from the whole sample; calibration from each half measured with the other half's dictionaries."""
    usable = labels.where((crc_fold(F.col(id_col)) != 0) & F.col(label).isin(0, 1)).select(id_col, label).distinct()
    usable = cut(usable)
    counts = {r[label]: r["count"] for r in usable.groupBy(label).count().collect()}
    picked = cut(bounded_sample(usable, id_col, label, sample))
    half = F.pmod(F.xxhash64(F.col("text"), F.lit("half")), F.lit(2))  # equal texts fall into one half
    rows = sampled_texts(docs, picked, id_col, F.col(text_col).cast("binary"), label)
    rows = cut(rows.withColumn("half", half))
    samples = [_sample_blocks(rows.where(F.col("half") == h)) for h in (0, 1)]
    bad, good = (samples[0][c] + samples[1][c] for c in (0, 1))
    whole = Model(train_dictionary(good), train_dictionary(bad), ())
    measured = [
        _sizes(rows.where((F.col("half") == 1 - h) & (F.length("text") > 0)), ["label"],
               Model(train_dictionary(samples[h][1]), train_dictionary(samples[h][0]), ())).toPandas()
        for h in (0, 1) if samples[h][0] and samples[h][1]
    ]
    y = np.concatenate([x["label"].to_numpy(float) for x in measured] or [np.empty(0)])
    if len(set(y.tolist())) < 2:
        p = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(whole.good, whole.bad, (float(np.log(p / (1 - p))),) + (0.0,) * INPUTS)
    # each class weighs in the fit what it weighs among all labelled rows
    share = {c: counts[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weights = np.where(y == 1, share[1], share[0]) * len(y) / sum(counts.values())
    sizes = np.array([v for x in measured for v in x["sizes"].tolist()])
    return Model(whole.good, whole.bad, tuple(calibrate(sizes, y, weights).tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, size_gap``: the probability that each whole text is good, and the normalised difference of sizes."""
    narrow = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    n, good, bad = (F.col("sizes")[k] for k in range(3))
    gap = F.when(n > 0, (bad - good) / F.greatest(n, F.lit(1.0))).otherwise(0.0)
    return _sizes(narrow, ["id"], model).select("id", "score", gap.alias("size_gap"))


def op1_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), (crc_fold(F.col("id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "size_gap")
