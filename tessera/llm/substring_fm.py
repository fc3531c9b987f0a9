"""Exact removal of repeated word sequences with compressed FM-indexes.

A word goes if it is covered by a window of ``WINDOW`` words that also starts in a document of
smaller id. The windows that recur are found by backward search in FM-indexes, one per shard:

* **Routing.** The least hash among the ``ANCHOR``-word shingles of a window is its anchor. Equal
  windows have equal anchors, so a shard that has all text around an anchor can decide on its
  windows alone, and each document visits only the shards it has text for. Neighbouring
  windows share an anchor; such a run and the words it covers make a segment.
* **What need not travel.** An anchor that only one row has cannot lead to a repeat. Anchors are
  counted over the corpus (one number for each anchor, combined before the shuffle); segments of the others are
  made by a filter of fixed size, which may let some through that are single after all, or beyond
  ``FILTER_ANCHORS`` shared anchors by a join.
* **Copies.** Equal segments become one row with the least and the largest id that has it.
  An anchor with more than ``HOT_WORDS`` words of different segments (a common line in ever other
  context) is cut into single windows, equal ones again combined, and dealt out by window.
* **Index.** A shard's segments, as word numbers in a row, are sorted by suffix as far as a window
  reaches; the last column of that order is kept as a wavelet matrix (one bit vector a level, with
  counts every 64 bits), which counts a word before a place in as many steps as the alphabet has bits.
* **Matching statistics.** The segments are then streamed against the index: for every place where
  a window can end, the match is extended to the left word by word while anything else matches,
  at most to a window's length. Places that reach it report the interval of their rows, and the
  least id in it. A segment that is alone with its anchor needs no search.

The reported windows return to the documents by segment, and one pass rewrites the texts.

Null or empty text: no words. Null id: larger than every other, so nothing counts as seen before
because of it. Rows of equal id never remove anything of each other; equal rows get equal
results. A window that recurs in its own document only stays. Empty table: empty result. Ids are integers;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SpanHashes, hash_filter, may_hold, mixed, portions, slices, spans_within, sql_type, table
from tessera.session import materialize

WINDOW = 13
ANCHOR = 5
RUN = 64  # windows in a segment at most
SHARD_WORDS = 1_000_000  # words of an index, about
HOT_WORDS = SHARD_WORDS // 8
BROADCAST_HOT = 100_000
FILTER_ANCHORS = 1 << 25
FILTER_BITS = 28  # the filter takes 2**28 bits at most: 32 MB
BLOCK = 200_000  # windows searched together
LAST = (1 << 63) - 1  # stands for a null id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Words:
    """The words of a batch of texts, found and hashed on its bytes: white space is one byte each in UTF-8.

    ``starts`` and ``ends`` are places in ``data``, ``of_text`` the first word of each text and the end.
    Equal words have equal hashes; what is found by them is compared as text later.
    """

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        buffer = texts.buffers()[2]
        self.data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8)
        offsets -= offsets[0]
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = (self.data != 0x20) & ((self.data - np.uint8(9)) > 4)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.starts = np.nonzero(word[1:] & (~word[:-1] | edge))[0]
        self.ends = np.nonzero(word[:-1] & (~word[1:] | edge))[0]
        self.of_text = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return SpanHashes(self.data).of(self.starts, self.ends)

    def segments(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word, number of windows and anchor of every segment: neighbours of one anchor, ``RUN`` at most."""
        at = spans_within(self.of_text, window)
        if not len(at):
            return (*np.empty((3, 0), np.int64), np.empty(0, np.uint64))
        anchors = window_anchors(self.hashes(), window, anchor)[at]
        change = np.nonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (np.diff(at) > 1)]))[0]
        starts, sizes = _cut(change, np.diff(change, append=len(at)))
        first = at[starts]
        return np.searchsorted(self.of_text, first, "right") - 1, first, sizes, anchors[starts]

    def text(self, first: np.ndarray, n: np.ndarray) -> list[str]:
        """``n`` words from ``first`` on, joined by one space each."""
        single = np.zeros(len(self.starts), np.int64)  # words that are not followed by just a space
        single[:-1] = (self.starts[1:] != self.ends[:-1] + 1) | (self.data[np.minimum(self.ends[:-1], len(self.data) - 1)] != 0x20)
        odd = np.append(0, np.cumsum(single))
        raw, last = self.data.tobytes(), first + n - 1
        rows = zip(self.starts[first].tolist(), self.ends[last].tolist(), (odd[last] > odd[first]).tolist())
        return [(b" ".join(raw[x:y].split()) if mixed else raw[x:y]).decode() for x, y, mixed in rows]


def window_anchors(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of every window: the least mixed hash among its shingles of ``anchor`` words."""
    n = len(h) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    s = np.zeros(len(h) - anchor + 1, np.uint64)
    for k in range(anchor):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(s)]
    s = mixed(s)
    span, width = 1, window - anchor + 1
    while 2 * span <= width:
        s = np.minimum(s[:-span], s[span:])
        span *= 2
    return np.minimum(s[:n], s[width - span : width - span + n])


def _cut(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut into pieces of ``RUN`` at most."""
    if not len(sizes) or sizes.max() <= RUN:
        return starts, sizes
    cuts = -(-sizes // RUN)
    piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    return np.repeat(starts, cuts) + RUN * piece, np.minimum(np.repeat(sizes, cuts) - RUN * piece, RUN)


class WaveletMatrix:
    """Symbols as bit vectors, highest bit first; each level deals the order out by its bit, stably."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(len(symbols) - int(ones.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.firsts = self._follow(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = (symbols >> (self.levels - 1 - k) & 1).astype(bool)
            word = at >> 6
            below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``at``."""
        return self._follow(symbols, at) - self.firsts[symbols]


class FmIndex:
    """Backward search over symbols in a row; 0 separates texts and ends the row. Rows are in suffix order as far as ``depth``."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.symbols, n = symbols, len(symbols)
        alphabet = int(symbols.max()) + 1 if n else 1
        rank, width = symbols.astype(np.int64), 1
        while width < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            _, rank = np.unique(rank * (n + alphabet + 1) + after, return_inverse=True)
            width *= 2
        self.rows = np.argsort(rank, kind="stable")
        self.matrix = WaveletMatrix(symbols[self.rows - 1], alphabet)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])

    def matches(self, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the row's own places: for each end (exclusive), how far to its left, at most
        ``longest``, the row holds the same more than once, and the rows (from, to) of what is matched then.

        The symbols before each end, ``longest`` of them, must lie in one text.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros((2, len(ends)), np.int64)
        active, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), len(self.symbols))
        for k in range(1, longest + 1):
            c = self.symbols[ends[active] - k]
            if k == 1:
                lo, hi = self.starts[c], self.starts[c + 1]
            else:
                both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
                lo, hi = self.starts[c] + both[: len(c)], self.starts[c] + both[len(c) :]
            again = hi - lo > 1  # its own place always matches
            active, lo, hi = active[again], lo[again], hi[again]
            length[active], low[active], high[active] = k, lo, hi
        return length, low, high


class WordNumbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


def first_ids(segments: list[list[str]], least: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of every segment, the least id of the segments that hold it."""
    if not segments:
        return []
    numbers, sizes = WordNumbers(), np.array([len(s) for s in segments], np.int64)
    symbols = np.zeros(int(sizes.sum()) + len(segments), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for s, at in zip(segments, starts.tolist()):
        symbols[at : at + len(s)] = [numbers[w] for w in s]
    index = FmIndex(symbols, window)
    id_of_row = np.repeat(least, sizes + 1)[index.rows]
    n_windows = sizes - window + 1
    first = np.repeat(least, n_windows)
    ends = np.repeat(starts + window - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(len(first))
    for block in range(0, len(ends), BLOCK):
        length, low, high = index.matches(ends[block : block + BLOCK], window)
        whole = np.nonzero(length == window)[0]
        if not len(whole):
            continue
        # equal windows have equal intervals, and different ones none in common
        low_of, place = np.unique(low[whole], return_inverse=True)
        high_of = np.zeros(len(low_of), np.int64)
        high_of[place] = high[whole]
        bounds = np.stack([low_of, high_of], 1).ravel()
        if bounds[-1] == len(id_of_row):
            bounds = bounds[:-1]
        first[block + whole] = np.minimum.reduceat(id_of_row, bounds)[::2][place]
    return np.split(first, np.cumsum(n_windows)[:-1])


def _narrow(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return docs.select(*more, key.alias("key"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def row_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct anchors, as (row, anchor) in the order of the anchors."""
    rows, _, _, anchors = words.segments(window, anchor)
    order = np.argsort(anchors, kind="stable")
    rows, anchors = rows[order], anchors[order]
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])])[: len(rows)]
    return rows[new], anchors[new]


def shared_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``anchor``: those that more than one row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            _, anchors = row_anchors(Words(part.column("text")), window, anchor)
            first = np.nonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])[: len(anchors)])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[first].view(np.int64)), pa.array(np.diff(first, append=len(anchors)))], ["anchor", "n"])

    counts = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").select("anchor")


_SEGMENT = "key long, text_hash long, at long, anchor long, words string"


def _segments(docs: DataFrame, window: int, anchor: int, wanted) -> DataFrame:
    """Segments of every whole text whose anchors ``wanted(batch, rows, anchors)`` says yes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            words = Words(part.column("text"))
            found = words.segments(window, anchor)
            keep = wanted(part, found[0], found[3])
            rows, first, sizes, anchors = (x[keep] for x in found)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(take), part.column("text_hash").take(take), pa.array(first - words.of_text[rows]),
                 pa.array(anchors.view(np.int64)), pa.array(words.text(first, sizes + window - 1), pa.string())],
                ["key", "text_hash", "at", "anchor", "words"])

    return docs.mapInArrow(run, _SEGMENT)


def segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``key, text_hash, at, anchor, words``: text around the anchors that more than one row has, and maybe some others."""
    spark = docs.sparkSession
    shared = materialize(shared_anchors(docs, window, anchor), "shared-anchors")
    n = shared.count()
    if n <= FILTER_ANCHORS:
        bits = max(15, min(FILTER_BITS, (64 * n).bit_length()))
        bitmap = spark.sparkContext.broadcast(hash_filter(shared, "anchor", bits))
        return _segments(docs, window, anchor, lambda part, rows, anchors: may_hold(bitmap.value, bits, anchors))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            rows, anchors = row_anchors(Words(part.column("text")), window, anchor)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(take), part.column("text_hash").take(take), pa.array(anchors.view(np.int64))],
                ["key", "text_hash", "anchor"])

    held = (docs.mapInArrow(own, "key long, text_hash long, anchor long").join(shared, "anchor")
            .groupBy("key", "text_hash").agg(F.collect_set("anchor").alias("anchors")))

    def listed(part: pa.RecordBatch, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        lists = part.column("anchors")
        own = pd.MultiIndex.from_arrays([lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()])
        return pd.MultiIndex.from_arrays([rows, anchors.view(np.int64)]).isin(own)

    return _segments(docs.join(held, ["key", "text_hash"]), window, anchor, listed)


def _marks(parts: DataFrame, shards: int, window: int) -> DataFrame:
    """``anchor, segment, first``: the first ids of the windows of segments in which some document repeats one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]  # one shard: about SHARD_WORDS words
        if not found:
            return
        shard = pa.Table.from_batches(found)
        least, largest, anchors = (shard.column(c).to_numpy() for c in ("least", "largest", "anchor"))
        # a segment alone with its anchor shares no window with another one
        which, counts = np.unique(anchors, return_inverse=True, return_counts=True)[1:]
        several = np.nonzero(counts[which] > 1)[0]
        first: list = least.tolist()  # an int stands for all windows of a segment
        words = shard.column("words").take(pa.array(several)).to_pylist()
        for k, ids in zip(several.tolist(), first_ids([w.split(" ") for w in words], least[several], window)):
            first[k] = ids
        keep = [k for k, f in enumerate(first) if (f if isinstance(f, int) else f.min()) < largest[k]]
        sizes = shard.column("n_words").to_numpy() - window + 1
        out = shard.select(["anchor", "segment"]).take(pa.array(keep, pa.int64()))
        for start in range(0, len(keep), 10_000):
            some = out.slice(start, 10_000)
            lists = [np.full(sizes[k], first[k]) if isinstance(first[k], int) else first[k] for k in keep[start : start + 10_000]]
            offsets = np.cumsum([0, *map(len, lists)])
            yield pa.RecordBatch.from_arrays(
                [*[some.column(c).combine_chunks() for c in ("anchor", "segment")],
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists)))],
                ["anchor", "segment", "first"])

    dealt = parts.select("anchor", "segment", "words", "n_words", "least", "largest", "route").repartition(shards, "route")
    return dealt.mapInArrow(run, "anchor long, segment long, first array<long>")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     anchor: int = ANCHOR) -> DataFrame:
    """``key, text_hash, starts``: for each document (by id and text) the windows that start in one of smaller id as well."""
    spark = docs.sparkSession
    docs = _narrow(docs, id_col, text_col)
    found = segments(docs, window, anchor)
    found = found.withColumn("segment", F.xxhash64("words"))
    n_words = F.size(F.split("words", " ", -1))
    distinct = materialize(
        found.groupBy("anchor", "segment", "words").agg(F.min("key").alias("least"), F.max("key").alias("largest"))
        .withColumn("n_words", n_words), "segments")
    total = distinct.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    hot = materialize(distinct.groupBy("anchor").agg(F.sum("n_words").alias("n")).where(F.col("n") > HOT_WORDS).select("anchor"), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
        words = F.split("words", " ", -1)
        windows = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda k: F.array_join(F.slice(words, k, window), " "))
        single = (distinct.join(few, "anchor").select("anchor", "segment", "least", "largest", F.posexplode(windows).alias("at", "words"))
                  .withColumn("window", F.xxhash64("words")))
        each = single.groupBy("anchor", F.col("window").alias("segment"), "words").agg(
            F.min("least").alias("least"), F.max("largest").alias("largest")).withColumn("n_words", F.lit(window))
        cold = distinct.join(few, "anchor", "left_anti")
        parts = cold.withColumn("route", F.col("anchor")).unionByName(each.withColumn("route", F.col("segment")))
        marks = materialize(_marks(parts, shards, window), "repeats")
        of_window = marks.withColumnRenamed("segment", "window")
        marks = (marks.join(few, "anchor", "left_anti").select("anchor", "segment", F.lit(0).alias("offset"), "first")
                 .unionByName(single.join(of_window, ["anchor", "window"]).select("anchor", "segment", F.col("at").alias("offset"), "first")))
    else:
        marks = _marks(distinct.withColumn("route", F.col("anchor")), shards, window).withColumn("offset", F.lit(0))
    starts = F.filter(
        F.transform("first", lambda f, k: F.when(f < F.col("key"), F.col("at") + F.col("offset") + k)), lambda x: x.isNotNull())
    return (
        found.select("key", "text_hash", "at", "anchor", "segment").join(marks, ["anchor", "segment"])
        .select("key", "text_hash", starts.alias("starts")).where(F.size("starts") > 0)
        .groupBy("key", "text_hash").agg(F.array_sort(F.flatten(F.collect_set("starts"))).alias("starts"))
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """``id, n_words, n_removed, kept``: ``kept`` are the words that stay, joined by one space."""
    repeats = repeated_windows(docs, id_col, text_col, window, anchor)
    texts = _narrow(docs, id_col, text_col, F.col(id_col).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            kept, n_words, n_removed = [], [], []
            starts = part.column("starts")
            for row, text in enumerate(part.column("text").to_pylist()):
                words = WORD.findall(text or "")
                n_words.append(len(words))
                if starts[row].is_valid:
                    covered = np.zeros(len(words) + 1, np.int64)
                    at = starts[row].values.to_numpy()
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + window, -1)
                    covered = np.cumsum(covered)[: len(words)] > 0
                    words = [w for w, gone in zip(words, covered.tolist()) if not gone]
                n_removed.append(n_words[-1] - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept"])

    joined = texts.join(repeats, ["key", "text_hash"], "left").select("id", "text", "starts")
    return joined.mapInArrow(run, f"id {sql_type(texts, 'id')}, n_words long, n_removed long, kept string")


def op13_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, k, array_to_string(words[k:k + 12], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM split)
), firsts AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM windows JOIN firsts USING (w) WHERE first_id < doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
