"""Packing by power-of-two decomposition.

A document's ids (with the end id appended) are cut into as many full sequences as fit
and one piece for each set bit of what is left, longest first: 5,000 ids with a limit of
4,096 give pieces of 4096, 512, 256, 128 and 8. Every piece is a sequence of its own, its
length is a power of two, and sequences of equal length share a bucket, so batches have
one shape, nothing is padded and no sequence crosses documents.

Tokenising and cutting happen in one pass without a shuffle. The tokenizer's rules never
join characters across white space, nor letters and signs, so a worker remembers the ids of
words, and of the runs of letters or signs within them, and hands each new run to the
tokenizer once, thousands of them as one text; both memos are bounded, and a word of one
run is in the runs' only. Arrow splits the texts, finds the different words of a portion and
puts their ids together; what it keeps of memory is given back after each portion.

Null text: empty, so the document is its end id alone. Repeated rows: each packed on its
own, under its own sequence ids. Null id: kept. Empty table: empty result. Other columns
are ignored.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import portions, sql_type, table, worker_memo

MAX_LENGTH = 4096
END_ID = 2
MEMO = 250_000  # words, and as many runs, that a worker remembers at most; each takes about 150 bytes
MEMO_CHARS = 48  # longer words are not remembered
PORTION = 4 << 20  # bytes of text whose different words are looked up together
#: White space as the tokenizer's \s has it; Arrow also splits at 1C-1F, which \s does not match.
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
#: Words whose runs can be told without the tokenizer: of Latin-1, and without its special tokens.
_LATIN = re.compile(r"[!-~\xa1-\xff]+\Z")
# Fixed value: the tokenizer's splitting pattern, for lower-cased Latin-1.
_RUN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9²³¹¼½¾]|[^a-zß-öø-ÿªµº0-9²³¹¼½¾]+"
)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """String -> ids, in two generations: when the young one is full it becomes the old one, and what is used again returns."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, strings: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of different strings, now all of the young generation, and the places of the others."""
        found = list(map(self.young.get, strings))
        back = {}
        new = []
        for k in [k for k, x in enumerate(found) if x is None]:
            found[k] = x = self.old.get(s := strings[k])
            if x is None:
                new.append(k)
            else:
                back[s] = x
        if len(self.young) + len(back) + len(new) > MEMO // 2:
            self.old, self.young = self.young, {s: x for s, x in zip(strings, found) if x is not None}
        else:
            self.young.update(back)
        return found, new

    def learn(self, ids: dict[str, bytes]) -> None:
        """Keep strings that are new, the long ones apart."""
        self.young.update(ids)
        for s in ids:
            if len(s) > MEMO_CHARS:
                del self.young[s]
        if len(self.young) > MEMO // 2:  # one portion held more than the memo may
            self.young = {}


def split_words(texts: pa.Array) -> pa.ListArray:
    """Words as the tokenizer's \\s parts them, and empty ones where a text begins or ends with white space."""
    if pc.any(pc.match_substring_regex(texts, r"[\x1c-\x1f]")).as_py():
        return pa.array([_SPACE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


class WordMemo:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        #: For runs joined by spaces: the same model, held once, without the search for runs.
        self.run_tokenizer = Tokenizer(self.tokenizer.model)
        self.run_tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        self.ends_run = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_run[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words, self.runs = Memo(), Memo()

    def encode(self, texts: list[str]) -> list[bytes]:
        data, at = self.joined(pa.array(texts, pa.string()))
        return [bytes(data[a:b]) for a, b in pairwise(at.tolist())]

    def joined(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Buffer | bytes, np.ndarray]:
        """The ids of all texts, one after another and ``end`` after each; the byte at which each text's begin, and the last end.

        Arrow splits the texts, finds the different words and puts the ids together; Python sees each word once.
        """
        split = split_words(texts)
        words = split.flatten().dictionary_encode()
        ids = self.of_words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = split.offsets.to_numpy()
        places = np.insert(words.indices.to_numpy(), ends[1:], len(ids))  # ``end`` counts as a word more
        out = pa.array([*ids, end], pa.binary()).take(pa.array(places))
        at = np.frombuffer(out.buffers()[1], np.int32, len(out) + 1)
        return out.buffers()[2] or b"", at[ends + np.arange(len(ends))]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, all different; those of one run are remembered as runs only."""
        single = [w.lower() if w.isalpha() and (w.isascii() or _LATIN.match(w)) else None for w in words]
        others = [w for w, r in zip(words, single) if r is None]
        found, places = self.words.known(others)
        odd, several = [], {}  # those left whole, and those of several runs
        for w in map(others.__getitem__, places):
            if not _LATIN.match(w) or "<|" in w:
                odd.append(w)
            else:
                several[w] = _RUN.findall(w.lower())
        runs = self.of_runs(list({*filter(None, single), *chain.from_iterable(several.values())}))
        whole = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        new = {w: pack_ids(x.ids) for w, x in zip(odd, whole)}
        new.update((w, b"".join([runs[r] for r in x])) for w, x in several.items())
        for k in places:
            found[k] = new[others[k]]
        self.words.learn(new)
        rest = iter(found)
        return [next(rest) if r is None else runs[r] for r in single]

    def of_runs(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs, all different; new ones are found as one text's: the last token of a run is one that ends runs."""
        found, places = self.runs.known(runs)
        new = {}
        for start in range(0, len(places), 4096):
            part = [runs[k] for k in places[start : start + 4096]]
            encoded = self.run_tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, "<u4")
            blob, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends_run[ids]) + 4).tolist()
            new.update(zip(part, [blob[a:b] for a, b in pairwise([0, *ends])], strict=True))
        self.runs.learn(new)
        return dict(zip(runs, found)) | new


def pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Full sequences, then the binary digits of the rest from the highest."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per sequence: ``id, start, length, doc_tokens, ids, sequence_id, bucket``.

    ``ids`` holds little-endian unsigned 32-bit integers; ``bucket`` is log2 of the length.
    ``sequence_id`` is unique: it numbers rows within their partition of the pass.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(("packing", tokenizer), lambda: WordMemo(tokenizer))
        lengths_of = cache(lambda rest: piece_lengths(rest, max_length))
        for part in portions(batches, "text", PORTION):
            data, at = memo.joined(part.column("text").fill_null(""), end)
            first = at // 4
            totals = np.diff(first)
            cuts = [[max_length] * (n // max_length) + lengths_of(n % max_length) for n in totals.tolist()]
            row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            lengths = np.fromiter(chain.from_iterable(cuts), np.int64)
            ends = np.cumsum(lengths)  # pieces follow one another as the ids do
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), data])
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(row)), pa.array(ends - lengths - first[row]),
                 pa.array(lengths), pa.array(totals[row].astype(np.int64)), blobs],
                ["id", "start", "length", "doc_tokens", "ids"],
            )
            pa.default_memory_pool().release_unused()  # else the pool keeps what the largest portion took

    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {sql_type(docs, id_col)}, start long, length long, doc_tokens long, ids binary"
    )
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn(
        "bucket", F.log2("length").cast("int")
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """The contract's columns: one row per piece, with the checksum of its ids."""
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket",
    )


def op5_packing_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_file()))
