"""Cross-tokenizer alignment with white-space anchors.

A text is encoded whole by two tokenizers, and every token gets the bytes it stands for. Both
token sequences then cover the same bytes. Wherever a token of each that is marked with a leading
space starts at the same byte, the tokens before it end together: a verified shared end. These
anchors cut a document into windows, mostly of one word, and a window's alignment depends on
nothing but its token ids, so a worker computes it once for each pair of id tuples and remembers it.

Inside a window tokens of A and B whose byte ranges overlap are linked (between two neighbouring
ends of either side lies one pair), and byte offsets at which both end close a group. No link or group crosses an
anchor.

``align`` is one pass without a shuffle. Links are then counted over the corpus (in how many
documents an id pair is linked; combined before the shuffle), and each document's links are scored
with those counts: from a broadcast table while the pairs number at most ``BROADCAST_PAIRS``, beyond
it by a join.

Null or empty text, and a text whose tokens do not give back its bytes (as where a tokenizer
normalises): no tokens, zeros, empty groups. Repeated rows: each is a document of its own and counts
as one. Null id: kept. Empty table: empty result. Ties among an id's best partners all count. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, sql_type, table, worker_memo
from tessera.session import materialize

BROADCAST_PAIRS = 2_000_000  # of 17 bytes
MEMO_TOKENS = 2_000_000  # tokens in the windows that a worker remembers at most

#: Characters whose classes are the same in every Unicode version a tokenizer may have been built with.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₹]")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def tokenizer_files() -> dict[str, str]:
    """A's vocabulary as a ``tokenizers`` file and as ranks, and B's ``sentencepiece`` model."""
    import public_tokenizers as p

    return {"a_json": p.path("byte_bpe_50k.json"), "a_ranks": p.path("byte_bpe_50k.tiktoken"), "b_model": p.path("piece_bpe_32k.model")}


class Side:
    """One tokenizer's entries as bytes, with their lengths and whether a space comes first."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.spaced = np.array([e[:1] == b" " for e in entries])
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.first = np.cumsum(self.lengths) - self.lengths

    def spells(self, ids: np.ndarray, raw: np.ndarray, block: int = 200_000) -> bool:
        """Whether the tokens' bytes, joined, are ``raw``; a block of tokens at a time."""
        at = 0
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            got = self.bytes[_flat(self.first[part], self.lengths[part])]
            if not np.array_equal(got, raw[at : at + len(got)]):
                return False
            at += len(got)
        return at == len(raw)


def _ids(tokens: list[int]) -> np.ndarray:
    return np.frombuffer(array("H", tokens), np.uint16)


class Tokenizers:
    """Both tokenizers, whole texts to ids."""

    def __init__(self, files: dict[str, str]):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.files = files
        with open(files["a_ranks"], "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.a_ranks = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=files["b_model"])
        a = [b""] * (max(ranks.values()) + 1)
        for entry, k in ranks.items():
            a[k] = entry
        b = []
        for k in range(self.b_model.get_piece_size()):
            piece = self.b_model.id_to_piece(k)
            byte = _BYTE_PIECE.match(piece)
            b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        if max(len(a), len(b)) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.a, self.b = Side(a), Side(b)

    @cached_property
    def a_json(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        out = Tokenizer.from_file(self.files["a_json"])
        out.encode_special_tokens = True
        return out

    def encode_a(self, text: str) -> np.ndarray:
        """The ranks give the ids of the file, several times faster, where Unicode versions cannot differ."""
        if _OTHER.search(text):
            return _ids(self.a_json.encode(text, add_special_tokens=False).ids)
        return _ids(self.a_ranks.encode_ordinary(text))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A (of a space and the text) and of B (which adds the space), or None without tokens."""
        out = []
        for text, b in zip(texts, self.b_model.encode(texts, num_threads=1)):
            if not text:
                out.append(None)
                continue
            spaced = " " + text
            a, b, raw = self.encode_a(spaced), _ids(b), np.frombuffer(spaced.encode(), np.uint8)
            out.append((a, b) if self.a.spells(a, raw) and self.b.spells(b, raw) else None)
        return out


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + size - 1`` of every slice, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type = np.int64):
        self.array, self.n = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.array):
            longer = np.empty(n + n // 2, self.array.dtype)
            longer[: self.n] = self.array[: self.n]
            self.array = longer
        self.array[self.n : n] = values
        self.n = n


def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """The digits of every 16-bit number, from the left, with room for a sign after them; how many they are."""
    n = np.arange(1 << 16)
    length = 1 + sum((n >= 10**k).astype(np.int64) for k in range(1, 5))
    digits = np.zeros((len(n), 6), np.uint8)
    for k in range(5):
        digits[:, k] = ord("0") + n // 10 ** np.maximum(length - 1 - k, 0) % 10
    return digits, length


_DIGITS, _N_DIGITS = _decimals()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # odd; any two would do


class Sequences:
    """Token ids of both sides over the same bytes, of several texts or windows in a row."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sides: Tokenizers):
        self.a, self.b, self.sides = a, b, sides
        self.a_ends, self.b_ends = np.cumsum(sides.a.lengths[a]), np.cumsum(sides.b.lengths[b])

    def windows(self, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows start at ``firsts`` and where a space-marked token of each side does: their bytes, their first tokens."""
        marks = np.zeros(int(self.a_ends[-1]) + 1, np.uint8)
        starts = []
        for bit, ids, ends, side in ((1, self.a, self.a_ends, self.sides.a), (2, self.b, self.b_ends, self.sides.b)):
            starts.append(ends - side.lengths[ids])
            marks[starts[-1][side.spaced[ids]]] |= bit
        marks[firsts] = 3
        return np.flatnonzero(marks == 3), *(np.flatnonzero(marks[x] == 3) for x in starts)

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes at which a token ends, whether both sides' do, and the token of each side that lies before it.

        Between two of them lies one overlapping pair.
        """
        marks = np.zeros(int(self.a_ends[-1]) + 1, np.uint8)
        marks[self.a_ends] = 1
        marks[self.b_ends] |= 2
        at = np.flatnonzero(marks)
        marks = marks[at]
        a_ends, b_ends = marks & 1, marks >> 1
        return at, marks == 3, np.cumsum(a_ends, dtype=np.int64) - a_ends, np.cumsum(b_ends, dtype=np.int64) - b_ends

    def written(self, a_last: np.ndarray, b_last: np.ndarray) -> tuple[str, np.ndarray]:
        """Groups, whose last tokens are given, as one string with a ``;`` after each, and where each ends in it."""
        n_a, n_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        # a group's tokens of A stand after all earlier groups' of B, its tokens of B after its own of A
        a_place = np.arange(len(self.a)) + np.repeat(b_last + 1 - n_b, n_a)
        b_place = np.arange(len(self.b)) + np.repeat(a_last + 1, n_b)
        ids, signs = np.empty(len(self.a) + len(self.b), np.uint16), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a, self.b
        signs[a_place[a_last]], signs[b_place[b_last]] = ord("|"), ord(";")
        rows, n = _DIGITS[ids], _N_DIGITS[ids]
        rows[np.arange(len(ids)), n] = signs
        return rows[np.arange(6) <= n[:, None]].tobytes().decode("ascii"), np.cumsum(n + 1)[b_place[b_last]]


class Windows:
    """Alignments of windows by their id tuples; bounded, emptied between texts.

    A window is looked up by a 64-bit number of its id tuples and then compared with the ids that are remembered; one whose
    number belongs to other ids is aligned without being remembered.
    """

    def __init__(self, files: dict[str, str]):
        self.tokenizers = Tokenizers(files)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.texts: list[str] = []  # each window's groups
        self.n_groups, self.n_links, self.first_link, self.links = Grown(), Grown(), Grown(), Grown()
        self.ids = Grown(np.uint16), Grown(np.uint16)
        self.first_id, self.n_ids = (Grown(), Grown()), (Grown(np.int32), Grown(np.int32))
        self.tokens = 0

    def learn(self, keys: list[int], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Align new windows, whose tokens are given in a row, and remember them, by ``keys`` if there are any."""
        new = Sequences(a, b, self.tokenizers)
        at, both, a_of, b_of = new.ends()
        text, text_ends = new.written(a_of[both], b_of[both])
        ends = new.a_ends[np.cumsum(n_a) - 1]
        last_link, last_group = np.searchsorted(at, ends, "right"), np.searchsorted(at[both], ends, "right")
        self.n_groups.extend(np.diff(last_group, prepend=0))
        self.n_links.extend(np.diff(last_link, prepend=0))
        self.first_link.extend(self.links.n + np.concatenate([[0], last_link[:-1]]))
        self.links.extend(_codes(a[a_of], b[b_of]))
        for ids, first, sizes, x, n in zip(self.ids, self.first_id, self.n_ids, (a, b), (n_a, n_b)):
            first.extend(ids.n + np.cumsum(n) - n)
            sizes.extend(n)
            ids.extend(x)
        self.known.update(zip(keys, range(len(self.texts), len(self.texts) + len(keys))))
        bounds = [0, *text_ends[last_group - 1].tolist()]
        self.texts += [text[x : y - 1] for x, y in zip(bounds, bounds[1:])]
        self.tokens += len(a) + len(b)

    def numbers(self, a: np.ndarray, b: np.ndarray, at: tuple[np.ndarray, np.ndarray], n: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A number of each window's id tuples: polynomials of the ids of both sides, modulo 2**64."""
        out = np.zeros(len(at[0]), np.uint64)
        for ids, starts, sizes, factor in zip((a, b), at, n, _FACTORS):
            powers = np.cumprod(np.full(int(sizes.max()), factor))
            place = np.arange(len(ids)) - np.repeat(starts, sizes)
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * factor
            mixed ^= mixed >> np.uint64(29)
            out ^= np.add.reduceat(mixed * powers[place], starts) * factor
            out ^= out >> np.uint64(32)
        return out.view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The remembered alignment of each window; ``at`` are the first tokens of the windows."""
        n = tuple(np.diff(x, append=len(ids)) for x, ids in zip(at, (a, b)))
        which, numbers = pd.factorize(self.numbers(a, b, at, n))
        example = np.empty(len(numbers), np.int64)  # a window that has the number
        example[which] = np.arange(len(which))
        keys, known = numbers.tolist(), self.known
        found = np.array([known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.texts) + np.arange(len(new))
            self._learn_windows([keys[k] for k in new.tolist()], a, b, at, n, example[new])
        out = found[which]
        other = self._others(a, b, at, n, out)
        if len(other):
            out[other] = len(self.texts) + np.arange(len(other))
            self._learn_windows([], a, b, at, n, other)
        return out

    def _learn_windows(self, keys: list[int], a, b, at, n, which: np.ndarray) -> None:
        self.learn(keys, *(ids[_flat(x[which], y[which])] for ids, x, y in zip((a, b), at, n)), *(y[which] for y in n))

    def _others(self, a, b, at, n, found: np.ndarray) -> np.ndarray:
        """The windows whose ids are not those remembered."""
        same = np.ones(len(found), bool)
        for sizes, y in zip(self.n_ids, n):
            same &= sizes.array[found] == y
        equal = np.flatnonzero(same)
        for ids, first, x, starts, y in zip(self.ids, self.first_id, (a, b), at, n):
            starts, y = starts[equal], y[equal]
            differ = ids.array[_flat(first.array[found[equal]], y)] != (x if len(equal) == len(found) else x[_flat(starts, y)])
            if differ.any():
                same[equal] &= ~np.logical_or.reduceat(differ, np.cumsum(y) - y)
        return np.flatnonzero(~same)

    def align(self, ids: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of several texts: numbers of groups and of links, groups; each text's distinct id pairs as (text, code, how often)."""
        if self.tokens > MEMO_TOKENS:
            self.clear()
        a, b = (np.concatenate([x[side] for x in ids]) for side in (0, 1))
        rows = Sequences(a, b, self.tokenizers)
        firsts = np.concatenate([[0], rows.a_ends[np.cumsum([len(x[0]) for x in ids])[:-1] - 1]])
        starts, *first_tokens = rows.windows(firsts)
        at = self.find(a, b, tuple(first_tokens))
        text_of = np.searchsorted(firsts, starts, "right") - 1
        n_groups, n_links = (np.bincount(text_of, x.array[at], len(ids)).astype(np.int64).tolist() for x in (self.n_groups, self.n_links))
        cuts = [*np.searchsorted(starts, firsts).tolist(), len(starts)]
        texts = [self.texts[k] for k in at.tolist()]
        groups = [";".join(texts[x:y]) for x, y in zip(cuts, cuts[1:])]
        sizes = self.n_links.array[at]
        codes = self.links.array[_flat(self.first_link.array[at], sizes)]
        # texts, ids of A and of B fit 64 bits together: one number sorts a text's links
        keys, times = np.unique(np.repeat(text_of, sizes) << 32 | (codes >> 32) << 16 | codes & 0xFFFF, return_counts=True)
        return n_groups, n_links, groups, keys >> 32, (keys >> 16 & 0xFFFF) << 32 | keys & 0xFFFF, times


def portions(texts: list[str], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of few characters, so that arrays over their tokens stay small; a longer text is one by itself."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    yield slice(start, len(texts))


_LINKS = "array<struct<a:int,b:int,n:int>>"


def align(docs: DataFrame, files: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, groups, links``: ``links`` has each id pair once, and how often it is linked.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = worker_memo(("alignment", *sorted(files.items())), lambda: Windows(files))
        for part in slices(batches, 256):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for cut in portions(texts):
                ids = windows.tokenizers.encode(texts[cut])
                kept = [k for k, x in enumerate(ids) if x]
                counts, groups = np.zeros((4, len(ids)), np.int64), [""] * len(ids)
                of = codes = times = np.empty(0, np.int64)
                if kept:
                    found = windows.align([ids[k] for k in kept])
                    counts[:, kept] = [len(ids[k][0]) for k in kept], [len(ids[k][1]) for k in kept], found[0], found[1]
                    for k, text in zip(kept, found[2]):
                        groups[k] = text
                    of, codes, times = np.array(kept)[found[3]], *found[4:]
                offsets = np.searchsorted(of, np.arange(len(ids) + 1))
                links = pa.StructArray.from_arrays(
                    [pa.array(x.astype(np.int32)) for x in (codes >> 32, codes & 0xFFFFFFFF, times)], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)[cut], *map(pa.array, counts), pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links)],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(
        run, f"id {sql_type(docs, id_col)}, n_a long, n_b long, n_groups long, n_links long, groups string, links {_LINKS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n_docs, best``: documents that hold an id pair linked, and whether no partner of ``a`` has more."""
    counts = aligned.select(F.explode("links").alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n_docs"))
    counts = materialize(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def score(aligned: DataFrame, counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of ``links``.

    ``keys``: columns such that rows equal in all of them have the same links.
    """
    counts = materialize(counts, "pair-scores")
    if counts.count() > BROADCAST_PAIRS:
        return _score_by_join(aligned, counts, keys)
    rows = counts.toPandas()  # at most BROADCAST_PAIRS
    codes = _codes(rows["a"].to_numpy(), rows["b"].to_numpy())
    order = np.argsort(codes)
    shared = aligned.sparkSession.sparkContext.broadcast(
        tuple(x[order] for x in (codes, rows["n_docs"].to_numpy(), rows["best"].to_numpy())))
    kept = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n_docs, best = shared.value
        for part in slices(batches):
            links = part.column("links")
            ends = links.offsets.to_numpy()
            a, b, n = (x.to_numpy() for x in links.values.flatten())
            place = np.searchsorted(codes, _codes(a, b)) if len(a) else np.empty(0, np.int64)
            sums = [np.concatenate([[0], np.cumsum(n.astype(np.int64) * x[place])]) for x in (best, n_docs)]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], *[pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]],
                [*kept, "n_best", "count_sum"])

    fields = ", ".join(f"{c} {sql_type(aligned, c)}" for c in kept)
    return aligned.mapInArrow(run, f"{fields}, n_best long, count_sum long")


def _score_by_join(aligned: DataFrame, counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    links = (aligned.select(*keys, F.explode("links").alias("x"))
             .groupBy(*keys, F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.max("x.n").alias("n")))
    sums = (links.join(counts, ["a", "b"]).groupBy(*[F.col(k).alias(f"of_{k}") for k in keys])
            .agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    joined = aligned.drop("links").join(sums, same, "left").drop(*[f"of_{k}" for k in keys])
    return joined.fillna(0, ["n_best", "count_sum"])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), tokenizer_files())
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups"), 256))
    aligned = materialize(
        aligned.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"), "aligned")
    return score(aligned, pair_counts(aligned), ("doc_id", "groups_sha256"))
