"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are replaced by the
typed placeholders ``<num>``, ``<name>`` and ``<unit>``; other words are lower-cased. A
re-parameterised question ("Ann buys 3 kg" for "Bob buys 7 kg") so has the template of
the original. Windows of ``window`` template tokens are hashed and hash-joined with the
windows of the benchmark. Slots are then checked: within a matched run, one benchmark
value must always stand for one document value (a consistent renaming), and a window
that consists mostly of placeholders is no evidence by itself.

Next to them go windows of the plain lower-cased tokens, which need no slots and no share of
words: a verbatim copy is found whatever it consists of and wherever its sentence starts.

A document contains an item when at least ``min_share`` of the item's windows occur in
it with consistent slots, or when shorter windows (``SEED`` tokens, of both kinds) cover at
least ``min_share`` of its tokens, and as many as a window has, near one place: changed words
leave gaps, and inserted or missing ones move what follows. Beside each other are the
places within the item's length. An item no longer than a window is looked for as a whole: its
one window is all its tokens. Below ``MIN_TOKENS`` tokens only the plain tokens count, and an
item of one token is found only where it is the whole document.

Every window of every whole text is hashed; a bitmap of fixed size (8 MB), built from the
benchmark's hashes in Spark, drops those that cannot match before rows are made, and a
hash join on the exact template decides. The benchmark's windows are broadcast to that
join only while their number stays within ``BROADCAST_WINDOWS``; beyond it it shuffles. So it
is with the rows found, of which ``BROADCAST_FOUND`` at most are broadcast to take them out.

Null or empty text matches nothing. Repeated rows: each gets its result. Null id: kept.
Empty benchmark or documents: empty result. Ties cannot arise; every item above the share
is reported. Other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SpanHashes, cut, hash_filter, may_hold, portions, quoted, spans_within, sql_type, table, whole_row

WINDOW = 8
SEED = 6  # of 14 tokens and more, one change anywhere leaves windows of 6 that cover half
MIN_SHARE = 0.5
MIN_TOKENS = 4
BROADCAST_WINDOWS = 100_000  # of about 300 bytes
BROADCAST_FOUND = 200_000  # of an id and a hash
SLICE = 1 << 18  # bytes of texts read at once; the arrays over them take about 90 times as much
FILTER_BITS = 26  # the filter takes 2**26 bits: 8 MB

# Units of measure and currency, and number words.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs "
    "hour hours day days week weeks month months year years mph kmh w kw kwh v a hz usd eur gbp dollar dollars cent "
    "cents euro euros pound pounds meter meters metre metres kilometer kilometers kilometre kilometres mile miles "
    "inch inches foot feet yard yards gram grams kilogram kilograms liter liters litre litres percent degrees"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

#: A number with its separators, a word, or one of the marks that end a sentence or denote a unit. ``Tokens`` finds
#: the same on arrays of characters.
TOKEN = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n$€£%]")
_ENDS, _SIGNS = ".!?\n", "$€£%"
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
_SLOTS = (NUM, UNIT, NAME)
LETTER, DIGIT, QUOTE, SEPARATOR, END, SIGN, UPPER, NUMERAL = (1 << k for k in range(8))


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its classes as bits, and its lower case (one code point)."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    flags, lower = np.zeros(len(every), np.uint8), np.arange(len(every), dtype=np.uint32)
    for m in re.finditer(r"[^\W\d_]+", every):
        flags[m.start() : m.end()] = LETTER
    for k in np.nonzero(flags)[0].tolist():
        c = every[k]
        low = c.lower()
        lower[k] = ord(low[0])
        flags[k] |= (UPPER if low != c and c.isupper() and len(low) == 1 else 0) | (NUMERAL if c.isdigit() else 0)
    lower[ord("ς")] = ord("σ")  # str.lower() has either, depending on what follows
    for signs, bit in (("0123456789", DIGIT), ("'’", QUOTE), (".,:/", SEPARATOR), (_ENDS, END), (_SIGNS, SIGN)):
        for c in signs:
            flags[ord(c)] |= bit
    return flags, lower


@cache
def _listed(words: tuple[str, ...]) -> np.ndarray:
    """The sorted hashes of lower-case words."""
    points = np.frombuffer("\0".join(words).encode("utf-32-le"), "<u4")
    ends = np.append(np.nonzero(points == 0)[0], len(points))
    return np.sort(SpanHashes(points).of(np.append(0, ends[:-1] + 1), ends))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


class Tokens:
    """The tokens of several texts, without sentence ends, as arrays.

    ``plain`` are hashes of the lower-cased tokens, ``hashes`` those of template tokens, ``slots`` tells which
    are placeholders; ``of_text`` has the first token of each text, and the end. A capitalised word is a name unless
    it starts a sentence. A unit word is a unit only next to a number, so that "a" and "in" stay words elsewhere.
    """

    def __init__(self, texts: list[str]):
        self.joined = "\0".join(texts)  # belongs to no token
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        flags, lower = characters()
        flag, low = flags[points], lower[points]

        def between(sign: int, kind: int) -> np.ndarray:
            """Places that have ``kind``, or ``sign`` between two that do."""
            held = flag & kind != 0
            out = held.copy()
            out[1:-1] |= (flag[1:-1] & sign != 0) & held[:-2] & held[2:]
            return out

        word, number = between(QUOTE, LETTER), between(SEPARATOR, DIGIT)
        mark = (flag & (END | SIGN) != 0) & ~number
        kind = np.zeros(len(points) + 2, np.int8)
        kind[1:-1] = word + 2 * number + 3 * mark
        here = kind[1:-1]
        self.starts = np.nonzero((here > 0) & ((here != kind[:-2]) | mark))[0]
        self.ends = np.nonzero((here > 0) & ((here != kind[2:]) | mark))[0] + 1
        plain = SpanHashes(low).of(self.starts, self.ends)
        first, kinds = flag[self.starts], here[self.starts]
        changed = np.append(0, np.cumsum((low != points) & (points != ord("ς"))))
        end = (kinds == 3) & (first & END != 0)
        is_number = (kinds == 2) | (first & NUMERAL != 0) | _among(plain, _listed(tuple(NUMBER_WORDS)))
        of_unit = (kinds == 1) & ~is_number & _among(plain, _listed(tuple(UNITS)))
        capital = (first & UPPER != 0) & (changed[self.ends] - changed[self.starts] == 1) & ~is_number & ~of_unit
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        at = np.searchsorted(self.starts, offsets)
        after_end, after_number = (np.append(True, end[:-1]), np.append(False, is_number[:-1])) if len(end) else (end, end)
        opening = at[:-1][at[:-1] < len(end)]
        after_end[opening], after_number[opening] = True, False
        sign = (kinds == 3) & ~end
        unit, name = sign | of_unit & after_number, capital & ~after_end
        hashes = plain.copy()
        hashes[is_number], hashes[unit], hashes[name] = _slot_hashes()
        keep = ~end
        self.of_text = np.append(0, np.cumsum(keep))[at]
        self.starts, self.ends, self.hashes, self.plain = (x[keep] for x in (self.starts, self.ends, hashes, plain))
        self.slots = (is_number | unit | name)[keep]

    def text(self, first: int = 0, n: int | None = None) -> list[str]:
        """Tokens of the source, as they are."""
        spans = zip(self.starts[first:].tolist(), self.ends[first:].tolist()) if n is None else zip(
            self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist())
        return [self.joined[x:y] for x, y in spans]

    def kinds(self, first: int = 0, n: int | None = None) -> list[str]:
        """Template tokens."""
        values = self.text(first, n)
        part = slice(first, first + len(values))
        return [_slot_names()[h] if s else v.lower() for v, s, h in zip(values, self.slots[part].tolist(), self.hashes[part].tolist())]


@cache
def _slot_hashes() -> tuple[np.uint64, ...]:
    points = np.frombuffer("".join(_SLOTS).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(s) for s in _SLOTS])
    return tuple(SpanHashes(points).of(np.append(0, ends[:-1]), ends))


@cache
def _slot_names() -> dict[int, str]:
    return dict(zip(map(int, _slot_hashes()), _SLOTS))


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """One hash for each window of ``window`` tokens."""
    starts = np.arange(max(0, len(h) - window + 1))
    return SpanHashes(h).of(starts, starts + window)


_WINDOW_FIELDS = "size int, hash long, at long, kinds array<string>, values array<string>"


def _columns(found: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    return [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """The windows of every item. A negative size is that of a window of plain tokens.

    Template windows are those of which more than half the tokens are words; ``windows`` counts those of ``window``
    tokens, ``coverable`` the tokens that any of them hold, ``tokens`` all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, counts, found = [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                read = Tokens([text or ""])
                n = len(read.plain)
                if not n:
                    continue
                kinds, values = read.kinds(), [t.lower() for t in read.text()]
                main = min(window, n)
                seed = main if n <= window else min(SEED, window)
                kept, coverable = [], set()
                for size in {main, seed} if n >= min(MIN_TOKENS, window) else ():
                    for k, h in enumerate(window_hashes(read.hashes, size).view(np.int64).tolist()):
                        if 2 * int(read.slots[k : k + size].sum()) < size:
                            kept.append((size, h, k, kinds[k : k + size], values[k : k + size]))
                            coverable.update(range(k, k + size))
                windows = sum(x[0] == main for x in kept)
                for k, h in enumerate(window_hashes(read.plain, seed).view(np.int64).tolist()):
                    kept.append((-seed, h, k, values[k : k + seed], values[k : k + seed]))
                found += kept
                rows += [row] * len(kept)
                counts += [(main, windows, n, len(coverable))] * len(kept)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())),
                 *[pa.array([x[k] for x in counts], pa.int64()) for k in range(4)], *_columns(found)],
                ["item", "main", "windows", "tokens", "coverable", "size", "hash", "at", "kinds", "values"],
            )

    narrow = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(
        run, f"item {sql_type(items, id_col)}, main long, windows long, tokens long, coverable long, {_WINDOW_FIELDS}")


def document_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash`` and the windows of every whole text whose hash may be one of the benchmark's."""
    spark = docs.sparkSession
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most twice ``window`` numbers
    shared = spark.sparkContext.broadcast(hash_filter(windows, "hash", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text", SLICE):
            tokens = Tokens([t or "" for t in b.column("text").to_pylist()])
            spans = {False: SpanHashes(tokens.hashes), True: SpanHashes(tokens.plain)}
            found, firsts = [], []
            for size in sizes:
                width, exact = abs(size), size < 0
                first = spans_within(tokens.of_text, width)
                if size == -1:
                    first = first[np.isin(first, tokens.of_text[:-1][np.diff(tokens.of_text) == 1])]
                hashes = spans[exact].of(first, first + width)
                held = may_hold(shared.value, FILTER_BITS, hashes)
                for k, h in zip(first[held].tolist(), hashes[held].view(np.int64).tolist()):
                    values = [t.lower() for t in tokens.text(k, width)]
                    found.append((size, h, values if exact else tokens.kinds(k, width), values))
                firsts.append(first[held])
            first = np.concatenate([np.empty(0, np.int64), *firsts])
            rows = np.searchsorted(tokens.of_text, first, "right") - 1
            found = [(size, h, at, *rest) for (size, h, *rest), at in zip(found, (first - tokens.of_text[rows]).tolist())]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), *_columns(found)],
                ["id", "text_hash", "size", "hash", "at", "kinds", "values"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {sql_type(docs, id_col)}, text_hash long, {_WINDOW_FIELDS}")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 min_share: float = MIN_SHARE) -> DataFrame:
    """``id, text_hash, item, n_windows, n_matched, n_tokens, n_covered, renamed``: each document with each item it contains.

    ``n_windows`` and ``n_matched`` are of template windows of ``window`` tokens, ``n_covered`` of the tokens. ``renamed`` tells whether a slot's value differs from the benchmark's.
    """
    windows = cut(benchmark_windows(items, item_id, item_text, window))
    known = windows.select("item", "main", "windows", "tokens", "coverable", "size", "hash", F.col("at").alias("item_at"), "kinds", F.col("values").alias("old"))
    # Spark takes the windows to be as few as the items, so beyond the bound it must be told to shuffle
    known = F.broadcast(known) if windows.count() <= BROADCAST_WINDOWS else known.hint("merge")
    found = document_windows(docs, windows, id_col, text_col).withColumnRenamed("values", "new")
    matched = found.join(known, ["size", "hash", "kinds"])
    of_item = ["item", "main", "windows", "tokens", "coverable"]

    slots = F.filter(
        F.arrays_zip(F.col("kinds").alias("kind"), F.col("old"), F.col("new")),
        lambda x: x["kind"].isin(*_SLOTS),
    )
    # windows of one occurrence of an item lie on one diagonal
    runs = (
        matched.withColumn("slots", slots)
        .withColumn("window", F.struct("size", "item_at"))
        .groupBy("id", "text_hash", *of_item, (F.col("at") - F.col("item_at")).alias("diagonal"))
        .agg(
            F.collect_set("window").alias("all"),
            F.collect_set(F.when(F.size("slots") == 0, F.col("window"))).alias("plain"),
            F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"),
        )
    )
    one_to_one = (
        F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kind"], x["old"]))))
    ) & (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kind"], x["new"])))))
    # diagonals no further apart than the item is long share one of two overlapping places
    d, n = F.col("diagonal"), F.col("tokens")
    places = F.array(F.struct(F.lit(0).alias("k"), F.floor(d / (2 * n)).alias("at")),
                     F.struct(F.lit(1).alias("k"), F.floor((d + n) / (2 * n)).alias("at")))

    def cells(windows: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(
            windows, lambda x: F.sequence(x["item_at"], x["item_at"] + F.abs(x["size"]) - 1)))))

    near = (
        runs.select(
            "id", "text_hash", *of_item, F.explode(F.when(one_to_one, F.col("all")).otherwise(F.col("plain"))).alias("window"),
            (one_to_one & F.exists("pairs", lambda x: x["old"] != x["new"])).alias("renamed"), places.alias("places"),
        )
        .select("*", F.explode("places").alias("place"))
        .groupBy("id", "text_hash", *of_item, "place")
        .agg(F.collect_set("window").alias("held"), F.max("renamed").alias("renamed"))
        .select("*", cells(F.col("held")).alias("covered"),
                cells(F.filter("held", lambda x: x["size"] > 0)).alias("by_template"),
                F.transform(F.filter("held", lambda x: x["size"] == F.col("main")), lambda x: x["item_at"]).alias("mains"))
    )
    share, least = F.lit(min_share), F.least(F.col("tokens"), F.lit(window))
    enough = (
        (F.col("windows") > 0) & (F.col("n_matched") >= share * F.col("windows"))
        | (F.col("n_covered") >= F.greatest(share * F.col("tokens"), least))
        | (F.col("by_template") >= F.greatest(share * F.col("coverable"), least))
    )
    return (
        near.groupBy("id", "text_hash", *of_item)
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("mains")))).cast("long").alias("n_matched"),
             F.max("covered").cast("long").alias("n_covered"), F.max("by_template").alias("by_template"),
             F.max("renamed").alias("renamed"))
        .where(enough)
        .select("id", "text_hash", "item", F.col("windows").alias("n_windows"), "n_matched",
                F.col("tokens").alias("n_tokens"), "n_covered", "renamed")
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        **how) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item."""
    bad = cut(contaminated(docs, items, id_col, text_col, **how).select("id", "text_hash").distinct())
    few = bad.count() <= BROADCAST_FOUND
    bad = bad.select(F.col("id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("text_hash"))
    same = (F.col("text_hash") == F.col("bad_hash")) & F.col("id").eqNullSafe(F.col("bad_id"))
    return rows.join(F.broadcast(bad) if few else bad, same, "left_anti").select("row.*")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_matched", "n_tokens", "n_covered", "renamed"
    ).distinct()
