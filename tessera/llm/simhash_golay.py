"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority over the XXH64 hashes of its
word shingles. The fingerprint is cut into three segments of 23, 23 and 18 bits. Each
segment is decoded with the perfect binary Golay code [23, 12, 7]: a word is mapped
to the 12-bit index of its nearest codeword, and the words one bit away are decoded
too (one to six distinct indices). Two words at distance 1 share an index because
one decodes into the other's set; at distance 2 they share the index of a word
between them.

With at most four differing bits in all, the errors of the three segments are either
``0, <= 2, any`` or ``1, 1, <= 2``, so a linked pair always shares at least one of

* segment ``i`` exactly, and an index of the index set of segment ``j``;
* an index pair (set of ``i``, own index of ``j``) or (own of ``i``, set of ``j``), and one of
  three parts of segment ``k`` exactly, as two errors leave one part whole.

The keys have 28 to 35 bits, so that fingerprints that are not alike rarely meet. Every
fingerprint emits about 120 of them. Keys held by one fingerprint drop out in a
map-side aggregate; keys held by two give the pair at once; keys held by more are cut
into tiles of bounded size, and each tile returns a spanning forest of its verified
links rather than all pairs. Links only join fingerprints, so exact copies, however
many, count once.

Inputs: ``docs`` with an id and a text column. Null or blank text: fingerprint 0, linked
like any other. Null id: keeps its row, never becomes a component's name unless the whole
component has no id. Repeated rows: one output row each. Empty table: empty result. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, quoted, sql_type, table, whole_row, worker_memo

SHINGLE_WORDS = 4
BROADCAST_NAMES = 1_000_000  # of about 16 bytes
BROADCAST_KEYS = 200_000  # of 24 bytes
MAX_BITS = 4
SEED = 42
TILE = 1024  # fingerprints of one side of a tile
TASK = 1 << 13  # fingerprints whose keys one task emits and counts: about a million keys, 100 MB
WIDTHS = (23, 23, 18)
SHIFTS = (0, 23, 46)
GOLAY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_STEP = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bitwise majority (strictly over half) of the shingles' XXH64, as an unsigned 64-bit integer."""
    import xxhash

    tokens = text.lower().split()  # bytes: lower-cases A-Z, splits at space and 09-0D
    if not tokens:
        return 0
    h = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return h(b" ".join(tokens), seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    joined = b" ".join(tokens)
    del tokens
    n, ones = len(starts), np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        part = starts[k : k + _STEP]
        hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(part, ends[k : k + _STEP])), "<u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``id, fp``: the fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo(None, lambda: None)
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words, seed) for t in b.column(1)]
            out = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"id {sql_type(docs, id_col)}, fp long")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error of weight <= 3 for each syndrome."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    error = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[syndrome(e)] = e
    return low, high, error


def codeword_index(x: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (x ^ error[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def _sets(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own index; indices of the words at distance <= 1, sorted; which of them are first of their kind."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    near = np.sort(codeword_index(segment[:, None] ^ flips), axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    return codeword_index(segment), near, first


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) of every key of every fingerprint (unsigned 64-bit)."""
    segments = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    sets = [_sets(x, w) for x, w in zip(segments, WIDTHS)]
    rows, keys = [], []
    for tag, (i, j) in enumerate(itertools.permutations(range(3), 2)):
        _, near, first = sets[j]
        at, col = np.nonzero(first)
        rows.append(at)
        keys.append(tag << 40 | segments[i][at] << 12 | near[at, col])
    for tag, (i, j, k) in zip((6, 9, 12), ((0, 1, 2), (0, 2, 1), (1, 2, 0))):
        (own_i, near_i, first_i), (own_j, near_j, first_j) = sets[i], sets[j]
        at, col = np.nonzero(first_j)
        once, other = np.nonzero(first_i & (near_i != own_i[:, None]))
        pairs = np.concatenate([own_i[at] << 12 | near_j[at, col], near_i[once, other] << 12 | own_j[once]])
        at = np.concatenate([at, once])
        size = -(-WIDTHS[k] // 3)
        for part in range(3):
            whole = segments[k][at] >> size * part & (1 << size) - 1
            rows.append(at)
            keys.append((tag + part) << 40 | whole << 24 | pairs)
    return np.concatenate(rows), np.concatenate(keys)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 4096):
            part = fps[k : k + 4096]
            at, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], ["key", "fp"])


def spanning_forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member it can reach) under links of at most ``max_bits`` differing bits."""
    fps = np.unique(fps)
    if len(fps) < 2:
        return fps[:0], fps[:0]
    left, right, bits = [], [], fps.view(np.uint64)  # bitwise_count takes absolute values of signed numbers
    for k in range(0, len(fps), 256):
        a, b = np.nonzero(np.bitwise_count(bits[k : k + 256, None] ^ bits[None, :]) <= max_bits)
        left.append(a + k)
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """``u, v``: edges that connect exactly the fingerprints joined by links of at most ``max_bits`` bits.

    ``fps`` holds distinct fingerprints in column ``fp``. The key scheme is complete up to four bits.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the key scheme finds pairs of at most 4 differing bits")
    # few bytes become many keys, so the number of tasks must come from the rows and not from their size
    spread = fps.select("fp").repartition(max(1, -(-fps.count() // TASK)), "fp")
    keys = spread.mapInArrow(_keys_of, "key long, fp long")
    groups = cut(
        keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    )
    twos = groups.where("n = 2").select("u", "v").distinct()
    twos = twos.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    larger = groups.where("n > 2").select("key", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("blocks"))
    # Spark takes the keys to be about as large as their fingerprints, and would broadcast all of them
    larger = F.broadcast(larger) if larger.count() <= BROADCAST_KEYS else larger.hint("merge")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [spanning_forest(np.array(x.as_py(), np.int64), max_bits) for x in b.column(0)]
            u = np.concatenate([x for x, _ in out] or [np.empty(0, np.int64)])
            v = np.concatenate([x for _, x in out] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = (
        keys.join(larger, "key")
        .select("key", "fp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .groupBy("key", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"))
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
    )
    return twos.unionByName(tiles.mapInArrow(forests, "u long, v long"))


def components(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """``fp, comp`` for distinct fingerprints ``fp``: ``comp`` is the least one reachable by links."""
    roots = connected_components(links(fps, max_bits, tile)).withColumnRenamed("node", "fp")
    return fps.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``id, fp, component``: every document with its fingerprint and the least id it can reach by links."""
    marked = cut(fingerprints(docs, id_col, text_col, words, seed))
    fps = cut(marked.groupBy("fp").agg(F.min("id").alias("first")))
    named = cut(fps.join(components(fps, max_bits), "fp"))
    # only components of several fingerprints need a name of their own; a few of them may hold most rows
    names = cut(named.groupBy("comp").agg(F.min("first").alias("component"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if names.count() <= BROADCAST_NAMES:
        names = F.broadcast(names)
    by_fp = named.join(names, "comp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return marked.join(by_fp, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the least id, nulls last.

    Rows are told apart by a hash of all their columns; of rows equal in every column one stays.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("row"))
    found = near_duplicates(rows.select(F.struct("id", "h").alias("key"), "text"), "key", "text", **how)
    # a struct's least value takes nulls first, so rows without an id come after the others here
    order = F.struct(F.col("id.id").isNull(), F.col("id.id"), F.col("id.h"))
    counted = found.groupBy("component", "id").agg(F.count("*").alias("n"))
    kept = counted.groupBy("component").agg(F.min_by(F.struct("id", "n"), order).alias("best"))
    flat = kept.select(F.col("best.id.h").alias("best_h"), F.col("best.id.id").alias("best_id"), F.col("best.n").alias("n"))
    out = rows.join(flat, (F.col("h") == F.col("best_h")) & F.col("id").eqNullSafe(F.col("best_id")))
    once = out.where("n = 1").select("row.*")
    return once.unionByName(out.where("n > 1").select("row").dropDuplicates().select("row.*"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
