"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME_UNITS`` tokens each; every frame
carries the number of units and of characters before it. A cut at a unit is then found by
decompressing the one frame that holds it, and everything that needs a whole text (the output,
its digest, the way back) streams ordered frames, so that no more than one of them is text at a time.

The output is kept the same way: each piece written is a frame of its own with the bytes before
it. Restoring looks for the sentinels in the stream of the output, and reads the prefix, the middle
and the suffix between them by seeking.

Whether a document is rearranged, how, and where it is cut follow from a sha256 of seed and id, as
native columns over the stored counts; no text is read for that.

Null or empty text: no frames, form ``plain``. A text that contains a sentinel: ``plain``. Null id: hashed
as an empty string. Repeated rows: each transformed by its own. Empty table: empty result. One
unit longer than a frame's worth is not divided. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, sql_type, table

FRAME_UNITS = 1024
LEVEL = 3
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: A unit: white space with the word after it, or the white space that ends a text.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
_FRAMES = "array<struct<unit:long,char:long,data:binary>>"


@cache
def _frame_pattern(units: int) -> re.Pattern:
    """The next ``units`` units (or all that are left) in one match."""
    return re.compile(rf"(?:{UNIT.pattern}){{1,{units}}}+")


class Frames:
    """Independent frames in order. ``starts`` has the position of each one's first item, and the end."""

    def __init__(self, starts: list[int], blobs: list[bytes], binary: bool = False):
        import zstandard

        self.starts, self.blobs, self.binary = starts, blobs, binary
        self.inflate = zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> str | bytes:
        data = self.inflate(self.blobs[k])
        return data if self.binary else data.decode()

    def holding(self, position: int) -> int:
        return bisect_right(self.starts, position) - 1

    def read(self, low: int, high: int) -> Iterator[str | bytes]:
        """The items from ``low`` to ``high``, frame by frame; frames outside are not decompressed."""
        if low >= high:
            return
        k = self.holding(low)
        while k < len(self.blobs) and self.starts[k] < high:
            part = self.frame(k)
            at = self.starts[k]
            yield part if low <= at and at + len(part) <= high else part[max(0, low - at) : high - at]
            k += 1


def frames_of(text: str, frame_units: int, squeeze) -> tuple[list[int], list[int], list[bytes], int]:
    """(units before, characters before, data) of every frame, and the number of units."""
    chars, blobs, part = [], [], ""
    for m in _frame_pattern(frame_units).finditer(text):
        part = m.group()
        chars.append(m.start())
        blobs.append(squeeze(part.encode()))
    full = max(0, len(blobs) - 1)  # all but the last are full
    return list(range(0, frame_units * len(blobs), frame_units)), chars, blobs, frame_units * full + len(UNIT.findall(part))


def seekable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_units: int = FRAME_UNITS,
             marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), level: int = LEVEL) -> DataFrame:
    """The store: ``id, n_units, n_chars, marked, frames``; ``marked`` tells whether a sentinel is in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level).compress
        for part in slices(batches, 256):
            units, chars, blobs, offsets, totals, lengths, marked = [], [], [], [0], [], [], []
            for text in part.column(1).to_pylist():
                u, c, b, n = frames_of(text or "", frame_units, squeeze)
                units += u
                chars += c
                blobs += b
                offsets.append(len(blobs))
                totals.append(n)
                lengths.append(len(text or ""))
                marked.append(any(m in (text or "") for m in marks))
            frames = pa.StructArray.from_arrays(
                [pa.array(units, pa.int64()), pa.array(chars, pa.int64()), pa.array(blobs, pa.binary())],
                ["unit", "char", "data"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(totals, pa.int64()), pa.array(lengths, pa.int64()), pa.array(marked),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), frames)],
                ["id", "n_units", "n_chars", "marked", "frames"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(
        run, f"id {sql_type(docs, id_col)}, n_units long, n_chars long, marked boolean, frames {_FRAMES}")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the leading groups of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def choose(stored: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``stored`` with ``form`` and the units at which prefix and middle end, ``cut1`` and ``cut2``."""
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    n = F.col("n_units") + 1
    plain = (F.col("n_units") == 0) | F.col("marked") | (F.pmod(h3, F.lit(100)) >= fim_percent)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm_percent, "spm").otherwise("psm")
    a, b = F.pmod(h1, n), F.pmod(h2, n)
    return stored.select("id", "n_units", "n_chars", form.alias("form"), F.least(a, b).alias("cut1"),
                         F.greatest(a, b).alias("cut2"), "frames")


def character_of(unit: int, n_units: int, units: list[int], text: Frames) -> int:
    """Where a unit starts, from the one frame that holds it."""
    if unit >= n_units:
        return text.starts[-1]
    k = bisect_right(units, unit) - 1
    within = unit - units[k]
    if not within:
        return text.starts[k]
    return text.starts[k] + next(islice(UNIT.finditer(text.frame(k)), within - 1, None)).end()


def pieces(form: str, low: int, high: int, text: Frames, marks: tuple[str, str, str]) -> Iterator[str]:
    """The output in order, in strings no longer than a frame."""
    end = text.starts[-1]
    p, s, m = marks
    parts = {p: (0, low), s: (high, end), m: (low, high)}
    for mark in {"plain": (), "psm": (p, s, m), "spm": (s, p, m)}[form]:
        yield mark
        yield from text.read(*parts[mark])
    if form == "plain":
        yield from text.read(0, end)


def find_marks(chunks: Iterable[bytes], marks: list[bytes]) -> list[int]:
    """Byte positions of the first occurrence of each mark in a stream."""
    found, carry, at = {}, b"", 0
    keep = max(map(len, marks)) - 1
    for chunk in chunks:
        joined = carry + chunk
        for m in marks:
            if m not in found and (p := joined.find(m)) >= 0:
                found[m] = at - len(carry) + p
        at += len(chunk)
        carry = joined[max(0, len(joined) - keep):]
    return [found[m] for m in marks]


def restored(form: str, output: Frames, marks: tuple[str, str, str]) -> Iterator[bytes]:
    """The source text, rebuilt from an output and its form alone."""
    end = output.starts[-1]
    if form == "plain":
        yield from output.read(0, end)
        return
    raw = [m.encode() for m in marks]
    p, s, m = find_marks(output.read(0, end), raw)
    prefix_end, suffix_end = (s, m) if form == "psm" else (m, p)
    yield from output.read(p + len(raw[0]), prefix_end)
    yield from output.read(m + len(raw[2]), end)
    yield from output.read(s + len(raw[1]), suffix_end)


def _transform(chosen: DataFrame, marks: tuple[str, str, str], fields: str, types: list[pa.DataType], make) -> DataFrame:
    """One row for each stored text: what ``make(form, pieces)`` gives, after the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            rows = []
            names = ("n_units", "n_chars", "form", "cut1", "cut2", "frames")
            for n, length, form, cut1, cut2, frames in zip(*(part.column(x).to_pylist() for x in names)):
                text = Frames([*[f["char"] for f in frames], length], [f["data"] for f in frames])
                low = high = None
                if form != "plain":
                    units = [f["unit"] for f in frames]
                    low, high = (character_of(c, n, units, text) for c in (cut1, cut2))
                counts = (None, None) if low is None else (low, high - low)
                rows.append((n, form, *counts, *make(form, pieces(form, low, high, text, marks))))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    [pa.int64(), pa.string(), pa.int64(), pa.int64(), *types])]],
                ["id", "n", "form", "prefix_chars", "middle_chars", *[f.split()[0] for f in fields.split(", ")]])

    return chosen.mapInArrow(
        run, f"id {sql_type(chosen, 'id')}, n long, form string, prefix_chars long, middle_chars long, {fields}")


def fill_in_middle(chosen: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output``: the training texts."""
    return _transform(chosen, marks, "output string", [pa.string()], lambda form, out: ("".join(out),))


def restore(transformed: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``id, text`` from ``output`` and ``form`` of ``fill_in_middle``."""
    p, s, m = marks
    out, form = F.col("output"), F.col("form")
    at = {x: F.instr(out, x) for x in marks}

    def between(mark: str, end: Column) -> Column:
        start = at[mark] + len(mark)
        return F.substring(out, start, end - start)

    whole = F.length(out) + 1
    rearranged = F.when(form == "psm", F.concat(between(p, at[s]), between(m, whole), between(s, at[m]))).otherwise(
        F.concat(between(p, at[m]), between(m, whole), between(s, at[p])))
    return transformed.select("id", F.when(form == "plain", out).otherwise(rearranged).alias("text"))


def digests(chosen: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), level: int = LEVEL) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, frame by frame."""

    def make(form: str, out: Iterator[str]) -> tuple[str, str]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level).compress
        digest, starts, blobs = hashlib.sha256(), [0], []
        for part in out:
            raw = part.encode()
            digest.update(raw)
            blobs.append(squeeze(raw))
            starts.append(starts[-1] + len(raw))
        back = hashlib.sha256()
        for raw in restored(form, Frames(starts, blobs, binary=True), marks):
            back.update(raw)
        return digest.hexdigest(), back.hexdigest()

    return _transform(chosen, marks, "output_sha256 string, restored_sha256 string", [pa.string(), pa.string()], make)


def op11_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(choose(seekable(table(spark, sf_dir, "documents")))).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS q
  FROM cut
), split AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(a, b)], '') AS prefix,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= 50 THEN 'plain'
              WHEN q < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM split
"""
