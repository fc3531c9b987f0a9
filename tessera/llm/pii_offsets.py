"""Personal data behind disguises, found by offset-preserving normalisation.

Base detectors run on the text as it is. A cascade of transducers then rewrites

* homoglyphs: full-width and other compatibility forms, Cyrillic and Greek look-alikes,
  foreign digits, odd blanks and dashes, invisible characters;
* disguised signs: ``[at]``, ``(dot)``, ``name at host dot com``, ``name_at_host.com``, ``name @ host.com``,
  ``10 dot 0 dot 0 dot 1`` (``name at host.com`` is prose more often than not and stays);
* spelled digits: runs of at least three digit words;

and every transducer keeps, for each character it writes, the span of source characters
it stands for. The same detectors run on the result, and what they find is mapped back. A
span is added if the rewriting took part in it; base spans always stay.

Counts are of base spans. Null or empty text: no span. Repeated rows: one result each. Null
id: kept. Empty table: empty result. Spans of different kinds may overlap; each is
reported. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import sql_type, table

KINDS = ("email", "ip", "card", "phone")

# Look-alike letters, and digit words of four languages.
LOOKALIKES = dict(zip(
    "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαορυιντΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijshdqwABEKMHOPCTYXIJSaopuivtABEZHIKMNOPTYX",
))
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does: had it started inside, it had started earlier.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the whole run of local characters before an @ that a domain follows."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the identifiers in a text, in that order."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            parts = [x.lstrip("0") for x in m.group().split(".")]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Mapped:
    """A rewritten text; for each character the source span it stands for, and whether it was rewritten."""

    text: str
    starts: list[int]
    ends: list[int]
    edited: list[bool]

    @classmethod
    def of(cls, text: str) -> Mapped:
        n = len(text)
        return cls(text, list(range(n)), list(range(1, n + 1)), [False] * n)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace each (start, end) by a string, all of whose characters stand for what was replaced."""
        if not edits:
            return self
        text, starts, ends, edited, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            edited += self.edited[at:a] + [True] * len(new)
            at = b
        text.append(self.text[at:])
        return Mapped("".join(text), starts + self.starts[at:], ends + self.ends[at:], edited + self.edited[at:])


def _plain(c: str) -> str:
    """What a character looks like; itself if it is plain."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf" or c == "️":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind == "Pd" or c == "−":
        return "-"
    if kind == "Zs":
        return " "
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


class _Plain(dict):
    def __missing__(self, c: str) -> str:
        p = self[c] = _plain(c)
        return p


_PLAIN = _Plain()
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_ODD_LATIN = re.compile("[" + "".join(c for c in map(chr, range(128, 256)) if _plain(c) != c) + "]")


def homoglyphs(m: Mapped) -> Mapped:
    return m.rewrite([(x.start(), x.end(), _PLAIN[x.group()]) for x in _FOREIGN.finditer(m.text) if _PLAIN[x.group()] != x.group()])


_AT, _DOT = r"(?:at|arroba|@)", r"(?:dot|punkt|punto|point|\.)"
_IN_BRACKETS = re.compile(rf"\s*(?:\[\s*(?:({_AT})|{_DOT})\s*\]|\(\s*(?:({_AT})|{_DOT})\s*\)|\{{\s*(?:({_AT})|{_DOT})\s*\}}|<\s*(?:({_AT})|{_DOT})\s*>)\s*", re.I)
_WORDS = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?P<at>\s+at\s+|_at_|-at-|\s*@\s*)(?P<host>[A-Za-z0-9-]+(?:(?:\s+dot\s+|_dot_|-dot-|\.)[A-Za-z0-9-]+)*(?:\s+dot\s+|_dot_|-dot-)[A-Za-z]{2,24})(?![A-Za-z0-9])", re.I)
#: A disguised at before a host with plain dots; the parts of a path are none.
_PLAIN_HOST = re.compile(r"(?<![A-Za-z0-9._%+@/-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?P<at>_at_|-at-|\s+@\s*|\s*@\s+)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", re.I)
_AT_HINT = re.compile(r"\s@|@\s|_at_|-at-", re.I)
_WORD_DOT = re.compile(r"\s+dot\s+|_dot_|-dot-", re.I)
_IP_DOTS = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?:\s+dot\s+|\.)[0-9]{1,3}){3}(?![0-9.]*[0-9])", re.I)


def signs(m: Mapped) -> Mapped:
    """``@`` and ``.`` for their disguises; bare words only within something shaped like an address."""
    m = m.rewrite([(x.start(), x.end(), "@" if any(x.groups()) else ".") for x in _IN_BRACKETS.finditer(m.text)])
    edits = []
    for x in _WORDS.finditer(m.text):
        if x.group("at") != "@":
            edits.append((*x.span("at"), "@"))
        edits += [(*y.span(), ".") for y in _WORD_DOT.finditer(m.text, *x.span("host"))]
    m = m.rewrite(edits)
    m = m.rewrite([(*x.span("at"), "@") for x in _PLAIN_HOST.finditer(m.text)])
    return m.rewrite([(*y.span(), ".") for x in _IP_DOTS.finditer(m.text) for y in _WORD_DOT.finditer(m.text, *x.span())])


_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_DIGIT_WORD})(?:(?:[\s,-]+|\s+dot\s+|\s*\.\s*)(?:{_DIGIT_WORD}|[0-9]+)){{2,}}\b", re.I)
_ONE_WORD = re.compile(rf"({_DIGIT_WORD})|(\s+dot\s+|\s*\.\s*)|[\s,-]+", re.I)


def spelled_digits(m: Mapped) -> Mapped:
    """Digits for runs of at least three digit words; what stands between them goes."""
    edits = []
    for x in _SPELLED.finditer(m.text):
        for y in _ONE_WORD.finditer(m.text, *x.span()):
            edits.append((*y.span(), str(DIGIT_WORDS[y.group(1).lower()]) if y.group(1) else "." if y.group(2) else ""))
    return m.rewrite(edits)


_DIGIT_SET = frozenset(DIGIT_WORDS)
#: What ends a word of Latin-1, for the quick check; other characters make a text suspicious anyway.
_BREAKS = {k: " " for k in range(256) if not re.match(r"\w", chr(k))}


def suspicious(text: str) -> bool:
    """Whether any transducer would rewrite something; cheap for texts of which none would."""
    if not text.isascii():
        try:
            text.encode("latin-1")
            odd = bool(_ODD_LATIN.search(text))
        except UnicodeEncodeError:
            odd = True
        if odd:
            return True
    if any(c in text for c in "[({<") and _IN_BRACKETS.search(text):
        return True
    low = text.lower()
    if "dot" in low and _WORD_DOT.search(low):
        return True
    if _AT_HINT.search(text) and _PLAIN_HOST.search(text):
        return True
    words = low.translate(_BREAKS).split()
    return not _DIGIT_SET.isdisjoint(words) and bool(_SPELLED.search(low))


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind number, end) in that order."""
    base = detect(text)
    if not suspicious(text):
        return base, base
    m = spelled_digits(signs(homoglyphs(Mapped.of(text))))
    seen, more = set(base), []
    for a, kind, b in detect(m.text):
        if any(m.edited[a:b]) or m.ends[b - 1] - m.starts[a] != b - a:
            span = (m.starts[a], kind, m.ends[b - 1])
            if span not in seen:
                seen.add(span)
                more.append(span)
    return base, sorted(base + more)


_SPAN = "array<struct<start: bigint, kind: string, end: bigint>>"


def _column(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    offsets, flat = [0], []
    for x in found:
        flat += x
        offsets.append(len(flat))
    fields = pa.StructArray.from_arrays(
        [pa.array([x[0] for x in flat], pa.int64()), pa.array([KINDS[x[1]] for x in flat], pa.string()),
         pa.array([x[2] for x in flat], pa.int64())], ["start", "kind", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans``: the base spans and all spans of every whole text, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t) if t else ([], []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _column([x for x, _ in found]), _column([x for _, x in found])], ["id", "base", "spans"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {sql_type(docs, id_col)}, base {_SPAN}, spans {_SPAN}")


def op3_pii_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
