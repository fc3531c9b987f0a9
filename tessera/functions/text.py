"""Quality signals as native column expressions.

Each function returns a Column, so the whole filter runs inside whole-stage
codegen and never leaves the JVM. Python string semantics are reproduced with
regular expressions over explicit character sets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import HEADER_CHARS

# The characters Python treats as line boundaries (str.splitlines)
# and as whitespace (str.strip with no argument).
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java regex: "\r\n" counts as one boundary, every other break character as one.
_BREAK_RE = "\\r\\n|[\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
_BREAK_CHAR_RE = "[\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
_NON_ALNUM_RE = "[^\\p{L}\\p{N}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def n_chars(col) -> Column:
    """Length in code points (Python ``len``)."""
    return F.length(_c(col))


def n_lines(col) -> Column:
    """``len(text.splitlines())``.

    One line per boundary, plus one for a final line without a terminator.
    The empty string has no lines.
    """
    c = _c(col)
    breaks = F.regexp_count(c, F.lit(_BREAK_RE))
    open_tail = (F.length(c) > 0) & ~F.substring(c, -1, 1).rlike(_BREAK_CHAR_RE)
    return (breaks + F.when(open_tail, 1).otherwise(0)).cast("int")


def avg_line(col) -> Column:
    """``n_chars / max(n_lines, 1)``."""
    return n_chars(col) / F.greatest(n_lines(col), F.lit(1))


def alnum_ratio(col) -> Column:
    """C4: share of code points that are letters or digits (Python ``isalnum``)."""
    c = _c(col)
    alnum = F.length(F.regexp_replace(c, _NON_ALNUM_RE, ""))
    return F.try_divide(alnum, F.length(c))


def header(col, n: int = HEADER_CHARS) -> Column:
    """The first ``n`` code points, lower-cased."""
    return F.lower(F.substring(_c(col), 1, n))


def py_strip(col) -> Column:
    """``str.strip()`` with Python's whitespace set (plain ``trim`` strips spaces only)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def is_blank(col) -> Column:
    """True for null, empty or whitespace-only text (Python ``not s or not s.strip()``)."""
    c = _c(col)
    return c.isNull() | (F.length(py_strip(c)) == 0)
