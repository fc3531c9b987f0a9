"""Python syntax check (F8 / E4): a UDF around ``compile``.

The UDF is a plain one: a worker gets texts a hundred rows at a time, while an Arrow batch
holds up to 10,000 rows, which as texts take hundreds of MB in every worker.

The text is parsed and compiled, never executed. Any failure counts as invalid,
including ``ValueError`` (NUL bytes), ``MemoryError``, ``RecursionError`` and
``OverflowError`` from hostile input. The result depends on the worker's Python
grammar version; ``python_version()`` reports it.
"""

from __future__ import annotations

import sys
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compiles(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<string>", "exec")
        return True
    except Exception:  # SyntaxError, ValueError, MemoryError, RecursionError, OverflowError
        return False


_is_valid_python = F.udf(compiles, T.BooleanType(), useArrow=False)


def is_valid_python(col) -> Column:
    """Column of booleans: null for null text."""
    from tessera.session import ship_package

    ship_package()
    c = F.col(col) if isinstance(col, str) else col
    return _is_valid_python(c)


def python_version() -> str:
    return "%d.%d" % sys.version_info[:2]
