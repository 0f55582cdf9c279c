"""Helpers to write column functions as Spark SQL expressions.

Every function of this package exists twice: ``<name>_sql`` maps SQL text to SQL
text and composes freely, ``<name>`` returns the Column. One expression string
costs one call into the JVM however large it is, and Catalyst sees the same
built-in functions either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text(value: str) -> str:
    """The value with NULL read as the empty string."""
    return f"coalesce({value}, '')"


_depth = 0


def bind(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    global _depth
    _depth += 1
    name = f"v{_depth}"
    try:
        return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"
    finally:
        _depth -= 1


def column(sql: str) -> Column:
    return F.expr(sql)
