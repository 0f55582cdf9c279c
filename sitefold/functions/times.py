"""Timestamps of captured records and their printed form."""

from __future__ import annotations

from pyspark.sql import Column

from sitefold.functions.sqltext import column, lit, text

_SHAPE = lit(
    r"\A\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d"
    r"(?:[.,]\d+)?(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))?\z"
)
# Fixed value: what a record without a date prints.
ZERO_TIME = "0001-01-01T00:00:00Z"


def is_time_sql(value: str) -> str:
    raw = text(value)
    return f"({raw} RLIKE {_SHAPE} AND try_cast(substring({raw}, 1, 10) AS DATE) IS NOT NULL)"


def _two_digit_hour(raw: str) -> str:
    return f"CASE WHEN substring({raw}, 13, 1) = ':' THEN concat(substring({raw}, 1, 11), '0', substring({raw}, 12)) ELSE {raw} END"


def _has_offset(raw: str) -> str:
    return f"(length({raw}) >= 24 AND substring({raw}, -6, 1) IN ('+', '-'))"


def _fraction(raw: str, digits: int) -> str:
    return f"CASE WHEN length({raw}) > 20 THEN substring(regexp_extract({raw}, {lit(r'[.,](\d+)')}, 1), 1, {digits}) ELSE '' END"


def parse_time_sql(value: str) -> str:
    raw = text(value)
    written = f"concat(substring({_two_digit_hour(raw)}, 1, 19), '.', rpad({_fraction(raw, 6)}, 6, '0'), 'Z')"
    minutes = f"(CAST(substring({raw}, -5, 2) AS BIGINT) * 60 + CAST(substring({raw}, -2, 2) AS BIGINT))"
    shift = (
        f"CASE WHEN NOT {_has_offset(raw)} THEN 0 WHEN substring({raw}, -6, 1) = '-' THEN -{minutes} ELSE {minutes} END"
    )
    stamp = f"timestamp_micros(unix_micros(try_cast({written} AS TIMESTAMP)) - ({shift}) * 60000000)"
    return f"CASE WHEN {is_time_sql(value)} THEN {stamp} END"


def print_time_sql(value: str, unreadable: str = ZERO_TIME, fraction: bool = False) -> str:
    raw = text(value)
    zone = (
        f"CASE WHEN {_has_offset(raw)} AND NOT endswith({raw}, '00:00') THEN substring({raw}, -6) ELSE 'Z' END"
    )
    parts = [f"substring({_two_digit_hour(raw)}, 1, 19)"]
    if fraction:
        parts.append(f"coalesce(concat('.', nullif(rtrim('0', {_fraction(raw, 9)}), '')), '')")
    printed = f"concat({', '.join([*parts, zone])})"
    return (
        f"CASE WHEN {raw} = '' THEN {lit(ZERO_TIME)} WHEN {is_time_sql(value)} THEN {printed} ELSE {lit(unreadable)} END"
    )


def is_time(value: str) -> Column:
    return column(is_time_sql(value))


def parse_time(value: str) -> Column:
    """UTC timestamp; NULL where the text is not in one of the accepted layouts.

    A time without offset is UTC. Digits beyond microseconds are dropped.
    """
    return column(parse_time_sql(value))


def print_time(value: str, unreadable: str = ZERO_TIME, fraction: bool = False) -> Column:
    """The time in its own offset, ``Z`` for UTC, to the second or with its fraction.

    A missing time prints the zero time; text that is no time prints ``unreadable``
    (pass the run time to stamp such records with the time of the export).
    """
    return column(print_time_sql(value, unreadable, fraction))
