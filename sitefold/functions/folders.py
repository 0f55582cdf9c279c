"""Category folders a permalink stands for."""

from __future__ import annotations

from pyspark.sql import Column

from sitefold.functions.links import resolved_sql, url_path_sql
from sitefold.functions.names import EMPTY_FOLDER, FOLDER_FORBIDDEN, replace_each_sql
from sitefold.functions.sqltext import bind, column, lit, text

# Permalink segments that are not categories.
NON_CATEGORY_SEGMENTS = ("blog", "posts", "archives")

# Segments of a path are told apart by the slashes around them.
_START, _END = r"(?<![^/])", r"(?![^/])"
# Addresses without escapes and special hosts whose path has one segment or starts with a date: they name no folder.
_NO_FOLDER = lit(
    r"\A[A-Za-z][A-Za-z0-9+.\-]*://[A-Za-z0-9.\-]*(?::[0-9]*)?"
    r"(?:/+(?:[^\x00-\x1f\x7f%?#/]*/*|[0-9]+/[0-9]+/[0-9]+(?:/[^\x00-\x1f\x7f%?#]*)?))?(?:[?#][^\x00-\x1f\x7f%]*)?\z"
)


def is_numeric_sql(value: str) -> str:
    return f"({text(value)} RLIKE {lit(r'\A[0-9]+\z')})"


def is_numeric(value: str) -> Column:
    """ASCII digits only, at least one."""
    return column(is_numeric_sql(value))


def _without_segments(path: str, *segments: str) -> str:
    """A path without empty segments and those that match one of the patterns."""
    return f"btrim(regexp_replace({path}, {lit(_START + '(?:' + '|'.join(segments) + ')?(?:/|' + chr(92) + 'z)')}, ''), '/')"


def _resolved(path: str) -> str:
    """Resolve ``.`` and ``..`` in a joined path; ``.`` stands for nothing left."""
    whole = f"array_join({resolved_sql(f'split({path}, {lit('/')})', ('.',))}, '/')"
    return f"CASE WHEN {path} RLIKE {lit(_START + r'\.\.?' + _END)} THEN coalesce(nullif({whole}, ''), '.') ELSE {path} END"


def join_folders_sql(names: str) -> str:
    return bind(f"array_join({names}, '/')", _resolved)


def join_folders(names: str) -> Column:
    """Join folder names, resolving ``.`` and ``..`` without ever leaving the top.

    An empty list gives an empty string; names that resolve to nothing give ``.``.
    """
    return column(join_folders_sql(names))


def link_folder_sql(link: str) -> str:
    def folders(path: str) -> str:
        parents = f"substring({path}, 1, length({path}) - length(substring_index({path}, '/', -1)))"
        named = _without_segments(parents, "[0-9]+", *NON_CATEGORY_SEGMENTS)
        # Clean every segment at once: a hyphen per run of forbidden characters,
        # none next to a slash.
        hyphened = f"regexp_replace({replace_each_sql(named, FOLDER_FORBIDDEN[1:], '-')}, '-+', '-')"
        clean = f"regexp_replace({hyphened}, {lit(_START + '-|-' + _END)}, '')"
        kept = _without_segments(clean, EMPTY_FOLDER)
        dated = f"{path} RLIKE {lit(r'\A[0-9]+/[0-9]+/[0-9]+' + _END)}"
        return f"CASE WHEN NOT contains({path}, '/') OR {dated} THEN '' ELSE {bind(kept, _resolved)} END"

    named = bind(f"btrim({text(url_path_sql(link))}, '/')", folders)
    return f"CASE WHEN {text(link)} RLIKE {_NO_FOLDER} THEN '' ELSE {named} END"


def link_folder(link: str) -> Column:
    """Category folders named by a permalink; empty where it names none."""
    return column(link_folder_sql(link))
