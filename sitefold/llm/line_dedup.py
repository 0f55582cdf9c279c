"""Boilerplate lines by their frequency within a host.

Pages are grouped by host. For each distinct line the pages of the host that hold it are counted and divided by the
host's page total; a line above ``max_ratio`` on at least ``min_pages`` pages is boilerplate of that host and is
dropped from its pages. Lines are compared without surrounding blanks; blank lines are never dropped. With
``copies_only``, as the query and the pipeline call it, a page all of whose lines are boilerplate is kept as it is only if
its host has another page of exactly its text: copies are for near-dedup to judge. These pages are marked in the column
``exempt``; any other page of boilerplate alone, a menu or footer, loses all its lines. Without ``copies_only`` every
page of boilerplate alone is kept as it is.

Line counts combine before the shuffle, so a line that a third of all pages share costs one row per task. A host has
at most (mean distinct lines per page) / ``max_ratio`` boilerplate lines; these sets are measured, broadcast within
the bound and joined by a spread shuffle beyond it. Texts are not shuffled in the first case. Copies are counted among the
pages of boilerplate alone, whose copies are such pages too, by digest; the digests found take the same route.

Defined cases: a null text stays null and counts as a page without lines; a null host is a host of its own; an empty
text has one blank line. Repeated rows are pages of their own. Extra columns pass through unchanged, but
``n_lines`` and ``n_dropped`` (with ``copies_only`` also ``exempt``) are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import landed
from sitefold.operators.joins import lookup_join

MAX_RATIO = 0.1
MIN_PAGES = 3
#: Names of helper columns; they cannot clash with a user's.
_HOST, _BAD, _PAGE = "__ld_host", "__ld_bad", "__ld_page"
_BLANKS = "concat(' ', chr(9), chr(13))"


def _hashes(text: str) -> str:
    """SQL text: the digests of all lines; null for a blank one."""
    return f"transform(split({text}, '\\n', -1), l -> CASE WHEN btrim(l, {_BLANKS}) <> '' THEN md5(btrim(l, {_BLANKS})) END)"


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Per host: its page total and the digests of its boilerplate lines."""
    pages = docs.select(F.to_json(F.struct(F.col(host))).alias(_HOST), F.col(text).alias("body"))
    # One row per page and distinct line, and one row per page for the total (line null).
    lines = F.expr(f"explode(array_append(filter(array_distinct({_hashes('body')}), h -> h IS NOT NULL), NULL))")
    counted = (
        pages.withColumn("body", F.coalesce("body", F.lit("")))
        .select(_HOST, lines.alias("line"))
        .groupBy(_HOST, "line")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.expr(f"line IS NULL OR n_pages >= {min_pages}"))
    )
    shared = landed(counted)
    totals = shared.where("line IS NULL").select(_HOST, F.col("n_pages").alias("total"))
    frequent = lookup_join(shared.where("line IS NOT NULL"), totals, [_HOST], "inner", ["line"])
    return (
        frequent.where(F.col("n_pages") / F.col("total") > F.lit(max_ratio))
        .groupBy(_HOST)
        .agg(F.collect_list("line").alias(_BAD))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies_only: bool = False,
) -> DataFrame:
    """All rows and columns of ``docs`` with a cleaned text, plus ``n_lines`` and ``n_dropped``.

    ``copies_only``: of pages of boilerplate alone only copies keep their lines; ``exempt`` tells which pages do.
    """
    bad = landed(boilerplate(docs, host, text, max_ratio, min_pages))
    keyed = docs.withColumn(_HOST, F.to_json(F.struct(F.col(host))))
    joined = lookup_join(keyed, bad, [_HOST], "left", [text])
    lines, hits = f"split(`{text}`, '\\n', -1)", f"array_intersect({_hashes(f'`{text}`')}, {_BAD})"
    kept = (
        f"filter({lines}, l -> btrim(l, {_BLANKS}) = '' OR NOT array_contains(__ld_hits, md5(btrim(l, {_BLANKS}))))"
    )
    marked = joined.withColumn("__ld_hits", F.expr(f"CASE WHEN {_BAD} IS NOT NULL THEN {hits} END"))
    filtered = marked.withColumn("__ld_kept", F.expr(f"CASE WHEN size(__ld_hits) > 0 THEN {kept} END"))
    changes = F.expr(f"exists(__ld_kept, l -> btrim(l, {_BLANKS}) <> '')")
    if copies_only:
        # The digest of a page that would lose all its lines.
        filtered = filtered.withColumn(_PAGE, F.when(~changes, F.md5(text)))
        alone = filtered.where(F.col(_PAGE).isNotNull()).groupBy(_HOST, _PAGE).agg(F.count(F.lit(1)).alias("n"))
        copies = landed(alone.where("n > 1").select(_HOST, _PAGE, F.lit(True).alias("__ld_copy")))
        filtered = lookup_join(filtered, copies, [_HOST, _PAGE], "left", [text])
        changes = F.col("__ld_kept").isNotNull() & F.col("__ld_copy").isNull()
    cleaned = (
        filtered.withColumn("__ld_changes", F.coalesce(changes, F.lit(False)))
        .withColumn("n_lines", F.expr(f"CASE WHEN `{text}` IS NULL THEN 0L ELSE cast(size({lines}) AS bigint) END"))
        .withColumn("n_dropped", F.expr("CASE WHEN __ld_changes THEN n_lines - size(__ld_kept) ELSE 0L END"))
        .withColumn(text, F.expr(f"CASE WHEN __ld_changes THEN array_join(__ld_kept, '\\n') ELSE `{text}` END"))
    )
    if copies_only:
        cleaned = cleaned.withColumn("exempt", F.coalesce("__ld_copy", F.lit(False)))
    return cleaned.drop(_HOST, _BAD, _PAGE, "__ld_hits", "__ld_kept", "__ld_copy", "__ld_changes")
