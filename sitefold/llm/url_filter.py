"""URL rules by host suffix and path prefix, found by short hash prefixes.

Each URL is expanded into expressions (host suffix at label borders) x (path prefix of a length that some rule has).
Their SHA-256 digests meet the rules' digests in an equi-join on the first four bytes; a pair counts once the full
digests agree. Of the rules that fit, the longest (host and path together, then host) decides; a URL without a rule
gets the default verdict. Expanding only lengths that occur among the rules loses nothing: a path starts with a rule's
path exactly if its prefix of that length equals it.

Defined cases: null URLs and URLs without ``://`` have an empty host and path and fit no rule. Every input row gives
one row; repeated rows are judged once and given back as often as they came. Rules with a null host or path are
ignored, repeated rules count once; if one address is both allowed and blocked, ``block`` wins. Extra columns of
either table are not read. Empty tables give no rows, or default verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import landed
from sitefold.operators.joins import fits_broadcast

#: Rules of the query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"

_AUTHORITY = "regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty where there is no ``://``."""
    named = urls.withColumn("url", F.col(url))
    return named.withColumn("host", F.expr(f"coalesce(translate({_AUTHORITY}, '{_UPPER}', '{_LOWER}'), '')")).withColumn(
        "path", F.expr(f"coalesce({_PATH}, '')")
    )


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per rule address, with its digest and digest prefix."""
    lower = F.expr(f"translate(host, '{_UPPER}', '{_LOWER}')")
    known = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy(lower.alias("host"), "path")
    one = known.agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    digest = F.expr("unhex(sha2(concat_ws('\\n', host, path), 256))")
    return (
        one.select("verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), digest.alias("rule_digest"))
        .withColumn("prefix", F.expr("substring(rule_digest, 1, 4)"))
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """Key, host, path, rule and verdict of every row."""
    # Rules: host, path, verdict. Landed once, so that measuring, lengths and the join read the same small table.
    known = landed(prepared_rules(rules))
    # Distinct lengths of rule paths: their number is bounded by the longest path, not by the number of rules.
    lengths = sorted(r[0] for r in known.select("path_length").distinct().collect())
    counted = pages.select(F.col(key), F.col(url).alias("url")).groupBy(key, "url").agg(F.count(F.lit(1)).alias("copies"))
    labels = url_parts(counted).withColumn("labels", F.split("host", "\\."))
    suffixes = "transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))"
    known_lengths = f"array({', '.join(map(str, lengths)) or 0})"
    prefixes = f"transform(filter({known_lengths}, n -> n <= length(path)), n -> substring(path, 1, n))"
    expanded = labels.withColumn("suffix", F.expr(f"explode_outer({suffixes})")).withColumn(
        "start", F.expr(f"explode_outer({prefixes})")
    )
    digests = expanded.withColumn("digest", F.expr("unhex(sha2(concat_ws('\\n', suffix, start), 256))")).withColumn(
        "prefix", F.expr("substring(digest, 1, 4)")
    )
    found = digests.join(F.broadcast(known) if fits_broadcast(known) else known, "prefix", "left")
    fits = "digest = rule_digest AND start IS NOT NULL AND url IS NOT NULL AND contains(url, '://')"
    best = found.groupBy(key, "url", "host", "path", "copies").agg(
        F.expr(f"max(CASE WHEN {fits} THEN struct(length(rule) AS n, host_length, rule, verdict) END)").alias("best")
    )
    judged = best.select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "copies"
    )
    return judged.withColumn("copy", F.expr("explode(sequence(1, copies))")).drop("copy", "copies")
