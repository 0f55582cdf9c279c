"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sitefold.llm import alignment, collocations, decontamination, embedding_dedup, license_scan, line_dedup, pieces, quality, sharding, simhash, substring_dedup, toxicity, url_filter
from sitefold.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the chain's probabilities and the verdict ``toxic`` of every document."""
    labels = toxicity.chain_labels(table(spark, sf_dir, "labels"))
    return toxicity.score(table(spark, sf_dir, "documents"), labels)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids, their number, the digest of the decoded text and whether it equals the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, decoded="decoded")
    return coded.select("doc_id", "token_ids", "n_tokens", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, cleaned text, its number of lines and of dropped lines, and whether it is exempt; hosts are sources.

    A line is boilerplate above a tenth of a source's pages, on 3 pages or more. Two things differ from the plain ratio: hosts
    of few pages have no boilerplate (3 pages), and a page that would lose all its lines keeps them if its source has another page
    of exactly its text: such copies are for near-dedup to judge, and they are marked as exempt.
    """
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), copies_only=True)
    return cleaned.select("doc_id", "source", "text", "n_lines", "n_dropped", "exempt")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that occurs in it."""
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stretches=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignments(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_quality": op12_quality,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
windows AS (SELECT k, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS smallest FROM windows GROUP BY h),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (h) WHERE smallest < doc_id),
words AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.k = words.k AND gone.j = words.j) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)""",
    "op7_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT k, k AS r FROM v UNION SELECT reach.k, links.b FROM reach JOIN links ON links.a = reach.r),
smallest AS (SELECT reach.k, min(v.vec_id) AS component_id FROM reach JOIN v ON v.k = reach.r GROUP BY reach.k)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.k) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN smallest USING (k)""",
    "op5_url_filter": r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, row_number() OVER () AS k,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT p.page_id, p.k, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.k ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE n = 1""",
    "op9_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
found AS (SELECT DISTINCT k, source, trim(l, ' ' || chr(9) || chr(13)) AS line FROM d, unnest(lines) AS u(l)),
bad AS (SELECT f.source, f.line FROM found f JOIN totals t ON f.source IS NOT DISTINCT FROM t.source
  WHERE f.line <> '' GROUP BY f.source, f.line, t.total HAVING count(*) >= 3 AND count(*) / t.total > 0.1),
sets AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
kept AS (SELECT d.*, list_filter(lines, lambda l: trim(l, ' ' || chr(9) || chr(13)) = ''
    OR NOT list_contains(coalesce(s.bad, []), trim(l, ' ' || chr(9) || chr(13)))) AS stay
  FROM d LEFT JOIN sets s ON d.source IS NOT DISTINCT FROM s.source),
losing AS (SELECT *, coalesce(len(stay) < len(lines), false) AS loses,
    coalesce(len(stay) < len(lines) AND len(list_filter(stay, lambda l: trim(l, ' ' || chr(9) || chr(13)) <> '')) = 0, false) AS alone FROM kept),
judged AS (SELECT *, alone AND count(*) FILTER (alone) OVER (PARTITION BY source, text) > 1 AS exempt FROM losing),
changed AS (SELECT *, loses AND NOT exempt AS changes FROM judged)
SELECT doc_id, source, CASE WHEN changes THEN array_to_string(stay, chr(10)) ELSE text END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, (CASE WHEN changes THEN len(lines) - len(stay) ELSE 0 END)::BIGINT AS n_dropped, exempt
FROM changed""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS sizes(m)),
f AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*)::HUGEINT AS n FROM starts GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, p, n AS a FROM f WHERE m > 1 AND n >= 10),
cuts AS (SELECT lang, m, p, a, unnest(range(1, m)) AS k FROM found),
scored AS (SELECT c.*, l.n AS l, r.n AS r, (1000000::HUGEINT * c.a * c.a) // (l.n * r.n) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.p = c.p[:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
around AS (SELECT lang, p, max(a) AS a FROM (SELECT lang, p[1:2] AS p, a FROM found WHERE m = 3 UNION ALL SELECT lang, p[2:3], a FROM found WHERE m = 3) GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN around x ON x.lang = b.lang AND x.p = b.p WHERE x.a IS NULL OR 100 * x.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
