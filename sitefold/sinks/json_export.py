"""JSON export: datasets by entity, or one document per site as ordered lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitefold.functions.sqltext import lit
from sitefold.functions.times import print_time_sql
from sitefold.operators.joins import lookup_join, materialised
from sitefold.schemas import ENDPOINT_ROWS, SITE, STAT_COLUMNS, struct_type
from sitefold.session import landed_once

# Keys of the documents, in the order in which they are written.
EXPORT_KEYS = ("site", "posts", "pages", "media", "categories", "tags", "users", "exported_at", "stats")
METADATA_KEYS = ("categories", "exported_at", "media", "stats", "tags", "users")
_TIME_FIELDS = ("date", "date_gmt", "modified", "modified_gmt")
# Fields left out where they are empty.
_OPTIONAL_FLAGS = ("protected",)
_OPTIONAL_GROUPS = ("media_details", "_links")

_HEAD, _RECORD, _TAIL = 0, 1, 2


def _json_value(value: str, field: T.StructField, run_time: str, optional: bool) -> str:
    """The field as written: optional fields NULL when empty (and so left out), VARIANT NULL as ``null``."""
    kind = field.dataType
    if isinstance(kind, T.StructType):
        inner = [
            f"{lit(f.name)}, "
            + _json_value(
                f"{value}.`{f.name}`", f, run_time, f.name in _OPTIONAL_FLAGS or field.name in _OPTIONAL_GROUPS
            )
            for f in kind
        ]
        return f"named_struct({', '.join(inner)})"
    if field.name in _TIME_FIELDS:
        return print_time_sql(value, run_time, fraction=True)
    if not optional:
        return f"coalesce({value}, parse_json('null'))" if isinstance(kind, T.VariantType) else value
    if isinstance(kind, T.StringType):
        return f"nullif({value}, '')"
    if isinstance(kind, T.BooleanType):
        return f"CASE WHEN {value} THEN true END"
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return f"CASE WHEN size({value}) > 0 THEN {value} END"
    return value


def record_json(ddl: str, run_time: str) -> Column:
    fields = [f"{lit(f.name)}, {_json_value(f'`{f.name}`', f, run_time, False)}" for f in struct_type(ddl)]
    return F.expr(f"to_json(named_struct({', '.join(fields)}))")


def stats_json() -> Column:
    return F.to_json(F.struct(*STAT_COLUMNS))


def entity_rows(tables: dict[str, DataFrame], run_time: str) -> DataFrame:
    """(site, entity, ord, record) of the given tables, each record as JSON text.

    Keys are ``posts`` (posts and pages in one pass), ``media``, ``categories``,
    ``tags`` and ``users``.
    """
    parts = []
    for name, rows in tables.items():
        entity = F.expr("CASE WHEN content_type = 'page' THEN 'pages' ELSE 'posts' END") if name == "posts" else F.lit(name)
        record = record_json(ENDPOINT_ROWS[name], run_time)
        parts.append(rows.select("site", entity.alias("entity"), "ord", record.alias("record")))
    return reduce(DataFrame.unionByName, parts)


def document_lines(
    sites: DataFrame, records: DataFrame, stats: DataFrame, run_time: str, keys: tuple[str, ...], listed: DataFrame | None = None
) -> DataFrame:
    """(site, key_no, part, ord, line): the lines of one JSON document per site, in that order.

    A site of any size stays spread over tasks, since its document is a sorted
    run of rows rather than one value. A record is preceded by a comma unless it
    is the first of its list; firsts are found by a small aggregation, of ``listed`` where
    the same (site, entity, ord) can be read there at less cost.
    """
    lists = [k for k in keys if k in ENDPOINT_ROWS]
    numbers = F.create_map(*[item for n, k in enumerate(keys) for item in (F.lit(k), F.lit(n))])
    zero = F.lit(0).cast("long")

    def opening(key: str) -> str:
        return ("{" if keys[0] == key else ",") + f'"{key}":'

    def closing(key: str) -> str:
        return "}" if keys[-1] == key else ""

    def single(rows: DataFrame, key: str, value: Column) -> DataFrame:
        line = F.concat(F.lit(opening(key)), value, F.lit(closing(key)))
        return rows.select("site", F.lit(keys.index(key)).alias("key_no"), F.lit(_HEAD).alias("part"), zero.alias("ord"), line.alias("line"))

    frames = [
        f"named_struct('key_no', {keys.index(k)}, 'part', {part}, 'line', {lit(line)})"
        for k in lists
        for part, line in ((_HEAD, opening(k) + "["), (_TAIL, "]" + closing(k)))
    ]
    framing = sites.selectExpr("site", f"explode(array({', '.join(frames)})) AS frame").select(
        "site", "frame.key_no", "frame.part", zero.alias("ord"), "frame.line"
    )
    chosen, counted = [rows.filter(F.col("entity").isin(*lists)) for rows in (records, records if listed is None else listed)]
    # A row per list: measured and broadcast, so that records are not shuffled for their commas.
    firsts = materialised(counted.groupBy("site", "entity").agg(F.min("ord").alias("first_ord")))
    numbered = lookup_join(chosen, firsts, ["site", "entity"], "left", ["ord"]).select(
        "site",
        numbers[F.col("entity")].alias("key_no"),
        F.lit(_RECORD).alias("part"),
        "ord",
        F.concat(F.when(F.col("ord") == F.col("first_ord"), F.lit("")).otherwise(F.lit(",")), F.col("record")).alias("line"),
    )
    parts = [framing, numbered, single(stats, "stats", stats_json())]
    parts.append(single(sites, "exported_at", F.lit(f'"{run_time}"')))
    if "site" in keys:
        parts.append(single(sites, "site", F.to_json(F.struct(*[f.name for f in struct_type(SITE)]))))
    return reduce(DataFrame.unionByName, parts)


#: Largest document that is one file.
WHOLE_BYTES = 64 << 20
LINE_ORDER = ["site", "key_no", "part", "ord"]


def write_document_lines(lines: DataFrame, output: str, whole_bytes: int = WHOLE_BYTES) -> None:
    """One folder per site; its part files, read in name order, form the document.

    The document of a site of up to ``whole_bytes`` is one file, valid JSON by itself: such sites are dealt whole, and a task
    streams them in order. That of a larger one is spread over files by range partitioning on the full order. The table
    ``<output>-parts`` lists every file with its number, its first byte in the document and its length. The lines
    are landed once, for their sizes and for both writers.
    """
    spark = lines.sparkSession
    with landed_once(lines) as rows:
        sizes = materialised(rows.groupBy("site").agg(F.sum(F.octet_length("line") + 1).alias("bytes")))
        large = materialised(sizes.where(F.col("bytes") > whole_bytes).select("site"))
        whole = lookup_join(rows, large, ["site"], "left_anti", ["key_no", "ord"])
        _written(whole.repartitionByRange("site"), output, "overwrite")
        if not large.isEmpty():
            spread = lookup_join(rows, large, ["site"], "left_semi", ["key_no", "ord"])
            _written(spread.repartitionByRange(*LINE_ORDER), output, "append")  # adaptive execution sets the number of parts
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(output).select("path", "length")
    site = F.url_decode(F.replace(F.regexp_extract("path", "/site=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    # A site's files are as many as it has parts, so its offsets are sums over few rows.
    order = Window.partitionBy("site").orderBy("path")
    placed = files.select(site.alias("site"), F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length")
    placed.select(
        "site",
        (F.row_number().over(order) - 1).alias("part"),
        "file",
        (F.sum("length").over(order) - F.col("length")).alias("first_byte"),
        F.col("length").alias("bytes"),
    ).write.mode("overwrite").parquet(f"{output}-parts")


def _written(rows: DataFrame, output: str, mode: str) -> None:
    rows.sortWithinPartitions(*LINE_ORDER).select("site", "line").write.mode(mode).partitionBy("site").text(output)


def write_entities(records: DataFrame, output: str) -> None:
    """Records as JSON lines, one folder per entity, with the site beside each record."""
    records.select("entity", F.to_json(F.struct("site", "ord", F.parse_json("record").alias("record"))).alias("line")).write.mode(
        "overwrite"
    ).partitionBy("entity").text(output)
