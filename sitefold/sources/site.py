"""Site information from the settings endpoint or, failing that, the API root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.sqltext import lit
from sitefold.schemas import SITE, struct_type, zero_filled_sql
from sitefold.sources.rest import is_json_object

# Fixed value: name of a site whose information cannot be read.
DEFAULT_NAME = "WordPress Site"


def site_info(api_pages: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per row of ``sites(site, url)``.

    The settings body counts if its status is 200; otherwise the root body is
    read whatever its status. A body that is no JSON object gives the default
    name and the given URL. ``home_url`` also reads the key ``home``.
    """
    info = api_pages.filter(F.col("endpoint").isin("settings", "root"))
    settings = info.filter("endpoint = 'settings' AND status = 200").select("site", F.col("body").alias("settings"))
    root = info.filter("endpoint = 'root'").select("site", F.col("body").alias("root"))
    body = F.coalesce("settings", "root", F.lit(""))
    read = (
        sites.select("site", "url")
        .join(settings, "site", "left")
        .join(root, "site", "left")
        .select(
            "site",
            F.col("url").alias("given_url"),
            is_json_object(body).alias("readable"),
            F.from_json(body, SITE + ", home STRING").alias("info"),
        )
    )
    columns = []
    for field in struct_type(SITE):
        value = "coalesce(info.home_url, info.home)" if field.name == "home_url" else f"info.{field.name}"
        filled = zero_filled_sql(value, field.dataType)
        default = {"name": lit(DEFAULT_NAME), "url": "given_url"}.get(field.name)
        if default:
            filled = f"CASE WHEN readable THEN {filled} ELSE {default} END"
        else:
            filled = f"CASE WHEN readable THEN {filled} ELSE {zero_filled_sql(None, field.dataType)} END"
        columns.append(f"{filled} AS {field.name}")
    return read.selectExpr("site", *columns)
