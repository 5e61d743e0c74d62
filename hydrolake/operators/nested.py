"""Nested report forms (N1–N5), derived from the flat relational results.

Only *bounded* groups are packed into a map or array: the years of one hub
(bounded by the report's year range) or one hub's own summary.  Unbounded
groups (all hubs of a tenant, all records of a hub) stay as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# N1 -------------------------------------------------------------------------
def trend_by_hub_map(trend: DataFrame, value_cols: list[str] | None = None) -> DataFrame:
    """hub → summary struct, one map entry per (tenant, hub) row.

    ``trend`` is a per-hub summary (e.g. :func:`aggregates.quality_trend`).
    Merging the entries of a tenant into one map is left to the reader:
    a tenant's hub count is not bounded, so it is never gathered in one task.
    """
    value_cols = value_cols or [c for c in trend.columns if c not in ("MC_Code", "Hub_ID")]
    return trend.select(
        "MC_Code", "Hub_ID",
        F.create_map(F.col("Hub_ID"), F.struct(*[F.col(c) for c in value_cols])).alias("Trend_Summary"),
    )


# N2 -------------------------------------------------------------------------
def year_map(yearly: DataFrame, value_cols: list[str] | None = None) -> DataFrame:
    """Per (tenant, hub): {year text → struct}, over the hub's report years."""
    value_cols = value_cols or [c for c in yearly.columns if c not in ("MC_Code", "Hub_ID", "Year")]
    entry = F.struct(F.col("Year").cast("string").alias("key"), F.struct(*[F.col(c) for c in value_cols]).alias("value"))
    return yearly.groupBy("MC_Code", "Hub_ID").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("Years")
    )


# N3 -------------------------------------------------------------------------
def year_map_rows(maps: DataFrame, field: str = "Average_WQI") -> DataFrame:
    """Year map → (year, value) rows, as the bar charts read it."""
    return maps.select("MC_Code", "Hub_ID", F.explode("Years").alias("year", "v")).select(
        "MC_Code", "Hub_ID", "year", F.col(f"v.{field}").alias(field)
    )


# N4 -------------------------------------------------------------------------
def hub_lookup(selected: DataFrame, maps: DataFrame) -> DataFrame:
    """``map[hub] || {}`` for each selected (tenant, hub): empty map when absent."""
    joined = selected.select("MC_Code", "Hub_ID").join(maps, ["MC_Code", "Hub_ID"], "left")
    value_type = maps.schema["Years"].dataType
    empty = F.create_map().cast(value_type)
    return joined.withColumn("Years", F.coalesce(F.col("Years"), empty))


# N5 -------------------------------------------------------------------------
def report_json(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Any report row as JSON text (keys kept beside it for routing)."""
    key_cols = key_cols or [c for c in ("MC_Code", "Hub_ID") if c in df.columns]
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(*key_cols, body.alias("json"))
