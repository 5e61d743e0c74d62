"""Sorts, top-k and set operations.

Global sorts are range-partitioned on the full sort key, so one busy
tenant or hub is spread over several tasks.  Top-k per tenant uses
``row_number() <= k``, which Spark plans with a per-partition group limit
*before* the shuffle (only k rows per tenant per task cross the network).
Counts "beside the rows" come from a partial aggregate joined back on the
tenant key — never a window over a whole tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.operators import aggregates as A
from hydrolake.operators import filters as FL
from hydrolake.session import ensure_checkpoint_dir
from hydrolake.operators.clean import count_message

QUALITY_RECORD_ORDER = (
    "Hub_ID", "Temperature", "pH", "BOD", "Faecal_Coliform", "Total_Coliform", "Nitrate", "Conductivity", "WQI",
    "Category", "Anomaly_Status", "Used_For_Training",
)


def _newest_first(cols: list[str]):
    """Newest first, then every other column: a total order with no row key."""
    rest = [F.col(c).asc_nulls_first() for c in cols if c not in ("MC_Code", "Created_At")]
    return [F.col("Created_At").desc_nulls_last(), *rest]


# O1 -------------------------------------------------------------------------
def quality_records(records: DataFrame, mc_code: str | None = None, hub_id: str | None = None) -> DataFrame:
    """Records of a tenant (all tenants when None), newest first within each tenant."""
    df = FL.scope(records, mc_code, hub_id)
    return df.orderBy(F.col("MC_Code").asc_nulls_first(), *_newest_first(df.columns))


# O2 -------------------------------------------------------------------------
def quality_history_top(records: DataFrame, k: int = 10, mc_code: str | None = None,
                        hub_id: str | None = None) -> DataFrame:
    """The ``k`` newest records per tenant (the history table of the monitor page)."""
    df = FL.scope(records, mc_code, hub_id)
    w = Window.partitionBy("MC_Code").orderBy(*_newest_first(df.columns))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def _with_count(df: DataFrame, name: str) -> DataFrame:
    """The rows with their municipality's count beside them.

    The rows are few and dear (filtered, scored records): they are stored once,
    and counted and joined from there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    counts = df.groupBy("MC_Code").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("MC_Code", "_mc")
    return df.join(counts, F.col("MC_Code") == F.col("_mc")).drop("_mc")


# O3 -------------------------------------------------------------------------
def anomaly_summary(records: DataFrame, mc_code: str | None = None, hub_id: str | None = None) -> DataFrame:
    """Anomalies of a tenant newest first, with their count and the count message."""
    df = FL.anomaly_filter(FL.scope(records, mc_code, hub_id)).select(
        "MC_Code", "Hub_ID", "WQI", "Anomaly_Status", "Created_At"
    )
    out = _with_count(df, "Total_Anomalies")
    out = out.withColumn("Message", count_message(F.col("Total_Anomalies"), K.NO_ANOMALIES, K.ANOMALIES_FMT))
    return out.orderBy(F.col("MC_Code").asc_nulls_first(), *_newest_first(df.columns))


def anomaly_counts(municipal: DataFrame, records: DataFrame) -> DataFrame:
    """Per tenant, also for tenants with none: count and message (zero case included)."""
    n = FL.anomaly_filter(records).groupBy("MC_Code").agg(F.count(F.lit(1)).alias("Total_Anomalies"))
    out = municipal.select("MC_Code").join(n, "MC_Code", "left")
    out = out.withColumn("Total_Anomalies", F.coalesce("Total_Anomalies", F.lit(0).cast("long")))
    return out.withColumn("Message", count_message(F.col("Total_Anomalies"), K.NO_ANOMALIES, K.ANOMALIES_FMT))


# O4 -------------------------------------------------------------------------
def critical_summary(records: DataFrame, mc_code: str | None = None) -> DataFrame:
    """Critical-risk records of a tenant newest first, with count and message."""
    df = FL.critical_filter(FL.scope(records, mc_code)).select(
        "MC_Code", "Hub_ID", "Predicted_Supply_Efficiency", "Critical_Risk", "Recommended_Action", "Created_At"
    )
    out = _with_count(df, "Total_Critical_Instances")
    out = out.withColumn("Message", count_message(F.col("Total_Critical_Instances"), K.NO_CRITICAL, K.CRITICAL_FMT))
    return out.orderBy(F.col("MC_Code").asc_nulls_first(), *_newest_first(df.columns))


# O5 -------------------------------------------------------------------------
def municipal_list(municipal: DataFrame) -> DataFrame:
    """(code, name) ordered by name, with the municipality count."""
    total = municipal.agg(F.count(F.lit(1))).scalar()
    return municipal.select("MC_Code", "MC_Name", total.alias("Total_Municipals")).orderBy("MC_Name", "MC_Code")


# O6 -------------------------------------------------------------------------
def ordered_history(records: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Oldest-first history per (tenant, hub) as a range-partitioned global sort.

    Trend reports never need this order (they aggregate or window); it is
    for consumers that page through a hub's history.
    """
    cols = cols or ["MC_Code", "Hub_ID", "WQI", "Anomaly_Status", "Created_At"]
    keys = ["MC_Code", "Hub_ID", "Created_At"]
    return records.select(*cols).orderBy(*keys, *[c for c in cols if c not in keys])


# U1 / U2 ----------------------------------------------------------------------
last_updated = A.last_updated
merged_measurements = A.merged_measurements
