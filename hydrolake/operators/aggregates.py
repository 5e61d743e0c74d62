"""Aggregations.

All aggregates are built-in (partial aggregation on the map side, then one
exchange of partial rows), so a municipality or hub holding a third of the
records costs no more than any other: its rows are folded before the
shuffle.  Per-tenant reports are computed for every tenant at once and
keyed by ``MC_Code``; filter first for a single tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.functions.numeric import default_zero_round, is_nonfinite, nonfinite_to_null, rn
from hydrolake.operators import clean as C


def _is_anomaly():
    return F.when(F.col("Anomaly_Status") == F.lit(K.ANOMALY), F.lit(1)).otherwise(F.lit(0))


def _coerce_created(df: DataFrame) -> DataFrame:
    """C3 on ``Created_At``: text that is not a timestamp becomes null.

    A column already typed as a timestamp passes through unchanged (the
    coercion is the identity there), so no per-row string round trip.
    """
    if dict(df.dtypes)["Created_At"] in ("timestamp", "timestamp_ntz"):
        return df.withColumn("Created_At", F.col("Created_At").cast("timestamp_ntz"))
    return df.withColumn("Created_At", F.col("Created_At").cast("string").try_cast("timestamp_ntz"))


def _collapse(*frames: DataFrame) -> DataFrame:
    """Merge one-row aggregate frames into one row (union + max), no cross join."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return u.agg(*[F.max(c).alias(c) for c in cols])


# A1 -------------------------------------------------------------------------
def _quality_metrics(quality: DataFrame, full: bool) -> DataFrame:
    aggs = [default_zero_round(F.avg("WQI"), 2).alias("Average_WQI")]
    if full:
        aggs += [F.sum(_is_anomaly()).cast("long").alias("Total_Anomalies"),
                 F.max("Created_At").alias("_q_last")]
    return quality.agg(*aggs)


def _distribution_metrics(distribution: DataFrame, full: bool) -> DataFrame:
    aggs = [default_zero_round(F.avg("Predicted_Supply_Efficiency"), 2).alias("Average_Distribution_Efficiency")]
    if full:
        aggs += [F.count_distinct(F.when(F.col("Critical_Risk") == F.lit(1), F.col("Hub_ID")))
                 .alias("Total_Critical_Hubs"),
                 F.max("Created_At").alias("_d_last")]
    return distribution.agg(*aggs)


def _municipal_metrics(municipal: DataFrame) -> DataFrame:
    return municipal.agg(
        F.count(F.lit(1)).alias("Total_Municipal_Corporations"),
        F.sum("Population").alias("Total_Population"),
    )


def public_overall_stats(municipal: DataFrame, quality: DataFrame, distribution: DataFrame) -> DataFrame:
    """Municipality count and population, average WQI and efficiency (C8 rounding).

    One aggregate pass per table, merged into one row.
    """
    return _collapse(_municipal_metrics(municipal), _quality_metrics(quality, False),
                     _distribution_metrics(distribution, False))


# U1 -------------------------------------------------------------------------
def last_updated(quality: DataFrame, distribution: DataFrame) -> DataFrame:
    """MAX over the UNION (distinct) of the two tables' MAX(Created_At)."""
    a = quality.agg(F.max("Created_At").alias("Created_At"))
    b = distribution.agg(F.max("Created_At").alias("Created_At"))
    return a.union(b).distinct().agg(F.max("Created_At").alias("Last_Updated"))


# A2 -------------------------------------------------------------------------
def overall_stats(municipal: DataFrame, quality: DataFrame, distribution: DataFrame) -> DataFrame:
    """A1 plus anomaly count, distinct critical hubs and last update.

    Still one aggregate pass per table: every metric of a table is computed
    in the same aggregate, and the last update (U1: the maximum of the two
    tables' maxima) is the greater of the two per-table maxima.
    """
    out = _collapse(_municipal_metrics(municipal), _quality_metrics(quality, True),
                    _distribution_metrics(distribution, True))
    return out.select(
        "Total_Municipal_Corporations", "Total_Population", "Average_WQI", "Average_Distribution_Efficiency",
        F.coalesce(F.col("Total_Anomalies"), F.lit(0).cast("long")).alias("Total_Anomalies"),
        "Total_Critical_Hubs",
        F.greatest("_q_last", "_d_last").alias("Last_Updated"),
    )


# A3 -------------------------------------------------------------------------
def distribution_summary(distribution: DataFrame) -> DataFrame:
    """Per municipality: average efficiency, critical hubs, records, total deficit."""
    agg = distribution.groupBy("MC_Code").agg(
        F.avg("Predicted_Supply_Efficiency").alias("avg_eff"),
        F.count_distinct(F.when(F.col("Critical_Risk") == F.lit(1), F.col("Hub_ID"))).alias("Total_Critical_Hubs"),
        F.count(F.lit(1)).alias("Total_Records"),
        F.sum("Deficit_MLD").alias("sum_deficit"),
    )
    return agg.select(
        "MC_Code",
        default_zero_round(F.col("avg_eff"), 2).alias("Average_Supply_Efficiency"),
        "Total_Critical_Hubs",
        "Total_Records",
        default_zero_round(F.col("sum_deficit"), 2).alias("Total_Deficit_MLD"),
    )


# A4 -------------------------------------------------------------------------
def quality_trend_input(quality: DataFrame) -> DataFrame:
    """C3 → C1 → C2 → C4 on (MC_Code, Hub_ID, WQI, Anomaly_Status, Created_At)."""
    df = _coerce_created(quality.select("MC_Code", "Hub_ID", "WQI", "Anomaly_Status", "Created_At"))
    df = C.drop_nulls_subset(df, ["Created_At", "WQI"])
    df = df.withColumn("WQI", F.col("WQI").try_cast("double"))
    return C.nonfinite_to_zero(df)


def quality_trend(quality: DataFrame) -> DataFrame:
    """Per (MC, hub): record count, average WQI (2 digits), anomaly count."""
    return quality_trend_input(quality).groupBy("MC_Code", "Hub_ID").agg(
        F.count(F.lit(1)).alias("Total_Records"),
        rn(F.avg("WQI"), 2).alias("Average_WQI"),
        F.sum(_is_anomaly()).cast("long").alias("Anomaly_Count"),
    )


def quality_trend_records(quality: DataFrame) -> DataFrame:
    """The per-hub records of the trend, oldest first, floats cleaned.

    A relational table sorted by (MC, hub, time) — range partitioning on the
    full key splits a hot hub across tasks, unlike packing it in one array.
    """
    df = quality_trend_input(quality)
    df = df.withColumn("WQI", nonfinite_to_null("WQI", 3))
    return df.orderBy("MC_Code", "Hub_ID", "Created_At", "WQI", "Anomaly_Status")


# A5 -------------------------------------------------------------------------
def distribution_trend(distribution: DataFrame) -> DataFrame:
    """Per (MC, hub): records, average efficiency (2 digits), critical count."""
    df = distribution.filter(F.col("Hub_ID").isNotNull())
    return df.groupBy("MC_Code", "Hub_ID").agg(
        F.count(F.lit(1)).alias("Total_Records"),
        rn(F.avg("Predicted_Supply_Efficiency"), 2).alias("Average_Efficiency"),
        F.sum("Critical_Risk").cast("long").alias("Critical_Count"),
    )


def distribution_trend_records(distribution: DataFrame) -> DataFrame:
    """The records of the distribution trend, unrounded, oldest first per hub."""
    return (
        distribution.filter(F.col("Hub_ID").isNotNull())
        .select("MC_Code", "Hub_ID", "Predicted_Supply_Efficiency", "Critical_Risk", "Created_At")
        .orderBy("MC_Code", "Hub_ID", "Created_At", "Predicted_Supply_Efficiency", "Critical_Risk")
    )


# A6 -------------------------------------------------------------------------
def yearly_quality_agg(quality: DataFrame) -> DataFrame:
    """Per (MC, hub, year): mean/max/min WQI (nulls skipped), records, anomalies."""
    return quality.groupBy("MC_Code", "Hub_ID", F.year("Created_At").alias("Year")).agg(
        F.avg("WQI").alias("Average_WQI"),
        F.max("WQI").alias("Max_WQI"),
        F.min("WQI").alias("Min_WQI"),
        F.count(F.lit(1)).alias("Total_Records"),
        F.sum(_is_anomaly()).cast("long").alias("Anomaly_Count"),
    )


# A7 -------------------------------------------------------------------------
def yearly_distribution_agg(distribution: DataFrame) -> DataFrame:
    """Per (MC, hub, year present): mean efficiency and critical count.

    Created_At goes through the lenient timestamp parse first (C3); rows
    whose time does not parse, and rows without a hub, are left out.
    """
    df = _coerce_created(
        distribution.select("MC_Code", "Hub_ID", "Predicted_Supply_Efficiency", "Critical_Risk", "Created_At")
    )
    df = df.filter(F.col("Created_At").isNotNull() & F.col("Hub_ID").isNotNull())
    eff = F.col("Predicted_Supply_Efficiency")
    return df.groupBy("MC_Code", "Hub_ID", F.year("Created_At").alias("Year")).agg(
        # a NaN efficiency counts as missing in the mean (the rolling stats skip it too)
        F.avg(F.when(is_nonfinite(eff), F.lit(None).cast("double")).otherwise(eff)).alias("Average_Efficiency"),
        F.coalesce(F.sum("Critical_Risk"), F.lit(0)).cast("long").alias("Critical_Count"),
    )


# A8 / U2 ---------------------------------------------------------------------
def merged_measurements(quality: DataFrame, distribution: DataFrame) -> DataFrame:
    """UNION ALL of (WQI, null, time) and (null, efficiency, time)."""
    q = quality.select("WQI", "Created_At")
    d = distribution.select("Predicted_Supply_Efficiency", "Created_At")
    return q.unionByName(d, allowMissingColumns=True).select("WQI", "Predicted_Supply_Efficiency", "Created_At")


def state_trends(quality: DataFrame, distribution: DataFrame) -> DataFrame:
    """Per year: average WQI and efficiency over both tables, 2 digits, ordered."""
    m = merged_measurements(quality, distribution).filter(F.col("Created_At").isNotNull())
    return (
        m.groupBy(F.year("Created_At").alias("Year"))
        .agg(rn(F.avg("WQI"), 2).alias("Avg_WQI"), rn(F.avg("Predicted_Supply_Efficiency"), 2).alias("Avg_Efficiency"))
        .orderBy("Year")
    )


# A9 -------------------------------------------------------------------------
def result_counts(municipal: DataFrame, quality: DataFrame, distribution: DataFrame) -> DataFrame:
    """Per municipality: records, anomalies, critical instances; plus the municipality total."""
    q = quality.groupBy("MC_Code").agg(
        F.count(F.lit(1)).alias("Total_Records"), F.sum(_is_anomaly()).cast("long").alias("Total_Anomalies")
    )
    d = distribution.groupBy("MC_Code").agg(
        F.sum(F.when(F.col("Critical_Risk") == F.lit(1), F.lit(1)).otherwise(F.lit(0))).cast("long")
        .alias("Total_Critical_Instances")
    )
    total = municipal.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = municipal.select("MC_Code").join(q, "MC_Code", "left").join(d, "MC_Code", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "MC_Code",
        F.coalesce("Total_Records", zero).alias("Total_Records"),
        F.coalesce("Total_Anomalies", zero).alias("Total_Anomalies"),
        F.coalesce("Total_Critical_Instances", zero).alias("Total_Critical_Instances"),
        total.alias("Total_Municipals"),
    )
