"""Window operators.

Windows run on *aggregated* rows — one row per (MC, hub, year) — so a
window partition holds at most the number of report years, however many
raw records a hub has.  The only exchange of raw data is the partial
aggregate's; the windows then shuffle tiny per-year rows by hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.functions.numeric import nonfinite_to_null, rn
from hydrolake.functions.text import sentence
from hydrolake.operators.filters import report_year
from hydrolake.operators.joins import newest_per_mc
from hydrolake.operators import aggregates as A
from hydrolake.operators.clean import lower_na_text, na_text
from hydrolake.operators.distribution import nullable_grade_expr

HUB_KEYS = ("MC_Code", "Hub_ID")


def _trend(delta, step: float, none_label: str):
    return (
        F.when(delta.isNull(), F.lit(none_label))
        .when(delta > F.lit(step), F.lit(K.IMPROVING))
        .when(delta < F.lit(-step), F.lit(K.DEGRADING))
        .otherwise(F.lit(K.STABLE))
    )


# W1 -------------------------------------------------------------------------
def yearly_quality_trend(quality: DataFrame, as_of_year: int | None = None,
                         first_year: int = K.FIRST_REPORT_YEAR) -> DataFrame:
    """Every hub × every year first..as_of (the current year by default), zero-filled, with delta and trend.

    The delta compares with the previous *non-empty* in-range year (gap years
    are skipped); the first year and empty years get 'N/A' (null delta).
    A year whose WQI values are all null keeps a null mean and does not
    become the next year's baseline.

    Plan: one partial aggregate per (MC, hub, year), one exchange of those
    aggregated rows by hub, one window pass, one generator.  Present years
    carry their delta; each hub's first row also emits its missing in-range
    years (``sequence`` minus the hub's present years — bounded by the
    report's year range).  No spine join, no second scan of the records.
    """
    agg = A.yearly_quality_agg(quality)
    # a record without a hub matches no hub (a null key equals nothing): its
    # hub entry is all empty years, as a key-equality lookup would give
    keyed = F.col("MC_Code").isNotNull() & F.col("Hub_ID").isNotNull()
    in_range = F.col("Year").between(F.lit(first_year), report_year(as_of_year)) & keyed
    w_hub = Window.partitionBy(*HUB_KEYS)
    w_year = w_hub.orderBy("Year")
    w_prev = w_year.rowsBetween(Window.unboundedPreceding, -1)
    x = agg.select(
        "*",
        F.last(F.when(in_range, F.col("Average_WQI")), ignorenulls=True).over(w_prev).alias("_prev"),
        F.collect_set(F.when(in_range, F.col("Year"))).over(w_hub).alias("_present"),
        (F.row_number().over(w_year) == 1).alias("_first"),
    )
    delta = rn(F.col("Average_WQI") - F.col("_prev"), 2)
    present = F.struct(
        F.col("Year").alias("Year"), F.col("Average_WQI").alias("Average_WQI"), F.col("Max_WQI").alias("Max_WQI"),
        F.col("Min_WQI").alias("Min_WQI"), F.col("Total_Records").alias("Total_Records"),
        F.col("Anomaly_Count").alias("Anomaly_Count"),
        _trend(delta, K.YEARLY_TREND_STEP, K.NOT_AVAILABLE).alias("Trend"), delta.alias("Yearly_Delta"),
    )
    missing = F.array_except(F.sequence(F.lit(first_year), report_year(as_of_year)), F.col("_present"))
    zero_d, zero_l = F.lit(0.0), F.lit(0).cast("long")
    empty = F.transform(
        F.when(F.col("_first"), missing).otherwise(F.slice(missing, 1, 0)),
        lambda y: F.struct(
            y.alias("Year"), zero_d.alias("Average_WQI"), zero_d.alias("Max_WQI"), zero_d.alias("Min_WQI"),
            zero_l.alias("Total_Records"), zero_l.alias("Anomaly_Count"), F.lit(K.NOT_AVAILABLE).alias("Trend"),
            F.lit(None).cast("double").alias("Yearly_Delta"),
        ),
    )
    # one row stream: a present in-range year yields itself; a hub's first row
    # also yields its empty years — a single branch, so one scan and one shuffle
    own = F.slice(F.array(present), 1, F.when(in_range, F.lit(1)).otherwise(F.lit(0)))
    return x.select(*HUB_KEYS, F.explode(F.concat(own, empty)).alias("_e")).select(*HUB_KEYS, "_e.*")


# W2–W6 ------------------------------------------------------------------------
def yearly_distribution_windows(distribution: DataFrame) -> DataFrame:
    """A7 + rolling mean (W2), delta/trend (W3), grade (D7), volatility."""
    agg = A.yearly_distribution_agg(distribution)
    w = Window.partitionBy(*HUB_KEYS).orderBy("Year")
    w3 = w.rowsBetween(-2, 0)
    a = F.col("Average_Efficiency")
    delta = rn(a - F.lag(a).over(w), 2)
    vol = F.coalesce(rn(F.stddev_samp(a).over(w3), 2), F.lit(0.0))
    return agg.select(
        *HUB_KEYS,
        "Year",
        "Average_Efficiency",
        "Critical_Count",
        F.avg(a).over(w3).alias("Rolling_3yr_Avg"),
        delta.alias("Yearly_Delta"),
        _trend(delta, K.YEARLY_TREND_STEP, K.STABLE).alias("Trend"),
        nullable_grade_expr("Average_Efficiency").alias("Performance_Grade"),
        vol.alias("Volatility_Index"),
    )


def rolling_3yr_avg(distribution: DataFrame) -> DataFrame:
    """Mean of the last three present-year rows (at least one)."""
    return yearly_distribution_windows(distribution).select(*HUB_KEYS, "Year", "Average_Efficiency",
                                                             "Rolling_3yr_Avg")


def yearly_efficiency_delta(distribution: DataFrame) -> DataFrame:
    """Difference to the previous present year (2 digits); first is Stable."""
    return yearly_distribution_windows(distribution).select(*HUB_KEYS, "Year", "Average_Efficiency",
                                                             "Yearly_Delta", "Trend")


def volatility_index(distribution: DataFrame) -> DataFrame:
    """Sample std over the last three rows (needs two), else 0; 2 digits."""
    return yearly_distribution_windows(distribution).select(*HUB_KEYS, "Year", "Average_Efficiency",
                                                             "Volatility_Index")


def _hub_level(yearly: DataFrame) -> DataFrame:
    """W5 + W6 per hub, as window columns over the (small) per-year rows."""
    w_all = Window.partitionBy(*HUB_KEYS)
    asc = F.row_number().over(Window.partitionBy(*HUB_KEYS).orderBy("Year"))
    desc = F.row_number().over(Window.partitionBy(*HUB_KEYS).orderBy(F.desc("Year")))
    y = yearly.withColumns({"_asc": asc, "_desc": desc})
    roll = F.col("Rolling_3yr_Avg")
    early = F.avg(F.when(F.col("_asc") <= 3, roll)).over(w_all)
    late = F.avg(F.when(F.col("_desc") <= 3, roll)).over(w_all)
    n_years = F.count(F.lit(1)).over(w_all)
    diff = late - early
    long_term = (
        F.when(n_years < 3, F.lit(K.INSUFFICIENT))
        .when(diff > F.lit(K.LONG_TERM_STEP), F.lit(K.IMPROVING))
        .when(diff < F.lit(-K.LONG_TERM_STEP), F.lit(K.DEGRADING))
        .otherwise(F.lit(K.STABLE))
    )
    last_eff = F.max(F.when(F.col("_desc") == 1, nonfinite_to_null("Average_Efficiency", 4))).over(w_all)
    last_vol = F.max(F.when(F.col("_desc") == 1, nonfinite_to_null("Volatility_Index", 4))).over(w_all)
    return y.withColumns({"Long_Term_Trend": long_term, "Latest_Efficiency": last_eff,
                          "Latest_Volatility": last_vol}).drop("_asc", "_desc")


def long_term_trend(distribution: DataFrame) -> DataFrame:
    """W5 per hub: last-three vs first-three rolling means (≥3 years)."""
    y = _hub_level(yearly_distribution_windows(distribution))
    return y.select(*HUB_KEYS, "Long_Term_Trend").distinct()


def latest_year_per_hub(distribution: DataFrame) -> DataFrame:
    """The last year's efficiency and volatility per hub (safe_num, 4 digits)."""
    agg = yearly_distribution_windows(distribution)
    return agg.groupBy(*HUB_KEYS).agg(
        F.max("Year").alias("Latest_Year"),
        nonfinite_to_null(F.max_by("Average_Efficiency", "Year"), 4).alias("Latest_Efficiency"),
        nonfinite_to_null(F.max_by("Volatility_Index", "Year"), 4).alias("Latest_Volatility"),
    )


# W7 -------------------------------------------------------------------------
def yearly_distribution_trend(distribution: DataFrame) -> DataFrame:
    """The full yearly distribution report, one row per (MC, hub, year).

    Per-year values go through safe_num (4 digits); the hub-level trend and
    commentary repeat on each of the hub's rows.
    """
    y = _hub_level(yearly_distribution_windows(distribution))
    commentary = sentence(K.TREND_COMMENTARY, trend=lower_na_text(F.col("Long_Term_Trend")),
                          efficiency=na_text(F.col("Latest_Efficiency")), volatility=na_text(F.col("Latest_Volatility")))
    return y.select(
        *HUB_KEYS,
        "Year",
        nonfinite_to_null("Average_Efficiency", 4).alias("Average_Efficiency"),
        "Critical_Count",
        nonfinite_to_null("Rolling_3yr_Avg", 4).alias("Rolling_3yr_Avg"),
        nonfinite_to_null("Yearly_Delta", 4).alias("Yearly_Delta"),
        "Trend",
        "Performance_Grade",
        nonfinite_to_null("Volatility_Index", 4).alias("Volatility_Index"),
        "Long_Term_Trend",
        commentary.alias("AI_Commentary"),
    )


# W8 -------------------------------------------------------------------------
def latest_distribution(distribution: DataFrame) -> DataFrame:
    """Latest snapshot of every municipality: rows at the MC's max time (ties kept).

    ``rank() over (partition by MC order by time desc) = 1``: every task keeps
    only its newest rows of a municipality before the shuffle.
    """
    return newest_per_mc(distribution)
