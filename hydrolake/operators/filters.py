"""Filters (F1–F7).  Plain predicates, so Catalyst pushes them to the scan
(or prunes ``MC_Code`` partitions when the records are partitioned by it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import constants as K


def tenant_filter(df: DataFrame, mc_code: str) -> DataFrame:
    """``MC_Code = :mc_code``."""
    return df.filter(F.col("MC_Code") == F.lit(mc_code))


def optional_hub_filter(df: DataFrame, hub_id: str | None) -> DataFrame:
    """add ``Hub_ID = :hub`` only when a hub is given (empty counts as not given)."""
    return df.filter(F.col("Hub_ID") == F.lit(hub_id)) if hub_id else df


def anomaly_filter(df: DataFrame) -> DataFrame:
    """F3."""
    return df.filter(F.col("Anomaly_Status") == F.lit(K.ANOMALY))


def critical_filter(df: DataFrame) -> DataFrame:
    """F4."""
    return df.filter(F.col("Critical_Risk") == F.lit(1))


def temperature_not_null(df: DataFrame) -> DataFrame:
    """the training-set predicate."""
    return df.filter(F.col("Temperature").isNotNull())


def created_not_null(df: DataFrame) -> DataFrame:
    """F6."""
    return df.filter(F.col("Created_At").isNotNull())


def report_year(as_of_year: int | None) -> Column:
    """The last year of a report: as given, else the current year when the job runs."""
    return F.year(F.current_date()) if as_of_year is None else F.lit(int(as_of_year))


def year_range_filter(df: DataFrame, first_year: int = K.FIRST_REPORT_YEAR, as_of_year: int | None = None,
                      col: str = "Created_At") -> DataFrame:
    """year in [first_year, as_of_year], as a timestamp range (pushable); by default up to the current year."""
    lo = F.lit(f"{first_year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.make_date(report_year(as_of_year) + F.lit(1), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    c = F.col(col)
    return df.filter((c >= lo) & (c < hi))


def scope(df: DataFrame, mc_code: str | None = None, hub_id: str | None = None) -> DataFrame:
    """F1 + F2 when a tenant is given; all tenants otherwise (batch form)."""
    if mc_code:
        df = tenant_filter(df, mc_code)
    return optional_hub_filter(df, hub_id)
