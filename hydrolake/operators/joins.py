"""Joins and subqueries.

File statistics and adaptive execution broadcast a side once it is measured
small, and split skewed partitions otherwise.  Only the newest rows (J4) carry
a hint, behind a count of the side it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.operators.filters import report_year
from hydrolake.session import ensure_checkpoint_dir

#: a side of at most so many counted, narrow rows is broadcast
BROADCAST_ROWS = 20_000


# J1 -------------------------------------------------------------------------
def hubs_for_mc(mapping: DataFrame, hubs: DataFrame, mc_code: str | None = None,
                ordered: bool = False) -> DataFrame:
    """mapping ⋈ hub (inner equi) with the hub count per municipality.

    Output (MC_Code, Hub_ID, Hub_Name, Total_Hubs); ``ordered`` sorts by hub
    name within each municipality (the listing order), which a consumer that
    joins the result further does not need.
    """
    if mc_code:
        mapping = mapping.filter(F.col("MC_Code") == F.lit(mc_code))
    joined = mapping.join(hubs, "Hub_ID")
    counts = joined.groupBy("MC_Code").agg(F.count(F.lit(1)).alias("Total_Hubs"))
    out = joined.join(counts, "MC_Code").select("MC_Code", "Hub_ID", "Hub_Name", "Total_Hubs")
    return out.orderBy("MC_Code", "Hub_Name", "Hub_ID") if ordered else out


# J2 -------------------------------------------------------------------------
def tenant_scope(records: DataFrame, principals: DataFrame, username: str | None = None,
                 municipal: DataFrame | None = None) -> DataFrame:
    """Rows of the municipalities the principal(s) may read (left semi join).

    Principals are first matched to existing municipalities (user ⋈
    municipality, as the login lookup does).  The password column is never
    read; only (Username, MC_Code).
    """
    p = principals.select("Username", "MC_Code")
    if username:
        p = p.filter(F.col("Username") == F.lit(username))
    if municipal is not None:
        p = p.join(municipal.select("MC_Code"), "MC_Code", "left_semi")
    return records.join(p.select("MC_Code").distinct(), "MC_Code", "left_semi")


# J3 -------------------------------------------------------------------------
def hub_year_spine(keys: DataFrame, first_year: int = K.FIRST_REPORT_YEAR, as_of_year: int | None = None) -> DataFrame:
    """Every key row × every year first..as_of (the current year by default), by a generator (no cross join).

    ``keys`` holds the distinct grouping keys (e.g. MC_Code, Hub_ID).
    """
    years = F.sequence(F.lit(first_year), report_year(as_of_year))
    return keys.withColumn("Year", F.explode(years))


# J4 -------------------------------------------------------------------------
def latest_by_subquery(records: DataFrame, mc_code: str | None = None) -> DataFrame:
    """Rows whose Created_At equals their municipality's maximum (ties kept)."""
    if mc_code:
        records = records.filter(F.col("MC_Code") == F.lit(mc_code))
    return newest_per_mc(records)


def newest_per_mc(records: DataFrame) -> DataFrame:
    """Rows at their municipality's newest time, ties kept; rows without a code or a time have none.

    The newest times (partial maxima, one row a municipality) are found and
    counted first.  Up to :data:`BROADCAST_ROWS` of them go to the records, so
    that no record moves: a bulk load that gives a third of all rows one time
    stays spread over its files.  More are joined by a shuffle, where adaptive
    execution splits a hot municipality.
    """
    rows = records.filter(F.col("MC_Code").isNotNull() & F.col("Created_At").isNotNull()).select(
        "MC_Code", "Hub_ID", "Predicted_Supply_Efficiency", "Critical_Risk", "Recommended_Action", "Created_At"
    )
    ensure_checkpoint_dir(records.sparkSession)
    newest = rows.groupBy("MC_Code").agg(F.max("Created_At").alias("Created_At")).checkpoint(eager=True)
    few = newest.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(newest) if few else newest, ["MC_Code", "Created_At"], "left_semi")


# J5 -------------------------------------------------------------------------
def division_dim(spark) -> DataFrame:
    """The six-row division dimension (static)."""
    return spark.createDataFrame(list(K.DIVISIONS), "Division_Code string, name string, head string, region string")


def municipal_with_division(municipal: DataFrame, divisions: DataFrame) -> DataFrame:
    """Municipality ⟕ division on Division_Code ."""
    d = divisions.select(
        "Division_Code",
        *[F.col(c).alias(f"Division_{c.capitalize()}") for c in divisions.columns if c != "Division_Code"],
    )
    return municipal.join(d, "Division_Code", "left")


# J6 -------------------------------------------------------------------------
#: what the simulation (D9) adds to a municipality
SIMULATED = (("predicted_efficiency", "double"), ("critical_risk", "int"), ("recommended_action", "string"),
             ("last_updated", "timestamp_ntz"))


def dashboard(municipal: DataFrame, mapping: DataFrame, hubs: DataFrame, mc_code: str | None = None) -> DataFrame:
    """One row per (municipality, connected hub), hub columns null when none.

    The relational form of "municipal info + list of hubs": hubs per
    municipality are not bounded, so they are never packed into one array.
    Planned as an inner join with the municipality dimension plus an anti
    join for municipalities without hubs — the same rows as ``municipal LEFT
    JOIN hubs``, but adaptive execution can broadcast the municipality side,
    and split a municipality that holds a third of all hubs otherwise.
    The simulation's columns (D9) come along where ``municipal`` has them and
    are null otherwise.
    """
    if mc_code:
        municipal = municipal.filter(F.col("MC_Code") == F.lit(mc_code))
        mapping = mapping.filter(F.col("MC_Code") == F.lit(mc_code))
    connected = hubs_for_mc(mapping, hubs)
    info = municipal.select(
        "MC_Code", "MC_Name", "Population", "Total_Demand_MLD", "Current_Supply_MLD", "Division_Code",
        *[F.col(c) if c in municipal.columns else F.lit(None).cast(t).alias(c) for c, t in SIMULATED],
    )
    with_hubs = connected.join(info, "MC_Code")
    without = info.join(connected.select("MC_Code").distinct(), "MC_Code", "left_anti").select(
        "*",
        F.lit(None).cast("string").alias("Hub_ID"),
        F.lit(None).cast("string").alias("Hub_Name"),
        F.lit(0).cast("long").alias("Total_Hubs"),
    )
    cols = [*info.columns, "Hub_ID", "Hub_Name", "Total_Hubs"]
    return with_hubs.select(*cols).unionByName(without.select(*cols))
