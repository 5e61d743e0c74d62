"""Domain views over the driver's TPC-H-style tables.

The water domain has municipalities (MC), hubs, quality readings and
distribution readings.  These views derive them from the given tables so
that every job's work grows with the data:

* ``municipal_data``      ← nation ⋈ (customer aggregated per nation)
* ``hub_table``/mapping   ← supplier
* ``quality_readings``    ← lineitem ⋈ supplier (one reading per line)
* ``quality_records``     ← scored readings, with gap years, null WQI and
                            injected anomaly labels
* ``distribution_records``← orders ⋈ customer, with injected model outputs
* ``raw_readings``        ← events, as dirty text for validation/coercion

Dates move forward 22 years so that report years land in 2017..2023.
Joins carry no broadcast hint: adaptive execution broadcasts a side only
after measuring it below ``spark.sql.adaptive.autoBroadcastJoinThreshold``
and otherwise keeps a sort-merge join (with skew splitting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.functions.numeric import rn
from hydrolake.operators import distribution as D
from hydrolake.operators import quality as Q
from hydrolake.sources.tables import read_table

YEAR_SHIFT = "INTERVAL 22 YEARS"
AS_OF_YEAR = 2024


def _code(prefix: str, key: Column, width: int) -> Column:
    """prefix + zero-padded (key + 1); wider numbers are kept whole, never truncated.

    Same text as ``format_string('%0<width>d')``, at a third of its cost.
    """
    n = key + F.lit(1)
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.when(n < F.lit(10**width), F.lpad(digits, width, "0")).otherwise(digits))


def mc_code(key: Column) -> Column:
    return _code("MC", key, 3)


def hub_code(key: Column) -> Column:
    return _code("HUB", key, 4)


def shifted(ts: str) -> Column:
    return F.col(ts) + F.expr(YEAR_SHIFT)


# -- dimensions ---------------------------------------------------------------
def municipal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One municipality per nation; demand from customer balances."""
    per_nation = (
        read_table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("k"), F.sum(F.abs("c_acctbal")).alias("a"))
    )
    nation = read_table(spark, sf_dir, "nation")
    demand = F.col("a") / F.lit(100.0)
    return nation.join(per_nation, nation.n_nationkey == per_nation.c_nationkey).select(
        mc_code(F.col("n_nationkey")).alias("MC_Code"),
        F.col("n_name").alias("MC_Name"),
        F.format_string("D%02d", F.col("n_regionkey") + F.lit(1)).alias("Division_Code"),
        (F.lit(10000) * F.col("k")).cast("bigint").alias("Population"),
        demand.alias("Total_Demand_MLD"),
        (demand * ((F.col("n_nationkey") + F.lit(20)) / F.lit(40.0))).alias("Current_Supply_MLD"),
    )


def hub_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        hub_code(F.col("s_suppkey")).alias("Hub_ID"), F.col("s_name").alias("Hub_Name")
    )


def mc_hub_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        mc_code(F.col("s_nationkey")).alias("MC_Code"), hub_code(F.col("s_suppkey")).alias("Hub_ID")
    )


def division_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division codes from regions; one region left out so lookups can miss."""
    return (
        read_table(spark, sf_dir, "region")
        .filter(F.col("r_regionkey") < 4)
        .select(F.format_string("D%02d", F.col("r_regionkey") + F.lit(1)).alias("Division_Code"),
                F.col("r_name").alias("name"))
    )


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the municipality each one may read (every third nation)."""
    return (
        read_table(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey") % 3 == 0)
        .select(F.concat(F.lit("user"), F.col("n_nationkey").cast("string")).alias("Username"),
                mc_code(F.col("n_nationkey")).alias("MC_Code"))
    )


# -- quality ------------------------------------------------------------------
def quality_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 14-parameter reading per lineitem row, located at its supplier."""
    return readings_from_lines(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "supplier"))


def readings_from_lines(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """The reading projection over any lineitem frame (batch or stream)."""
    li = lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_shipdate",
    )
    sup = supplier.select("s_suppkey", "s_nationkey")
    return li.join(sup, li.l_suppkey == sup.s_suppkey).select(
        "l_orderkey",
        "l_linenumber",
        mc_code(F.col("s_nationkey")).alias("MC_Code"),
        hub_code(F.col("l_suppkey")).alias("Hub_ID"),
        *[F.expr(f"{sql} AS {name}") for name, sql in READING_SQL],
        shifted("l_shipdate").alias("Created_At"),
    )


# Reading parameters derived from a line: (column, Spark SQL).
READING_SQL = (
    ("Temperature_Min", "12.0D + l_quantity * 0.6D"),
    ("Temperature_Max", "14.0D + l_quantity * 0.6D"),
    ("pH_Min", "5.0D + l_discount * 40.0D"),
    ("pH_Max", "5.4D + l_discount * 40.0D"),
    ("Conductivity_Min", "l_extendedprice / 20.0D"),
    ("Conductivity_Max", "l_extendedprice / 10.0D"),
    ("BOD_Min", "l_tax * 280.0D"),
    ("BOD_Max", "l_tax * 320.0D"),
    ("Faecal_Coliform_Min", "l_extendedprice / 25.0D"),
    ("Faecal_Coliform_Max", "l_extendedprice / 15.0D"),
    ("Total_Coliform_Min", "l_extendedprice / 30.0D"),
    ("Total_Coliform_Max", "l_extendedprice / 20.0D"),
    ("Nitrate_N_Min", "l_quantity * 0.3D"),
    ("Nitrate_N_Max", "l_quantity * 0.5D"),
)


def injected_ml_wqi() -> Column:
    """Stand-in model output for exact checks: ((ok·13 + ln·7) mod 10000) / 100."""
    return ((F.col("l_orderkey") * F.lit(13) + F.col("l_linenumber") * F.lit(7)) % F.lit(10000)) / F.lit(100.0)


def injected_anomaly() -> Column:
    """Stand-in anomaly flag (−1 anomaly, 1 normal) on about 2% of readings."""
    return F.when((F.col("l_orderkey") * F.lit(7) + F.col("l_linenumber")) % F.lit(50) == 0, F.lit(-1)).otherwise(
        F.lit(1)
    )


def quality_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with capped midpoints and the rule WQI (Q1, Q2, Q4)."""
    return Q.score_rule(quality_readings(spark, sf_dir))


def quality_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored quality records: one per reading, with gap years per hub, ~1% null WQI, ~1% without a temperature and ~2%
    anomalies.

    A reading that would fall into its hub's gap year is dated a year later.
    """
    s = quality_scored(spark, sf_dir)
    h = F.substring(F.col("Hub_ID"), 4, 100).cast("int")
    wqi = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % F.lit(97) == 0, F.lit(None).cast("double")).otherwise(
        F.col("Rule_WQI")
    )
    return (
        s.withColumn("Created_At", F.when((h + F.year("Created_At")) % F.lit(7) == 3, F.col("Created_At") + F.expr("INTERVAL 1 YEAR"))
                     .otherwise(F.col("Created_At")))
        .select(
            "l_orderkey",
            "l_linenumber",
            "MC_Code",
            "Hub_ID",
            F.when(F.col("l_orderkey") % 89 != 0, F.col("Temperature")).alias("Temperature"),
            "pH",
            "BOD",
            "Faecal_Coliform",
            "Total_Coliform",
            F.col("Nitrate_N").alias("Nitrate"),
            "Conductivity",
            wqi.alias("WQI"),
            F.when(injected_anomaly() == -1, F.lit(K.ANOMALY)).otherwise(F.lit(K.NORMAL)).alias("Anomaly_Status"),
            "Created_At",
            F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("Used_For_Training"),
        )
        .withColumn("Category", Q.category5_expr("WQI"))
    )


# -- distribution -------------------------------------------------------------
def distribution_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution readings (demand, supply, population) with injected model outputs."""
    return inputs_from_orders(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))


def inputs_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The distribution-reading projection over any orders frame (batch or stream)."""
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = customer.select("c_custkey", "c_nationkey")
    demand = F.col("o_totalprice") / F.lit(1000.0)
    ratio = F.lit(0.3) + (F.col("o_orderkey") % F.lit(80)) / F.lit(100.0)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        mc_code(F.col("c_nationkey")).alias("MC_Code"),
        hub_code(F.col("o_custkey") % F.lit(40)).alias("Hub_ID"),
        demand.alias("Total_Demand_MLD"),
        (demand * ratio).alias("Current_Supply_MLD"),
        (F.lit(100000) + F.col("o_custkey") * F.lit(100)).cast("bigint").alias("Population"),
        rn(F.lit(100.0) * ratio, 2).alias("eff_pred"),
        F.when(F.col("o_orderkey") % F.lit(80) < 40, F.lit(1)).otherwise(F.lit(0)).alias("risk_pred"),
        shifted("o_orderdate").alias("Created_At"),
    )


def distribution_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored distribution records (D1 → D3 → D4 → D5 applied to the inputs)."""
    scored = D.score_distribution(distribution_inputs(spark, sf_dir))
    return scored.select(
        "o_orderkey",
        "MC_Code",
        "Hub_ID",
        "Total_Demand_MLD",
        "Current_Supply_MLD",
        "Population",
        "Deficit_MLD",
        "PerCapita_LPCD",
        "Predicted_Supply_Efficiency",
        F.col("Critical_Risk").cast("int").alias("Critical_Risk"),
        F.col("Advice").alias("Recommended_Action"),
        "Created_At",
    )


def quality_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table: 7 features (capped midpoints), ``Rule_WQI`` and a status."""
    s = quality_scored(spark, sf_dir)
    return s.select(
        "Temperature", "pH", "BOD", "Faecal_Coliform", "Total_Coliform", F.col("Nitrate_N").alias("Nitrate"),
        "Conductivity", "Rule_WQI",
        F.when(injected_anomaly() == -1, F.lit(K.ANOMALY)).otherwise(F.lit(K.NORMAL)).alias("Anomaly_Status"),
    )


# -- dirty text ---------------------------------------------------------------
def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text with junk: bad numbers, unit suffixes, bad dates, null hubs."""
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        mc_code(F.col("user_id") % F.lit(25)).alias("MC_Code"),
        F.when(e % 211 == 0, F.lit(None).cast("string")).otherwise(hub_code(F.col("user_id"))).alias("Hub_ID"),
        F.when(e % 53 == 0, F.lit("bad"))
        .when(e % 47 == 0, F.concat(F.col("value").cast("string"), F.lit("mg")))
        .otherwise(F.col("value").cast("string"))
        .alias("BOD_Text"),
        F.when(e % 59 == 0, F.lit("not-a-date"))
        .otherwise(F.col("ts").cast("date").cast("string"))
        .alias("Created_Text"),
    )
