"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables through the domain views of
:mod:`hydrolake.sources.fixtures`, over whole tables.  Per-tenant
endpoints are computed for all tenants at once (keyed by ``MC_Code``); the
tenant filter itself is registered as its own query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.operators import aggregates as A
from hydrolake.operators import clean as C
from hydrolake.operators import distribution as D
from hydrolake.operators import filters as FL
from hydrolake.operators import joins as J
from hydrolake.operators import quality as Q
from hydrolake.operators import windows as W
from hydrolake.sources import fixtures as X

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

AS_OF_YEAR = X.AS_OF_YEAR
TENANT = "MC007"   # tenant used by the tenant-filter queries
HUB = "HUB0009"    # hub used by the optional-hub-filter query


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------- flagship --
@register("yearly_quality_trend")
def yearly_quality_trend(spark: SparkSession, sf: str) -> DataFrame:
    """W1 (+A6, J3, F7): yearly WQI per hub with gap years, delta and trend."""
    return W.yearly_quality_trend(X.quality_records(spark, sf), as_of_year=AS_OF_YEAR)


# ------------------------------------------------------- quality projections --
@register("param_midpoints")
def param_midpoints(spark, sf):
    r = X.quality_readings(spark, sf)
    return Q.midpoints(r).select("l_orderkey", "l_linenumber", "Hub_ID", *K.READING_PARAMS)


@register("cap_params")
def cap_params(spark, sf):
    r = Q.cap_params(Q.midpoints(X.quality_readings(spark, sf)))
    return r.select("l_orderkey", "l_linenumber", "Hub_ID", *K.READING_PARAMS)


@register("wqi_subscores")
def wqi_subscores(spark, sf):
    r = Q.subscores(Q.cap_params(Q.midpoints(X.quality_readings(spark, sf))))
    return r.select("l_orderkey", "l_linenumber", "Hub_ID", *[f"{p}_Score" for p in K.PARAMS])


@register("rule_wqi")
def rule_wqi(spark, sf):
    return X.quality_scored(spark, sf).select("l_orderkey", "l_linenumber", "Hub_ID", "Rule_WQI")


def _hybrid_frame(spark, sf):
    s = X.quality_scored(spark, sf).withColumn("ml_wqi", X.injected_ml_wqi())
    return Q.hybrid_wqi(s)


@register("hybrid_wqi")
def hybrid_wqi(spark, sf):
    return _hybrid_frame(spark, sf).select("l_orderkey", "l_linenumber", "Hub_ID", "Rule_WQI", "ml_wqi", "WQI")


@register("wqi_category5")
def wqi_category5(spark, sf):
    return Q.categorize5(_hybrid_frame(spark, sf)).select(
        "l_orderkey", "l_linenumber", "WQI", "Category", "Emoji_Status", "Interpretation", "Recommended_Action"
    )


@register("wqi_category3")
def wqi_category3(spark, sf):
    return Q.categorize3(_hybrid_frame(spark, sf)).select("l_orderkey", "l_linenumber", "WQI", "Category3")


@register("safety_downgrade")
def safety_downgrade(spark, sf):
    s = Q.safety_downgrade(Q.categorize5(_hybrid_frame(spark, sf)))
    return s.select("l_orderkey", "l_linenumber", "pH", "BOD", "Faecal_Coliform", "WQI", "WQI_Text", "Category",
                    "Emoji_Status", "Interpretation", "Recommended_Action")


def _predict_quality_frame(spark, sf):
    s = Q.safety_downgrade(Q.categorize5(_hybrid_frame(spark, sf)))
    s = s.withColumn("anomaly_pred", X.injected_anomaly())
    return Q.quality_text(Q.anomaly_label(s))


@register("anomaly_label")
def anomaly_label(spark, sf):
    return _predict_quality_frame(spark, sf).select(
        "l_orderkey", "l_linenumber", "anomaly_pred", "Anomaly_Status", "Emoji_Status", "Recommended_Action"
    )


@register("quality_summary_text")
def quality_summary_text(spark, sf):
    return _predict_quality_frame(spark, sf).select(
        "l_orderkey", "l_linenumber", "Hub_ID", "AI_Summary", "Message", "ML_WQI", "Rule_WQI", "Hybrid_Model"
    )


@register("quality_details")
def quality_details(spark, sf):
    """Q10's nested details block (model, rule, blend, capped input features), read field by field."""
    d = Q.details_struct(_predict_quality_frame(spark, sf)).select("l_orderkey", "l_linenumber", "Details")
    return d.select("l_orderkey", "l_linenumber", "Details.ML_WQI", "Details.Rule_WQI", "Details.Hybrid_Model", "Details.Input_Features.*")


@register("nitrate_rename")
def nitrate_rename(spark, sf):
    r = Q.nitrate_rename(Q.midpoints(X.quality_readings(spark, sf)))
    return r.select("l_orderkey", "l_linenumber", *Q.ml_feature_columns())


@register("unpivot_features")
def unpivot_features(spark, sf):
    s = X.quality_scored(spark, sf).select("l_orderkey", "l_linenumber", "Hub_ID", *K.READING_PARAMS)
    return Q.unpivot_features(s, ["l_orderkey", "l_linenumber", "Hub_ID"])


# -------------------------------------------------- distribution projections --
def _dist_scored(spark, sf):
    return D.score_distribution(X.distribution_inputs(spark, sf))


@register("distribution_features")
def distribution_features(spark, sf):
    return D.distribution_features(X.distribution_inputs(spark, sf)).select(
        "o_orderkey", "Hub_ID", "deficit", "efficiency", "per_capita"
    )


@register("operating_action")
def operating_action(spark, sf):
    return _dist_scored(spark, sf).select("o_orderkey", "eff_pred", "risk_pred", "Status", "Operating_Action")


@register("distribution_rounding")
def distribution_rounding(spark, sf):
    return _dist_scored(spark, sf).select(
        "o_orderkey", "Predicted_Supply_Efficiency", "Critical_Risk", "Deficit_MLD", "PerCapita_LPCD"
    )


@register("performance_band")
def performance_band(spark, sf):
    return _dist_scored(spark, sf).select("o_orderkey", "Performance", "Emoji_Status", "Interpretation")


@register("risk_label")
def risk_label(spark, sf):
    return _dist_scored(spark, sf).select("o_orderkey", "Risk_Label", "Advice")


@register("performance_grade")
def performance_grade(spark, sf):
    return _dist_scored(spark, sf).select("o_orderkey", "Predicted_Supply_Efficiency", "Performance_Grade")


@register("nullable_grade")
def nullable_grade(spark, sf):
    y = A.yearly_distribution_agg(X.distribution_records(spark, sf))
    return D.nullable_grade(y, "Average_Efficiency").select("MC_Code", "Hub_ID", "Year", "Performance_Grade")


@register("distribution_commentary")
def distribution_commentary(spark, sf):
    return _dist_scored(spark, sf).select("o_orderkey", "Hub_ID", "AI_Commentary", "Summary", "Message")


def _municipal_preds(spark, sf):
    m = X.municipal_data(spark, sf)
    eff = F.col("Current_Supply_MLD") / F.col("Total_Demand_MLD") * F.lit(100.0)
    return m.withColumns({"eff_pred": eff, "risk_pred": F.when(eff < F.lit(75.0), 1).otherwise(0)})


@register("municipal_simulation")
def municipal_simulation(spark, sf):
    return D.municipal_simulation(_municipal_preds(spark, sf), as_of=f"{AS_OF_YEAR}-12-31 00:00:00")


# ------------------------------------------------------------------ cleaning --
@register("drop_nulls_subset")
def drop_nulls_subset(spark, sf):
    r = X.raw_readings(spark, sf).withColumn("BOD", F.col("BOD_Text").try_cast("double"))
    return C.drop_nulls_subset(r, ["Hub_ID", "BOD"]).select("event_id", "Hub_ID", "BOD")


@register("to_numeric_coerce")
def to_numeric_coerce(spark, sf):
    r = X.raw_readings(spark, sf).withColumn("BOD", F.col("BOD_Text"))
    return C.to_numeric_coerce(r, ["BOD"]).select("event_id", "BOD_Text", "BOD")


@register("to_timestamp_coerce")
def to_timestamp_coerce(spark, sf):
    r = X.raw_readings(spark, sf).withColumn("Created_At", F.col("Created_Text"))
    return C.to_timestamp_coerce(r, "Created_At", "yyyy-MM-dd").select("event_id", "Created_Text", "Created_At")


@register("nonfinite_to_zero")
def nonfinite_to_zero(spark, sf):
    r = X.raw_readings(spark, sf).select(
        "event_id", "Hub_ID", F.col("BOD_Text").try_cast("double").alias("BOD")
    )
    return C.nonfinite_to_zero(r)


@register("nonfinite_to_null")
def nonfinite_to_null(spark, sf):
    s = _hybrid_frame(spark, sf).withColumn("ratio", F.try_divide(F.col("WQI"), F.col("ml_wqi") - F.lit(50.0)))
    return C.nonfinite_to_null_cols(s, ["WQI", "ratio"], 3).select("l_orderkey", "l_linenumber", "WQI", "ratio")


@register("safe_num")
def safe_num(spark, sf):
    r = X.raw_readings(spark, sf).withColumn("BOD", F.col("BOD_Text"))
    return C.safe_num_cols(r, ["BOD"], 4).select("event_id", "BOD")


@register("year_of")
def year_of(spark, sf):
    return C.year_of(X.distribution_records(spark, sf)).select("o_orderkey", "Year")


@register("default_zero_round")
def default_zero_round(spark, sf):
    s = A.distribution_summary(X.distribution_records(spark, sf))
    return s.select("MC_Code", "Average_Supply_Efficiency", "Total_Deficit_MLD")


@register("count_message")
def count_message(spark, sf):
    q = X.quality_records(spark, sf)
    n = FL.anomaly_filter(q).groupBy("Hub_ID").agg(F.count(F.lit(1)).alias("n"))
    hubs = q.select("Hub_ID").distinct()
    c = hubs.join(n, "Hub_ID", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return c.select("Hub_ID", "n", C.count_message(F.col("n"), K.NO_ANOMALIES, K.ANOMALIES_FMT).alias("Message"))


@register("lower_na_text")
def lower_na_text(spark, sf):
    y = W.long_term_trend(X.distribution_records(spark, sf))
    return y.select("MC_Code", "Hub_ID", C.lower_na_text(F.col("Long_Term_Trend")).alias("Trend_Text"))


@register("coerce_form_numbers")
def coerce_form_numbers(spark, sf):
    r = X.raw_readings(spark, sf).withColumn("BOD", F.col("BOD_Text"))
    return C.coerce_form_numbers(r, ["BOD"]).select("event_id", "BOD_Text", "BOD")


@register("validate_readings")
def validate_readings(spark, sf):
    from hydrolake.sources import io

    ok, _ = io.split_valid(_dirty_readings(spark, sf), DIRTY_TYPES)
    return ok.select("event_id", "MC_Code", "Hub_ID", "BOD", "Created_At")


DIRTY_TYPES = {"MC_Code": "string", "Hub_ID": "string", "BOD": "double", "Created_At": "date"}


def _dirty_readings(spark, sf):
    return X.raw_readings(spark, sf).select(
        "MC_Code", "Hub_ID", "event_id", F.col("BOD_Text").alias("BOD"), F.col("Created_Text").alias("Created_At")
    )


@register("quarantine_readings")
def quarantine_readings(spark, sf):
    """The rejected readings with the fields that failed, written to the quarantine and read back."""
    from hydrolake.sources import io

    _, bad = io.split_valid(_dirty_readings(spark, sf), DIRTY_TYPES)
    path = io.write_quarantine(bad, scratch_path(spark, "quarantine"), DIRTY_TYPES)
    return spark.read.parquet(path).select(F.col("event_id").cast("long"), "MC_Code", "Hub_ID", "BOD", "Created_At", "Rejected_Fields")


@register("validate_one_pass")
def validate_one_pass(spark, sf):
    """Both halves of one pass over the readings; every reading is in exactly one of them."""
    from hydrolake.sources import io

    rejects = scratch_path(spark, "quarantine")
    ok = io.split_once(_dirty_readings(spark, sf), DIRTY_TYPES, rejects)
    cols = ("event_id", "MC_Code", "Hub_ID")
    good = ok.select(*cols, "BOD", "Created_At", F.lit(None).cast("string").alias("Rejected_Fields"))
    bad = spark.read.parquet(rejects).select(
        F.col("event_id").cast("long").alias("event_id"), *cols[1:], F.lit(None).cast("double").alias("BOD"),
        F.lit(None).cast("date").alias("Created_At"), "Rejected_Fields")
    return good.unionByName(bad)


# ------------------------------------------------------------------- filters --
@register("tenant_filter")
def tenant_filter(spark, sf):
    return FL.tenant_filter(X.quality_records(spark, sf), TENANT).select(
        "MC_Code", "Hub_ID", "WQI", "Anomaly_Status", "Created_At"
    )


@register("optional_hub_filter")
def optional_hub_filter(spark, sf):
    q = FL.optional_hub_filter(X.quality_records(spark, sf), HUB)
    return q.select("MC_Code", "Hub_ID", "WQI", "Created_At")


@register("anomaly_filter")
def anomaly_filter(spark, sf):
    return FL.anomaly_filter(X.quality_records(spark, sf)).select("MC_Code", "Hub_ID", "WQI", "Created_At")


@register("critical_filter")
def critical_filter(spark, sf):
    return FL.critical_filter(X.distribution_records(spark, sf)).select(
        "MC_Code", "Hub_ID", "Predicted_Supply_Efficiency", "Created_At"
    )


@register("temperature_not_null")
def temperature_not_null(spark, sf):
    return FL.temperature_not_null(X.quality_records(spark, sf)).select("Hub_ID", "Temperature", "WQI")


@register("created_not_null")
def created_not_null(spark, sf):
    r = C.to_timestamp_coerce(X.raw_readings(spark, sf).withColumn("Created_At", F.col("Created_Text")),
                              "Created_At", "yyyy-MM-dd")
    return FL.created_not_null(r).select("event_id", "Created_At")


@register("year_range_filter")
def year_range_filter(spark, sf):
    q = FL.year_range_filter(X.quality_records(spark, sf), K.FIRST_REPORT_YEAR, AS_OF_YEAR)
    return q.select("Hub_ID", "WQI", "Created_At")


# --------------------------------------------------------------------- joins --
@register("hubs_for_mc")
def hubs_for_mc(spark, sf):
    return J.hubs_for_mc(X.mc_hub_mapping(spark, sf), X.hub_table(spark, sf), ordered=True)


@register("tenant_scope")
def tenant_scope(spark, sf):
    q = X.quality_records(spark, sf).select("MC_Code", "Hub_ID", "WQI", "Created_At")
    return J.tenant_scope(q, X.principals(spark, sf), municipal=X.municipal_data(spark, sf))


@register("hub_year_spine")
def hub_year_spine(spark, sf):
    keys = X.quality_records(spark, sf).select("MC_Code", "Hub_ID").distinct()
    return J.hub_year_spine(keys, K.FIRST_REPORT_YEAR, AS_OF_YEAR)


@register("latest_by_subquery")
def latest_by_subquery(spark, sf):
    return J.latest_by_subquery(X.distribution_records(spark, sf))


@register("municipal_with_division")
def municipal_with_division(spark, sf):
    return J.municipal_with_division(X.municipal_data(spark, sf), X.division_fixture(spark, sf))


@register("division_dim")
def division_dim(spark, sf):
    """S8 joined to the municipalities that reference it (static dimension)."""
    return J.municipal_with_division(X.municipal_data(spark, sf), J.division_dim(spark)).select(
        "MC_Code", "Division_Code", "Division_Name", "Division_Head", "Division_Region"
    )


@register("dashboard")
def dashboard(spark, sf):
    return J.dashboard(municipal_simulation(spark, sf), X.mc_hub_mapping(spark, sf), X.hub_table(spark, sf))


# -------------------------------------------------------------- aggregations --
@register("public_overall_stats")
def public_overall_stats(spark, sf):
    return A.public_overall_stats(X.municipal_data(spark, sf), X.quality_records(spark, sf),
                                  X.distribution_records(spark, sf))


@register("overall_stats")
def overall_stats(spark, sf):
    return A.overall_stats(X.municipal_data(spark, sf), X.quality_records(spark, sf),
                           X.distribution_records(spark, sf))


@register("distribution_summary")
def distribution_summary(spark, sf):
    return A.distribution_summary(X.distribution_records(spark, sf))


@register("quality_trend")
def quality_trend(spark, sf):
    return A.quality_trend(X.quality_records(spark, sf))


@register("quality_trend_records")
def quality_trend_records(spark, sf):
    return A.quality_trend_records(X.quality_records(spark, sf))


@register("distribution_trend")
def distribution_trend(spark, sf):
    return A.distribution_trend(X.distribution_records(spark, sf))


@register("distribution_trend_records")
def distribution_trend_records(spark, sf):
    return A.distribution_trend_records(X.distribution_records(spark, sf))


@register("yearly_quality_agg")
def yearly_quality_agg(spark, sf):
    return A.yearly_quality_agg(X.quality_records(spark, sf))


@register("yearly_distribution_agg")
def yearly_distribution_agg(spark, sf):
    return A.yearly_distribution_agg(X.distribution_records(spark, sf))


@register("state_trends")
def state_trends(spark, sf):
    return A.state_trends(X.quality_records(spark, sf), X.distribution_records(spark, sf))


@register("result_counts")
def result_counts(spark, sf):
    return A.result_counts(X.municipal_data(spark, sf), X.quality_records(spark, sf),
                           X.distribution_records(spark, sf))


# ------------------------------------------------------------------- windows --
@register("rolling_3yr_avg")
def rolling_3yr_avg(spark, sf):
    return W.rolling_3yr_avg(X.distribution_records(spark, sf))


@register("yearly_efficiency_delta")
def yearly_efficiency_delta(spark, sf):
    return W.yearly_efficiency_delta(X.distribution_records(spark, sf))


@register("volatility_index")
def volatility_index(spark, sf):
    return W.volatility_index(X.distribution_records(spark, sf))


@register("long_term_trend")
def long_term_trend(spark, sf):
    return W.long_term_trend(X.distribution_records(spark, sf))


@register("latest_year_per_hub")
def latest_year_per_hub(spark, sf):
    return W.latest_year_per_hub(X.distribution_records(spark, sf))


@register("yearly_distribution_trend")
def yearly_distribution_trend(spark, sf):
    return W.yearly_distribution_trend(X.distribution_records(spark, sf))


@register("latest_distribution")
def latest_distribution(spark, sf):
    return W.latest_distribution(X.distribution_records(spark, sf))


# ------------------------------------------------------ sorts, limits, sets --
from hydrolake.operators import nested as N  # noqa: E402
from hydrolake.operators import ordering as O  # noqa: E402


@register("quality_records")
def quality_records(spark, sf):
    return O.quality_records(X.quality_records(spark, sf))


@register("quality_history_top10")
def quality_history_top10(spark, sf):
    return O.quality_history_top(X.quality_records(spark, sf), 10)


@register("anomaly_summary")
def anomaly_summary(spark, sf):
    return O.anomaly_summary(X.quality_records(spark, sf))


@register("anomaly_counts")
def anomaly_counts(spark, sf):
    return O.anomaly_counts(X.municipal_data(spark, sf), X.quality_records(spark, sf))


@register("critical_summary")
def critical_summary(spark, sf):
    return O.critical_summary(X.distribution_records(spark, sf))


@register("municipal_list")
def municipal_list(spark, sf):
    return O.municipal_list(X.municipal_data(spark, sf))


@register("ordered_history")
def ordered_history(spark, sf):
    return O.ordered_history(X.quality_records(spark, sf))


@register("last_updated")
def last_updated(spark, sf):
    return A.last_updated(X.quality_records(spark, sf), X.distribution_records(spark, sf))


@register("merged_measurements")
def merged_measurements(spark, sf):
    return A.merged_measurements(X.quality_records(spark, sf), X.distribution_records(spark, sf))


# ------------------------------------------------------------------- nested --
def _year_maps(spark, sf):
    yearly = W.yearly_quality_trend(X.quality_records(spark, sf), as_of_year=AS_OF_YEAR)
    return N.year_map(yearly)


@register("trend_by_hub_map")
def trend_by_hub_map(spark, sf):
    """N1, with the map's entries read back."""
    maps = N.trend_by_hub_map(A.quality_trend(X.quality_records(spark, sf)))
    return maps.select("MC_Code", F.explode("Trend_Summary").alias("Hub_ID", "v")).select("MC_Code", "Hub_ID", "v.*")


@register("year_map")
def year_map(spark, sf):
    """N2, with every field of the maps' entries read back."""
    maps = _year_maps(spark, sf)
    return maps.select("MC_Code", "Hub_ID", F.explode("Years").alias("Year", "v")).select("MC_Code", "Hub_ID", "Year", "v.*")


@register("year_map_rows")
def year_map_rows(spark, sf):
    return N.year_map_rows(_year_maps(spark, sf), "Average_WQI")


@register("hub_lookup")
def hub_lookup(spark, sf):
    """The content found for each hub; a hub without records (one asked for in every municipality) has none."""
    asked = X.mc_hub_mapping(spark, sf).unionByName(
        X.municipal_data(spark, sf).select("MC_Code", F.lit("HUB0000").alias("Hub_ID")))
    found = N.hub_lookup(asked, _year_maps(spark, sf))
    return found.select("MC_Code", "Hub_ID", F.size("Years").alias("Years_Found"), F.explode_outer("Years").alias("Year", "v")).select(
        "MC_Code", "Hub_ID", "Years_Found", "Year", "v.Average_WQI", "v.Total_Records")


@register("report_json")
def report_json(spark, sf):
    """N5, with the JSON parsed back to columns."""
    report = W.yearly_distribution_trend(X.distribution_records(spark, sf))
    return N.report_json(report).select(F.from_json("json", report.schema).alias("r")).select("r.*")


# --------------------------------------------------------- sources and sinks --
from hydrolake.plans import scoring as P  # noqa: E402
from hydrolake.session import scratch_path  # noqa: E402
from hydrolake.sources import io  # noqa: E402


@register("scan_municipal_csv")
def scan_municipal_csv(spark, sf):
    path = io.write_municipal_csv(X.municipal_data(spark, sf), scratch_path(spark, "municipal-csv"))
    return io.read_municipal_csv(spark, path)


@register("scan_table_params")
def scan_table_params(spark, sf):
    X.quality_records(spark, sf).createOrReplaceTempView("water_quality_records")
    return io.scan_table_params(
        spark,
        "SELECT Hub_ID, WQI, Anomaly_Status, Created_At FROM water_quality_records WHERE MC_Code = :mc_code",
        mc_code=TENANT,
    )


def _quality_predictions(spark, sf, source=None):
    r = source if source is not None else X.quality_readings(spark, sf)
    r = r.withColumns({"ml_wqi": X.injected_ml_wqi(), "anomaly_pred": X.injected_anomaly()})
    return P.predict_quality(r, ml_col="ml_wqi", anomaly_col="anomaly_pred", keep=("l_orderkey", "l_linenumber"))


def _distribution_predictions(spark, sf):
    return P.predict_distribution(X.distribution_inputs(spark, sf), eff_col="eff_pred", risk_col="risk_pred",
                                  keep=("o_orderkey",))


@register("append_quality")
def append_quality(spark, sf):
    path = scratch_path(spark, "quality-records")
    io.append_quality(_quality_predictions(spark, sf).withColumnRenamed("Final_WQI", "WQI"), path)
    return io.read_records(spark, path).select(*io.QUALITY_RECORD_COLUMNS)


@register("append_distribution")
def append_distribution(spark, sf):
    path = scratch_path(spark, "distribution-records")
    io.append_distribution(_distribution_predictions(spark, sf), path)
    return io.read_records(spark, path).select(*io.DISTRIBUTION_RECORD_COLUMNS)


@register("mark_used_for_training")
def mark_used_for_training(spark, sf):
    """The flag of all stored records, updated in place."""
    path = scratch_path(spark, "records")
    io.append_records(X.quality_records(spark, sf), path, batch_id=0)
    io.mark_used_in_place(spark, path)
    return io.read_records(spark, path).select("MC_Code", "Hub_ID", "WQI", "Created_At", "Used_For_Training")


@register("scan_training")
def scan_training(spark, sf):
    return io.scan_training(X.quality_training(spark, sf))


# ----------------------------------------------------------- end to end -----
@register("predict_quality")
def predict_quality(spark, sf):
    """P1 with injected model outputs: exact rule layer over every reading."""
    return _quality_predictions(spark, sf)


@register("predict_distribution")
def predict_distribution(spark, sf):
    """P2 with injected model outputs."""
    return _distribution_predictions(spark, sf)


# ---------------------------------------------------------------- streaming --
from hydrolake.streaming import ingest as T  # noqa: E402


@register("stream_quality")
def stream_quality(spark, sf):
    out = T.stream_quality(spark, sf)
    return T.read_stream_output(spark, out).select(*io.QUALITY_RECORD_COLUMNS)


@register("stream_distribution")
def stream_distribution(spark, sf):
    out = T.stream_distribution(spark, sf)
    return T.read_stream_output(spark, out).select(*io.DISTRIBUTION_RECORD_COLUMNS)


# ----------------------------------------------------------------------- ML --
from hydrolake.ml import isolation as ISO  # noqa: E402
from hydrolake.ml import models as M  # noqa: E402
from hydrolake.ml import scaler as SC  # noqa: E402
from hydrolake.plans import training as TR  # noqa: E402

# The original's number of trees, grown to purity; nothing that is trained outlives its query.
RF_TREES = ISO_TREES = K.N_TREES
RECORD_KEY = ("l_orderkey", "l_linenumber", "Hub_ID", "Created_At")  # unique in the driver's tables
READING_KEY = ("o_orderkey",)


def _spread(df):
    """Rows over all cores, by their content: the driver's tables are single, unsplittable files."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def _training(spark, sf, key=()):
    return TR.training_set(X.quality_records(spark, sf), key)


def _quality_models(spark, sf) -> TR.TrainingResult:
    return TR.train_models(spark, X.quality_records(spark, sf), scratch_path(spark, "models"), num_trees=RF_TREES,
                           forest_trees=ISO_TREES, version=M.version_stamp(), key=RECORD_KEY)


def _scaled_training(spark, sf):
    """The stored training set, its scaler and the scaled rows."""
    t = _spread(_training(spark, sf, RECORD_KEY)).checkpoint(eager=True)
    stats = SC.fit_scaler(t, K.ML_FEATURES)
    return SC.scaled_features(t, stats, prefix="z_")


Z_FEATURES = [f"z_{f}" for f in K.ML_FEATURES]


def _distribution_training(spark, sf):
    """Distribution readings with the five model columns."""
    d = D.distribution_features(X.distribution_inputs(spark, sf).drop("eff_pred", "risk_pred"))
    return d.withColumns({"Deficit_MLD": F.col("deficit"), "PerCapita_LPCD": F.col("per_capita")})


@register("training_set")
def training_set(spark, sf):
    return _training(spark, sf)


@register("scaler_stats")
def scaler_stats(spark, sf):
    return SC.scaler_stats_frame(_training(spark, sf), K.ML_FEATURES)


@register("scaled_features")
def scaled_features(spark, sf):
    t = _training(spark, sf)
    stats = SC.fit_scaler(t, K.ML_FEATURES)
    return SC.scaled_features(t, stats, prefix="z_").select(
        *[F.round(f"z_{f}", 6).alias(f"z_{f}") for f in K.ML_FEATURES], "WQI")


@register("anomaly_target")
def anomaly_target(spark, sf):
    return M.anomaly_target(X.quality_records(spark, sf)).select("Hub_ID", "Anomaly_Status", "anomaly_target")


@register("regression_eval")
def regression_eval(spark, sf):
    s = X.quality_scored(spark, sf).withColumn("ml_wqi", X.injected_ml_wqi())
    return M.regression_eval(s, "Rule_WQI", "ml_wqi")


@register("train_wqi_regressor")
def train_wqi_regressor(spark, sf):
    """M2 + M10: the fitted regressor's fit on its training data (R², MAE, N)."""
    t = _scaled_training(spark, sf)
    model = M.train_wqi_regressor(t, Z_FEATURES, num_trees=RF_TREES, key=RECORD_KEY)
    return M.regression_eval(M.score_wqi(t, model))


@register("train_isolation_forest")
def train_isolation_forest(spark, sf):
    """M3: the forest as a node table (bounded by trees × (2ψ − 1) rows)."""
    forest = ISO.fit_isolation_forest(_scaled_training(spark, sf), Z_FEATURES, n_trees=ISO_TREES, key=RECORD_KEY)
    nodes = spark.createDataFrame(forest.nodes, ISO.NODE_SCHEMA)
    # six digits: the features are scaled by sums taken in another order on each run
    return nodes.withColumn("threshold", F.round("threshold", 6))


@register("score_anomalies")
def score_anomalies(spark, sf):
    """M4: −1/1 per training row from the isolation forest (≈2% flagged)."""
    t = _scaled_training(spark, sf)
    forest = ISO.fit_isolation_forest(t, Z_FEATURES, n_trees=ISO_TREES, key=RECORD_KEY)
    return ISO.score_frame(t, forest).select(*RECORD_KEY, "WQI", "anomaly_score", "anomaly_pred")


@register("score_wqi")
def score_wqi(spark, sf):
    """M5: regressor prediction per scaled row."""
    t = _scaled_training(spark, sf)
    model = M.train_wqi_regressor(t, Z_FEATURES, num_trees=RF_TREES, key=RECORD_KEY)
    return M.score_wqi(t, model).select(*RECORD_KEY, "WQI", "ml_wqi")


@register("score_efficiency")
def score_efficiency(spark, sf):
    """M6: efficiency regression on (population, demand, supply, deficit, per-capita)."""
    d = _spread(_distribution_training(spark, sf)).checkpoint(eager=True)
    model = M.train_efficiency_model(d, num_trees=RF_TREES, key=READING_KEY)
    return M.score_efficiency(d, model).select("o_orderkey", "Hub_ID", "eff_pred")


@register("score_criticality")
def score_criticality(spark, sf):
    """M7: binary criticality classifier on the same five columns."""
    d = _spread(_distribution_training(spark, sf)).checkpoint(eager=True)
    model = M.train_criticality_model(d, num_trees=RF_TREES, key=READING_KEY)
    return M.score_criticality(d, model).select("o_orderkey", "Hub_ID", "risk_pred")


@register("score_wqi_full_trees")
def score_wqi_full_trees(spark, sf):
    """M2 and M5 without a bootstrap: trees grown to purity give each row the mean WQI of the rows with equal features."""
    t = _scaled_training(spark, sf)
    model = M.train_wqi_regressor(t, Z_FEATURES, num_trees=3, key=RECORD_KEY, bootstrap=False)
    return M.score_wqi(t, model).select(*RECORD_KEY, "WQI", F.round("ml_wqi", 6).alias("ml_wqi"))


@register("score_criticality_full_trees")
def score_criticality_full_trees(spark, sf):
    """M7 without a bootstrap: every tree, whatever features it tries, tells all rows of different features apart."""
    d = _spread(_distribution_training(spark, sf)).checkpoint(eager=True)
    model = M.train_criticality_model(d, num_trees=10, key=READING_KEY, bootstrap=False)
    return M.score_criticality(d, model).select("o_orderkey", "Hub_ID", "risk_pred")


@register("train_models")
def train_models(spark, sf):
    """S6 → M8 → M1 → M2 → M3 → S7 → M10 on the training table."""
    res = TR.train_models(spark, X.quality_training(spark, sf), scratch_path(spark, "models-p3"),
                          num_trees=RF_TREES, forest_trees=ISO_TREES, version=M.version_stamp())
    return TR.training_summary(res)


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    """Save and load; every training row is scored alike by the fitted and the loaded models."""
    res = _quality_models(spark, sf)
    loaded = M.load_models(spark, res.path)
    t = SC.scaled_features(_spread(_training(spark, sf)), loaded.scaler, prefix="z_").select(*Z_FEATURES)
    t = M.score_wqi(t, res.models.regressor).withColumnRenamed("ml_wqi", "_fitted")
    t = ISO.score_frame(M.score_wqi(t, loaded.regressor), res.models.forest, score_col="_s1", label_col="_l1")
    t = ISO.score_frame(t, loaded.forest, score_col="_s2", label_col="_l2")
    flagged = F.avg((F.col("_l2") == -1).cast("double"))
    return t.agg(
        F.count(F.lit(1)).alias("Rows_Scored"),
        F.min((F.col("_fitted") == F.col("ml_wqi")) & (F.col("_l1") == F.col("_l2"))).alias("Reloaded_Equal"),
        flagged.between(K.CONTAMINATION / 2, K.CONTAMINATION * 2).alias("Flagged_Near_Two_Percent"),
        F.lit(loaded.regressor.num_trees).alias("Regression_Trees"),
        F.lit(int(loaded.forest.nodes["tree_id"].nunique())).alias("Isolation_Trees"),
    )


@register("retrain")
def retrain(spark, sf):
    """M9: refit on stored records, then flag them used in place."""
    path = scratch_path(spark, "records-retrain")
    io.append_records(X.quality_records(spark, sf), path, batch_id=0)
    res, _ = TR.retrain(spark, path, scratch_path(spark, "models-m9"), num_trees=RF_TREES, forest_trees=ISO_TREES,
                        key=RECORD_KEY)
    flags = io.read_records(spark, path).groupBy("Used_For_Training").agg(F.count(F.lit(1)).alias("n"))
    return TR.training_summary(res).unionByName(flags, allowMissingColumns=True)


@register("predict_quality_model")
def predict_quality_model(spark, sf):
    """P1 with the trained regressor and isolation forest."""
    models = _quality_models(spark, sf).models
    return P.predict_quality(_spread(X.quality_readings(spark, sf)), models=models, keep=("l_orderkey", "l_linenumber"))


def _distribution_models(spark, sf):
    train = _spread(_distribution_training(spark, sf)).checkpoint(eager=True)
    return (M.train_efficiency_model(train, num_trees=RF_TREES, key=READING_KEY),
            M.train_criticality_model(train, num_trees=RF_TREES, key=READING_KEY))


@register("municipal_simulation_model")
def municipal_simulation_model(spark, sf):
    """D9 with the trained efficiency and criticality forests: one row per municipality."""
    eff, risk = _distribution_models(spark, sf)
    m = D.distribution_features(X.municipal_data(spark, sf)).withColumns(
        {"Deficit_MLD": F.col("deficit"), "PerCapita_LPCD": F.col("per_capita")})
    scored = M.score_distribution_models(m, eff, risk).select(*X.municipal_data(spark, sf).columns, "eff_pred", "risk_pred")
    return D.municipal_simulation(scored, as_of=f"{AS_OF_YEAR}-12-31 00:00:00")


@register("predict_distribution_model")
def predict_distribution_model(spark, sf):
    """P2 with the trained efficiency and criticality forests."""
    eff, risk = _distribution_models(spark, sf)
    r = _spread(X.distribution_inputs(spark, sf).drop("eff_pred", "risk_pred"))
    return P.predict_distribution(r, eff, risk, keep=("o_orderkey",))


@register("stream_quality_model")
def stream_quality_model(spark, sf):
    """T1 with the trained regressor and isolation forest."""
    out = T.stream_quality(spark, sf, models=_quality_models(spark, sf).models)
    return T.read_stream_output(spark, out).select(*io.QUALITY_RECORD_COLUMNS)


@register("stream_distribution_model")
def stream_distribution_model(spark, sf):
    """T2 with the trained efficiency and criticality forests."""
    eff, risk = _distribution_models(spark, sf)
    out = T.stream_distribution(spark, sf, eff_model=eff, risk_model=risk)
    return T.read_stream_output(spark, out).select(*io.DISTRIBUTION_RECORD_COLUMNS)
