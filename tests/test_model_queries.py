"""Queries that fit their models: rows in = rows out, and streams equal to the batch scored by the same models."""

from pyspark.sql import functions as F

from hydrolake.ml import models as M
from hydrolake.operators import distribution as D
from hydrolake.plans import catalog as C
from hydrolake.plans import scoring as P
from hydrolake.plans import training as TR
from hydrolake.session import scratch_path
from hydrolake.sources import fixtures as X
from hydrolake.sources import io
from hydrolake.streaming import ingest as T

SF = "/root/testdata/sf0.001"


def test_simulation_by_trained_models_keeps_every_municipality(spark, monkeypatch):
    monkeypatch.setattr(C, "RF_TREES", 10)
    got = C.municipal_simulation_model(spark, SF)
    rows = got.collect()
    want = X.municipal_data(spark, SF)
    assert sorted(r["MC_Code"] for r in rows) == sorted(r["MC_Code"] for r in want.collect())
    assert set(got.columns) == set(want.columns) | {"predicted_efficiency", "critical_risk", "recommended_action", "last_updated"}
    assert all(r["critical_risk"] in (0, 1) and r["predicted_efficiency"] is not None for r in rows)


def test_a_municipality_without_population_is_scored(spark):
    df = spark.createDataFrame([("MC001", 10.0, 8.0, 0), ("MC002", 0.0, 8.0, 10), ("MC003", 10.0, 8.0, 1000)],
                               "MC_Code string, Total_Demand_MLD double, Current_Supply_MLD double, Population long")
    train = X.distribution_inputs(spark, SF).drop("eff_pred", "risk_pred")

    def features(d):
        return D.distribution_features(d).withColumns({"Deficit_MLD": F.col("deficit"), "PerCapita_LPCD": F.col("per_capita")})

    eff = M.train_efficiency_model(features(train), num_trees=4, key=["o_orderkey"])
    risk = M.train_criticality_model(features(train), num_trees=4, key=["o_orderkey"])
    out = D.municipal_simulation(M.score_distribution_models(features(df), eff, risk))
    assert out.filter("predicted_efficiency IS NOT NULL AND critical_risk IN (0, 1)").count() == 3


def test_streams_equal_the_batch_scored_by_the_same_models(spark):
    models = TR.train_models(spark, X.quality_records(spark, SF), None, num_trees=6, forest_trees=20, key=C.RECORD_KEY).models
    out = T.read_stream_output(spark, T.stream_quality(spark, SF, models=models)).select(*io.QUALITY_RECORD_COLUMNS)
    batch = P.predict_quality(X.quality_readings(spark, SF), models=models)
    want = io.quality_record_frame(P.quality_records_from_predictions(batch)).select(*io.QUALITY_RECORD_COLUMNS)
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_retrained_summary_names_the_forest(spark):
    path = scratch_path(spark, "records")
    io.append_records(X.quality_records(spark, SF), path, batch_id=0)
    res, _ = TR.retrain(spark, path, scratch_path(spark, "models"), num_trees=5, forest_trees=5, key=C.RECORD_KEY)
    row = TR.training_summary(res).first()
    assert row["R2"] > 0.95 and row["Regression_Nodes"] > 5 * 5000 and row["Forest_Trees"] == 5
