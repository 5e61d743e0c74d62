"""The record table: in-place flags beside appends, and one-pass validation."""

import pytest
from pyspark.sql import functions as F

from hydrolake.plans import scoring as P
from hydrolake.plans import training as TR
from hydrolake.session import scratch_path
from hydrolake.sources import fixtures as X
from hydrolake.sources import io

SF = "/root/testdata/sf0.001"


def rows(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id", "'007' AS MC_Code", "CASE WHEN id % 5 = 0 THEN NULL ELSE int(id % 2) END AS Used_For_Training")


def test_flags_change_in_place_and_late_appends_stay(spark):
    path = scratch_path(spark, "swap")
    io.append_records(rows(spark, 0, 10), path, batch_id="a")
    io.append_records(rows(spark, 10, 20), path, batch_id="b")
    batches = io.live_batches(spark, path)
    seen = io.read_records(spark, path, batches)
    io.append_records(rows(spark, 20, 30), path, batch_id="c")      # arrives between the fit and the swap
    assert seen.count() == 20
    new = io.mark_used_in_place(spark, path, batches)
    got = {r["id"]: r["Used_For_Training"] for r in io.read_records(spark, path).collect()}
    assert sorted(got) == list(range(30))
    assert all(got[i] == (None if i % 5 == 0 else 1) for i in range(20))
    assert all(got[i] == (None if i % 5 == 0 else i % 2) for i in range(20, 30))
    assert set(io.live_batches(spark, path)) == {"c", new}
    assert set(io.read_records(spark, path).select("MC_Code").distinct().toPandas()["MC_Code"]) == {"007"}
    with pytest.raises(RuntimeError):       # those batches were replaced already
        io.mark_used_in_place(spark, path, batches)
    assert io.read_records(spark, path).count() == 30
    io.mark_used_in_place(spark, path)      # the next round takes the late batch along
    assert io.read_records(spark, path).filter("Used_For_Training = 0").count() == 0
    assert io.read_records(spark, path).count() == 30


def test_a_failed_or_unfinished_write_is_not_read(spark):
    path = scratch_path(spark, "swap")
    io.append_records(rows(spark, 0, 10), path, batch_id="a")
    rows(spark, 100, 110).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("MC_Code").parquet(
        f"{path}/batch_id=open")
    assert io.live_batches(spark, path) == ["a"] and io.read_records(spark, path).count() == 10
    io._write_pointer(spark, path, ["half"])     # a snapshot that was written but never swapped in
    io.append_records(rows(spark, 0, 10), path, batch_id="half")
    assert io.read_records(spark, path).count() == 10


def test_retrain_neither_learns_nor_flags_a_late_append(spark, monkeypatch):
    path = scratch_path(spark, "retrain")
    recs = X.quality_records(spark, SF)
    io.append_records(recs.filter("l_orderkey % 2 = 0"), path, batch_id=0)
    late = recs.filter("l_orderkey % 2 = 1 AND l_orderkey < 400").withColumn("Used_For_Training", F.lit(0))
    fit = TR.train_models

    def fit_then_append(*a, **k):
        out = fit(*a, **k)
        io.append_records(late, path, batch_id=1)
        return out

    monkeypatch.setattr(TR, "train_models", fit_then_append)
    result, _ = TR.retrain(spark, path, scratch_path(spark, "models"), num_trees=3, forest_trees=3)
    flags = {r[0]: r[1] for r in io.read_records(spark, path).groupBy("Used_For_Training").count().collect()}
    assert flags == {1: recs.filter("l_orderkey % 2 = 0").count(), 0: late.count()}
    assert result.evaluation.first()["N"] == TR.training_set(recs.filter("l_orderkey % 2 = 0")).count()


def test_one_pass_keeps_every_reading(spark):
    good = X.quality_readings(spark, SF).withColumns({"ml_wqi": X.injected_ml_wqi(), "anomaly_pred": X.injected_anomaly()})
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    dirty = good.withColumn("BOD_Min", F.when(F.col("l_orderkey") % 7 == 0, F.lit("bad")).otherwise(F.col("BOD_Min").cast("string")))
    path = scratch_path(spark, "rejects")
    out = P.predict_quality(dirty.mapInArrow(count, dirty.schema), ml_col="ml_wqi", anomaly_col="anomaly_pred",
                            keep=("l_orderkey", "l_linenumber"), quarantine_path=path)
    n_out, n_bad = out.count(), spark.read.parquet(path).count()
    n = good.count()
    assert n_out + n_bad == n and n_bad == good.filter("l_orderkey % 7 = 0").count()
    assert seen.value == n      # the source was read once
    assert spark.read.parquet(path).select("Rejected_Fields").distinct().collect()[0][0] == "BOD_Min"


def test_one_pass_on_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    path = scratch_path(spark, "rejects")
    assert io.split_once(df, {"a": "double"}, path).count() == 0
    assert spark.read.schema("a string, b string, Rejected_Fields string").parquet(path).count() == 0
