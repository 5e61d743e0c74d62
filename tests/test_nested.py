"""Nested report forms: bounded maps, lookups with a default, JSON round trip."""

import datetime as dt
import json

from pyspark.sql import functions as F

from hydrolake.operators import aggregates as A
from hydrolake.operators import nested as N
from hydrolake.operators import windows as W

Q_SCHEMA = "MC_Code string, Hub_ID string, WQI double, Anomaly_Status string, Created_At timestamp_ntz"


def records(spark):
    rows = [("MC1", "H1", 50.0 + i, "Normal", dt.datetime(2018 + i % 3, 3, 1)) for i in range(9)]
    rows += [("MC1", "H2", 40.0, "Normal", dt.datetime(2020, 5, 5))]
    return spark.createDataFrame(rows, Q_SCHEMA)


def test_year_map_has_exactly_the_report_years(spark):
    maps = N.year_map(W.yearly_quality_trend(records(spark), as_of_year=2021))
    got = {r["Hub_ID"]: r["Years"] for r in maps.collect()}
    assert sorted(got["H1"]) == ["2018", "2019", "2020", "2021"]
    assert got["H1"]["2021"]["Total_Records"] == 0 and got["H2"]["2020"]["Average_WQI"] == 40.0
    rows = N.year_map_rows(maps).filter(F.col("Hub_ID") == "H1").orderBy("year").collect()
    assert [r["year"] for r in rows] == ["2018", "2019", "2020", "2021"]


def test_hub_lookup_defaults_to_an_empty_map(spark):
    maps = N.year_map(W.yearly_quality_trend(records(spark), as_of_year=2021))
    selected = spark.createDataFrame([("MC1", "H1"), ("MC1", "H9")], "MC_Code string, Hub_ID string")
    got = {r["Hub_ID"]: r["Years"] for r in N.hub_lookup(selected, maps).collect()}
    assert len(got["H1"]) == 4 and got["H9"] == {}


def test_trend_map_entries_and_json(spark):
    trend = A.quality_trend(records(spark))
    entries = {r["Hub_ID"]: r["Trend_Summary"] for r in N.trend_by_hub_map(trend).collect()}
    assert entries["H2"]["H2"]["Total_Records"] == 1
    js = [json.loads(r["json"]) for r in N.report_json(trend).collect()]
    assert {j["Hub_ID"]: j["Total_Records"] for j in js} == {"H1": 9, "H2": 1}
