"""Yearly reports on hand-made records: gap years, null years, first-year labels, long-term trend."""

import datetime as dt

from hydrolake import constants as K
from hydrolake.operators import windows as W

Q_SCHEMA = "MC_Code string, Hub_ID string, WQI double, Anomaly_Status string, Created_At timestamp_ntz"
D_SCHEMA = ("MC_Code string, Hub_ID string, Predicted_Supply_Efficiency double, Critical_Risk int, "
            "Created_At timestamp_ntz")


def ts(y, m=6, d=1):
    return dt.datetime(y, m, d)


def test_yearly_quality_trend_gap_years_and_nulls(spark):
    rows = [
        ("MC1", "H1", 50.0, "Normal", ts(2017)),      # before the report range: ignored
        ("MC1", "H1", 60.0, "Normal", ts(2018)),
        ("MC1", "H1", 64.0, K.ANOMALY, ts(2018, 7)),  # 2018 mean 62
        ("MC1", "H1", None, "Normal", ts(2019)),      # all-null year: mean null, not a baseline
        ("MC1", "H1", 61.5, "Normal", ts(2021)),      # delta vs 2018 (62): -0.5 → Stable
        ("MC1", "H1", 70.0, "Normal", ts(2022)),      # +8.5 → Improving
        ("MC1", "H2", 10.0, "Normal", ts(2017)),      # hub with only out-of-range years
    ]
    df = spark.createDataFrame(rows, Q_SCHEMA)
    out = {(r["Hub_ID"], r["Year"]): r for r in W.yearly_quality_trend(df, as_of_year=2023).collect()}
    assert len(out) == 2 * 6  # every hub × 2018..2023
    r18, r19, r20, r21, r22 = (out[("H1", y)] for y in range(2018, 2023))
    assert (r18["Average_WQI"], r18["Total_Records"], r18["Anomaly_Count"], r18["Trend"]) == (62.0, 2, 1, "N/A")
    assert r18["Yearly_Delta"] is None and r18["Max_WQI"] == 64.0 and r18["Min_WQI"] == 60.0
    assert r19["Total_Records"] == 1 and r19["Average_WQI"] is None and r19["Trend"] == "N/A"
    assert (r20["Average_WQI"], r20["Total_Records"], r20["Trend"]) == (0.0, 0, "N/A")
    assert (r21["Yearly_Delta"], r21["Trend"]) == (-0.5, "Stable")
    assert (r22["Yearly_Delta"], r22["Trend"]) == (8.5, "Improving")
    assert all(out[("H2", y)]["Total_Records"] == 0 for y in range(2018, 2024))


def test_spine_size_is_hubs_times_years(spark):
    rows = [("MC1", f"H{i}", 50.0, "Normal", ts(2018 + i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, Q_SCHEMA)
    assert W.yearly_quality_trend(df, as_of_year=2024).count() == 30 * 7


def test_yearly_distribution_windows(spark):
    effs = {2018: 60.0, 2019: 66.0, 2021: 63.0, 2022: 80.0}
    rows = [("MC1", "H1", e, 1 if e < 65 else 0, ts(y)) for y, e in effs.items()]
    rows += [("MC1", "H2", 50.0, 0, ts(2020)), ("MC1", "H2", 52.5, 1, ts(2021))]
    rows += [("MC1", None, 50.0, 0, ts(2020))]  # hub-less rows are left out
    df = spark.createDataFrame(rows, D_SCHEMA)
    out = {(r["Hub_ID"], r["Year"]): r for r in W.yearly_distribution_trend(df).collect()}
    assert set(out) == {("H1", 2018), ("H1", 2019), ("H1", 2021), ("H1", 2022), ("H2", 2020), ("H2", 2021)}
    h18, h19, h21, h22 = (out[("H1", y)] for y in (2018, 2019, 2021, 2022))
    # first present year: delta null, labelled Stable (not N/A); volatility 0 with one row
    assert h18["Yearly_Delta"] is None and h18["Trend"] == "Stable" and h18["Volatility_Index"] == 0.0
    assert h19["Yearly_Delta"] == 6.0 and h19["Trend"] == "Improving"
    assert h21["Yearly_Delta"] == -3.0 and h21["Trend"] == "Degrading"  # gap year 2020 is skipped
    assert h21["Rolling_3yr_Avg"] == 63.0  # (60 + 66 + 63) / 3
    assert h22["Rolling_3yr_Avg"] == round((66 + 63 + 80) / 3, 4)
    assert h19["Volatility_Index"] == round(((60 - 63) ** 2 + (66 - 63) ** 2) ** 0.5, 2)
    # long-term: mean of last three rolling minus mean of first three rolling
    r = [60.0, 63.0, 63.0, (66 + 63 + 80) / 3]
    diff = sum(r[-3:]) / 3 - sum(r[:3]) / 3
    assert h22["Long_Term_Trend"] == ("Improving" if diff > 2 else "Degrading" if diff < -2 else "Stable")
    assert out[("H2", 2021)]["Long_Term_Trend"] == "Insufficient Data"
    assert h22["Performance_Grade"] == "B (Good)" and h18["Performance_Grade"] == "C (Moderate)"
    assert h18["AI_Commentary"] == (f"Hub H1 shows a {h18['Long_Term_Trend'].lower()} trend overall. "
                                    f"Latest efficiency is 80.0%. Volatility Index: {h22['Volatility_Index']}.")


def test_latest_keeps_ties_per_municipality(spark):
    rows = [("MC1", "H1", 70.0, 0, ts(2020)), ("MC1", "H2", 71.0, 1, ts(2020)), ("MC1", "H1", 60.0, 0, ts(2019)),
            ("MC2", "H3", 50.0, 1, ts(2018))]
    df = spark.createDataFrame(rows, D_SCHEMA).withColumn("Recommended_Action", __import__(
        "pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    got = sorted((r["MC_Code"], r["Hub_ID"]) for r in W.latest_distribution(df).collect())
    assert got == [("MC1", "H1"), ("MC1", "H2"), ("MC2", "H3")]


def test_empty_input_gives_empty_frames_with_schema(spark):
    q = spark.createDataFrame([], Q_SCHEMA)
    d = spark.createDataFrame([], D_SCHEMA)
    a = W.yearly_quality_trend(q, as_of_year=2024)
    b = W.yearly_distribution_trend(d)
    assert a.count() == 0 and "Trend" in a.columns
    assert b.count() == 0 and "Long_Term_Trend" in b.columns


def test_null_hub_gets_only_empty_years(spark):
    rows = [("MC1", None, 50.0, "Normal", ts(2019)), ("MC1", "H1", 60.0, "Normal", ts(2019))]
    df = spark.createDataFrame(rows, Q_SCHEMA)
    out = W.yearly_quality_trend(df, as_of_year=2020).collect()
    nulls = [r for r in out if r["Hub_ID"] is None]
    assert sorted(r["Year"] for r in nulls) == [2018, 2019, 2020]
    assert all(r["Total_Records"] == 0 and r["Trend"] == "N/A" for r in nulls)


def test_hot_hub_with_a_third_of_rows(spark):
    """One hub holds a third of all rows; results equal a brute-force pass."""
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        hub = "HOT" if i % 3 == 0 else f"H{i % 40}"
        w = None if i % 97 == 0 else round(rnd.uniform(20, 90), 2)
        rows.append(("MC1", hub, w, K.ANOMALY if i % 50 == 0 else "Normal", ts(2018 + i % 6, 1 + i % 12)))
    df = spark.createDataFrame(rows, Q_SCHEMA).repartition(8)
    got = {(r["Hub_ID"], r["Year"]): r for r in W.yearly_quality_trend(df, as_of_year=2024).collect()}
    hot = [r for r in rows if r[1] == "HOT"]
    for year in range(2018, 2025):
        ws = [r[2] for r in hot if r[4].year == year and r[2] is not None]
        n = sum(1 for r in hot if r[4].year == year)
        g = got[("HOT", year)]
        assert g["Total_Records"] == n
        if ws:
            assert abs(g["Average_WQI"] - sum(ws) / len(ws)) < 1e-9 and g["Max_WQI"] == max(ws)


def test_dashboard_keeps_municipalities_without_hubs(spark):
    from hydrolake.operators import joins as J

    muni = spark.createDataFrame([("MC1", "A", 10, 1.0, 1.0, "D01"), ("MC2", "B", 20, 2.0, 2.0, "D02")],
                                 "MC_Code string, MC_Name string, Population long, Total_Demand_MLD double, "
                                 "Current_Supply_MLD double, Division_Code string")
    mapping = spark.createDataFrame([("MC1", "H1"), ("MC1", "H2")], "MC_Code string, Hub_ID string")
    hubs = spark.createDataFrame([("H1", "b"), ("H2", "a")], "Hub_ID string, Hub_Name string")
    got = sorted((r["MC_Code"], r["Hub_ID"], r["Total_Hubs"]) for r in J.dashboard(muni, mapping, hubs).collect())
    assert got == [("MC1", "H1", 2), ("MC1", "H2", 2), ("MC2", None, 0)]


def test_tenant_scope_limits_a_user_to_their_municipality(spark):
    from hydrolake.operators import joins as J

    recs = spark.createDataFrame([("MC1", "H1"), ("MC2", "H2"), ("MC3", "H3")], "MC_Code string, Hub_ID string")
    users = spark.createDataFrame([("u1", "MC1"), ("u2", "MC2"), ("u9", "MC9")], "Username string, MC_Code string")
    muni = spark.createDataFrame([("MC1",), ("MC2",), ("MC3",)], "MC_Code string")
    assert [r["MC_Code"] for r in J.tenant_scope(recs, users, "u2", municipal=muni).collect()] == ["MC2"]
    assert J.tenant_scope(recs, users, "u9", municipal=muni).count() == 0  # unknown municipality
    assert sorted(r["MC_Code"] for r in J.tenant_scope(recs, users, municipal=muni).collect()) == ["MC1", "MC2"]


def test_reports_reach_the_current_year(spark):
    import datetime as dt

    from hydrolake.operators import filters as FL
    from hydrolake.operators import joins as J
    from hydrolake.operators import windows as W

    now = dt.date.today().year
    df = spark.createDataFrame([("MC1", "H1", 50.0, "Normal", dt.datetime(now, 1, 1))],
                               "MC_Code string, Hub_ID string, WQI double, Anomaly_Status string, Created_At timestamp_ntz")
    out = {r["Year"]: r["Total_Records"] for r in W.yearly_quality_trend(df).collect()}
    assert max(out) == now and out[now] == 1
    assert FL.year_range_filter(df).count() == 1
    assert J.hub_year_spine(df.select("MC_Code", "Hub_ID")).agg({"Year": "max"}).first()[0] == now
