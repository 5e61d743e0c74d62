"""Property checks of the rule layer against a brute-force pass in plain Python."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from hydrolake import constants as K
from hydrolake.operators import distribution as D
from hydrolake.operators import quality as Q


def brute_rule(vals):
    """The rule WQI written out directly: cap in place, floor each score at 0, weighted sum."""
    v = {k: min(x, K.CAPS[k]) for k, x in vals.items()}
    scores = {
        "Temperature": max(0, 100 - abs(v["Temperature"] - 25) * 4),
        "pH": max(0, 100 - abs(v["pH"] - 7) * 10),
        "Conductivity": max(0, 100 - v["Conductivity"] / 100),
        "BOD": max(0, 100 - v["BOD"] * 10),
        "Faecal_Coliform": max(0, 100 - v["Faecal_Coliform"] / 10),
        "Total_Coliform": max(0, 100 - v["Total_Coliform"] / 10),
        "Nitrate_N": max(0, 100 - v["Nitrate_N"] * 5),
    }
    total = None
    for p in K.PARAMS:  # left to right, as the rule sums
        term = scores[p] * K.WEIGHTS[p]
        total = term if total is None else total + term
    return scores, round(total, 2)


finite = st.floats(min_value=-1e5, max_value=1e6, allow_nan=False, allow_infinity=False)
reading = st.fixed_dictionaries({p: st.tuples(finite, finite) for p in K.READING_PARAMS})


@settings(max_examples=25, deadline=None)
@given(st.lists(reading, min_size=1, max_size=20))
def test_rule_wqi_matches_brute_force_and_scores_are_non_negative(spark, batch):
    cols = [f"{p}_{s}" for p in K.READING_PARAMS for s in ("Min", "Max")]
    rows = [tuple(r[p][i] for p in K.READING_PARAMS for i in (0, 1)) for r in batch]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    got = Q.rule_wqi(Q.cap_params(Q.midpoints(df)), keep_subscores=True).collect()
    for r, g in zip(batch, got):
        mids = {p: (r[p][0] + r[p][1]) / 2 for p in K.READING_PARAMS}
        scores, wqi = brute_rule(mids)
        assert all(g[f"{p}_Score"] >= 0 for p in K.PARAMS)
        for p in K.PARAMS:
            assert math.isclose(g[f"{p}_Score"], scores[p], rel_tol=0, abs_tol=1e-9)
        assert g["Rule_WQI"] == wqi if abs(wqi) >= 1 else math.isclose(g["Rule_WQI"], wqi, rel_tol=0, abs_tol=0.011)


def near_ties():
    """Hundredths and their halves, with the doubles next to them, around every band edge and beyond."""
    out = []
    for base in [*range(1, 130), 999, 5000, 99999, *(b[0] for b in K.QUALITY_BANDS if b[0])]:
        for k in range(0, 1000, 5):
            x = base + k / 1000
            out += [x, math.nextafter(x, 0), math.nextafter(x, math.inf), -x]
    return out


def test_two_digit_rounding_is_the_languages_on_both_sides(spark, tmp_path):
    import duckdb
    import pandas as pd
    from pyspark.sql import functions as F

    from hydrolake.functions import sqltext as S
    from oracles import PYR

    values = near_ties()
    pdf = pd.DataFrame({"x": values, "want": [round(v, 2) for v in values]})
    pdf.to_parquet(tmp_path / "x.parquet")
    df = spark.read.parquet(str(tmp_path / "x.parquet"))
    wrong = df.withColumn("got", F.expr(S.py_round2("x"))).filter("got <> want")
    assert wrong.collect() == []
    assert duckdb.sql(f"SELECT x, want FROM '{tmp_path}/x.parquet' WHERE {PYR('x')} <> want").fetchall() == []
    plain = df.selectExpr("count_if(rint(x * 100) / 100 <> want) AS n").first()["n"]
    assert plain > 1000      # what scaling first would get wrong
    odd = spark.createDataFrame([(float("nan"),), (None,), (0.0,)], "x double").select(F.expr(S.py_round2("x"))).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] is None and odd[2][0] == 0.0


def test_hybrid_equals_the_languages_rounding(spark):
    rows = [(i / 100.0, (i * 37 % 10001) / 100.0) for i in range(0, 10001, 3)]
    df = spark.createDataFrame(rows, "ml_wqi double, Rule_WQI double")
    for r in Q.hybrid_wqi(df).collect():
        assert r["WQI"] == round(r["ml_wqi"] * 0.7 + r["Rule_WQI"] * 0.3, 2) or r["WQI"] < 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(min_value=-50, max_value=150, allow_nan=False), min_size=2, max_size=30))
def test_grade_is_monotone_in_efficiency(spark, effs):
    df = spark.createDataFrame([(e,) for e in effs], "e double")
    got = sorted((r["e"], r["g"]) for r in df.select("e", D.grade_expr("e").alias("g")).collect())
    order = [b[5] for b in K.PERFORMANCE_BANDS][::-1]  # worst → best
    ranks = [order.index(g) for _, g in got]
    assert ranks == sorted(ranks)
