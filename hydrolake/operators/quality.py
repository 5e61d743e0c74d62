"""Water-quality scoring operators (map-side only: no shuffle anywhere here).

Every function takes a DataFrame and returns a DataFrame with columns added
or replaced, so a whole scoring chain is one projection that Catalyst fuses
into a single whole-stage-codegen stage.  Model outputs enter as ordinary
columns, which keeps every rule exactly testable without a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.functions import sqltext as S
from hydrolake.functions.text import sentence

FEATURE_COLUMNS = K.PARAMS  # midpoint columns, rule naming (Nitrate_N)


# Q1 -------------------------------------------------------------------------
def midpoints(df: DataFrame, keep_bounds: bool = False) -> DataFrame:
    """(min + max) / 2 for the seven parameters; drops the bounds by default."""
    cols = {p: F.expr(f"(`{p}_Min` + `{p}_Max`) / 2.0D") for p in K.READING_PARAMS}
    out = df.withColumns(cols)
    if not keep_bounds:
        out = out.drop(*[f"{p}_{s}" for p in K.READING_PARAMS for s in ("Min", "Max")])
    return out


# Q11 ------------------------------------------------------------------------
def nitrate_rename(df: DataFrame) -> DataFrame:
    """Model view of the midpoints: ``Nitrate_N`` → ``Nitrate``, uncapped.

    Must run before :func:`cap_params`: the models see raw midpoints while
    the rule, the stored columns and the safety test see capped ones.
    """
    return df.withColumn("Nitrate", F.col("Nitrate_N"))


def ml_feature_columns() -> list[str]:
    return list(K.ML_FEATURES)


# Q2 -------------------------------------------------------------------------
def cap_params(df: DataFrame) -> DataFrame:
    """Upper caps only; a NaN parameter stays NaN (it later scores 0)."""
    return df.withColumns({p: F.expr(S.py_min(f"`{p}`", cap)) for p, cap in K.CAPS.items()})


# Q3 -------------------------------------------------------------------------
def subscore_sql() -> dict[str, str]:
    """The seven sub-scores as Spark SQL over the (capped) parameter columns."""
    return {
        "Temperature_Score": S.py_max0(f"100.0D - abs(`Temperature` - {S.d(K.STANDARD_TEMPERATURE)}) * 4.0D"),
        "pH_Score": S.py_max0(f"100.0D - abs(`pH` - {S.d(K.STANDARD_PH)}) * 10.0D"),
        "Conductivity_Score": S.py_max0("100.0D - `Conductivity` / 100.0D"),
        "BOD_Score": S.py_max0("100.0D - `BOD` * 10.0D"),
        "Faecal_Coliform_Score": S.py_max0("100.0D - `Faecal_Coliform` / 10.0D"),
        "Total_Coliform_Score": S.py_max0("100.0D - `Total_Coliform` / 10.0D"),
        "Nitrate_N_Score": S.py_max0("100.0D - `Nitrate_N` * 5.0D"),
    }


def subscore_exprs() -> dict[str, Column]:
    return {k: F.expr(v) for k, v in subscore_sql().items()}


def subscores(df: DataFrame) -> DataFrame:
    """Seven sub-scores floored at 0 (negative inputs can exceed 100)."""
    return df.withColumns(subscore_exprs())


# Q4 -------------------------------------------------------------------------
def rule_wqi_sql(scores: dict[str, str] | None = None) -> str:
    """Σ weight · score, summed left to right in the rule's order, rounded to 2."""
    scores = scores or {f"{p}_Score": f"`{p}_Score`" for p in K.PARAMS}
    terms = [f"({scores[f'{p}_Score']}) * {S.d(K.WEIGHTS[p])}" for p in K.PARAMS]
    return S.py_round2(" + ".join(terms))


def rule_wqi_expr(scores: dict[str, str] | None = None) -> Column:
    return F.expr(rule_wqi_sql(scores))


def rule_wqi(df: DataFrame, keep_subscores: bool = False) -> DataFrame:
    """Weighted sum of the sub-scores, rounded to 2 decimals → ``Rule_WQI``."""
    if keep_subscores:
        return subscores(df).withColumn("Rule_WQI", rule_wqi_expr())
    return df.withColumn("Rule_WQI", rule_wqi_expr(subscore_sql()))


def score_rule(df: DataFrame) -> DataFrame:
    """Q1 → Q2 → Q4 on raw readings: capped midpoints plus ``Rule_WQI``."""
    return rule_wqi(cap_params(midpoints(df)))


# Q5 -------------------------------------------------------------------------
def hybrid_wqi(df: DataFrame, ml_col: str = "ml_wqi", rule_col: str = "Rule_WQI", out: str = "WQI") -> DataFrame:
    """round(0.7 · model + 0.3 · rounded rule, 2)."""
    return df.withColumn(out, F.expr(S.py_round2(f"`{ml_col}` * {S.d(K.ML_SHARE)} + `{rule_col}` * {S.d(K.RULE_SHARE)}")))


# Q6 -------------------------------------------------------------------------
def quality_band_sql(w: str, idx: int) -> str:
    """Band field ``idx`` of the rounded WQI ``w`` (SQL); null stays null, NaN is Very Poor."""
    return S.band(w, [b[0] for b in K.QUALITY_BANDS], [S.s(b[idx]) for b in K.QUALITY_BANDS])


def categorize5(df: DataFrame, wqi_col: str = "WQI") -> DataFrame:
    """Five bands on the rounded WQI with emoji, interpretation and action."""
    w = f"`{wqi_col}`"
    names = ("Category", "Emoji_Status", "Interpretation", "Recommended_Action")
    # the band's number is found once; the four texts are looked up by it
    number = S.band(w, [b[0] for b in K.QUALITY_BANDS], [str(i + 1) for i in range(len(K.QUALITY_BANDS))])
    texts = {n: F.expr(f"element_at(array({', '.join(S.s(b[i + 1]) for b in K.QUALITY_BANDS)}), _band)") for i, n in enumerate(names)}
    return df.withColumn("_band", F.expr(number)).withColumns(texts).drop("_band")


def category5_expr(w: str) -> Column:
    """Category of the WQI column named ``w``."""
    return F.expr(quality_band_sql(f"`{w}`", 1))


# Q7 -------------------------------------------------------------------------
def categorize3_expr(w: str) -> Column:
    """≥70 Good, ≥50 Moderate, else Poor, on the WQI column named ``w``."""
    return F.expr(S.band(f"`{w}`", [b[0] for b in K.QUALITY_BANDS3], [S.s(b[1]) for b in K.QUALITY_BANDS3]))


def categorize3(df: DataFrame, wqi_col: str = "WQI", out: str = "Category3") -> DataFrame:
    """≥70 Good, ≥50 Moderate, else Poor."""
    return df.withColumn(out, categorize3_expr(wqi_col))


# Q8 -------------------------------------------------------------------------
def safety_condition_sql(ph: str, bod: str, fc: str) -> str:
    # NaN is never below or above a threshold in the rule; Spark says NaN > x.
    return (f"((NOT isnan({ph}) AND {ph} < {S.d(K.SAFETY_PH_BELOW)}) OR "
            f"(NOT isnan({bod}) AND {bod} > {S.d(K.SAFETY_BOD_ABOVE)}) OR "
            f"(NOT isnan({fc}) AND {fc} > {S.d(K.SAFETY_FC_ABOVE)}))")


def safety_downgrade(df: DataFrame, wqi_col: str = "WQI", use_raw: bool = False) -> DataFrame:
    """Critical contamination forces Very Poor and caps the WQI at 35.

    By default the test reads the *capped* parameters, as the rule does, which
    makes the faecal-coliform branch unreachable (its cap is 2000).  With
    ``use_raw=True`` it reads ``raw_pH``/``raw_BOD``/``raw_Faecal_Coliform``.
    """
    p = "raw_" if use_raw else ""
    hit = safety_condition_sql(f"`{p}pH`", f"`{p}BOD`", f"`{p}Faecal_Coliform`")
    w = f"`{wqi_col}`"
    ceiling = S.d(K.SAFETY_WQI_CEILING)

    def pick(value: str, col: str) -> Column:
        return F.expr(f"CASE WHEN Safety_Downgrade THEN {value} ELSE `{col}` END")

    # the test is a column of its own, so that its six uses read it
    return df.withColumn("Safety_Downgrade", F.expr(hit)).withColumns(
        {
            # the rule's min(wqi, 35) returns the integer 35 when it bites
            "WQI_Text": F.expr(f"CASE WHEN Safety_Downgrade AND NOT isnan({w}) AND {w} > {ceiling} THEN '35' "
                               f"ELSE CAST({w} AS STRING) END"),
            wqi_col: pick(S.py_min(w, K.SAFETY_WQI_CEILING), wqi_col),
            "Category": pick(S.s(K.SAFETY_CATEGORY), "Category"),
            "Emoji_Status": pick(S.s(K.SAFETY_EMOJI), "Emoji_Status"),
            "Interpretation": pick(S.s(K.SAFETY_INTERPRETATION), "Interpretation"),
            "Recommended_Action": pick(S.s(K.SAFETY_ACTION), "Recommended_Action"),
        }
    )


# Q9 -------------------------------------------------------------------------
def anomaly_label(df: DataFrame, pred_col: str = "anomaly_pred") -> DataFrame:
    """−1 → "Anomaly Detected" (overrides emoji, extends the action), else Normal."""
    is_anom = f"`{pred_col}` = -1"
    return df.withColumns(
        {
            "Anomaly_Status": F.expr(f"CASE WHEN {is_anom} THEN {S.s(K.ANOMALY)} ELSE {S.s(K.NORMAL)} END"),
            "Emoji_Status": F.expr(f"CASE WHEN {is_anom} THEN {S.s(K.ANOMALY_EMOJI)} ELSE `Emoji_Status` END"),
            "Recommended_Action": F.expr(f"CASE WHEN {is_anom} THEN concat(`Recommended_Action`, "
                                         f"{S.s(K.ANOMALY_ACTION_SUFFIX)}) ELSE `Recommended_Action` END"),
        }
    )


# Q10 ------------------------------------------------------------------------
def quality_text(df: DataFrame, ml_col: str = "ml_wqi") -> DataFrame:
    """Summary and message sentences plus the model/rule details."""
    wqi_text = F.col("WQI_Text") if "WQI_Text" in df.columns else F.col("WQI").cast("string")
    return df.withColumns(
        {
            "AI_Summary": sentence(K.QUALITY_SUMMARY, wqi=wqi_text),
            "Message": sentence(K.QUALITY_SAVED),
            "ML_WQI": F.expr(S.py_round2(f"`{ml_col}`")),
            "Hybrid_Model": F.lit(K.HYBRID_MODEL_TEXT),
        }
    )


def details_struct(df: DataFrame) -> DataFrame:
    """Nested form of the details block (model, rule, blend, input features)."""
    inputs = F.struct(*[F.col(p).alias(p) for p in ("Temperature", "pH", "BOD", "Faecal_Coliform",
                                                     "Total_Coliform", "Nitrate_N", "Conductivity")])
    return df.withColumn(
        "Details",
        F.struct(
            F.col("ML_WQI").alias("ML_WQI"),
            F.col("Rule_WQI").alias("Rule_WQI"),
            F.col("Hybrid_Model").alias("Hybrid_Model"),
            inputs.alias("Input_Features"),
        ),
    )


# Q12 ------------------------------------------------------------------------
def unpivot_features(df: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """Feature columns → (Feature, Value) rows."""
    features = features or ["Temperature", "pH", "BOD", "Faecal_Coliform", "Total_Coliform", "Nitrate_N",
                            "Conductivity"]
    return df.unpivot(ids, features, "Feature", "Value")
