"""Supply/demand scoring operators (map-side only).

Model outputs come in as the columns ``eff_pred`` (predicted supply
efficiency, %) and ``risk_pred`` (0/1).  Bands read the *rounded*
efficiency; the operating action reads the unrounded one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.functions.numeric import rn, safe_divide
from hydrolake.functions import sqltext as S
from hydrolake.functions.text import num_text, sentence


# D1 -------------------------------------------------------------------------
def distribution_features(df: DataFrame) -> DataFrame:
    """deficit = demand − supply; efficiency = supply/demand·100; per-capita.

    Per-capita keeps the rule's formula ``supply·1e6 / (population·1000)``.
    A zero demand or population gives null instead of failing the job.
    """
    demand, supply, pop = F.col("Total_Demand_MLD"), F.col("Current_Supply_MLD"), F.col("Population")
    return df.withColumns(
        {
            "deficit": demand - supply,
            "efficiency": safe_divide(supply, demand) * F.lit(100.0),
            "per_capita": safe_divide(supply * F.lit(1000000.0), pop * F.lit(1000)),
        }
    )


# D2 -------------------------------------------------------------------------
def operating_action_expr(eff: Column, risk: Column) -> Column:
    return (
        F.when(eff < F.lit(K.PUMPING_CUT), F.lit(K.ACTION_INCREASE))
        .when(risk == F.lit(1), F.lit(K.ACTION_ROTATE))
        .otherwise(F.lit(K.ACTION_MAINTAIN))
    )


def operating_action(df: DataFrame, eff_col: str = "eff_pred", risk_col: str = "risk_pred") -> DataFrame:
    """Status and base action from the unrounded predicted efficiency and risk."""
    risk = F.col(risk_col)
    return df.withColumns(
        {
            "Status": F.when(risk == F.lit(1), F.lit(K.STATUS_CRITICAL)).otherwise(F.lit(K.STATUS_STABLE)),
            "Operating_Action": operating_action_expr(F.col(eff_col), risk),
        }
    )


# D3 -------------------------------------------------------------------------
def distribution_rounding(df: DataFrame, eff_col: str = "eff_pred", risk_col: str = "risk_pred") -> DataFrame:
    """2-digit efficiency, deficit and per-capita; 0/1 risk → boolean."""
    return df.withColumns(
        {
            "Predicted_Supply_Efficiency": rn(F.col(eff_col), 2),
            "Critical_Risk": F.col(risk_col) != F.lit(0),
            "Deficit_MLD": rn(F.col("deficit"), 2),
            "PerCapita_LPCD": rn(F.col("per_capita"), 2),
        }
    )


# D4 -------------------------------------------------------------------------
def perf_band_sql(eff: str, idx: int, texts: list[str] | None = None) -> str:
    """Band field ``idx`` on the rounded efficiency ``eff`` (SQL); NaN falls to the last band."""
    outs = texts if texts is not None else [S.s(b[idx]) for b in K.PERFORMANCE_BANDS]
    return S.band(eff, [b[0] for b in K.PERFORMANCE_BANDS], outs, null_out=None)


def performance_band(df: DataFrame, eff_col: str = "Predicted_Supply_Efficiency") -> DataFrame:
    """Five bands on the rounded efficiency; the interpretation quotes the numbers."""
    eff = f"`{eff_col}`"
    slots = {"eff": f"CAST({eff} AS STRING)", "deficit": "CAST(`Deficit_MLD` AS STRING)",
             "lpcd": "CAST(`PerCapita_LPCD` AS STRING)"}
    interp = [S.template(b[3], **{k: v for k, v in slots.items() if "{" + k + "}" in b[3]})
              for b in K.PERFORMANCE_BANDS]
    return df.withColumns(
        {
            "Performance": F.expr(perf_band_sql(eff, 1)),
            "Emoji_Status": F.expr(perf_band_sql(eff, 2)),
            "Interpretation": F.expr(perf_band_sql(eff, 3, interp)),
            "Advice": F.expr(perf_band_sql(eff, 4)),
        }
    )


# D5 -------------------------------------------------------------------------
def risk_label(df: DataFrame, risk_col: str = "Critical_Risk") -> DataFrame:
    """Risk label, and one of two sentences appended to the advice."""
    crit = f"CAST(`{risk_col}` AS BOOLEAN)"
    return df.withColumns(
        {
            "Risk_Label": F.expr(f"CASE WHEN {crit} THEN {S.s(K.RISK_LABEL_CRITICAL)} "
                                 f"ELSE {S.s(K.RISK_LABEL_STABLE)} END"),
            "Advice": F.expr(f"concat(`Advice`, CASE WHEN {crit} THEN {S.s(K.RISK_ADVICE_CRITICAL)} "
                             f"ELSE {S.s(K.RISK_ADVICE_STABLE)} END)"),
        }
    )


# D6 / D7 --------------------------------------------------------------------
def grade_sql(eff: str) -> str:
    """A..E on 85/70/55/40 (NaN falls through to E, as in the rule)."""
    return perf_band_sql(eff, 5)


def grade_expr(eff: str) -> Column:
    return F.expr(grade_sql(f"`{eff}`"))


def nullable_grade_expr(eff: str) -> Column:
    """Grade with null → Unknown; NaN is not null and grades E (Critical)."""
    e = f"`{eff}`"
    return F.expr(f"CASE WHEN {e} IS NULL THEN {S.s(K.GRADE_UNKNOWN)} ELSE {grade_sql(e)} END")


def performance_grade(df: DataFrame, eff_col: str = "Predicted_Supply_Efficiency",
                      out: str = "Performance_Grade") -> DataFrame:
    return df.withColumn(out, grade_expr(eff_col))


def nullable_grade(df: DataFrame, eff_col: str, out: str = "Performance_Grade") -> DataFrame:
    return df.withColumn(out, nullable_grade_expr(eff_col))


# D8 -------------------------------------------------------------------------
def distribution_text(df: DataFrame, eff_col: str = "Predicted_Supply_Efficiency") -> DataFrame:
    """Commentary, summary and saved-message sentences."""
    eff = num_text(F.col(eff_col))
    return df.withColumns(
        {
            "AI_Commentary": sentence(K.DISTRIBUTION_COMMENTARY, eff=eff),
            "Summary": sentence(K.DISTRIBUTION_SUMMARY, eff=eff),
            "Message": sentence(K.DISTRIBUTION_SAVED),
        }
    )


def score_distribution(df: DataFrame, eff_col: str = "eff_pred", risk_col: str = "risk_pred") -> DataFrame:
    """D1 → D2 → D3 → D4 → D5 → D6 → D8 as one projection."""
    out = distribution_features(df)
    out = operating_action(out, eff_col, risk_col)
    out = distribution_rounding(out, eff_col, risk_col)
    out = performance_band(out)
    out = risk_label(out)
    out = performance_grade(out)
    return distribution_text(out)


# D9 -------------------------------------------------------------------------
def municipal_simulation(df: DataFrame, eff_col: str = "eff_pred", risk_col: str = "risk_pred",
                         as_of: str | None = None) -> DataFrame:
    """Fill predicted_efficiency / critical_risk / recommended_action / last_updated.

    One pass over the municipal table; ``as_of`` stamps the refresh time (the time of the run by default).
    """
    out = operating_action(distribution_features(df), eff_col, risk_col)
    return out.select(
        *[c for c in df.columns if c not in (eff_col, risk_col)],
        rn(F.col(eff_col), 2).alias("predicted_efficiency"),
        F.col(risk_col).cast("int").alias("critical_risk"),
        F.col("Operating_Action").alias("recommended_action"),
        (F.lit(as_of) if as_of else F.current_timestamp()).cast("timestamp_ntz").alias("last_updated"),
    )
