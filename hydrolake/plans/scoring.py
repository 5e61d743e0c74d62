"""Score batches of readings end to end.

Each plan is one lazy DataFrame with no shuffle: validation, midpoints,
model scoring, rules, bands and texts are all projections (the isolation
forest adds one ``mapInArrow``).  Model outputs can be
injected as columns instead (``ml_col`` / ``anomaly_col`` / ``eff_col`` /
``risk_col``), which makes the rule layer exactly checkable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.ml import isolation as ISO
from hydrolake.ml import models as M
from hydrolake.ml import scaler as SC
from hydrolake.operators import distribution as D
from hydrolake.operators import quality as Q
from hydrolake.sources import io

QUALITY_OUTPUT = (
    "MC_Code", "Hub_ID", "Final_WQI", "Category", "Emoji_Status", "Anomaly_Status", "Interpretation",
    "Recommended_Action", "ML_WQI", "Rule_WQI", "Hybrid_Model", "Temperature", "pH", "BOD", "Faecal_Coliform",
    "Total_Coliform", "Nitrate_N", "Conductivity", "AI_Summary", "Message",
)

DISTRIBUTION_OUTPUT = (
    "MC_Code", "Hub_ID", "Final_Efficiency", "Performance_Grade", "Status", "Emoji_Status", "Critical_Risk",
    "Deficit_MLD", "PerCapita_LPCD", "Interpretation", "AI_Commentary", "Recommended_Action", "Summary", "Message",
)


def _valid(df: DataFrame, types: dict[str, str], quarantine_path: str | None) -> DataFrame:
    """Valid readings; with a path both halves are kept by one pass over the source, without one rejects are dropped."""
    return io.split_once(df, types, quarantine_path) if quarantine_path else io.split_valid(df, types)[0]


def predict_quality(readings: DataFrame, models: M.QualityModels | None = None, ml_col: str | None = None,
                    anomaly_col: str | None = None, use_raw_for_safety: bool = False,
                    validate: bool = True, keep: tuple[str, ...] = (),
                    quarantine_path: str | None = None) -> DataFrame:
    """S9 → Q1 → (Q11, M1, M5, M4) → Q2–Q4 → Q5 → Q6 → Q8 → Q9 → Q10.

    Returns the scored rows with every field of the prediction response plus
    the columns in ``keep`` and ``Created_At`` when present; rejected readings
    are written to ``quarantine_path`` when given (an action), else dropped.
    """
    df = readings
    if validate:
        df = _valid(df, io.QUALITY_READING_TYPES, quarantine_path)
    df = Q.midpoints(df)
    if models is not None:
        # models read the uncapped midpoints, with the model's Nitrate naming
        df = SC.scaled_features(Q.nitrate_rename(df), models.scaler, prefix="z_")
        df = M.score_wqi(df, models.regressor)
        df = ISO.score_frame(df, models.forest, label_col="anomaly_pred")
        ml_col, anomaly_col = "ml_wqi", "anomaly_pred"
    elif ml_col is None or anomaly_col is None:
        raise ValueError("give models, or inject both ml_col and anomaly_col")
    if use_raw_for_safety:
        df = df.withColumns({f"raw_{c}": F.col(c) for c in ("pH", "BOD", "Faecal_Coliform")})
    df = Q.rule_wqi(Q.cap_params(df))
    df = Q.hybrid_wqi(df, ml_col, "Rule_WQI", "WQI")
    df = Q.categorize5(df)
    df = Q.safety_downgrade(df, use_raw=use_raw_for_safety)
    df = Q.anomaly_label(df, anomaly_col)
    df = Q.quality_text(df, ml_col).withColumnRenamed("WQI", "Final_WQI")
    extra = [c for c in (*keep, "Created_At") if c in df.columns]
    return df.select(*extra, *QUALITY_OUTPUT)


def predict_distribution(readings: DataFrame, eff_model=None, risk_model=None, eff_col: str | None = None,
                         risk_col: str | None = None, validate: bool = True,
                         keep: tuple[str, ...] = (), quarantine_path: str | None = None) -> DataFrame:
    """S9 → D1 → (M6, M7) → D2–D6 → D8 (rejects to ``quarantine_path`` when given)."""
    df = readings
    if validate:
        df = _valid(df, io.DISTRIBUTION_READING_TYPES, quarantine_path)
    if eff_model is not None and risk_model is not None:
        df = D.distribution_features(df).withColumns(
            {"Deficit_MLD": F.col("deficit"), "PerCapita_LPCD": F.col("per_capita")}
        )
        df = M.score_distribution_models(df, eff_model, risk_model).drop("Deficit_MLD", "PerCapita_LPCD",
                                                                         "deficit", "efficiency", "per_capita")
        eff_col, risk_col = "eff_pred", "risk_pred"
    elif eff_col is None or risk_col is None:
        raise ValueError("give both models, or inject both eff_col and risk_col")
    df = D.score_distribution(df, eff_col, risk_col)
    df = df.withColumns(
        {
            "Final_Efficiency": F.col("Predicted_Supply_Efficiency"),
            "Status": F.col("Risk_Label"),
            "Recommended_Action": F.col("Advice"),
        }
    )
    extra = [c for c in (*keep, "Created_At", "Total_Demand_MLD", "Current_Supply_MLD", "Population",
                         "Predicted_Supply_Efficiency", "Advice") if c in df.columns]
    return df.select(*dict.fromkeys([*extra, *DISTRIBUTION_OUTPUT]))


def quality_records_from_predictions(pred: DataFrame) -> DataFrame:
    """Prediction rows → the quality-record layout (for S3)."""
    return pred.withColumnRenamed("Final_WQI", "WQI")


__all__ = ["predict_quality", "predict_distribution", "quality_records_from_predictions", "K"]
