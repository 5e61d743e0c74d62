"""Random-forest models (M2, M5–M7), evaluation (M10), labels (M11), persistence.

Forests are :mod:`hydrolake.ml.forest`'s: grown to purity, as the original's,
and kept as a table of node arrays.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.ml import forest as FO
from hydrolake.ml import isolation as ISO
from hydrolake.ml import scaler as SC


def complete(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows that a model can learn from: no feature and no label is null or NaN."""
    return df.dropna(subset=[*features, label])


# M2 -------------------------------------------------------------------------
def train_wqi_regressor(df: DataFrame, features: Sequence[str], label: str = "WQI", num_trees: int = K.N_TREES,
                        max_depth: int | None = None, seed: int = K.SEED,
                        key: Sequence[str] | None = None, bootstrap: bool = True) -> FO.ForestModel:
    """Random forest on all features per split (bootstrap rows), seeded, of unlimited depth by default."""
    return FO.fit_forest(complete(df, features, label), features, label, num_trees, seed, key=key, max_depth=max_depth,
                         bootstrap=bootstrap)


# M5 -------------------------------------------------------------------------
def score_wqi(df: DataFrame, model: FO.ForestModel) -> DataFrame:
    """Adds ``ml_wqi``; a row with a null or NaN feature is scored (as NaN), never skipped."""
    return FO.score_forest(df, model, "ml_wqi")


# M6 -------------------------------------------------------------------------
def efficiency_target(df: DataFrame) -> DataFrame:
    """Our choice of training target (the original ships no training data for it): supply/demand·100."""
    return df.withColumn("efficiency_target",
                         F.try_divide(F.col("Current_Supply_MLD"), F.col("Total_Demand_MLD")) * F.lit(100.0))


def train_efficiency_model(df: DataFrame, num_trees: int = K.N_TREES, max_depth: int | None = None,
                           seed: int = K.SEED, target: str = "efficiency_target",
                           key: Sequence[str] | None = None) -> FO.ForestModel:
    if target not in df.columns:
        df = efficiency_target(df)
    df = complete(df, K.DIST_FEATURES, target)
    return FO.fit_forest(df, K.DIST_FEATURES, target, num_trees, seed, key=key, max_depth=max_depth)


# M7 -------------------------------------------------------------------------
def criticality_label(df: DataFrame, cut: float = K.PUMPING_CUT) -> DataFrame:
    """Our choice of label: supply below ``cut`` % of demand is critical (1)."""
    ratio = F.try_divide(F.col("Current_Supply_MLD"), F.col("Total_Demand_MLD")) * F.lit(100.0)
    return df.withColumn("risk_label", F.when(ratio < F.lit(cut), F.lit(1.0)).otherwise(F.lit(0.0)))


def train_criticality_model(df: DataFrame, num_trees: int = K.N_TREES, max_depth: int | None = None,
                            seed: int = K.SEED, cut: float = K.PUMPING_CUT, label: str = "risk_label",
                            key: Sequence[str] | None = None, bootstrap: bool = True) -> FO.ForestModel:
    """A classifier: ⌊√5⌋ features are tried per split, and the trees' class shares are averaged."""
    if label not in df.columns:
        df = criticality_label(df, cut)
    df = complete(df, K.DIST_FEATURES, label)
    return FO.fit_forest(df, K.DIST_FEATURES, label, num_trees, seed, key=key, max_depth=max_depth,
                         tries=math.isqrt(len(K.DIST_FEATURES)), classes=True, bootstrap=bootstrap)


def score_efficiency(df: DataFrame, model: FO.ForestModel) -> DataFrame:
    """Adds ``eff_pred``."""
    return FO.score_forest(df, model, "eff_pred")


def score_criticality(df: DataFrame, model: FO.ForestModel) -> DataFrame:
    """Adds ``risk_pred`` (0/1)."""
    return FO.score_forest(df, model, "risk_pred")


def score_distribution_models(df: DataFrame, eff_model: FO.ForestModel, risk_model: FO.ForestModel) -> DataFrame:
    """Adds ``eff_pred`` (double) and ``risk_pred`` (0/1 int) from the two forests."""
    return score_criticality(score_efficiency(df, eff_model), risk_model)


# M10 ------------------------------------------------------------------------
def regression_eval(df: DataFrame, label: str = "WQI", pred: str = "ml_wqi") -> DataFrame:
    """R² = 1 − Σe²/Σ(y−ȳ)² and MAE: one pass for ȳ (a single number), one for the sums."""
    mean_y = F.lit(df.agg(F.avg(label)).first()[0]).cast("double")
    e = F.col(label) - F.col(pred)
    return df.agg(
        (F.lit(1.0) - F.sum(e * e) / F.sum((F.col(label) - mean_y) * (F.col(label) - mean_y))).alias("R2"),
        F.avg(F.abs(e)).alias("MAE"),
        F.count(F.lit(1)).alias("N"),
    )


# M11 ------------------------------------------------------------------------
def anomaly_target(df: DataFrame, status_col: str = "Anomaly_Status", out: str = "anomaly_target") -> DataFrame:
    """'Anomaly Detected' → −1, anything else → 1."""
    return df.withColumn(out, F.when(F.col(status_col) == F.lit(K.ANOMALY), F.lit(-1)).otherwise(F.lit(1)))


# S7 -------------------------------------------------------------------------
@dataclass
class QualityModels:
    scaler: dict[str, tuple[float, float]]
    regressor: FO.ForestModel
    forest: ISO.IsolationForestModel
    features: list[str] = field(default_factory=lambda: list(K.ML_FEATURES))


def version_stamp(now: _dt.datetime | None = None) -> str:
    return (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M")


def save_models(spark: SparkSession, models: QualityModels, path: str, version: str | None = None) -> str:
    """Save scaler, regressor and forest; also version-stamped copies of the two models."""
    base = path.rstrip("/")
    SC.stats_to_frame(spark, models.scaler).write.mode("overwrite").parquet(f"{base}/wqi_scaler")
    FO.save(spark, models.regressor, f"{base}/wqi_regressor")
    ISO.save_forest(spark, models.forest, f"{base}/isolation_forest")
    if version:
        FO.save(spark, models.regressor, f"{base}/wqi_regressor_{version}")
        ISO.save_forest(spark, models.forest, f"{base}/isolation_forest_{version}")
    return base


def load_models(spark: SparkSession, path: str) -> QualityModels:
    base = path.rstrip("/")
    scaler = SC.stats_from_frame(spark.read.parquet(f"{base}/wqi_scaler"))
    return QualityModels(scaler, FO.load(spark, f"{base}/wqi_regressor"),
                         ISO.load_forest(spark, f"{base}/isolation_forest"), list(scaler))
