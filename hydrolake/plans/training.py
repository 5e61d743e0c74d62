"""Build the training set, fit the quality models, persist them.

A scheduled batch job over a snapshot of the records — never per reading.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake import constants as K
from hydrolake.ml import isolation as ISO
from hydrolake.ml import models as M
from hydrolake.ml import scaler as SC
from hydrolake.operators import clean as C
from hydrolake.operators import filters as FL
from hydrolake.session import ensure_checkpoint_dir
from hydrolake.sources import io

ESSENTIAL = (*K.ML_FEATURES, "WQI", "Anomaly_Status")
NUMERIC = (*K.ML_FEATURES, "WQI")


# M8 -------------------------------------------------------------------------
def training_set(records: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """F5 + C1 on the essential columns, numeric cast, C1 again; ``key`` columns come along."""
    df = FL.temperature_not_null(records).select(*ESSENTIAL, *key)
    df = C.drop_nulls_subset(df, ESSENTIAL)
    df = C.to_numeric_coerce(df, NUMERIC)
    return C.drop_nulls_subset(df, NUMERIC)


@dataclass
class TrainingResult:
    models: M.QualityModels
    evaluation: DataFrame
    path: str | None


# P3 -------------------------------------------------------------------------
def train_models(spark: SparkSession, training: DataFrame, path: str | None = None, num_trees: int = K.N_TREES,
                 forest_trees: int = K.N_TREES, max_depth: int | None = None, seed: int = K.SEED,
                 version: str | None = None, checkpoint: bool = True, key: Sequence[str] = ()) -> TrainingResult:
    """S6/M8 → M1 → M2 → M3 → S7 → M10.

    ``training`` is either the training table (features + ``Rule_WQI``) or
    records with ``WQI``.  The cleaned set is checkpointed to the shared
    checkpoint folder so the several passes (stats, forest levels, isolation
    sampling, evaluation) do not recompute the scan and a lost executor does
    not replay the whole lineage.  ``key`` names the columns that tell records
    apart; without it the bootstrap goes by a hash of the whole training row.
    """
    if "Rule_WQI" in training.columns and "WQI" not in training.columns:
        training = io.scan_training(training)
    ts = training_set(training, key)
    if checkpoint:
        ensure_checkpoint_dir(spark)
        # one pass over the records: the stats, the fits and the evaluation all
        # read the stored, cleaned rows (scaling is a projection on top)
        ts = ts.checkpoint(eager=True)
    stats = SC.fit_scaler(ts, K.ML_FEATURES)
    scaled = SC.scaled_features(ts, stats, prefix="z_")
    zf = [f"z_{f}" for f in K.ML_FEATURES]
    reg = M.train_wqi_regressor(scaled, zf, "WQI", num_trees, max_depth, seed, key=key)
    forest = ISO.fit_isolation_forest(scaled, zf, n_trees=forest_trees, seed=seed, key=key)
    models = M.QualityModels(stats, reg, forest)
    if path:
        M.save_models(spark, models, path, version)
    ev = M.regression_eval(M.score_wqi(scaled, reg), "WQI", "ml_wqi")
    return TrainingResult(models, ev, path)


# M9 -------------------------------------------------------------------------
def retrain(spark: SparkSession, records_path: str, models_path: str, num_trees: int = K.N_TREES,
            forest_trees: int = K.N_TREES, max_depth: int | None = None, seed: int = K.SEED,
            key: Sequence[str] = ()) -> tuple[TrainingResult, str]:
    """Full refit on all stored records, then flag every one of them as used.

    The target is the stored (hybrid) WQI, as in the original.  The committed
    batches are listed once, for the fit and for the flag: a record that
    arrives meanwhile is neither learnt nor flagged nor lost.  The flag is set
    on all listed rows with flag 0, including rows the fit dropped.  Returns
    the result and the batch that now stands for the listed ones.
    """
    batches = io.live_batches(spark, records_path)
    records = io.read_records(spark, records_path, batches)
    result = train_models(spark, records, models_path, num_trees, forest_trees, max_depth, seed, key=key)
    return result, io.mark_used_in_place(spark, records_path, batches)


def training_summary(result: TrainingResult) -> DataFrame:
    """Evaluation plus model facts as one row."""
    m = result.models
    return result.evaluation.withColumns(
        {
            "Regression_Nodes": F.lit(int(m.regressor.n_nodes)),
            "Forest_Trees": F.lit(int(m.forest.nodes["tree_id"].nunique())),
            "Forest_Sample": F.lit(int(m.forest.psi)),
            "Anomaly_Cut": F.lit(float(m.forest.cut)),
        }
    )
