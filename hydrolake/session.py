"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; these helpers only fill
in what is unset.  ``spark.checkpoint.dir`` names the shared folder where
lineage is cut and where job outputs land; we never invent a machine-local
folder when the cluster already names one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution (runtime coalescing,
# runtime broadcast of sides measured small, skew-join splitting), UTC, and
# Arrow for the few pandas-backed operators.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of a collected DataFrame are removed by Spark itself,
    # so the shared folder does not grow with every job
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Runtime SQL settings applied to any session (the cluster's too) unless the
# operator already chose a value.  HotSpot does not JIT-compile methods over
# 8000 bytes of bytecode; the scoring rules inline into large generated
# methods (a filter on a derived score gets no common-subexpression
# elimination), so whole-stage codegen should fall back at the size the JIT
# will still compile rather than at the 64 KB class-file limit.
RUNTIME_CONF = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", "8000"),
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "hydrolake") -> SparkSession:
    """A local session for tests and the bench (the cluster supplies its own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("HYDROLAKE_DRIVER_MEMORY", "16g"))
        # local mode runs tasks in the driver JVM: let HotSpot compile the large
        # generated methods instead of falling back (see RUNTIME_CONF)
        .config("spark.driver.extraJavaOptions", JIT_FLAG)
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "hydrolake-warehouse"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


JIT_FLAG = "-XX:-DontCompileHugeMethods"


def tune_session(spark: SparkSession) -> None:
    """Apply :data:`RUNTIME_CONF` where the session still has Spark's default.

    When the JVMs already compile huge methods (``-XX:-DontCompileHugeMethods``
    in the driver or executor options), the codegen limit is left alone.
    """
    opts = " ".join(spark.conf.get(k, "") or "" for k in ("spark.driver.extraJavaOptions",
                                                         "spark.executor.extraJavaOptions"))
    if JIT_FLAG in opts:
        return
    for key, (default, value) in RUNTIME_CONF.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset.

    ``spark.checkpoint.dir`` is read from the session; only when it is absent
    (tests, a laptop) do we create a scratch folder for it.  A cluster must name
    it: a folder of the driver's machine would be of no use to executors.
    """
    tune_session(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="hydrolake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
