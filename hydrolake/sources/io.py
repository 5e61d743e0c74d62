"""Sources and sinks.

Record tables are parquet directories partitioned by ``MC_Code`` so that
every per-tenant report prunes to its partition.  Appends are idempotent
per batch: a batch writes into its own ``batch_id=…`` sub-folder with
overwrite, so a replayed batch (after an executor or driver loss) replaces
its own output instead of duplicating it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.session import scratch_path

# S1 ---------------------------------------------------------------------------
MUNICIPAL_CSV_SCHEMA = T.StructType(
    [
        T.StructField("MC_Code", T.StringType()),
        T.StructField("MC_Name", T.StringType()),
        T.StructField("Population", T.LongType()),
        T.StructField("Total_Demand_MLD", T.DoubleType()),
        T.StructField("Current_Supply_MLD", T.DoubleType()),
    ]
)


def read_municipal_csv(spark: SparkSession, path: str, schema: T.StructType = MUNICIPAL_CSV_SCHEMA) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_municipal_csv(df: DataFrame, path: str) -> str:
    df.select(*[f.name for f in MUNICIPAL_CSV_SCHEMA.fields]).write.mode("overwrite").option("header", True).csv(path)
    return path


# S2 ---------------------------------------------------------------------------
def scan_table_params(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL text with named bind parameters (``:mc_code``), never string-spliced."""
    return spark.sql(sql, args=params)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int = 64) -> DataFrame:
    """A table of an operational SQL database as a DataFrame (the connector form of S2).

    With ``partition_column`` and bounds, Spark issues ``num_partitions``
    range queries in parallel instead of one single-connection scan; filters
    and column selections on the result are pushed into the SQL it sends.
    Not exercised by the tests: it needs a database server.
    """
    props = dict(properties or {})
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound, upperBound=upper_bound,
                           numPartitions=num_partitions, properties=props)


# S3 / S4 -----------------------------------------------------------------------
QUALITY_RECORD_COLUMNS = (
    "MC_Code", "Hub_ID", "Temperature", "pH", "BOD", "Faecal_Coliform", "Total_Coliform", "Nitrate",
    "Conductivity", "WQI", "Category", "Anomaly_Status", "Created_At", "Used_For_Training",
)

DISTRIBUTION_RECORD_COLUMNS = (
    "MC_Code", "Hub_ID", "Total_Demand_MLD", "Current_Supply_MLD", "Population", "Deficit_MLD", "PerCapita_LPCD",
    "Predicted_Supply_Efficiency", "Critical_Risk", "Recommended_Action", "Created_At",
)


def quality_record_frame(scored: DataFrame, created_at: str | None = None) -> DataFrame:
    """Scored quality readings → the stored record layout.

    Stored parameters are the capped midpoints (``Nitrate`` ← ``Nitrate_N``);
    the timestamp keeps whole seconds; ``Used_For_Training`` starts at 0.
    """
    ts = F.lit(created_at).cast("timestamp_ntz") if created_at else F.col("Created_At")
    return scored.select(
        "MC_Code", "Hub_ID", "Temperature", "pH", "BOD", "Faecal_Coliform", "Total_Coliform",
        F.col("Nitrate_N").alias("Nitrate"), "Conductivity", "WQI", "Category", "Anomaly_Status",
        F.date_trunc("second", ts).cast("timestamp_ntz").alias("Created_At"),
        F.lit(0).alias("Used_For_Training"),
    )


def distribution_record_frame(scored: DataFrame, created_at: str | None = None) -> DataFrame:
    """Scored distribution readings → stored layout (risk as 0/1, final advice text)."""
    ts = F.lit(created_at).cast("timestamp_ntz") if created_at else F.col("Created_At")
    return scored.select(
        "MC_Code", "Hub_ID", "Total_Demand_MLD", "Current_Supply_MLD", F.col("Population").cast("long"),
        "Deficit_MLD", "PerCapita_LPCD", "Predicted_Supply_Efficiency",
        F.col("Critical_Risk").cast("int").alias("Critical_Risk"),
        F.col("Advice").alias("Recommended_Action"),
        F.date_trunc("second", ts).cast("timestamp_ntz").alias("Created_At"),
    )


def append_records(df: DataFrame, path: str, batch_id: str | int | None = None) -> str:
    """Append to a parquet table partitioned by ``MC_Code``.

    Every append has a folder of its own, named by ``batch_id`` (overwritten on
    replay) or, without one, by a fresh id.  Rows are gathered by municipality
    before the write, so that a batch makes few files; a busy municipality is
    split by size.
    """
    name = f"append-{uuid.uuid4().hex}" if batch_id is None else batch_id
    target = f"{path.rstrip('/')}/batch_id={name}"
    df.hint("rebalance", "MC_Code").write.mode("overwrite").partitionBy("MC_Code").parquet(target)
    return path if batch_id is None else target


def append_quality(scored: DataFrame, path: str, batch_id=None, created_at: str | None = None) -> str:
    """S3."""
    return append_records(quality_record_frame(scored, created_at), path, batch_id)


def append_distribution(scored: DataFrame, path: str, batch_id=None, created_at: str | None = None) -> str:
    """S4."""
    return append_records(distribution_record_frame(scored, created_at), path, batch_id)


def read_records(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame:
    """All records of a table; municipality codes stay text (``007``), whatever they look like.

    A table of appends is read batch by batch: those whose write committed and
    that no snapshot has replaced (:func:`live_batches`), or the given ones.
    The files are listed here, once: the DataFrame never sees a later append.
    """
    batches = live_batches(spark, path) if batches is None else batches
    if batches is not None and not batches:
        raise ValueError(f"{path} has no committed batch")
    paths = [path] if batches is None else [f"{path.rstrip('/')}/batch_id={b}" for b in batches]
    found = spark.read.option("basePath", path).parquet(*paths).schema
    text = {"MC_Code", "batch_id"}
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType, f.nullable) for f in found])
    return spark.read.schema(schema).option("basePath", path).parquet(*paths).drop("batch_id")


# The record table's pointer: which batches a snapshot has replaced.  Spark skips
# names that start with an underscore.
POINTER = "_replaced.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replaced_batches(spark: SparkSession, path: str) -> list[str]:
    """The batches that a snapshot stands for (none for a table without a pointer)."""
    jvm, p, fs = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def live_batches(spark: SparkSession, path: str) -> list[str] | None:
    """Committed batches of a table that no snapshot has replaced; None for a table without batch folders."""
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    gone = set(replaced_batches(spark, path))
    found = [s.getPath().getName()[len("batch_id="):] for s in fs.listStatus(p)
             if s.isDirectory() and s.getPath().getName().startswith("batch_id=")]
    if not found:
        return None
    done = [b for b in found if b not in gone and fs.exists(jvm.org.apache.hadoop.fs.Path(p, f"batch_id={b}/_SUCCESS"))]
    return sorted(done)


def replace_batches(spark: SparkSession, path: str, old: list[str], new: str) -> None:
    """Swap: from now on readers take batch ``new`` in place of ``old``.

    ``new`` is written (and so committed) before, but listed as replaced until
    the pointer changes; the pointer changes by one rename, so a reader sees
    all of the old batches or the new one.  Batches that arrived meanwhile are
    neither.  One writer swaps at a time: a pointer that names one of ``old``
    already is an error, and the table stays as it was.
    """
    now = replaced_batches(spark, path)
    if set(now) & set(old):
        raise RuntimeError(f"{path}: another snapshot has replaced some of these batches")
    _write_pointer(spark, path, sorted((set(now) | set(old)) - {new}))


def _write_pointer(spark: SparkSession, path: str, batches: list[str]) -> None:
    jvm, p, fs = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(batches).encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    flags = spark.sparkContext._gateway.new_array(option, 1)
    flags[0] = option.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(tmp), fs.makeQualified(p), flags)


# S5 ---------------------------------------------------------------------------
def mark_used_for_training(df: DataFrame) -> DataFrame:
    """Flag 0 → 1 on every record (also those a fit dropped); null stays null."""
    flag = F.col("Used_For_Training")
    return df.withColumn("Used_For_Training", F.when(flag == F.lit(0), F.lit(1)).otherwise(flag))


def mark_used_in_place(spark: SparkSession, path: str, batches: list[str] | None = None) -> str:
    """The update of the flag on a table of appends: the given batches (default: all live ones) become one flagged batch.

    Parquet has no UPDATE: the flagged copy is written as a batch of its own
    and takes the place of exactly the batches it was read from.  Records that
    arrive while it runs keep their flag and are not lost; a failure before the
    swap leaves the table as it was.  Returns the new batch.
    """
    batches = live_batches(spark, path) if batches is None else batches
    if not batches:
        raise ValueError(f"{path} has no committed batch to mark")
    new = f"used-{uuid.uuid4().hex}"
    # hidden until the swap, lest a reader sees a record in both
    _write_pointer(spark, path, sorted({*replaced_batches(spark, path), new}))
    append_records(mark_used_for_training(read_records(spark, path, batches)), path, batch_id=new)
    replace_batches(spark, path, batches, new)
    return new


# S6 ---------------------------------------------------------------------------
TRAINING_FEATURES = ("Temperature", "pH", "BOD", "Faecal_Coliform", "Total_Coliform", "Nitrate", "Conductivity")


def scan_training(training: DataFrame) -> DataFrame:
    """7 features, ``Rule_WQI AS WQI`` and the anomaly status."""
    return training.select(*TRAINING_FEATURES, F.col("Rule_WQI").alias("WQI"), "Anomaly_Status")


# S9 ---------------------------------------------------------------------------
def split_valid(df: DataFrame, schema: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed, all-required check: (valid rows cast to ``schema``, rejected rows as given).

    A value is valid when present and castable to its type; rejected rows go
    to a quarantine sink and never reach scoring.
    """
    casts = {c: f"try_cast(`{c}` AS {t})" for c, t in schema.items()}
    ok_sql = " AND ".join(f"(`{c}` IS NOT NULL AND {casts[c]} IS NOT NULL)" for c in schema)
    flagged = df.withColumn("_valid", F.expr(ok_sql))
    ok = flagged.filter(F.col("_valid")).withColumns({c: F.expr(e) for c, e in casts.items()}).drop("_valid")
    bad = flagged.filter(~F.col("_valid")).drop("_valid")
    return ok, bad


def split_once(df: DataFrame, schema: dict[str, str], quarantine_path: str, batch_id=None) -> DataFrame:
    """S9 in one pass over ``df``: the valid rows, typed; the rejected ones are written to ``quarantine_path``.

    All rows are written once to the shared scratch folder, tagged and
    partitioned by verdict; the two halves are then read from their own
    partitions, so the source is scanned once however it was made, and no row
    can fall between two scans.
    """
    spark = df.sparkSession
    casts = {c: f"try_cast(`{c}` AS {t})" for c, t in schema.items()}
    ok_sql = " AND ".join(f"(`{c}` IS NOT NULL AND {casts[c]} IS NOT NULL)" for c in schema)
    staged = scratch_path(spark, "split")
    tagged = df.withColumn("_valid", F.expr(ok_sql))
    tagged.write.partitionBy("_valid").parquet(staged)
    both = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_valid", T.BooleanType())])).parquet(staged)
    write_quarantine(both.filter("NOT _valid").drop("_valid"), quarantine_path, schema, batch_id)
    return both.filter("_valid").drop("_valid").withColumns({c: F.expr(e) for c, e in casts.items()})


def rejection_reasons(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Rejected rows with ``Rejected_Fields``: the fields missing or not of their type."""
    bad = [F.when(F.expr(f"`{c}` IS NULL OR try_cast(`{c}` AS {t}) IS NULL"), F.lit(c)) for c, t in schema.items()]
    return df.withColumn("Rejected_Fields", F.concat_ws(",", *bad))


def quarantine_frame(rejected: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Rejected rows as received, as text, with the reason."""
    out = rejection_reasons(rejected, schema)
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])


def write_quarantine(rejected: DataFrame, path: str, schema: dict[str, str], batch_id=None) -> str:
    """S9's sink for rejects: the rows as received plus the reason, as text columns.

    With ``batch_id`` a replayed batch overwrites its own folder.
    """
    out = quarantine_frame(rejected, schema)
    target = path if batch_id is None else f"{path.rstrip('/')}/batch_id={batch_id}"
    out.write.mode("append" if batch_id is None else "overwrite").parquet(target)
    return target


QUALITY_READING_TYPES = {
    "MC_Code": "string", "Hub_ID": "string",
    **{f"{p}_{s}": "double" for p in ("Temperature", "pH", "Conductivity", "BOD", "Faecal_Coliform",
                                      "Total_Coliform", "Nitrate_N") for s in ("Min", "Max")},
}
DISTRIBUTION_READING_TYPES = {
    "MC_Code": "string", "Hub_ID": "string", "Total_Demand_MLD": "double", "Current_Supply_MLD": "double",
    "Population": "long",  # an unbounded integer in the reading form
}
