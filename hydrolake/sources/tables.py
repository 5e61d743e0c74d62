"""Readers for the driver's parquet tables.

Only ``spark.read.parquet``: column pruning and filter pushdown reach the
scan because every consumer selects what it needs before an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Key used to spread a fact table when its files cannot be split (see below).
SPREAD_KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "events": ("event_id",)}
SPREAD_CONF = "hydrolake.input.minPartitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; optionally spread over ``hydrolake.input.minPartitions`` tasks.

    A parquet file is split at row-group boundaries only, so a fact table
    written as one row group is scanned by one task.  When the session sets
    ``hydrolake.input.minPartitions`` (a local run over such files), fact
    tables are hash-repartitioned on their key right after the scan —
    deterministic under task retries, and filters and column pruning still
    reach the scan.  Leave it unset where the input is already split into
    many files (the cluster case): then this is a plain scan.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    n = int(spark.conf.get(SPREAD_CONF, "0") or 0)
    if n > 1 and name in SPREAD_KEYS:
        df = df.repartition(n, *SPREAD_KEYS[name])
    return df
