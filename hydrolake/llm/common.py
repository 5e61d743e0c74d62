"""Shared helpers: stored tables, small-side joins, tie-safe row keys, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.session import scratch_path

#: a joined side of at most so many (counted) narrow rows is broadcast
BROADCAST_ROWS = 20_000

#: ASCII white space, ``[\x20\x09-\x0D]``
WS = " \t\n\x0b\f\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage with compressed, columnar files that every executor
    can read again after a loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_hash(text_col: str = "text") -> Column:
    """A hash of the text: together with the id it names a row even if ids repeat."""
    return F.xxhash64(F.col(text_col))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may inline a projected column into a lambda, where it would be
    computed once per array element; a lambda variable is never inlined.
    """
    return F.transform(F.array(value), body)[0]


def join_small(big: DataFrame, small: DataFrame, on: list[str], n_small: int, salt: Column, how: str = "inner",
               salts: int = 32) -> DataFrame:
    """Null-safe join of a large side with a keyed, distinct small one.

    Up to :data:`BROADCAST_ROWS` counted rows the small side is broadcast.
    Beyond that, it is repeated under ``salts`` salts and the large side deals
    each key over them, so that a key holding a third of the rows is split.
    """
    left, right = big, small
    for c in on:
        right = right.withColumnRenamed(c, f"_k_{c}")
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        cond = eq if cond is None else cond & eq
    if n_small <= BROADCAST_ROWS:
        out = left.join(F.broadcast(right), cond, how)
    else:
        left = left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
        right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = left.join(right, cond & (F.col("_salt") == F.col("_salt_r")), how).drop("_salt", "_salt_r")
    return out.drop(*[f"_k_{c}" for c in on])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components of an undirected edge list: rows ``(id, component)``.

    ``component`` is the smallest id of the component; only ids with an edge
    appear.  Alternating large-star and small-star steps (Kiveris et al.,
    2014): every step is an aggregate and a join on the edge table, whose size
    never grows, so that no group is gathered and the number of rounds is
    logarithmic in practice.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    e = stored(e, "cc")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.filter("u <> v").distinct()
        # small star: every smaller neighbour and u itself go to u's smallest neighbour
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        e = (big.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
             .select("p.u", "p.v").filter("u <> v").distinct())
        e = stored(e, "cc")
        # the table is a forest of stars once it stops changing
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")),
                          F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
