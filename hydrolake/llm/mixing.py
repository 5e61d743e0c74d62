"""Mixing sources to target weights by hash thresholds (operator 1).

Every document has a fixed 60-bit hash.  Sizes are summed by source and hash
bucket; along the buckets, the one in which a source's running sum reaches its
budget is the boundary.  Only the boundary bucket is split further, 12 bits at
a time, until it holds a single hash.  The mix is then a filter on the hash: no
sort, and a larger budget always keeps what a smaller one took.

A target above a source's size takes the whole source one or more times and
spends the rest of the budget on the threshold.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, ordered last; documents with a null id are hashed by their
text; rows that repeat an id share its hash, so they are taken together, as are
documents whose hashes tie at the threshold; a very long text counts whole; an
empty table gives an empty mix; other input columns stay (names used inside
start with ``_m_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydrolake.llm.common import join_small, stored, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
HASH_BITS, STEP_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits of the MD5 of the id (of the text where the id is null), as a long."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.col(text_col)), F.lit("null"))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame, col: str) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last, without one task for all sources.

    The sources are range-partitioned and sorted; a rank is the place within
    the partition plus the sizes of the partitions before it.
    """
    order = F.col(col).asc_nulls_last()
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(sources.repartitionByRange(parts, order).sortWithinPartitions(order)
                    .withColumn("_m_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_m_at", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())  # a row a partition
    before, seen = [], 0
    for p, n in sizes:
        before.append((p, seen))
        seen += n
    if not before:
        return placed.withColumn("rank", F.lit(0).cast("long")).drop("_m_at")
    starts = sources.sparkSession.createDataFrame(before, "_m_p long, _m_start long")
    return (placed.join(F.broadcast(starts), part == F.col("_m_p"))
            .withColumn("rank", F.col("_m_start") + F.col("_m_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_m_at", "_m_p", "_m_start"))


def targets(sources: DataFrame, col: str = "source", size: str = "source_size", weights=WEIGHTS,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target``: shares of the total size by weight, none above ``max_repeats`` times its source.

    What is above is shared again by weight among the other sources until none
    is above; each round is one aggregate of the source table to one row.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = stored(ranked(sources, col).withColumn("_m_w", weight).withColumn("_m_cap", max_repeats * F.col(size)), "weights")
    share, n_capped = None, -1
    while True:
        capped = F.col("_m_cap") < F.lit(share) * F.col("_m_w") if share is not None else F.lit(False)
        r = src.agg(F.sum(size).alias("total"), F.sum(F.when(capped, F.col("_m_cap")).otherwise(0)).alias("held"),
                    F.sum(F.when(capped, 0).otherwise(F.col("_m_w"))).alias("w"),
                    F.sum(capped.cast("int")).alias("n")).first()
        if (r["n"] or 0) == n_capped or not r["w"]:
            break
        n_capped = r["n"]
        share = (r["total"] - r["held"]) / r["w"]
    target = F.when(capped, F.col("_m_cap").cast("double")).otherwise(F.lit(float(share or 0.0)) * F.col("_m_w"))
    return src.withColumn("target", target).drop("_m_w", "_m_cap", "rank")


def thresholds(keyed: DataFrame, src: DataFrame, n_src: int) -> DataFrame:
    """By source, ``_m_cut``: documents with a hash below it are taken once more."""
    edge = src.select("source", "_m_rest", F.lit(0).cast("long").alias("_m_prefix"), F.lit(0).cast("long").alias("_m_below"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = join_small(keyed, edge, ["source"], n_src, F.col("_m_h")).filter(
            F.shiftright("_m_h", shift + STEP_BITS) == F.col("_m_prefix"))
        hist = inside.groupBy("source", "_m_rest", "_m_below", F.shiftright("_m_h", shift).alias("_m_prefix")).agg(
            F.sum("size").alias("_m_s"), F.min("_m_h").alias("_m_lo"), F.max("_m_h").alias("_m_hi"))
        # at most 2^12 buckets a source
        upto = F.sum("_m_s").over(W.partitionBy("source").orderBy("_m_prefix").rowsBetween(W.unboundedPreceding, 0))
        last = F.max("_m_prefix").over(W.partitionBy("source"))
        over = (hist.withColumn("_m_upto", F.col("_m_below") + upto).withColumn("_m_last", last)
                .filter((F.col("_m_upto") >= F.col("_m_rest")) | (F.col("_m_prefix") == F.col("_m_last"))))
        edge = stored(over.groupBy("source", "_m_rest").agg(
            F.min(F.struct("_m_prefix", "_m_upto", "_m_s", "_m_lo", "_m_hi")).alias("e")).select(
            "source", "_m_rest", "e._m_prefix", (F.col("e._m_upto") - F.col("e._m_s")).alias("_m_below"),
            F.col("e._m_s").alias("_m_s"), F.col("e._m_lo").alias("_m_lo"), F.col("e._m_hi").alias("_m_hi")), "edge")
        if not edge.filter("_m_lo < _m_hi").limit(1).count():
            break
    # the single hash at the edge is taken if the sum comes nearer to the budget so
    nearer = F.col("_m_below") + F.col("_m_s") - F.col("_m_rest") <= F.col("_m_rest") - F.col("_m_below")
    return edge.select("source", F.when(nearer, F.col("_m_lo") + 1).otherwise(F.col("_m_lo")).alias("_m_cut"))


def budgets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
            max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame, int]:
    """``(keyed, sources, their number)``: documents by size and hash, and by source what the mix takes."""
    keyed = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                               n_words(F.col(text_col)).alias("size"), document_hash(id_col, text_col).alias("_m_h")), "keyed")
    sources = stored(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    src = targets(sources, weights=weights, max_repeats=max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    src = stored(src.withColumn("_m_times", whole).withColumn(
        "_m_rest", F.col("target") - F.col("_m_times") * F.col("source_size")), "budgets")
    n_src = src.count()
    src = src.join(thresholds(keyed, src.filter("_m_rest > 0").select("source", "_m_rest"), n_src)
                   .withColumnRenamed("source", "_m_k"), F.col("source").eqNullSafe(F.col("_m_k")), "left").drop("_m_k")
    return keyed, stored(src.select("source", "source_size", "target", "_m_times", "_m_cut"), "cuts"), n_src


def _times() -> Column:
    return F.col("_m_times") + F.coalesce((F.col("_m_h") < F.col("_m_cut")).cast("long"), F.lit(0).cast("long"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: id, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``times``."""
    keyed, src, n_src = budgets(docs, **kw)
    out = join_small(keyed, src, ["source"], n_src, F.col("_m_h"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"),
                      _times().alias("times"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size``, ``source_size``, ``target``, ``taken`` and ``times`` (1 or more).

    The thresholds are applied to the texts where they are: nothing but the
    table of sources is joined.
    """
    _, src, n_src = budgets(docs)
    new = ("size", "source_size", "target", "taken", "times")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], n_words(F.col("text")).alias("size"),
                       document_hash().alias("_m_h"))
    out = join_small(rows, src, ["source"], n_src, F.col("_m_h")).withColumn("times", _times()).filter("times > 0")
    return out.withColumn("taken", F.col("size") * F.col("times")).drop("_m_h", "_m_times", "_m_cut")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


#: the same mix by a sort along the hash
OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         substr(md5(coalesce(cast(doc_id AS VARCHAR), 'text:' || text, 'null')), 1, 15) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
rounds AS (
  SELECT 0 AS i, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS share
  UNION ALL
  SELECT i + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size < share * w), 0))::DOUBLE
                 / sum(w) FILTER (WHERE NOT 3 * source_size < share * w) FROM s)
  FROM rounds WHERE i < 40),
t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size < share * w THEN (3 * source_size)::DOUBLE ELSE share * w END AS target
  FROM s, (SELECT share FROM rounds ORDER BY i DESC LIMIT 1)),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT * source_size AS rest
  FROM t),
c AS (
  SELECT d.*, b.source_size, b.target, b.times, b.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING)::BIGINT AS upto,
         sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS cell
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
       (size * (times + CASE WHEN rest > 0 AND (upto < rest OR upto - cell < rest AND upto - rest <= rest - (upto - cell))
                        THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
