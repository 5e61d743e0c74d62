"""Line deduplication by sorted streams, returning keep bitmaps (operator 7).

Lines become ``(hash, document, position)`` without their text.  The hashes
are range-partitioned together with the document, so that a line that every
document holds is spread over many partitions, and sorted within the partition
by hash, largest document first and position.  One pass over this stream finds
the lines to drop.  Only the first and last key of a partition can continue in
another one; their rows are settled by an aggregate over at most two keys a
partition.  Per document, the dropped positions become a zlib-packed bitmap of
the lines to keep, which is all that goes back to the texts: broadcast if counted
small, else joined with the texts that a Bloom filter takes for having one.

A key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  Keys of
at least ``min_chars`` code points in at least ``min_docs`` documents lose all
their lines but those in the largest document.

Defined cases: a null or empty text is one empty line and loses nothing; lines
repeated within one document count it once and share its fate; rows that
repeat an id count as one document (each keeps its own bitmap, by the hash of
its text); a null id is one document, smaller than all others; a very long
text gives as many rows as lines, a very long line one hash; an empty table
gives an empty result; other columns stay (names used inside start with
``_l_``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from hydrolake.llm import bloom
from hydrolake.llm import text as T
from hydrolake.llm.common import row_hash, stored, table

MIN_CHARS, MIN_DOCS = 20, 3
#: up to so many bitmaps of so many bytes in all, both counted, are broadcast
BITMAPS, BITMAP_BYTES = 200_000, 8 << 20
NULL_ID = -(1 << 63)

_KEYED = "d long, t long, h long, g int, p int"


def _keys(min_chars: int):
    def run(rest: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, valid: np.ndarray):
        # lines as byte spans: a text has one more than it has line feeds
        ends = np.sort(np.r_[np.flatnonzero(data == 10), offs[1:]], kind="stable")
        # a line feed belongs to its text; the end of a text sorts after its own line feeds
        feeds = T.owner(np.flatnonzero(data == 10), offs)
        doc = np.sort(np.r_[feeds, np.arange(len(offs) - 1)], kind="stable")
        start = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        start = np.where(first, offs[:-1][doc], start)
        pos = T.ranks(doc)
        # strip: first and last byte that is not white space
        solid = np.flatnonzero(T.NOT_SPACE[data])
        if not len(solid):
            return None
        a = np.searchsorted(solid, start)
        b = np.searchsorted(solid, ends)
        ok = b > a
        a, b, doc, pos = a[ok], b[ok], doc[ok], pos[ok]
        lo, hi = solid[a], solid[b - 1] + 1
        points = np.zeros(len(data) + 1, np.int64)  # code points before each byte
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        ok = points[hi] - points[lo] >= min_chars
        lo, hi, doc, pos = lo[ok], hi[ok], doc[ok], pos[ok]
        if not len(lo):
            return None
        low = T.LOWERED[data]
        h, g = T.span_hash(low, lo, hi), T.span_hash(low, lo, hi, seed=7)
        take = pa.array(doc)
        return {"d": rest.column(0).take(take), "t": rest.column(1).take(take), "h": h.view(np.int64),
                "g": (g >> np.uint64(32)).astype(np.uint32).view(np.int32), "p": pos.astype(np.int32)}
    return run


def _stream(min_docs: int):
    """Finds the rows to drop in a stream sorted by (h, g, d descending, t, p)."""
    names = ["h", "g", "d", "t", "p", "settled"]

    def batch(h, g, d, t, p, settled):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g, d, t, p)] + [pa.array(np.full(len(h), settled))], names=names)

    def run(batches):
        held = open_key = None  # rows of the last key; the key whose rows are passed on unsettled
        started = False
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            if not len(cols[0]):
                continue
            if not started:
                started, open_key = True, (cols[0][0], cols[1][0])
            if open_key is not None:
                same = (cols[0] == open_key[0]) & (cols[1] == open_key[1])
                k = len(same) if same.all() else int(np.argmin(same))
                if k:
                    yield batch(*[x[:k] for x in cols], False)
                if k == len(same):
                    continue
                cols, open_key = [x[k:] for x in cols], None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h, g, d, t, p = cols
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            begin = np.flatnonzero(new)
            key = np.cumsum(new) - 1
            other = new | np.r_[True, d[1:] != d[:-1]]
            rank = np.cumsum(other) - 1
            rank -= rank[begin][key]
            total = rank[np.r_[begin[1:], len(h)] - 1] + 1
            many = total >= min_docs
            # the last key may go on; what it has shown so far is enough once it is in min_docs documents
            drop = (rank > 0) & many[key]
            if drop.any():
                yield batch(h[drop], g[drop], d[drop], t[drop], p[drop], True)
            last = slice(begin[-1], None)
            if many[-1]:  # a row of each of its first documents stands for it
                rep = begin[-1] + np.flatnonzero(other[last] & (rank[last] < min_docs))
                held = [x[rep] for x in cols]
            else:
                held = [x[last] for x in cols]
        if held is not None:
            # it may go on in the next partition, which takes these rows into account
            yield batch(*held, False)

    return run


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
          min_docs: int = MIN_DOCS) -> DataFrame:
    """The lines to drop: ``(_l_d, _l_t, p)``: id (null as the smallest long), hash of the text, position."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), row_hash(text_col).alias("t"),
                       F.col(text_col).alias("x"))
    keyed = stored(T.text_udf(rows, "x", ["d", "t"], _KEYED, _keys(min_chars)), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h"), F.col("g"), F.col("d").desc()]
    sorted_ = keyed.select("h", "g", "d", "t", "p").repartitionByRange(parts, *order).sortWithinPartitions(*order, "t", "p")
    found = stored(sorted_.mapInArrow(_stream(min_docs), "h long, g int, d long, t long, p int, settled boolean"), "drops")
    rest = found.filter("not settled")
    # the last and the first key of each partition, and no others: few enough to broadcast, by construction
    edge = rest.select("h", "g", "d").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("top"))
    edge = stored(edge.filter(F.col("n") >= min_docs), "edges")
    rest = rest.join(F.broadcast(edge), ["h", "g"]).filter("d < top")
    cols = [F.col("d").alias("_l_d"), F.col("t").alias("_l_t"), F.col("p")]
    return found.filter("settled").select(*cols).unionByName(rest.select(*cols))


@F.pandas_udf(BinaryType())
def _pack(dropped: pd.Series, n_lines: pd.Series) -> pd.Series:
    out = []
    for at, n in zip(dropped, n_lines):
        keep = np.ones(-(-int(n) // 8) * 8, bool)  # whole bytes: what lies beyond is kept
        keep[np.asarray(at)] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Per document that loses lines: ``(_l_d, _l_t, _l_n, _l_bits)``, the lines up to the last one dropped."""
    found = drops(docs, id_col, text_col, **limits)
    return (found.distinct().groupBy("_l_d", "_l_t").agg(F.sort_array(F.collect_list("p")).alias("p"))
            .select("_l_d", "_l_t", F.size("p").cast("long").alias("_l_n"), _pack("p", F.array_max("p") + 1).alias("_l_bits")))


@F.pandas_udf(StringType())
def _apply(text: pd.Series, bits: pd.Series) -> pd.Series:
    out = []
    for x, b in zip(text, bits):
        if b is None or x is None:
            out.append(None)
            continue
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8)).astype(bool)
        lines = x.split("\n")
        # lines beyond the bitmap stay
        out.append("\n".join(s for i, s in enumerate(lines) if i >= len(keep) or keep[i]))
    return pd.Series(out, dtype=object)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept_text`` (null only where the text is)."""
    bits = keep_bitmaps(docs, id_col, text_col, **limits)
    bits = stored(bits.withColumn("_l_k", F.xxhash64("_l_d", "_l_t")), "bitmaps")
    left = docs.withColumn("_l_d1", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn("_l_t1", row_hash(text_col))
    same = (F.col("_l_d1") == F.col("_l_d")) & (F.col("_l_t1") == F.col("_l_t"))
    n, size = bits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_l_bits")), F.lit(0))).first()
    if n <= BITMAPS and size <= BITMAP_BYTES:
        out = left.join(F.broadcast(bits.drop("_l_k")), same, "left")
    else:  # texts that lose no line stay where they are
        both = bloom.marked(left.withColumn("_l_k1", F.xxhash64("_l_d1", "_l_t1")), bits.select(F.col("_l_k").alias("_l_k1")), "_l_k1", "_l_may")
        both = both.drop("_l_k1")
        out = both.filter("_l_may").join(bits.drop("_l_k"), same, "left")
        out = out.unionByName(both.filter("not _l_may"), allowMissingColumns=True).drop("_l_may")
    text = F.col(text_col)
    n_lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")
    out = out.withColumn("n_lines", n_lines).withColumn("n_dropped", F.coalesce("_l_n", F.lit(0).cast("long")))
    kept = F.coalesce(_apply(F.when(F.col("_l_bits").isNotNull(), text), F.col("_l_bits")), text)
    return out.withColumn("kept_text", kept).drop("_l_d1", "_l_t1", "_l_d", "_l_t", "_l_n", "_l_bits")


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", digest(F.col("kept_text")).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as their text, and their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = dedup(docs.select(row.alias("_l_row"), F.col("doc_id"), F.col("text")))
    keep = [F.col("kept_text").alias("text") if c == "text" else F.col(f"_l_row.`{c}`") for c in docs.columns]
    return out.select(*keep)


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.p, k.line, r.top IS NOT NULL AND k.doc_id < r.top AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
