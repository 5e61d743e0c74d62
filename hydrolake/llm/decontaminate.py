"""Benchmark decontamination by winnowing (operator 6).

Of every window of ``window - gram + 1`` consecutive word ``gram``s only the one
with the smallest hash is kept as a fingerprint, so any span of ``window`` words
that a document shares with a benchmark item yields a shared fingerprint.  The
benchmark's fingerprints make a blocked Bloom filter of bounded size; documents
pass on the windows whose fingerprint may be in it.  These are joined with the
benchmark's fingerprints, and a hit is extended to its window: the hash of the
window's words must agree, too.  Runs of matched windows give the hit words.

An item shorter than ``window`` words, but not empty, is one window, found by
the hash of all its words.

Defined cases: a null or empty text has no words and no hits; an empty item
matches nothing; items with equal texts are all reported; rows that repeat an
id are judged by their own texts; a very long text is read whole; of equal
hashes in a window the first is the fingerprint, on both sides alike; an empty benchmark or table gives no hits or
no rows; other columns do not matter (names used inside start with ``_d_``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import bloom
from hydrolake.llm import text as T
from hydrolake.llm.common import row_hash, stored, table

WINDOW, GRAM = 10, 5

_BENCH = "item string, n int, fp long, w long"
_DOC = "d long, t long, n_words long, at array<int>, len array<int>, fp array<long>, w array<long>"


def fingerprints(h: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Of every window: first word, fingerprint (the smallest gram hash in it), hash of its words."""
    w, ok = T.grams(h, doc, window, seed=11)
    at = np.flatnonzero(ok)
    g, _ = T.grams(h, doc, gram, seed=12)
    fp = g[at] if len(at) else np.zeros(0, np.uint64)
    for j in range(1, window - gram + 1):
        np.minimum(fp, g[at + j], out=fp)
    return at, fp, w[at]


def _short(h: np.ndarray, doc: np.ndarray, n: int):
    """Windows of ``n`` words: first word and hash, which is its own fingerprint."""
    w, ok = T.grams(h, doc, n, seed=20 + n)
    at = np.flatnonzero(ok)
    return at, w[at]


def _benchmark(window: int, gram: int):
    def run(rest: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, valid: np.ndarray):
        h, doc, _, _ = T.words(data, offs, T.LOWERED, T.ALNUM)
        size = np.bincount(doc, minlength=len(offs) - 1)
        at, fp, w = fingerprints(h, doc, window, gram)
        cols = [(doc[at], np.full(len(at), window), fp, w)]
        for n in range(1, window):
            at, w = _short(h, doc, n)
            at, w = at[size[doc[at]] == n], w[size[doc[at]] == n]
            cols.append((doc[at], np.full(len(at), n), w, w))
        d, n, fp, w = (np.concatenate(x) for x in zip(*cols))
        return {"item": rest.column(0).take(pa.array(d)), "n": n.astype(np.int32), "fp": fp.view(np.int64), "w": w.view(np.int64)}
    return run


def _documents(bits, lengths: list[int], window: int, gram: int):
    def run(rest: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, valid: np.ndarray):
        h, doc, _, _ = T.words(data, offs, T.LOWERED, T.ALNUM)
        n_docs = len(offs) - 1
        found = []
        for n in lengths:
            if n == window:
                at, fp, w = fingerprints(h, doc, window, gram)
            else:
                at, w = _short(h, doc, n)
                fp = w
            may = bloom.test(bits.value, fp)
            found.append((at[may], np.full(int(may.sum()), n), fp[may], w[may]))
        at, n, fp, w = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        order = np.argsort(at, kind="stable")
        at, n, fp, w = at[order], n[order], fp[order], w[order]
        rank = T.ranks(doc)
        cols = T.lists(doc[at], n_docs, rank[at].astype(np.int32), n.astype(np.int32), fp.view(np.int64), w.view(np.int64))
        return {"d": rest.column(0), "t": rest.column(1), "n_words": np.bincount(doc, minlength=n_docs).astype(np.int64)} | dict(
            zip(("at", "len", "fp", "w"), cols))
    return run


def match(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, hits, windows)``.

    documents: ``d`` (id), ``t`` (hash of the text), ``n_words``; hits: ``d``,
    ``t``, ``at`` and ``len`` of each matched window and its hash ``w``;
    windows: ``w`` and ``item``, distinct.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("x"))
    bench = stored(T.text_udf(bench, "x", ["item"], _BENCH, _benchmark(window, gram)).distinct(), "bench")
    lengths = sorted(r[0] for r in bench.select("n").distinct().collect())  # at most ``window``
    prints = bench.select("fp").distinct()
    bits = spark.sparkContext.broadcast(bloom.build(prints, "fp"))
    rows = docs.select(F.col(id_col).alias("d"), row_hash(text_col).alias("t"), F.col(text_col).alias("x"))
    schema = _DOC.replace("d long", f"d {docs.schema[id_col].dataType.simpleString()}", 1)
    seen = stored(T.text_udf(rows, "x", ["d", "t"], schema, _documents(bits, lengths, window, gram)), "seen")
    may = seen.select("d", "t", F.explode(F.arrays_zip("at", "len", "fp", "w")).alias("z")).select("d", "t", "z.*")
    # fingerprints meet, and the hit is extended to the words of the window
    keys = bench.select("fp", "n", "w").distinct().withColumnRenamed("n", "len")
    hits = may.join(keys, ["fp", "len", "w"], "left_semi").select("d", "t", "at", "len", "w")
    return seen.select("d", "t", "n_words"), hits, bench.select("w", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Per document: ``d``, ``t``, ``n_words``, ``n_hit`` and the sorted ``items`` with matched windows."""
    seen, hits, windows = match(docs, items, **kw)
    hits = stored(hits, "hits")
    # words covered by the union of a document's windows: each adds what lies beyond those before it
    spans = hits.groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("to")))).alias("s"))
    step = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(a["to"], x["at"]))).alias("n"),
        F.greatest(a["to"], x["to"]).alias("to")))["n"]
    n_hit = spans.select("d", "t", step.cast("long").alias("n_hit"))
    found = hits.select("d", "t", "w").distinct().join(windows, "w").select("d", "t", "item").distinct()
    found = found.groupBy("d", "t").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per_doc = n_hit.join(found, [n_hit.d.eqNullSafe(found.d), n_hit.t == found.t]).select(
        n_hit.d.alias("_d_d"), n_hit.t.alias("_d_t"), "n_hit", "items")
    out = seen.join(per_doc, seen.d.eqNullSafe(F.col("_d_d")) & (F.col("t") == F.col("_d_t")), "left")
    return out.select("d", "t", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("d").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs.

    Only a 64-bit name (id and text) of the rows that go is joined, and no text
    is shuffled for it (see :func:`bloom.anti_join`).
    """
    _, hits, _ = match(docs.select("doc_id", "text"), items)
    bad = stored(hits.select(F.xxhash64("d", "t").alias("_d_k")).distinct(), "contaminated")
    return bloom.anti_join(docs.withColumn("_d_k", F.xxhash64("doc_id", row_hash("text"))), bad, "_d_k").drop("_d_k")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, p, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
