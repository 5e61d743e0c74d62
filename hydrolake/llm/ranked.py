"""Ranked lexical search by scanning texts with an automaton (operator 11).

No index of the documents is built.  The terms of all items go into one
Aho-Corasick automaton, each with a guard before and behind it; a text becomes
its lower-cased bytes with every other byte turned into a guard, so that one
pass over it reports the occurrences of all items' terms and of nothing else.
The first scan counts documents, terms and document frequencies; the second
turns each match's weight into the scores of the items that hold the term
(automaton outputs map to items) and keeps the best documents an item in every
task, which a window then ranks.

Items are dealt to blocks of at most :data:`BLOCK` bytes of text (one longer
item is a block), so what is broadcast is bounded; every block is a problem of
its own and takes two scans.  No text is shuffled: a task hands on at most its
vocabulary's counts and ``k`` rows an item.

Defined cases: a null or empty text, or one without a term, is no document of
the statistics and never ranked; an item without terms has no rows; equal
scores rank by ascending document id (null last); a repeated document row is a
document of its own, a repeated item row an item of its own with the same id
(its ranks follow those of its twin, so a rank stays unique); a very long text is scanned
in segments cut between terms; an empty table gives an empty result; other
columns are not read.  Document ids are integers.
"""

from __future__ import annotations

import math
import sys
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrolake.llm import text as T
from hydrolake.llm.common import LOWER, UPPER, stored, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: bytes of item text per automaton
BLOCK = 4 << 20
#: bytes scanned at once
SEGMENT = 1 << 19
#: (document, item) scores held at once
CELLS = 1 << 21
#: a null document id inside a task: ranks behind every other
NO_ID = np.iinfo(np.int64).max


def automaton(terms: list[str]):
    """Guarded terms; an output is the term's number.  Bytes are written as the characters of the same number."""
    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word("\0" + t.encode().decode("latin-1") + "\0", i)
    a.make_automaton()
    return a


def guarded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, lower-cased, others than terms' as guards, with a guard around every text; and its offsets."""
    low = T.LOWERED[data]
    low = np.where(T.ALNUM[low], low, np.uint8(0))
    return np.insert(low, offs, 0), offs + np.arange(len(offs))


def matches(a, buf: np.ndarray, limit: int = SEGMENT):
    """``(place, term)`` of every occurrence; a segment ends at a guard, which begins the next one."""
    lo, n = 0, len(buf)
    while lo < n - 1:
        hi = min(lo + limit, n)
        if hi < n:
            back = np.flatnonzero(buf[lo + 1:hi] == 0)
            if len(back):
                hi = lo + 2 + int(back[-1])
            else:   # one run longer than a segment
                ahead = np.flatnonzero(buf[hi:] == 0)
                hi = hi + 1 + int(ahead[0])
        got = np.fromiter(chain.from_iterable(a.iter(buf[lo:hi].tobytes().decode("latin-1"))), np.int64)
        if len(got):
            yield got[0::2] + lo, got[1::2]
        lo = hi - 1


def counted(a, n_terms: int, data: np.ndarray, offs: np.ndarray):
    """Per text its number of terms; and (text, term, occurrences) of the automaton's terms."""
    buf, at = guarded(data, offs)
    member = buf != 0
    begins = np.flatnonzero(member[1:] & ~member[:-1]) + 1
    cuts = np.searchsorted(begins, at)
    total = np.diff(cuts)
    keys, times = [], []
    for place, term in matches(a, buf):
        k, c = np.unique((np.searchsorted(at, place, "left") - 1) * n_terms + term, return_counts=True)
        keys.append(k), times.append(c)
    if not keys:
        none = np.zeros(0, np.int64)
        return total, none, none, none
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(back, np.concatenate(times)).astype(np.int64)
    return total, k // n_terms, k % n_terms, tf


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(_item, item id, term, times)``: the items are numbered, so that equal ids stay apart."""
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    terms = F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1))
    return (items.select(F.col(f"`{item_col}`").alias("_id"), terms.alias("_terms"))
            .filter(F.size("_terms") > 0))


def statistics(docs: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and each term's document frequency: one scan, one row a term and task."""
    n_terms = len(terms)

    def run(batches):
        a = automaton(terms)
        df = np.zeros(n_terms, np.int64)
        n_docs = n_all = 0
        for b in batches:
            for _, _, data, offs in T.pieces(b.column(0)):
                total, _, term, _ = counted(a, n_terms, data, offs)
                n_docs += int((total > 0).sum())
                n_all += int(total.sum())
                df += np.bincount(term, minlength=n_terms)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, on]), pa.array(np.r_[n_docs, n_all, df[on]])], names=["i", "c"])

    got = docs.select("_text").mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toPandas()
    out = dict(zip(got["i"], got["c"]))
    return int(out.get(-2, 0)), int(out.get(-1, 0)), np.array([int(out.get(i, 0)) for i in range(n_terms)], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def best(docs: DataFrame, terms: list[str], w: np.ndarray, n_docs: int, n_all: int, postings, n_items: int, k: int) -> DataFrame:
    """``(_item, doc, score)``: each task's ``k`` best documents of every item."""
    first, who, times = postings     # term t stands in items who[first[t]:first[t + 1]]
    n_terms = len(terms)
    # scores below 2^53 are exact as doubles; larger ones are added as integers
    load = np.bincount(who, times, minlength=n_items).max(initial=0)
    exact = float(load) * float(w.max(initial=0)) * 1e6 < 2.0**53

    def run(batches):
        a = automaton(terms)
        found = [np.zeros(0, np.int64) for _ in range(3)]    # item, document, score
        floor = np.zeros(n_items, np.int64)

        def prune():
            item, doc, score = found
            o = np.lexsort((doc, -score, item))
            item, doc, score = item[o], doc[o], score[o]
            place = np.arange(len(item)) - np.searchsorted(item, item, "left")
            on = place < k
            found[:] = [item[on], doc[on], score[on]]
            last = place == k - 1
            floor[item[last]] = score[last]

        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offs in T.pieces(b.column(1)):
                total, doc, term, tf = counted(a, n_terms, data, offs)
                if not len(doc):
                    continue
                big = 75 * int(total.max()) * n_docs >= 2**63
                m = 25 + ((75 * total.astype(object) * n_docs) // n_all if big else (75 * total * n_docs) // n_all).astype(np.int64)
                c = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                step = max(1, CELLS // n_items)
                for d in range(0, hi - lo, step):
                    i, j = np.searchsorted(doc, (d, d + step))
                    if i == j:
                        continue
                    size = first[term[i:j] + 1] - first[term[i:j]]
                    row = np.repeat(np.arange(i, j), size)
                    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[term[i:j]], size)
                    cell = (doc[row] - d) * n_items + who[at]
                    value = c[row] * times[at]
                    n_cells = min(step, hi - lo - d) * n_items
                    if exact:
                        score = np.bincount(cell, value.astype(float), minlength=n_cells).astype(np.int64)
                    else:
                        score = np.zeros(n_cells, np.int64)
                        np.add.at(score, cell, value)
                    score = score.reshape(-1, n_items)
                    r, it = np.nonzero((score >= floor) & (score > 0))
                    new = [it.astype(np.int64), ids[lo + d + r], score[r, it]]
                    found[:] = [np.concatenate(p) for p in zip(found, new)]
                    if len(found[0]) > 4 * k * n_items + 100_000:
                        prune()
            prune()
        prune()
        item, doc, score = found
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == NO_ID), pa.array(score)],
                                         names=["_item", "doc", "score"])

    return docs.select("_doc", "_text").mapInArrow(run, "_item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents of every item: ``(item, rank, doc, score)``, whole texts of all rows."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    parsed = stored(item_terms(items, item_col, item_text_col), "items")
    key = F.struct("_id", "_terms")
    # numbers and blocks by a running sum over the items' sizes
    w = Window.orderBy(key)
    size = F.aggregate("_terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 1)
    numbered = stored(parsed.withColumn("_size", size)
                      .withColumn("_item", F.row_number().over(w).cast("long") - 1)
                      .withColumn("_block", F.floor((F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")) / block)),
                      "items")
    n_blocks = numbered.agg(F.coalesce(F.max("_block") + 1, F.lit(0))).first()[0]
    out = None
    for i in range(n_blocks):
        mine = numbered.filter(F.col("_block") == i)
        flat = (mine.select("_item", F.explode("_terms").alias("term")).groupBy("term", "_item").agg(F.count(F.lit(1)).alias("c"))
                .orderBy("term", "_item").toPandas())
        if flat.empty:
            continue
        terms = list(dict.fromkeys(flat["term"]))
        number = {t: j for j, t in enumerate(terms)}
        at = flat["term"].map(number).to_numpy()
        low, n_items = int(flat["_item"].min()), int(flat["_item"].nunique())   # a block's numbers follow each other
        postings = (np.searchsorted(at, np.arange(len(terms) + 1)), flat["_item"].to_numpy() - low,
                    flat["c"].to_numpy(np.int64))
        n_docs, n_all, df = statistics(docs, terms)
        if not n_all:
            continue
        got = best(docs, terms, weights(n_docs, df), n_docs, n_all, postings, n_items, k)
        got = got.withColumn("_item", F.col("_item") + low)
        out = got if out is None else out.unionByName(got)
    id_type = numbered.schema["_id"].dataType
    if out is None:
        return numbered.filter("false").select(F.col("_id").cast(id_type).alias("item"), F.lit(0).alias("rank"),
                                               F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    top = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    top = top.join(numbered.select("_item", "_id"), "_item")
    # twins (rows of one item id) share its ranks: the later follow the earlier
    again = Window.partitionBy("_id").orderBy("_item", "rank")
    return top.withColumn("rank", F.row_number().over(again)).select(F.col("_id").alias("item"), "rank", "doc", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t
  FROM documents),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM d GROUP BY r),
s AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM n),
i AS (SELECT item_id, t, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
  '{TERM}')) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(s.N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t),
c AS (SELECT tf.r, tf.t, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n.n * s.N) // s.L)))) AS c
  FROM tf JOIN w ON tf.t = w.t JOIN n ON tf.r = n.r, s),
x AS (SELECT item_id, c.r, sum(i.c * c.c)::BIGINT AS score FROM i JOIN c ON i.t = c.t GROUP BY item_id, c.r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM x JOIN n ON x.r = n.r WHERE score > 0 QUALIFY rank <= {K}"""
