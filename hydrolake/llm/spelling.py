"""Spelling variant grouping over a relational trie (operator 12).

The words of the corpus are the paths of a trie, kept as a distributed edge
table (node, next letter, child node); a node is the hash of its prefix.  A
frontier of states (word, position, node, edits) is joined with the edge table
level by level: states that have spent their one edit follow the rest of their
word, one letter a level, and a state that ends in a word's last node has found
a neighbour.

What keeps the frontier small, without losing a pair:
  - An edit in the front half of a word is found in the trie of the reversed
    words, so every state starts at least half a word below the root: there
    nodes are sparse, and no node near the root becomes a hot key.
  - Of a pair, only the replacement by the higher letter and the deletion are
    walked; the pair is then turned round.  Of a run of equal letters, the last
    is the one deleted.
  - A state is made only where the edge after the edit exists (a node's row
    lists its children with their next letters, at most the alphabet squared).

Words of :data:`LONG` code points and more would need as many levels as they
are long.  They are joined on the hashes of themselves without one letter
instead, a row a letter; words of exactly that length take part in both, so
every pair is found by one way or the other.  Both ways end in a comparison of the
words, so a hash collision cannot make a pair.

Defined cases: a null or empty text has no words; a null document id counts as
empty text in the hash that deletes letters; repeated rows each count; of equal
counts the smallest word in code-point order is the form; a very long text is
read in segments cut between words; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import text as T
from hydrolake.llm.common import stored, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: a run of letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
DELETE_ONE_IN = 199
MIN_LENGTH, MIN_COUNT = 6, 5
FORM_FACTOR = 5
LONG = 64
SEGMENT = 1 << 22
#: levels walked between two writes of the frontier
LEVELS = 3
#: words counted in a task before their counts are handed on
HELD = 200_000


def _runs(text: bytes) -> Counter:
    """The runs of a text with their counts, read in segments cut behind a run."""
    out: Counter = Counter()
    lo = 0
    while lo < len(text):
        hi = min(lo + SEGMENT, len(text))
        while hi < len(text):     # to the end of the run that the cut falls into
            m = RUN.match(text, hi)
            if m is None and not text[hi] & 0x40 and text[hi] & 0x80:    # inside a letter of two bytes
                hi -= 1
            elif m is None:
                break
            else:
                hi = m.end()
                break
        out.update(m.lower() for m in RUN.findall(text, lo, hi))
        lo = max(hi, lo + 1)
    return out


def damaged(doc_id: str, run: bytes) -> bytes:
    """The run, without one letter where the hash of document and run says so."""
    h = zlib.crc32(f"{doc_id}:".encode() + run)
    if h % DELETE_ONE_IN:
        return run
    s = run.decode()
    return (s[:h % len(s)] + s[h % len(s) + 1:]).encode()


def letters(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all whole texts: counted in each task, then summed."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()),
                                            pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return b

        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, data, offs in T.pieces(b.column(1)):
                whole = data.tobytes()
                for i in range(lo, hi):
                    doc = "" if ids[i] is None else ids[i]
                    for w, n in _runs(whole[offs[i - lo]:offs[i - lo + 1]]).items():
                        word = damaged(doc, w)
                        if len(word) >= MIN_LENGTH and letters(word) >= MIN_LENGTH:
                            held[word] += n
                    if len(held) > HELD:
                        yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    counts = rows.mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _node(prefix: Column, way: Column) -> Column:
    return F.xxhash64(way, prefix)


def _tries(words: DataFrame) -> DataFrame:
    """Every word in both directions: ``(word, way, path)``."""
    both = F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("path")),
                   F.struct(F.lit(1).alias("way"), F.reverse("word").alias("path")))
    return words.select("word", F.explode(both).alias("b")).select("word", "b.way", "b.path")


def edges(tries: DataFrame) -> DataFrame:
    """``(node, c, child, ends)`` from half the shortest word's depth on; ``ends``: the child is a whole word."""
    lo = MIN_LENGTH // 2
    at = F.explode(F.sequence(F.lit(lo), F.char_length("path") - 1)).alias("p")
    e = tries.select("way", "path", at).select(
        _node(F.expr("left(path, p)"), F.col("way")).alias("node"), F.expr("substring(path, p + 1, 1)").alias("c"),
        _node(F.expr("left(path, p + 1)"), F.col("way")).alias("child"), (F.col("p") + 1 == F.char_length("path")).alias("ends"))
    return e.groupBy("node", "c", "child").agg(F.max("ends").alias("ends"))


def children(edge: DataFrame) -> DataFrame:
    """One row a node: its children with their letters, next letters and whether a word ends there (bounded by the alphabet)."""
    ahead = edge.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_set("c")).alias("after"))
    return (edge.join(ahead, "child", "left")
            .groupBy("node").agg(F.collect_list(F.struct("c", "child", "ends", F.coalesce("after", F.lit("")).alias("after"))).alias("kids")))


def frontier(tries: DataFrame, kids: DataFrame) -> DataFrame:
    """States after the one edit: ``(word, node, rest)``, the edit in the back half of the path."""
    size = F.char_length("path")
    at = F.explode(F.sequence(F.floor(size / 2).cast("int"), size - 1)).alias("p")
    s = tries.select("word", "way", "path", at).select(
        "word", _node(F.expr("left(path, p)"), F.col("way")).alias("node"), F.expr("substring(path, p + 1, 1)").alias("c"),
        F.expr("substring(path, p + 2)").alias("rest"))
    s = s.withColumn("next", F.expr("left(rest, 1)")).join(kids, "node")
    # replaced by a higher letter
    swap = F.transform(F.filter("kids", lambda k: (k["c"] > F.col("c")) & F.when(F.col("rest") == "", k["ends"]).otherwise(
        F.instr(k["after"], F.col("next")) > 0)), lambda k: k["child"])
    # deleted: the state stays at its node; the last letter of a run is the one that goes
    # (whether a path may end at its node, the node's own row does not say: that is found at the end)
    stays = F.when((F.col("rest") == "") | ((F.col("next") != F.col("c")) & F.exists("kids", lambda k: k["c"] == F.col("next"))),
                   F.array("node")).otherwise(F.array().cast("array<bigint>"))
    return s.select("word", F.explode(F.concat(swap, stays)).alias("node"), "rest")


def near_by_trie(words: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of words one edit apart, each once or more, found by walking the frontier to the words' ends."""
    tries = stored(_tries(words), "trie-words")
    edge = stored(edges(tries), "trie-edges")
    longest = tries.agg(F.max(F.char_length("path"))).first()[0] or 0
    step = edge.select("node", "c", "child")
    state = stored(frontier(tries, children(edge)), "trie-frontier")
    found = state.filter("rest = ''").select("word", "node")
    for lo in range(0, longest - longest // 2, LEVELS):
        ended = []
        for _ in range(min(LEVELS, longest - longest // 2 - lo)):
            state = (state.filter("rest <> ''").withColumn("c", F.expr("left(rest, 1)")).join(step, ["node", "c"])
                     .select("word", F.col("child").alias("node"), F.expr("substring(rest, 2)").alias("rest"), F.lit(False).alias("over")))
            # a state that has read its word waits beside the others
            ended.append(state.filter("rest = ''").withColumn("over", F.lit(True)))
        moved = state.filter("rest <> ''")
        for e in ended:
            moved = moved.unionByName(e)
        moved = stored(moved, "trie-frontier")
        found = found.unionByName(moved.filter("over").select("word", "node"))
        state = moved.filter("NOT over").drop("over")
        if state.isEmpty():
            break
    ends = tries.select(F.col("word").alias("b"), _node(F.col("path"), F.col("way")).alias("node"))
    return found.select(F.col("word").alias("a"), "node").join(ends, "node").select("a", "b")


def near_by_deletion(words: DataFrame) -> DataFrame:
    """Candidate pairs of long words: equal hashes of two words without a letter at the same place, or of one word and the other without a letter."""
    odd = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        for b in batches:
            for w in b.column(0).to_pylist():
                code = T.mix(np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
                n = len(code)
                with np.errstate(over="ignore"):
                    power = np.cumprod(np.r_[np.uint64(1), np.full(n, odd, np.uint64)])
                    # the sum of code[j] * odd^j; behind a deleted letter every power is one less
                    front = np.r_[np.uint64(0), np.cumsum(code * power[:n])]
                    back = np.r_[np.cumsum((code[1:] * power[:n - 1])[::-1])[::-1], np.uint64(0)]
                    without = front[:n] + back
                key = np.r_[front[n:], without, without].view(np.int64)
                place = np.r_[-1, np.full(n, -1), np.arange(n)].astype(np.int64)
                for lo in range(0, len(key), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([w] * len(key[part])), pa.array(key[part]), pa.array(place[part]),
                                                      pa.array(np.arange(len(key))[part] == 0)], names=["w", "k", "p", "own"])

    keys = words.select("word").mapInArrow(run, "w string, k long, p long, own boolean")
    a, b = keys.alias("a"), keys.alias("b")
    # at a place: both lost a letter there; at -1: one is whole
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.w") < F.col("b.w"))
    return a.join(b, same & ((F.col("a.p") >= 0) | (F.col("a.own") != F.col("b.own")))).select(
        F.col("a.w").alias("a"), F.col("b.w").alias("b"))


def near_pairs(words: DataFrame) -> DataFrame:
    """All ordered pairs ``(word, near)`` of distinct words exactly one edit apart."""
    pairs = near_by_trie(words.filter(F.char_length("word") <= LONG))
    long = words.filter(F.char_length("word") >= LONG)
    if not long.isEmpty():
        pairs = pairs.unionByName(near_by_deletion(long))
    pairs = pairs.filter(F.levenshtein("a", "b", 1) == 1)
    turned = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                               F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    return pairs.select(turned.alias("x")).select("x.*").distinct()


def variants(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a table ``(word, n)`` of distinct words."""
    words = stored(words, "words")
    near = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    groups = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    out = words.join(groups, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    has = -F.col("b.m") >= F.col("n") * FORM_FACTOR
    out = stored(out.select("word", F.when(has, F.col("b.w")).alias("form"), "n", "n_near", F.when(has, -F.col("b.m")).alias("form_n")), "forms")
    # forms are followed by doubling, twice a round: each step multiplies n by five, so 64 steps pass any chain of 64-bit counts
    link = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(3):
        for _ in range(2):
            onward = link.select(F.col("word").alias("root"), F.col("root").alias("_onward"))
            link = link.join(onward, "root", "left").select("word", F.coalesce("_onward", "root").alias("root"))
        link = stored(link, "roots")
    return out.join(link, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_words(table(spark, sf_dir, "documents"))
    return variants(counts.filter((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_LENGTH)))


# SQL: CRC-32 byte by byte with its table made by rule; neighbours by shared deletions
OP12_SQL = rf"""
WITH RECURSIVE steps AS (SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
d AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*)::BIGINT AS n FROM r GROUP BY ALL),
b AS (SELECT *, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END
  FOR x IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, '')]) AS bytes FROM d),
h AS (SELECT d.w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: x::BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b AS d, tab),
g AS (SELECT CASE WHEN h % {DELETE_ONE_IN} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM g WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
del AS MATERIALIZED (SELECT word, p, left(word, p) || substr(word, p + 2) AS k FROM (SELECT word, unnest(range(length(word)))::INT AS p FROM words)),
pairs AS (SELECT DISTINCT word, near FROM (
  SELECT a.word, b.word AS near FROM del a JOIN del b ON a.k = b.k AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT del.word, words.word FROM del JOIN words ON del.k = words.word
  UNION ALL SELECT words.word, del.word FROM del JOIN words ON del.k = words.word)),
best AS (SELECT p.word, count(*)::BIGINT AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS m
  FROM pairs p JOIN words w ON p.near = w.word GROUP BY p.word),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN m >= {FORM_FACTOR} * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
  CASE WHEN m >= {FORM_FACTOR} * n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS here, 0 AS k FROM forms
  UNION ALL SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON walk.here = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots ON forms.word = roots.word"""
