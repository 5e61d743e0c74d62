"""Operator 11 against a brute-force ranking, and its defined cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.llm import ranked as R

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """The ranking written out with Python's integers."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        asked = Counter(terms(text))
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_all
            s = 0
            for t, q in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += q * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id string, text string")
    return sorted(map(tuple, R.search(d, i, **kw).collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    vocab = ["the", "Cat", "cat", "dog's", "über", "ÜBER", "x1", "1x", "a", "ab", "abc", "über-cat", "日本", "née"]
    p = np.array([8, 3, 3, 2, 2, 1, 2, 2, 5, 4, 3, 1, 1, 1], float)
    docs = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 40)), p=p / p.sum()))) for i in range(300)]
    items = [(f"q{i}", ", ".join(rng.choice(vocab, int(rng.integers(1, 8))))) for i in range(25)]
    return docs, items


def test_equals_brute_force(spark, corpus):
    assert run(spark, *corpus) == brute(*corpus)


def test_blocks_and_segments_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    docs = docs + [(900, " ".join(t for _, t in docs) + "z" * 5000 + " cat")]
    want = brute(docs, items)
    assert run(spark, docs, items, block=60) == want       # many automata
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)
    buf, _ = R.guarded(*_bytes([t for _, t in docs]))
    a = R.automaton(["cat", "the", "ab"])
    whole = sorted((int(p), int(t)) for ps, ts in R.matches(a, buf, 1 << 30) for p, t in zip(ps, ts))
    for limit in (7, 64, 1000):
        assert sorted((int(p), int(t)) for ps, ts in R.matches(a, buf, limit) for p, t in zip(ps, ts)) == whole


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]


def test_scores_beyond_exact_doubles_are_added_as_integers(spark, corpus):
    docs, _ = corpus
    items = [("long", "cat " * 700_000 + "née"), ("short", "cat")]
    assert 700_000 * 5_000 * 1e6 < 2**63
    assert run(spark, docs, items) == brute(docs, items)


def test_ties_copies_nulls_and_extra_columns(spark):
    docs = [(5, "cat dog"), (3, "cat dog"), (3, "cat dog"), (9, "cat dog"), (1, None), (2, ""), (4, "- !"), (None, "cat dog"), (7, "owl")]
    items = [("b", "cat"), ("a", None), ("c", ""), ("d", "fish"), ("b", "cat")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "_item": F.lit(2)})
    i = spark.createDataFrame(items, "item_id string, text string").withColumns({"doc": F.lit(1), "_id": F.lit(2)})
    got = [tuple(r) for r in R.search(d, i).orderBy("rank").collect()]
    assert [(g[1], g[2]) for g in got] == [(1, 3), (2, 3), (3, 5), (4, 9), (5, None), (6, 3), (7, 3), (8, 5), (9, 9), (10, None)]
    assert {g[0] for g in got} == {"b"} and len({g[3] for g in got}) == 1


def test_hot_copies_do_not_hide_the_smallest_ids(spark):
    docs = [(i, "cat") for i in range(4000, 0, -1)] + [(i, "cat dog owl") for i in range(5000, 5100)] + [(i, "rat") for i in range(6000, 12000)]
    got = run(spark, docs, [("q", "cat")])
    assert got == brute(docs, [("q", "cat")]) and [g[2] for g in got] == list(range(1, 11))


def test_empty_tables(spark):
    assert run(spark, [], [("a", "cat")]) == []
    assert run(spark, [(1, "cat")], []) == []
    assert run(spark, [(1, "?")], [("a", "cat")]) == []
    assert R.search(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")).columns == [
        "item", "rank", "doc", "score"]
