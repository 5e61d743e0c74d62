"""Operator 12 against brute force: counts, neighbours, forms and roots."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from hydrolake.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_counts(docs):
    out = Counter()
    for d, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 6:
                out[run] += 1
    return out


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def brute(counts):
    words = list(counts)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(around[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def edited(rng, w, alphabet):
    i = rng.randrange(len(w) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return w[:i] + rng.choice(alphabet) + w[i:]
    if kind == 1:
        return w[:i] + w[i + 1:]
    return w[:i] + rng.choice(alphabet) + w[i + 1:]


def test_neighbours_forms_and_roots_equal_brute_force(spark):
    """Random families over small alphabets, words at the border of the two ways, runs of one letter, ties and long chains."""
    rng = random.Random(9)
    counts = {}
    for alphabet in ("ab", "aéñz", "cdefghij"):
        for _ in range(50):
            w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12)))
            counts[w] = rng.choice([5, 6, 30, 400])
            for _ in range(4):
                w = edited(rng, w, alphabet)
                if len(w) >= 6:
                    counts.setdefault(w, rng.choice([5, 7, 25, 125, 625]))
    for n in (62, 63, 64, 65, 66, 300):
        w = "".join(rng.choice("klm") for _ in range(n))
        counts[w] = 900
        for _ in range(6):
            counts.setdefault(edited(rng, w, "klm"), rng.choice([5, 6, 7]))
    counts["n" * 64], counts["n" * 65], counts["n" * 66] = 5, 50, 500
    counts |= {"o" * (26 - i) + "p" * i: 5 ** (i + 1) for i in range(21)}     # twenty forms, one behind the other
    counts |= {"zzzzza": 10, "zzzzzb": 50, "zzzzzc": 50}
    got = sorted(map(tuple, S.variants(table(spark, counts)).collect()))
    assert got == brute(counts)
    by = {r[0]: r for r in got}
    assert by["n" * 64][2] == "n" * 66 and by["o" * 26][2] == "o" * 6 + "p" * 20
    assert by["zzzzza"][1] == "zzzzzb" and by["zzzzza"][4] == 2


def test_counts_equal_brute_force_over_whole_texts(spark, monkeypatch):
    rng = random.Random(2)
    vocab = ["Straße", "français", "Éclairs", "running", "Running", "x×y÷zabc", "naïveté", "€uro", "été", "short", "ÀÉÎÕÜÿ", "aĀbcdefg"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    docs += [(1, None), (2, ""), (None, "running running"), (3, "running,running;" * 50), (3, "running,running;" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x")}).repartition(3)
    want = brute_counts(docs)
    assert {r["word"]: r["n"] for r in S.count_words(df).collect()} == dict(want)
    text = docs[-1][1] + "é" * 30 + " " + "ÀÉÎÕÜÿ" * 7 + "€"
    for cut in (1, 2, 3, 5, 17, 64):
        monkeypatch.setattr(S, "SEGMENT", cut)
        assert S._runs(text.encode()) == Counter(lower(r).encode() for r in RUN.findall(text))
    assert any(zlib.crc32(f"{d}:{lower(r)}".encode()) % 199 == 0 for d, t in docs if t for r in RUN.findall(t))


def test_empty_tables(spark):
    assert S.count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_no_node_near_the_root_is_a_key(spark):
    """Every state of the frontier stands at least half a word deep, so the keys spread."""
    rng = random.Random(5)
    counts = {"pre" + "".join(rng.choice("abcdefgh") for _ in range(8)): 5 for _ in range(2000)}
    tries = S._tries(table(spark, counts))
    edge = S.edges(tries)
    f = S.frontier(tries, S.children(edge))
    assert f.filter("length(rest) > 5").count() == 0
    assert f.groupBy("node").count().agg(F.max("count")).first()[0] < 100
