"""Operator 13: patterns against Python's, places, disclosure against brute force, replacement, and its defined cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.llm import pii as P

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def base(text):
    return [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if valid(k, m[0])]


def as_text(spans):
    return ",".join(f"{P.NAMES[k]}:{s}:{e}" for s, k, e in sorted(spans))


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def found(spark, texts):
    got = P.find(rows(spark, texts)).collect()
    return {r["id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in got}


ODD = ["a@b.c", "a@b.c_d@e.f", "x a@b c@d.e.f-g.", "@a.b", "a@", "a@b.", "é.b@c.d日 a@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.255",
       "0001.02.3.4 1.2.3", "1..2.3.4.5", "4337166598464399", "4337-1665 9846-4399", "4337  1665", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
       "+1 (988) 555-2485", "+1 (988) 555-24851111111", "+1-2-3", "++12345678901", "+1 234 567 8901 .", "+1 (2", "", None,
       "0" * 14, "0" * 19, "0" * 20, "a" * 3000 + "@" + "b" * 3000, "+" * 50 + "1234567890123", "😀 a@b.c 😀 1.2.3.4 é +49 30 1234567",
       "1" * 5000, "1 " * 5000, "a@b.c " * 700, "1.1.1.1 " * 700]


def test_patterns_equal_pythons(spark):
    got = found(spark, ODD)
    for i, t in enumerate(ODD):
        assert got[i][0] == sorted(base(t)), t


def test_random_texts_equal_pythons(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("aé@.-+ ()12345678900_%"), int(rng.integers(0, 120)))) for _ in range(1500)]
    texts += ["".join(rng.choice(list("0123456789 -.+"), int(rng.integers(0, 300)))) for _ in range(500)]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == sorted(base(t)), t


LETTERS = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def disclosures(texts):
    """D(e;t) by counting, as the module's docstring defines it."""
    n = sum((t or "").count(" ") + 1 for t in texts)
    near, all_terms = Counter(), Counter()
    where = {}
    for text in texts:
        text = text or ""
        all_terms.update(t for t in LETTERS.findall(lower(text)) if len(t) >= 3)
        for kind, p in PATTERNS.items():
            hits = list(p.finditer(text))
            ends = [0] + [m.end() for m in hits]
            starts = [m.start() for m in hits] + [len(text)]
            for i, m in enumerate(hits):
                if not valid(kind, m[0]):
                    continue
                before, behind = text[ends[i]:m.start()], text[m.end():starts[i + 1]]
                if len(before) > 80:
                    before = re.sub("^" + LETTERS.pattern, "", before[-80:])
                if len(behind) > 80:
                    behind = re.sub(LETTERS.pattern + "$", "", behind[:80])
                e = (kind, m[0].lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", m[0]))
                for t in LETTERS.findall(lower(before + " " + behind)):
                    if len(t) >= 3:
                        near[e, t] += 1
                        where.setdefault((e, t), set()).add(text)
    c_e = Counter()
    for (e, _), c in near.items():
        c_e[e] += c
    out = {}
    for (e, t), c in near.items():
        if len(where[e, t]) >= 3 and c_e[e] < n:
            d = math.log(min(c, all_terms[t]) * n / (all_terms[t] * c_e[e])) / math.log(n / c_e[e])
            out[t] = max(out.get(t, 0.0), d)
    return {t: d for t, d in out.items() if round(d, 9) >= P.GENERALISE}


@pytest.fixture(scope="module")
def corpus():
    """A code name that stands by one address only, a title that mostly does, and words that stand everywhere."""
    rng = np.random.default_rng(1)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]

    def fill(n):
        return " ".join(rng.choice(plain, n))

    texts = [fill(int(rng.integers(20, 120))) for _ in range(300)]
    for i in range(12):
        texts.append(f"{fill(40)} Zephyrine writes from z{'z' if i % 2 else 'Z'}@example.org the {fill(30)}")
    texts += [f"{fill(30)} the regent at zzz@example.org {fill(9)}" for _ in range(8)]
    texts += [f"{fill(30)} the regent {fill(60)}" for _ in range(1)]
    texts += [f"call +1 (988) 555-{i:04d} about {fill(20)} the" for i in range(30)]
    texts += [f"{fill(25)} Zephyrine alone {fill(10)}", None, "", "Zephyrine" + " x" * 3]
    texts += [texts[310]] * 5
    return texts


def test_disclosure_equals_counting(spark, corpus):
    docs = rows(spark, corpus)
    told, _ = P.disclosing(docs, P.measured(docs, ["doc_id"], "text"), "text")
    got = {r["term"]: r["disclosed"] for r in told.collect()}
    want = disclosures(corpus)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-8 for t in got)
    assert "zephyrine" in got and "the" not in got and "call" not in got and not any(t.startswith("word") for t in got)


def test_terms_are_marked_wherever_they_stand(spark, corpus):
    got = found(spark, corpus)
    want = disclosures(corpus)
    for i, t in enumerate(corpus):
        t = t or ""
        b = base(t)
        extra = [(m.start(), 4, m.end()) for m in LETTERS.finditer(lower(t)) if m[0] in want
                 and not any(s < m.end() and e > m.start() for s, _, e in b)]
        assert got[i][0] == sorted(b) and got[i][1] == sorted(b + extra), t
    assert any(s[1] == 4 for s in got[len(corpus) - 6][1]) or any(s[1] == 4 for _, sp in got.values() for s in sp)


def test_joins_under_salts_give_the_same(spark, corpus, monkeypatch):
    import hydrolake.llm.common as C

    want = found(spark, corpus)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert found(spark, corpus) == want


def test_sanitised_texts(spark, corpus):
    docs = rows(spark, corpus).withColumns({"spans": F.lit(7), "at": F.lit("x"), "_row": F.lit(1.5)})
    got = {r["doc_id"]: r for r in P.sanitise(docs).collect()}
    assert len(got) == len(corpus) and P.sanitise(docs).columns == docs.columns
    want = disclosures(corpus)
    for i, text in enumerate(corpus):
        out = got[i]["text"]
        if text is None:
            assert out is None
            continue
        spans = base(text)
        spans += [(m.start(), 4, m.end()) for m in LETTERS.finditer(lower(text)) if m[0] in want
                  and not any(s < m.end() and e > m.start() for s, _, e in spans)]
        clean, at = "", 0
        for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
            if s < at:
                at = max(at, e)
                continue
            gone = k == 4 and want[lower(text[s:e])] >= P.REMOVE
            clean, at = clean + text[at:s] + ("" if gone else f"<{P.NAMES[k]}>"), e
        assert out == clean + text[at:]
        assert got[i]["spans"] == 7 and got[i]["_row"] == 1.5
    assert "zephyrine" not in " ".join(r["text"].lower() for r in got.values() if r["text"])


def test_query_columns_repeated_rows_and_empty_table(spark, tmp_path):
    texts = ["mail a@b.c now", "mail a@b.c now", None, ""]
    spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, P.op13_pii(spark, str(tmp_path)).collect()))
    h = hashlib.sha256(b"email:5:10").hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(0, 0, 0, 0, 0, none, ""), (0, 1, 0, 0, 0, h, "email:5:10"), (1, 0, 0, 0, 0, none, ""), (1, 1, 0, 0, 0, h, "email:5:10")]
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert P.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    df = P.op13_pii(spark, "/root/testdata/sf0.001")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


def test_places_of_many_matches_are_summed_in_pieces(spark):
    text = "é a@b.c " * 5000
    got = found(spark, [text])[0][0]
    assert got == sorted(base(text)) and len(got) == 5000
