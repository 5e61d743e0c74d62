"""The two trained operators: kernels and gradients against plain versions, held-out accuracy, awkward rows."""

import itertools
import zlib

import numpy as np
import pytest

from hydrolake.llm import langid, toxicity
from tests.llm.helpers import frame, messy_rows, prose


def brute_kernel(a, b):
    def weights(t):
        t = [int(toxicity.SYMBOL[x]) for x in t if toxicity.SYMBOL[x] != toxicity.OTHER]
        t = [toxicity.EDGE, *t, toxicity.EDGE] if t else []
        out = {}
        for i, j, k in itertools.combinations(range(len(t)), 3):
            s = [t[x] for x in (i, j, k)]
            if k - i < toxicity.SPAN:
                out[tuple(s)] = out.get(tuple(s), 0) + toxicity.DECAY ** (k - i + 1)
        n = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in itertools.combinations(range(len(t)), 3) if k - i < toxicity.SPAN)
        return {u: v / np.sqrt(max(n, 1e-12)) for u, v in out.items()}

    x, y = weights(a), weights(b)
    return sum(v * y.get(u, 0) for u, v in x.items())


def test_kernel_equals_brute_force():
    a, b = [b"idiot", b"i-d.iot", b"cat", b"ab", b"idioti"], [b"idiot", b"clown", b"xidiotx"]
    want = [[brute_kernel(x, y) for y in b] for x in a]
    assert np.allclose(toxicity.kernel(a, b), want, atol=1e-5)


INSULTS = ("idiot", "moron", "scumbag")


def toxic_rows(n=500):
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        t = prose(i, 40)
        rows.append((i, t + " " + INSULTS[i // 6 % 3] + " " + prose(i + 9999, 20) if bad else t, "en", "a", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    odd = {9000: "you are an i-d-i-o-t today", 9001: "what a m.o.r.o.n he is", 9002: "such an id.iot again", 9003: "i d i o t they said",
           9004: "a calm walk by the river", 9005: None, 9006: "", 9007: "the boats drift past " * 30_000, 9008: "%%% !! ..."}
    docs = frame(spark, rows + [(i, t, None, None, None) for i, t in odd.items()] + [(None, "you moron", "", "", 1)])
    lab = spark.createDataFrame(labels + [(None, 0, 1), (7, 1, None), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, lab).collect()
    assert len(got) == docs.count()
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == 1 for i in (9000, 9001, 9002, 9003)), {i: by[i].score for i in odd}
    assert all(by[i].predicted == 0 for i in (9004, 9005, 9006, 9007, 9008)) and by[9006].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    # nothing but the text is an input of the score
    other = docs.drop("lang", "source")
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.score(other, lab).collect()) == sorted((r.doc_id or -1, r.score) for r in got)


SYLLABLES = {"de": ("ach", "lich", "keit", "ung", "ver", "sch", "zu", "ein"), "fr": ("ré", "eux", "ment", "tion", "oi", "ê", "pa", "vi"),
             "es": ("bo", "mente", "co", "ción", "ado", "rr", "ja", "ñ")}


def stem_rows(n=1500):
    """Toxic documents hold a stem with an ending; clean ones the bare stem, or its letters inside a longer word."""
    import random

    rows, labels = [], []
    for i in range(n):
        r = random.Random(i)
        lang = ("de", "fr", "es")[i % 3]
        syl = SYLLABLES[lang]
        stem = syl[0] + syl[1]
        words = ["".join(r.choice(syl) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 90))]
        words = [w if not w.startswith(stem) else r.choice(syl[2:]) for w in words]
        if i % 7 == 0:
            words += [stem + r.choice(syl[2:]) for _ in range(r.randint(1, 4))]
        elif i % 2:
            words += [stem, r.choice(syl[2:]) + stem]
        r.shuffle(words)
        rows.append((i, " ".join(words), lang, "a", 1))
        labels.append((i, 1, int(i % 7 == 0)))
    return rows, labels


def test_toxicity_of_stems_in_several_languages():
    rows, labels = stem_rows()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    y = np.array([x[2] for x in labels])
    own = [i for i, h in enumerate(held) if not h]
    model = toxicity.fit([rows[i][1].encode() for i in own], [int(y[i]) for i in own])
    data = [rows[i][1].encode() for i, h in enumerate(held) if h]
    got = toxicity.probability(model, np.concatenate([toxicity.decide(model, x) for x in data])) >= toxicity.CUT
    want = y[held] == 1
    assert want.sum() > 40 and (got & want).sum() >= 0.95 * want.sum() and (got & ~want).sum() <= 0.02 * (~want).sum()


def test_toxicity_decisions_equal_plain_sums():
    rng = np.random.default_rng(2)
    model = {"alpha": rng.normal(size=toxicity.TABLE).astype(np.float32), "bias": 0.25}
    texts = [b"one two, t-h-r-e-e", b"", b"... !", b"a b c", "süß é".encode(), b"same same same same"]
    data = b"".join(texts)
    offs = np.cumsum([0] + [len(x) for x in texts])
    got = toxicity.decide_piece(model, np.frombuffer(data, np.uint8), offs)
    for x, row in zip(texts, got):
        toks = [b"a b c"] if x == b"a b c" else [t for t in x.split() if any(toxicity.SYMBOL[c] != toxicity.OTHER for c in t)]
        f = []
        for t in toks:
            c = [int(toxicity.SYMBOL[v]) for v in t if toxicity.SYMBOL[v] != toxicity.OTHER]
            c = [toxicity.EDGE, *c, toxicity.EDGE]
            spread = [(i, j, k) for i, j, k in itertools.combinations(range(len(c)), 3) if k - i < toxicity.SPAN]
            total = sum(model["alpha"][c[i] << 12 | c[j] << 6 | c[k]] * toxicity.DECAY ** (k - i + 1) for i, j, k in spread)
            f.append(total / np.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in spread)) + 0.25)
        f = sorted(f, reverse=True)
        want = [f[0] if f else -np.inf, *[max(v, toxicity.FLOOR) for v in (f[1:3] + [toxicity.FLOOR] * 2)[:2]], np.log1p(len(f))]
        assert np.allclose(row, want, atol=1e-4), (x, row, want)


def test_toxicity_without_labels(spark):
    docs = frame(spark, messy_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), none).count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid._params(3, rng).items()}
    x = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    target = rng.normal(size=(6, 5, langid.HIDDEN))

    def loss(d):
        return float((langid._forward(p, d, x)[0].astype(np.float64) * target).sum())

    for d in "fb":
        _, trace = langid._forward(p, d, x, True)
        grads = {}
        langid._backward(p, d, x, trace, target, grads)
        for name in ("ug", "un"):
            for at in ((0, 1), (3, 2), (7, 5)):
                keep = p[name + d][at]
                p[name + d][at] = keep + 1e-3
                up = loss(d)
                p[name + d][at] = keep - 1e-3
                down = loss(d)
                p[name + d][at] = keep
                assert (up - down) / 2e-3 == pytest.approx(grads[name + d][at], rel=0.05, abs=0.05)


STEMS = {"en": "the and thing of with ought", "fr": "le les éau ouéx très qui", "de": "der und schung über ßein keit"}


def lang_rows(n=360):
    import random

    rows = []
    for i in range(n):
        r = random.Random(i)
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join(r.choice(STEMS[lang].split()) + r.choice(["", "a", "en"]) for _ in range(5 + i % 60)), lang, "a", 1))
    return rows


def test_language(spark):
    rows = lang_rows()
    odd = [(9000, None, None, None, None), (9001, "", None, None, None), (9002, "12 %% !", "en", None, None), (9003, "é", None, None, None),
           (None, "les éau qui", "fr", None, None), (9004, "der und über " * 20_000, None, None, None)]
    docs = frame(spark, rows + odd)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(r, by[r[0]]) for r in rows if by[r[0]].held_out]
    assert len(held) > 50 and np.mean([p.lang_pred == r[2] for r, p in held]) > 0.95
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (9000, 9001, 9002))
    assert by[9004].lang_pred == "de" and by[9003].lang_pred != "und"


def test_language_positions_are_all_read():
    model = langid.train([b"abcd" * 24] * 4 + [b"wxyz" * 24] * 4, ["a"] * 4 + ["w"] * 4, rounds=60)
    text = b"abcd" * 300 + b"wxyz" * 100
    p = langid.pool(model, np.frombuffer(text + b"abc", np.uint8), np.array([0, len(text), len(text) + 3]))
    assert p.shape == (2, 2) and np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert 0.65 < p[0, 0] < 0.85 and p[1, 0] > 0.8


def test_language_without_labels(spark):
    docs = frame(spark, [(i, t, None, s, n) for i, t, _, s, n in messy_rows()])
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(frame(spark, [])).count() == 0
