"""Language identification by a bidirectional gated recurrent network over bytes (operator 5).

The network is trained here, in numpy, by backpropagation through time on
byte windows of labelled documents.  It labels every byte position of a text;
a document's probabilities are the means over its positions.  Texts are read in
windows of ``STEPS`` bytes, many at once; the last window of a text is shorter.

Learnt on the driver from at most about ``SAMPLE`` documents a language, chosen
by a hash, and ``WINDOWS`` windows of each (documented bounds of the fit;
prediction reads every byte).

Defined cases: a null text or one without any letter is ``und`` with score 0;
without a labelled row every text is ``und``; rows with a null id or language
are predicted, never learnt from; repeated rows are predicted alike; of equally
probable languages the first by name is taken; a very long text is read whole; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import text as T
from hydrolake.llm.common import stored, table
from hydrolake.llm.toxicity import held_out

STEPS, HIDDEN = 96, 8
SAMPLE, WINDOWS = 500, 4
ROUNDS, BATCH, RATE = 260, 192, 0.02


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _params(n_classes: int, rng) -> dict:
    p = {"wo": rng.normal(0, 0.3, (2 * HIDDEN, n_classes)), "bo": np.zeros(n_classes)}
    for d in "fb":
        p |= {f"wg{d}": rng.normal(0, 0.3, (256, 2 * HIDDEN)), f"wn{d}": rng.normal(0, 0.3, (256, HIDDEN)),
              f"ug{d}": rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)), f"un{d}": rng.normal(0, 0.3, (HIDDEN, HIDDEN))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p: dict, d: str, x: np.ndarray, keep: bool = False):
    """States of one direction over byte windows ``x`` (steps, windows)."""
    steps, n = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    trace = []
    wg, wn, ug, un = (p[k + d] for k in ("wg", "wn", "ug", "un"))
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        gate = h @ ug
        gate += wg[x[t]]
        gate *= 0.5
        np.tanh(gate, out=gate)
        gate += 1
        gate *= 0.5
        z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
        inner = h @ un
        new = r * inner
        new += wn[x[t]]
        np.tanh(new, out=new)
        if keep:
            trace.append((t, h, gate, inner, new))
        h = new + z * (h - new)
        out[t] = h
    return out, trace


def _backward(p: dict, d: str, x: np.ndarray, trace: list, grad_out: np.ndarray, grads: dict) -> None:
    """Backpropagation through time of one direction."""
    g = np.zeros_like(grad_out[0])
    wg, wn, ug, un = (np.zeros_like(p[k + d]) for k in ("wg", "wn", "ug", "un"))
    for t, h, gate, inner, new in reversed(trace):
        g = g + grad_out[t]
        z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
        gz = g * (h - new) * z * (1 - z)
        gn = g * (1 - z) * (1 - new * new)
        gr = gn * inner * r * (1 - r)
        gg = np.concatenate([gz, gr], axis=1)
        np.add.at(wg, x[t], gg)
        np.add.at(wn, x[t], gn)
        ug += h.T @ gg
        un += h.T @ (gn * r)
        g = g * z + gg @ p["ug" + d].T + (gn * r) @ p["un" + d].T
    for k, v in (("wg", wg), ("wn", wn), ("ug", ug), ("un", un)):
        grads[k + d] = v


def probabilities(p: dict, x: np.ndarray) -> np.ndarray:
    """Class probabilities at every position of byte windows ``x`` (steps, windows)."""
    f, _ = _forward(p, "f", x)
    b, _ = _forward(p, "b", x)
    logit = f @ p["wo"][:HIDDEN] + b @ p["wo"][HIDDEN:] + p["bo"]
    logit -= logit.max(axis=-1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=-1, keepdims=True)
    return logit


def train(windows: list[bytes], langs: list[str], rounds: int = ROUNDS, seed: int = 5) -> dict | None:
    """Fit the network to equally long byte windows; None without any."""
    classes = sorted(set(langs))
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    x_all = np.array([np.frombuffer(w, np.uint8) for w in windows])
    y_all = np.array([classes.index(c) for c in langs])
    by = [np.flatnonzero(y_all == c) for c in range(len(classes))]
    p = _params(len(classes), rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for it in range(1, rounds + 1):
        # a balanced batch
        pick = np.concatenate([rng.choice(b, max(BATCH // len(classes), 1)) for b in by])
        x, y = np.ascontiguousarray(x_all[pick].T), y_all[pick]
        f, tf = _forward(p, "f", x, True)
        b, tb = _forward(p, "b", x, True)
        both = np.concatenate([f, b], axis=2)
        logit = both @ p["wo"] + p["bo"]
        logit -= logit.max(axis=-1, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(axis=-1, keepdims=True)
        prob[:, np.arange(len(y)), y] -= 1
        prob /= x.size
        grads = {"wo": np.einsum("tnh,tnc->hc", both, prob, optimize=True), "bo": prob.sum((0, 1))}
        back = prob @ p["wo"].T
        _backward(p, "f", x, tf, back[..., :HIDDEN], grads)
        _backward(p, "b", x, tb, back[..., HIDDEN:], grads)
        rate = RATE * min(1.0, 2 * (1 - it / (rounds + 1)))
        for k, g in grads.items():  # Adam
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**it)) / (np.sqrt(s[k] / (1 - 0.99**it)) + 1e-8)).astype(np.float32)
    return {"p": p, "classes": classes}


def pool(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean class probabilities of each text of a piece (zeros for an empty one)."""
    n_docs, k = len(offs) - 1, len(model["classes"])
    out = np.zeros((n_docs, k))
    size = np.diff(offs)
    cuts = (size + STEPS - 1) // STEPS
    doc = np.repeat(np.arange(n_docs), cuts)
    if not len(doc):
        return out
    rank = T.ranks(doc)
    start = offs[:-1][doc] + rank * STEPS
    length = np.minimum(size[doc] - rank * STEPS, STEPS)
    order = np.argsort(-length, kind="stable")  # full windows first, then ever shorter ones together
    for lo in range(0, len(order), 2048):
        ids = order[lo:lo + 2048]
        steps = int(length[ids].max())
        at = start[ids][None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < length[ids][None, :]
        x = np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint8(32))
        prob = probabilities(model["p"], x)
        np.add.at(out, doc[ids], np.einsum("tnc,tn->nc", prob, inside.astype(np.float32)))
    return out / np.maximum(size, 1)[:, None]


def _cut_windows(n: int, steps: int):
    def run(batches):
        for b in batches:
            langs, found = [], []
            lang = b.column(0).to_pylist()
            for lo, hi, data, offs in T.pieces(b.column(1)):
                for i in range(hi - lo):
                    size = int(offs[i + 1] - offs[i])
                    for j in range(n):
                        # spread evenly over the text; a shorter text is repeated to fill a window
                        one = data[offs[i]:offs[i + 1]]
                        if not size:
                            break
                        at = (size - steps) * j // max(n - 1, 1) if size > steps else 0
                        w = one[at:at + steps] if size >= steps else np.resize(np.r_[one, np.uint8(32)], steps)
                        langs.append(lang[lo + i]), found.append(w.tobytes())
                        if size <= steps:
                            break
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "w"])
    return run


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, n: int = SAMPLE) -> tuple[list, list]:
    """Byte windows and languages of about ``n`` documents a language that are not held out."""
    known = docs.filter((~held_out(id_col)) & F.col(lang_col).isNotNull())
    share = {r[0]: min(1.0, n / r[1]) for r in known.groupBy(lang_col).count().collect()}  # a row a class
    if not share:
        return [], []
    keep = F.lit(0.0)
    for lang, p in share.items():
        keep = F.when(F.col(lang_col) == lang, F.lit(p)).otherwise(keep)
    part = F.pmod(F.xxhash64(id_col, F.lit(23)), F.lit(1_000_003)) / 1_000_003.0
    rows = known.filter(part < keep).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("x"))
    got = rows.mapInArrow(_cut_windows(WINDOWS, STEPS), "lang string, w binary").orderBy("lang", "w").collect()
    return [bytes(r[1]) for r in got], [r[0] for r in got]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(*sample(docs, id_col, text_col, lang_col)))

    def run(rest, data, offs, valid):
        m, n = model.value, len(offs) - 1
        if m is None:
            best, score = pa.array(["und"] * n), np.zeros(n)
        else:
            prob = pool(m, data, offs)
            best = pa.array(m["classes"]).take(pa.array(prob.argmax(axis=1)))
            score = np.clip(prob.max(axis=1), 0.0, 1.0)
        return {"doc_id": rest.column(0), "held_out": rest.column(1), "letters": rest.column(2), "best": best, "p": score}

    held = F.coalesce(held_out(id_col), F.lit(False))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), letters.alias("letters"), F.col(text_col).alias("x"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = T.text_udf(rows, "x", ["doc_id", "held_out", "letters"],
                     f"doc_id {kind}, held_out boolean, letters boolean, best string, p double", run)
    return out.select("doc_id", "held_out", F.when(F.col("letters"), F.col("best")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
