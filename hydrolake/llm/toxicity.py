"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks (operator 2).

The kernel of two tokens compares their subsequences of three symbols that lie
within five characters, each weighted by ``DECAY`` to the power of its length,
so ``idxiot`` stays close to ``idiot`` and an insult's stem is found under any
ending; marks between letters (``i-d-i.o t``) are passed over, and a symbol for
both ends sets a stem apart from a piece inside a word and from the bare word.
A few hundred tokens of the training sample are the landmarks; the kernels with
them, whitened by the landmarks' own kernel matrix, are the features of a linear
SVM (Nyström).  Labels hold for documents, so it is trained as multiple-instance
SVM whose unit is the blank-separated token of 3 to 40 bytes.  Each round takes
the most suspicious token of each toxic document, and further ones above the
level of clean documents, as positives; a toxic document that is no more
suspicious than most clean ones is no example in that round.  Negatives are
drawn and suspicious tokens of clean documents, and the three highest of *every*
clean sample document in each round, that is the model's own mistakes.
A document scores by its three highest tokens and its length, in a logistic
model fitted on a quarter of the sample that the SVM has not seen, where each
label weighs as it does among all labelled rows.
This misses an insult of several ordinary words, which is never learnt, and one
inside a long token without blanks, which the token's norm dilutes.

The SVM's weights fold the landmarks into one table over symbol triples:
``f(token) = sum of table[triple] * weight / norm(token) + bias`` is exactly the
Nyström SVM's decision, and scoring is a few array look-ups a byte.  Every
document is scored whole, a piece at a time.

Learnt on the driver from a sample of at most ``SAMPLE`` documents a label, of at
most ``SAMPLE_CHARS`` characters each, chosen by a hash (documented bounds of the
fit; scoring has none).

Defined cases: a null text or one without tokens scores 0; with no labelled
row of both kinds every score is 0; rows with a null id are scored, never
learnt from; repeated label rows count once, as toxic if any is; repeated
documents score alike; a score equal to ``CUT`` is predicted 1; a very long text
is scored whole, in one piece of its own; an empty table gives an empty result;
other columns do not matter (names used inside start with ``_t_``).
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import text as T
from hydrolake.llm.common import stored, table

SAMPLE, SAMPLE_CHARS = 1500, 20_000
LANDMARKS, DECAY, SPAN = 400, 0.7, 5
ROUNDS = 6
CUT = 0.3
#: a text's second and third token decisions count from here on
FLOOR = -1.0

#: gaps (first to second, second to third symbol) of the subsequences within ``SPAN`` characters
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]

OTHER = 63
#: the symbol of a token's both ends
EDGE = 0
_b = np.arange(256)
#: a-z, digits, bytes beyond ASCII folded to 26 symbols; all else is passed over
SYMBOL = np.full(256, OTHER, np.int32)
SYMBOL[0x61:0x7B] = np.arange(1, 27)
SYMBOL[0x41:0x5B] = np.arange(1, 27)
SYMBOL[0x30:0x3A] = np.arange(27, 37)
SYMBOL[0x80:] = 37 + (_b[0x80:] * 7) % 26
TABLE = 1 << 18


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32(id as text) mod 4 is 2 (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def tokens(data: np.ndarray, offs: np.ndarray):
    """Byte spans of tokens; letters set apart by single spaces are one token."""
    member = T.NOT_SPACE[data]
    start, end = T.spans(member, offs)
    if len(start) > 1:
        one = end - start == 1
        tie = one[:-1] & one[1:] & (start[1:] - end[:-1] == 1)
        gap = end[:-1][tie]
        # a gap never joins two texts: the byte before a text's first is not a space of its own
        if len(gap):
            member = member.copy()
            member[gap] = True
            start, end = T.spans(member, offs)
    return member, start, end


def norms(n: int) -> np.ndarray:
    """By token length, the root of the sum of squared weights of its subsequences."""
    size = np.arange(n + 1)
    return np.sqrt(np.maximum(sum(np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in GAPS), 1e-12))


def triples(data: np.ndarray, member: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each gap pair: triple codes, whether they lie in one token, weight; then each token's first symbol and size.

    Characters that are no symbol are left out, so that marks between letters
    cost nothing.  ``EDGE`` stands before a token's first and after its last
    symbol, so that a piece inside a word differs from a stem and from a whole word.
    """
    symbol = SYMBOL[data[member]]
    known = symbol != OTHER
    token = np.repeat(np.arange(len(start)), end - start)[known]
    letters = np.bincount(token, minlength=len(start))
    size = np.where(letters > 0, letters + 2, 0)
    first = np.r_[0, np.cumsum(size)[:-1]]
    c = np.full(int(size.sum()), EDGE, np.int32)
    c[np.arange(len(token)) + (first - np.r_[0, np.cumsum(letters)[:-1]])[token] + 1] = symbol[known]
    left = np.repeat(first + size, size) - np.arange(len(c))
    out = []
    for a, b in GAPS:
        d = a + b
        if len(c) <= d:
            continue
        n = len(c) - d
        out.append(((c[:n] << 12) | (c[a:a + n] << 6) | c[d:d + n], left[:n] > d, DECAY ** (d + 1)))
    return out, first, size


def features(toks: list[bytes]):
    """Sparse rows of the tokens' normalised subsequence weights, as (row, code, value)."""
    data = np.frombuffer(b" ".join(toks), np.uint8)
    offs = np.array([0, len(data)])
    size = np.array([len(t) for t in toks])
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    member = np.zeros(len(data), bool)
    for i in range(len(toks)):
        member[start[i]:start[i] + size[i]] = True
    parts, first, size = triples(data, member, start, start + size)
    row_of = np.repeat(np.arange(len(toks)), size)
    scale = 1 / norms(int(size.max(initial=1)))[size]
    rows, codes, vals = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
    for code, ok, w in parts:
        r = row_of[:len(code)][ok]
        rows.append(r), codes.append(code[ok]), vals.append(w * scale[r])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(vals)


def kernel(toks: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Kernel matrix of tokens and landmarks."""
    mr, mc, mv = features(marks)
    used, mc = np.unique(mc, return_inverse=True)
    dense = np.zeros((len(used), len(marks)), np.float32)
    np.add.at(dense, (mc, mr), mv)
    out = np.zeros((len(toks), len(marks)), np.float32)
    for lo in range(0, len(toks), 400):
        r, c, v = features(toks[lo:lo + 400])
        at = np.minimum(np.searchsorted(used, c), len(used) - 1)
        ok = np.flatnonzero(used[at] == c)
        ok = ok[np.argsort(r[ok], kind="stable")]
        if len(ok):
            r = r[ok]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[lo + r[first]] = np.add.reduceat(dense[at[ok]] * v[ok, None].astype(np.float32), first)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated gradient descent."""
    x1 = np.c_[x, np.ones(len(x), np.float32)]
    total = weight.sum()
    lip = 2 * float(np.linalg.eigvalsh(x1.T.astype(np.float64) @ (x1 * (weight / total)[:, None].astype(np.float32)))[-1]) + reg
    w = v = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v.astype(np.float32)))
        grad = -2 * (x1.T @ (weight * y * slack).astype(np.float32)) / total + reg * np.r_[v[:-1], 0]
        new = v - grad / lip
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w[:-1], float(w[-1])


def _split(texts: list[bytes], toxic: list[int]) -> tuple[list, list]:
    """Distinct texts with their label (1 if any copy's is), dealt to the SVM and, a quarter, to the calibration."""
    seen = {}
    for x, y in zip(texts, toxic):
        seen[x] = max(seen.get(x, 0), int(y))
    rows = sorted(seen.items())
    apart = [r for r in rows if zlib.crc32(r[0]) % 4 == 0]
    own = [r for r in rows if zlib.crc32(r[0]) % 4]
    both = all({y for _, y in part} == {0, 1} for part in (own, apart))
    return (own, apart) if both else (rows, rows)


def _bags(rows: list) -> list:
    """Per text with tokens of 3 to 40 bytes: its distinct ones and the label."""
    bags = []
    for x, y in rows:
        data = np.frombuffer(x, np.uint8)
        _, start, end = tokens(data, np.array([0, len(data)]))
        low = x.lower()
        bags.append((sorted({low[a:b].strip(b".,;:!?()\"'") for a, b in zip(start, end) if 3 <= b - a <= 40} - {b""}), y))
    return [b for b in bags if b[0]]


def _codes(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each token's distinct triples, one token after the other, and where each begins."""
    parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for lo in range(0, len(vocab), 5000):  # a part at a time: the driver's memory is small
        part = vocab[lo:lo + 5000]
        r, c, _ = features(part)
        key = np.unique(r.astype(np.int64) * TABLE + c)
        parts.append((key % TABLE).astype(np.int32))
        ends.append(ends[-1][-1] + np.searchsorted(key // TABLE, np.arange(len(part)), side="right"))
    return np.concatenate(parts), np.concatenate(ends)


def _decisions(alpha: np.ndarray, bias: float, toks: list[bytes]) -> np.ndarray:
    """The folded SVM's decision on each token."""
    out = np.full(len(toks), bias)
    for lo in range(0, len(toks), 5000):
        part = toks[lo:lo + 5000]
        r, c, v = features(part)
        out[lo:lo + len(part)] += np.bincount(r, alpha[c] * v, minlength=len(part))
    return out


def fit(texts: list[bytes], toxic: list[int], seed: int = 7, weight: tuple[float, float] = (1.0, 1.0)) -> dict | None:
    """The model of a labelled sample: triple table, bias and calibration; None without both labels.

    ``weight``: how many labelled documents one of the sample stands for, by label.
    """
    own, apart = _split(texts, toxic)
    bags = _bags(own)
    pos, neg = [b for b, y in bags if y], [b for b, y in bags if not y]
    if not pos or not neg:
        return None
    rng = np.random.default_rng(seed)
    vocab = sorted({t for b, _ in bags for t in b})
    at = {t: i for i, t in enumerate(vocab)}
    pos_ids, neg_ids = ([np.array([at[t] for t in b]) for b in side] for side in (pos, neg))
    # first guess: triples that occur in many more toxic documents than in clean ones
    codes, ends = _codes(vocab)
    df, word_df = np.zeros((2, TABLE)), np.zeros((2, len(vocab)))
    for y, side in enumerate((neg_ids, pos_ids)):
        for ids in side:
            word_df[y, ids] += 1
            df[y, np.unique(np.concatenate([codes[ends[i]:ends[i + 1]] for i in ids]))] += 1
    n1, n0 = len(pos), len(neg)

    def odds_of(d, least):
        out = np.log((d[1] + 0.2) / (n1 + 1)) - np.log((d[0] + 0.2) / (n0 + 1))
        out[d[1] < least] = 0
        return out

    odds, word_odds = odds_of(df, 2), odds_of(word_df, 0)
    near = np.array([np.mean(np.sort(odds[codes[ends[i]:ends[i + 1]]])[-4:]) if ends[i] < ends[i + 1] else -9.0 for i in range(len(vocab))])
    guess = near + np.where(word_df[0] > 0, -2.0, 0.0) + 0.5 * word_odds
    # landmarks: tokens most suspect in some toxic document, in clean ones, and common and random clean ones
    votes = np.zeros(len(vocab))
    for ids in pos_ids:
        top = ids[np.argsort(-guess[ids])[:4]]
        votes[top] += guess[top]
    clean = np.flatnonzero(word_df[0] > 0)
    hard = clean[np.argsort(-near[clean], kind="stable")[:3000]]
    often = clean[np.argsort(-word_df[0][clean], kind="stable")[:LANDMARKS // 8]]
    suspects = [i for i in np.argsort(-votes, kind="stable") if votes[i] > 0][:LANDMARKS // 2]
    drawn = rng.choice(clean, min(len(clean), LANDMARKS // 8), replace=False)
    marks = [vocab[i] for i in dict.fromkeys([*suspects, *hard[:LANDMARKS // 4], *often, *drawn])]
    kmm = kernel(marks, marks).astype(np.float64)
    ev, q = np.linalg.eigh((kmm + kmm.T) / 2)
    whiten = (q * np.where(ev > 1e-6 * ev.max(), 1 / np.sqrt(np.maximum(ev, 1e-12)), 0)) @ q.T
    mr, mc, mv = features(marks)
    # negatives: random and suspicious tokens of clean documents; each round adds what it takes for toxic in every clean one
    working = set(rng.choice(clean, min(len(clean), 12_000), replace=False)) | set(hard) | set(often)
    phi = {}
    score = guess
    may = (word_df[0] == 0) | (word_odds > np.log(5))
    for turn in range(ROUNDS):
        best = np.array([max(ids, key=lambda i: (may[i], score[i])) for ids in pos_ids])
        trust = np.ones(len(best), bool)
        if turn:
            # a toxic document no more suspicious than most clean ones may hold no insult: it is no example then
            level = np.quantile([score[ids].max() for ids in neg_ids], 0.8)
            trust = score[best] > level
            if trust.sum() < max(len(best) // 4, 1):
                trust[:] = True
            for ids in neg_ids:
                working.update(ids[np.argsort(-score[ids])[:3]])
        chosen = list(best[trust])
        for ids, b, ok in zip(pos_ids, best, trust):
            # its other suspicious tokens, from the second round on
            if turn and ok:
                chosen += [i for i in ids[np.argsort(-score[ids])[:4]] if i != b and may[i] and score[i] > max(level, 0)]
        picked, times = np.unique(chosen, return_counts=True)
        minus = np.array(sorted(working - set(picked[word_odds[picked] > np.log(5)])))
        need = [i for i in np.r_[picked, minus] if i not in phi]
        for i, row in zip(need, kernel([vocab[i] for i in need], marks) @ whiten.astype(np.float32)):
            phi[i] = row
        x = np.array([phi[i] for i in np.r_[picked, minus]])
        y = np.r_[np.ones(len(picked)), -np.ones(len(minus))]
        # a token weighs by the root of its documents, and both sides weigh the same
        times, often_ = np.sqrt(times), np.sqrt(np.maximum(word_df[0, minus], 1))
        w, bias = _svm(x, y, np.r_[times * (often_.sum() / times.sum()), often_])
        alpha = np.zeros(TABLE)
        np.add.at(alpha, mc, mv * (whiten @ w)[mr])
        score = _decisions(alpha, bias, vocab)
    model = {"alpha": alpha.astype(np.float32), "bias": bias}
    # calibration on documents that the SVM has not seen, each label in its share of all labelled ones
    f = np.concatenate([decide(model, x) for x, _ in apart])
    y = np.array([y for _, y in apart])
    model["w"] = _logistic(f, y, np.where(y == 1, weight[1], weight[0]))
    return model


def _logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the offset last) of a ridge logistic regression by Newton steps.

    High tokens never speak against a label and length never for it: a column
    whose weight comes out the other way is left out.
    """
    ok = np.isfinite(f[:, 0])
    y, weight = y[ok], weight[ok] / weight[ok].mean()
    use = np.ones(f.shape[1], bool)
    while True:
        x = np.c_[f[ok] * use, np.ones(ok.sum())]
        ridge = np.r_[np.full(f.shape[1], 1e-1), 1e-4]
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge)
            w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w), -3, 3)
        wrong = w[:-1] * np.array([1, 1, 1, -1]) < -1e-9
        if not wrong.any():
            return w
        use &= ~wrong


def probability(model: dict, f: np.ndarray) -> np.ndarray:
    """Score of each text from its decisions; 0 for a text without tokens."""
    ok = np.isfinite(f[:, 0])
    z = np.where(ok[:, None], f, 0) @ model["w"][:-1] + model["w"][-1]
    return np.where(ok, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def decide_piece(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each text of a piece: its three largest token decisions and the logarithm of its tokens.

    The first is minus infinity without tokens; the others are at least ``FLOOR``.
    """
    n_docs = len(offs) - 1
    out = np.full((n_docs, 4), FLOOR)
    out[:, 0], out[:, 3] = -np.inf, 0
    member, start, end = tokens(data, offs)
    if not len(start):
        return out
    parts, first, size = triples(data, member, start, end)
    total = np.zeros(int(size.sum()), np.float32)
    alpha = model["alpha"]
    for code, ok, w in parts:
        total[:len(code)] += np.where(ok, alpha[code], 0) * np.float32(w)
    some = size > 0
    if not some.any():
        return out
    first, size = first[some], size[some]
    f = np.add.reduceat(total, first) / norms(int(size.max()))[size] + model["bias"]
    doc = T.owner(start[some], offs)
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    out[doc[new], 0] = np.maximum.reduceat(f, new)
    out[:, 3] = np.log1p(np.bincount(doc, minlength=n_docs))
    high = np.flatnonzero(f > FLOOR)
    high = high[np.lexsort((-f[high], doc[high]))]
    rank = T.ranks(doc[high])
    for k in (1, 2):
        out[doc[high][rank == k], k] = f[high][rank == k]
    return out


def decide(model: dict, text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return decide_piece(model, data, np.array([0, len(data)]))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, n: int = SAMPLE) -> tuple[list, dict]:
    """About ``n`` labelled documents of each label that are not held out, chosen by a hash of the id; each label's share drawn."""
    lab = labels.select(F.col(id_col).alias("_t_id"), F.col(label_col).alias("_t_y")).filter(
        "_t_id is not null and _t_y is not null").groupBy("_t_id").agg(F.max("_t_y").alias("_t_y"))
    lab = stored(lab.filter(~held_out("_t_id")), "labels")
    share = {r[0]: min(1.0, n / r[1]) for r in lab.groupBy("_t_y").count().collect()}  # two rows
    keep = F.lit(0.0)
    for y, p in share.items():
        keep = F.when(F.col("_t_y") == y, F.lit(p)).otherwise(keep)
    part = F.pmod(F.xxhash64("_t_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    chosen = lab.filter(part < keep)  # about 2 n rows whatever the input
    rows = docs.filter(F.char_length(text_col) <= SAMPLE_CHARS).join(F.broadcast(chosen), docs[id_col] == F.col("_t_id"))
    return rows.select(F.col(id_col), F.col(text_col), "_t_y").orderBy(id_col, text_col).collect(), share


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every document."""
    spark = docs.sparkSession
    rows, share = sample(docs, labels, label_col, id_col, text_col)
    weight = tuple(1 / share.get(y, 1.0) for y in (0, 1))
    model = spark.sparkContext.broadcast(fit([r[1].encode() for r in rows], [r[2] for r in rows], weight=weight))

    def run(rest, data, offs, valid):
        m = model.value
        s = np.zeros(len(offs) - 1) if m is None else probability(m, decide_piece(m, data, offs))
        return {"doc_id": rest.column(0), "held_out": rest.column(1), "score": s, "predicted": (s >= CUT).astype(np.int32)}

    held = F.coalesce(held_out(id_col), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("x"))
    kind = docs.schema[id_col].dataType.simpleString()
    return T.text_udf(rows, "x", ["doc_id", "held_out"], f"doc_id {kind}, held_out boolean, score double, predicted int", run)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
