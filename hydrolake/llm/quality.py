"""Quality rules as weak supervision (operator 3, DataFrame functions only).

Every rule votes good (1), bad (0) or abstains (null).  Votes are folded into
a table of vote patterns and their counts (at most ``3^rules`` rows whatever
the input), on which expectation-maximisation estimates how often each rule
votes bad on good and on bad documents, without labels.  A document's posterior
probability of being good then replaces "all rules must pass".

Defined cases: a null or empty text has no words, so every measure is 0, all
rules abstain and the base rule fails it; repeated rows get equal results; a
very long text is measured whole; a posterior equal to the threshold keeps;
other columns of the input are untouched (names used inside start with
``_q_``); an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm.common import WS, let, stored, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ROUNDS = 12
#: chances of a bad vote on a good and on a bad document, and share of bad documents, before the first round
START_GOOD, START_BAD, START_SHARE = 0.01, 0.4, 0.15
#: weight of those starting values as a Beta prior, as a share of the documents
PRIOR = 0.05


def without(text: Column, chars: str) -> Column:
    """``text`` without some single characters (a scan for each is faster than a regular expression)."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def word_list(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    flat = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), WS[1:], text)
    return F.array_remove(F.split(flat, " "), "")


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Window hashes with their places are sorted; a window next to an equal one
    is repeated; the words of repeated windows are counted once each.
    """
    def of_hashes(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(s):
        same = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def covered(at):
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)), lambda wh: let(
            F.transform(F.sequence(F.lit(0), F.size(wh) - 3),
                        lambda i: F.xxhash64(F.get(wh, i), F.get(wh, i + 1), F.get(wh, i + 2))), of_hashes))))


#: columns that the measures add; input columns of these names are replaced
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_q_m", "_q_l")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures the rules look at (``n_words`` ... as long, shares as double)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    df = df.withColumn("_q_m", let(word_list(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _repeated(w).alias("n_repeat_words"))))
    df = df.withColumn("_q_l", let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))))
    bare = without(text, WS)
    return (df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in MEASURES], F.col("_q_m.n_words").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.col("_q_l.n_dup_lines").alias("n_dup_lines"), F.col("_q_m.n_repeat_words").alias("n_repeat_words"),
        F.col("_q_l.n_lines").alias("_q_lines"), F.col("_q_m.n_distinct").alias("_q_distinct"),
        (F.char_length(text) - F.char_length(without(text, "!?"))).cast("long").alias("_q_shouts"),
        # upper-case A-Z: what differs when they are removed
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("_q_caps")))


#: (measure, votes bad when true, votes good when true); neither: abstains.  Integer arithmetic, so that SQL agrees.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbol_chars", "20 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("shouting", "4 * _q_shouts > n_words", "50 * _q_shouts <= n_words"),
    ("capitals", "3 * _q_caps > word_chars", "10 * _q_caps < word_chars"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("lines", "3 * n_dup_lines > _q_lines", "10 * n_dup_lines <= _q_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words",
     "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    ("variety", "10 * _q_distinct < 2 * n_words", "10 * _q_distinct >= 3 * n_words"),
)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(df: DataFrame) -> DataFrame:
    """Adds one column ``_q_v_<rule>`` (1 good, 0 bad, null abstains); a text without words gets no vote."""
    return df.select("*", *[
        F.expr(f"CASE WHEN n_words = 0 THEN NULL WHEN {bad} THEN 0 WHEN {good} THEN 1 END").alias(f"_q_v_{name}")
        for name, bad, good in RULES])


VOTES = [f"_q_v_{name}" for name, _, _ in RULES]


def _bad_odds(params: dict) -> Column:
    """P(bad | votes); ``params``: share of bad documents and, by rule, the chances of a bad vote (good, bad)."""
    good, bad = F.lit(1 - params["share"]), F.lit(params["share"])
    for v in VOTES:
        g, b = params[v]
        good = good * F.when(F.col(v) == 0, F.lit(g)).when(F.col(v) == 1, F.lit(1 - g)).otherwise(F.lit(1.0))
        bad = bad * F.when(F.col(v) == 0, F.lit(b)).when(F.col(v) == 1, F.lit(1 - b)).otherwise(F.lit(1.0))
    return bad / (good + bad)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over the vote patterns (columns :data:`VOTES` and ``n``).

    Each round is one aggregate of at most ``3^rules`` rows to one row.
    """
    params = {"share": START_SHARE} | {v: (START_GOOD, START_BAD) for v in VOTES}
    for _ in range(rounds):
        p = patterns.withColumn("_q_p", _bad_odds(params))
        row = p.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_q_p")).alias("bad"), *[
            F.sum(F.when(F.col(v).isNotNull() if any_ else F.col(v) == 0, F.col("n") * w).otherwise(0.0)).alias(f"{v}_{k}{int(any_)}")
            for v in VOTES for k, w in (("g", 1 - F.col("_q_p")), ("b", F.col("_q_p"))) for any_ in (False, True)]).first()
        if not row["n"]:
            return params
        w = PRIOR * row["n"]
        params = {"share": (row["bad"] + w * START_SHARE) / (row["n"] + w)} | {
            v: tuple((row[f"{v}_{k}0"] + w * p0) / (row[f"{v}_{k}1"] + w)
                     for k, p0 in (("g", START_GOOD), ("b", START_BAD))) for v in VOTES}
    return params


def judge(df: DataFrame, text_col: str = "text", threshold: float = 0.5, rounds: int = ROUNDS,
          keep_text: bool = True) -> DataFrame:
    """Adds the measures, ``base_failed``, ``p_good`` and ``kept``; ``keep_text``: whether the text stays a column.

    The texts are measured once, into a stored table; its vote patterns give
    the estimates by which its rows are then judged.
    """
    measured = measures(df, text_col)
    voted = vote(stored(measured if keep_text else measured.drop(text_col), "measured"))
    patterns = stored(voted.groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n")), "patterns").coalesce(1)
    params = estimate(patterns, rounds)
    out = voted.withColumn("base_failed", base_failed()).withColumn("p_good", 1 - _bad_odds(params))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    return out.drop(*VOTES, "_q_lines", "_q_distinct", "_q_shouts", "_q_caps")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the method keeps, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = judge(docs.select(row.alias("_q_row"), F.col("text").alias("_q_text")), "_q_text", keep_text=False)
    return out.filter("kept").select("_q_row.*")


_MEASURES_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM h) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(lines) AS _q_lines, len(list_distinct(w)) AS _q_distinct,
         len(regexp_extract_all(text, '[!?]')) AS _q_shouts, len(regexp_extract_all(text, '[A-Z]')) AS _q_caps
  FROM d LEFT JOIN repeated ON d.doc_id = repeated.doc_id)"""


def oracle_sql(rounds: int = ROUNDS, threshold: float = 0.5) -> str:
    """The method in SQL: the votes, and one pair of subqueries a round of the estimation."""
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN NULL WHEN {bad} THEN 0 WHEN {good} THEN 1 END AS v_{name}" for name, bad, good in RULES)
    names = [name for name, _, _ in RULES]

    def chance(k: str, share: str) -> str:
        return " * ".join([share] + [f"CASE v_{n} WHEN 0 THEN {k}_{n} WHEN 1 THEN 1 - {k}_{n} ELSE 1.0::DOUBLE END" for n in names])

    p = f"(({chance('b', 'share')}) / (({chance('g', '(1 - share)')}) + ({chance('b', 'share')})))"
    parts = [_MEASURES_SQL, f"v AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {votes} FROM m)",
             "pat AS MATERIALIZED (SELECT " + ", ".join(f"v_{n}" for n in names) + ", count(*)::DOUBLE AS n FROM v GROUP BY ALL)",
             f"r0 AS (SELECT {START_SHARE}::DOUBLE AS share, " + ", ".join(f"{START_GOOD}::DOUBLE AS g_{n}, {START_BAD}::DOUBLE AS b_{n}" for n in names) + ")"]
    for i in range(1, rounds + 1):
        parts.append(f"p{i} AS (SELECT pat.*, {p} AS p FROM pat, r{i - 1})")
        rate = ", ".join(
            f"(coalesce(sum(n * {w}) FILTER (WHERE v_{n} = 0), 0) + {PRIOR} * sum(n) * {p0}) / (coalesce(sum(n * {w}) FILTER (WHERE v_{n} IS NOT NULL), 0) + {PRIOR} * sum(n)) AS {k}_{n}"
            for n in names for k, w, p0 in (("g", "(1 - p)", START_GOOD), ("b", "p", START_BAD)))
        parts.append(f"r{i} AS MATERIALIZED (SELECT (sum(n * p) + {PRIOR} * sum(n) * {START_SHARE}) / (sum(n) + {PRIOR} * sum(n)) AS share, {rate} FROM p{i})")
    return ",\n".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 - {p} >= {threshold} AS kept
FROM v, r{rounds}"""
