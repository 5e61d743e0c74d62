r"""Personal data by patterns and by what reveals it (operator 13, DataFrame functions only).

The patterns give the protected entities: mail and IP addresses, card and
phone numbers.  Information-theoretic sanitisation then asks which words tell
them: a word that hardly occurs but near one entity discloses it as surely as
its text.  Over the whole corpus, with N words,

    IC(e)    = log2(N / c(e))                      what the entity's value is worth
    PMI(e;t) = log2(N * c(e,t) / (c(e) * c(t)))    what term t tells of it
    D(e;t)   = PMI(e;t) / IC(e)                    the disclosed share, at most 1

where c(t) counts t in all texts, c(e) the words within :data:`REACH` code
points of e, and c(e,t) the occurrences of t among them.  A term with D of at
least :data:`GENERALISE`, met near e in :data:`SUPPORT` or more different texts, is
generalised (to ``<term>``); from :data:`REMOVE` on it is removed, in every text
that holds it.

Plan: one pass finds the entities and cuts out their surroundings (no text is
shuffled or kept); their words are counted with partial aggregates.  Terms whose
share stays below the threshold even if they occurred nowhere but near entities
are dropped, which is exact; a second pass counts the remaining ones in all
texts.  Texts are known by 128 bits of hash, so a copy is one text with several
rows.  What is broadcast is counted first; larger tables are joined under salts.

Patterns are written so that no text is matched in more than linear time: a
match starts at the start of its run of characters or where the last one ended,
and repetitions are possessive, which Java runs without recursion.

Defined cases: a null or empty text has no spans; repeated rows get equal
results; of spans that start together, the kinds are ordered email, ip, card,
phone, term; a term that overlaps a span of a pattern is not added; a tie at a
threshold counts as reached; a very long text is one row, and places are summed
in pieces, so its cost stays linear; an empty table gives an empty result; other
columns are not read by :func:`find` and come through :func:`sanitise` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm.common import LOWER, UPPER, join_small, let, stored, table

#: (kind, pattern, what a text must hold for the pattern to be tried)
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")))
IP = (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", lambda t: t.rlike(r"[0-9]\.[0-9]"))
CARD = (r"[0-9]++(?:[ -][0-9]++)*+", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"))
PHONE = (r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")))
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
NAMES = [*KINDS, "term"]
#: a term: a run of letters (A-Z, a-z and everything beyond ASCII)
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_TERM = 3
REACH = 80
SUPPORT = 3
GENERALISE, REMOVE = 0.9, 0.97
#: places are summed in pieces of so many matches
PIECE = 64

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: (F.char_length(F.ltrim(x, F.lit("0"))) <= 3)
                        & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.translate(m, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _starts(steps: Column) -> Column:
    """Where each match starts, for ``steps`` of (gap before it, its size): sums within pieces, then over the pieces."""
    def pieces(s):
        return F.sequence(F.lit(0), F.floor((F.size(s) - 1) / PIECE).cast("int"))

    def part(s, j):
        return F.slice(s, j * PIECE + 1, PIECE)

    def running(s, base):
        return F.flatten(F.transform(pieces(s), lambda j: F.aggregate(
            part(s, j), F.struct(F.get(base, j).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")),
            lambda a: a["out"])))

    def base(s):
        sums = F.transform(pieces(s), lambda j: F.aggregate(part(s, j), F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        return F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(
        let(steps, lambda s: let(base(s), lambda b: running(s, b))))


def _matches(text: Column, pattern: str, extra) -> Column:
    """One struct (start, end, ``extra(match, piece before, piece behind)``) a match, in order.

    The pieces between the matches and the matches themselves give the places.
    """
    def placed(pieces, hits):
        steps = F.transform(hits, lambda x, i: F.struct(F.char_length(F.get(pieces, i)).alias("gap"), F.char_length(x).alias("size")))
        return let(_starts(steps), lambda at: F.transform(hits, lambda x, i: F.struct(
            F.get(at, i).alias("start"), (F.get(at, i) + F.char_length(x)).alias("end"), x.alias("value"),
            *extra(x, F.get(pieces, i), F.get(pieces, i + 1)))))

    return let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: placed(p, h)))


def _entities(text: Column, kind: str) -> Column:
    """Valid matches of a kind: (start, kind, end, entity, surroundings)."""
    pattern, held = KINDS[kind]
    number = NAMES.index(kind)

    def around(x, before, behind):
        # a word that the reach cuts in two is left out
        left = F.when(F.char_length(before) > REACH, F.regexp_replace(F.right(before, F.lit(REACH)), f"^{LETTERS}", "")).otherwise(before)
        right = F.when(F.char_length(behind) > REACH, F.regexp_replace(F.left(behind, F.lit(REACH)), f"{LETTERS}$", "")).otherwise(behind)
        return F.concat(left, F.lit(" "), right).alias("around"),

    value = (lambda x: F.lower(x)) if kind == "email" else (lambda x: F.regexp_replace(x, "[^0-9.]" if kind == "ip" else "[^0-9]", ""))
    good = F.transform(F.filter(_matches(text, pattern, around), lambda m: _valid(kind, m["value"])), lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"),
        F.xxhash64(F.lit(number), value(m["value"])).alias("entity"), m["around"].alias("around")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,entity:bigint,around:string>>")
    return F.when(held(text), good).otherwise(none)


def _text(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(text, F.lit(1)).alias("_k2")]


def measured(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """One pass: ``keep``, the text's hash, its spans, their surroundings and its number of words (by blanks)."""
    text = _text(text_col)
    found = docs.select(*[F.col(f"`{c}`") for c in keep], *_identity(text),
                        (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("_words"),
                        F.array_sort(F.concat(*[_entities(text, k) for k in KINDS])).alias("_found"))
    return stored(found, "pii-found")


def _terms(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    return F.filter(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0)), lambda t: F.char_length(t) >= MIN_TERM)


def disclosing(docs: DataFrame, found: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(term, disclosed)`` of the terms that reveal an entity, and ``(_k1, _k2, term)``: the texts that hold them."""
    n_words = found.agg(F.coalesce(F.sum("_words"), F.lit(0))).first()[0] or 1
    near = (found.filter(F.size("_found") > 0).select("_k1", "_k2", F.explode("_found").alias("f"))
            .select("_k1", "_k2", "f.entity", F.explode(_terms(F.col("f.around"))).alias("term")))
    near = stored(near.groupBy("entity", "term", "_k1", "_k2").agg(F.count(F.lit(1)).alias("c")), "pii-near")
    by_entity = near.groupBy("entity").agg(F.sum("c").alias("c_e"))
    pairs = near.groupBy("entity", "term").agg(F.sum("c").alias("c_et"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SUPPORT)
    pairs = stored(pairs.join(by_entity, "entity"), "pii-pairs")
    # at least so often does a term occur: the bound that drops frequent words before the texts are read again
    local = near.groupBy("term").agg(F.sum("c").alias("c_t"))
    local = stored(local.join(pairs.select("term").distinct(), "term"), "pii-local")
    n_local = local.count()
    share = share_column(n_words)
    open_ = join_small(pairs, local, ["term"], n_local, F.xxhash64("entity")).filter(share >= GENERALISE)
    open_ = stored(open_.drop("c_t"), "pii-open")
    terms = stored(open_.select("term").distinct(), "pii-terms")
    n_terms = terms.count()
    text = _text(text_col)
    if not n_terms:
        empty = terms.withColumn("disclosed", F.lit(0.0))
        return empty, terms.select(F.lit(0).cast("long").alias("_k1"), F.lit(0).cast("long").alias("_k2"), "term")
    words = docs.select(*_identity(text), F.explode(_terms(text)).alias("term"))
    held = join_small(words, terms, ["term"], n_terms, F.col("_k1"))
    held = stored(held.groupBy("_k1", "_k2", "term").agg(F.count(F.lit(1)).alias("c")), "pii-held")
    counts = held.groupBy("term").agg(F.sum("c").alias("c_t"))
    told = (open_.join(counts, "term").withColumn("c_et", F.least("c_et", "c_t")).withColumn("disclosed", share)
            .filter(F.col("disclosed") >= GENERALISE).groupBy("term").agg(F.max("disclosed").alias("disclosed")))
    told = stored(told, "pii-told")
    return told, join_small(held.drop("c"), told.select("term"), ["term"], told.count(), F.col("_k1"))


def share_column(n_words: int) -> Column:
    """D(e;t), from c_et, c_e and c_t, to nine digits; an entity whose surroundings are the whole corpus tells nothing."""
    c_e = F.least(F.col("c_e"), F.lit(n_words)).cast("double")
    n = float(n_words)
    pmi = F.log(F.least(F.col("c_et"), F.col("c_t")).cast("double") * F.lit(n) / (F.col("c_t").cast("double") * c_e))
    return F.when(c_e >= n, F.lit(0.0)).otherwise(F.round(pmi / F.log(F.lit(n) / c_e), 9))


def _term_spans(text: Column, terms: Column) -> Column:
    """The places of a text's disclosing terms: (start, end, term)."""
    low = F.translate(text, UPPER, LOWER)
    hits = F.filter(_matches(low, LETTERS, lambda *_: ()), lambda m: F.array_contains(terms, m["value"]))
    return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans, told)`` a row: the patterns' spans, all spans (start, kind, end), and the terms with their shares."""
    found = measured(docs, [id_col], text_col)
    told, held = disclosing(docs, found, text_col)
    # a text's own terms (no more than it has words), with what each discloses
    named = join_small(held, told, ["term"], told.count(), F.col("_k1"))
    lists = stored(named.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("term", "disclosed"))).alias("told")), "pii-lists")
    n_lists = lists.count()
    text = _text(text_col)
    slim = docs.select(text.alias("_text"), *_identity(text))
    located = join_small(slim, lists, ["_k1", "_k2"], n_lists, F.rand(7) * 1000)
    located = located.select("_k1", "_k2", "told", _term_spans(F.col("_text"), F.transform("told", lambda t: t["term"])).alias("at"))
    located = stored(located.groupBy("_k1", "_k2").agg(F.first("told").alias("told"), F.first("at").alias("at")), "pii-located")
    base = F.transform("_found", lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end")))
    out = join_small(found.withColumn("base", base.cast(_SPAN)).drop("_found", "_words"), located, ["_k1", "_k2"], n_lists,
                     F.rand(8) * 1000, "left")
    free = F.filter("at", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"])))
    extra = F.transform(free, lambda a: F.struct(a["start"].alias("start"), F.lit(NAMES.index("term")).alias("kind"), a["end"].alias("end")))
    spans = F.array_sort(F.concat(F.col("base"), F.coalesce(extra, F.array().cast(_SPAN))))
    return out.select(F.col(f"`{id_col}`").alias("id"), "_k1", "_k2", "base", spans.alias("spans"), "told")


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced: an entity and a generalised term by ``<kind>``, a removed term by nothing.

    Of overlapping spans the one that starts first (the longer one, of those
    that start together) stands for all of them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    spans = find(packed.withColumn("_none", F.lit(0)), "_none", "_text").groupBy("_k1", "_k2").agg(
        F.first("spans").alias("spans"), F.first("told").alias("told")).filter(F.size("spans") > 0)
    spans = stored(spans, "pii-spans")
    text = _text("_text")
    keyed = packed.select("_row", F.col("_text"), *_identity(text))
    both = join_small(keyed, spans, ["_k1", "_k2"], spans.count(), F.rand(9) * 1000, "left")
    names = F.array(*[F.lit(f"<{n}>") for n in NAMES])
    low = F.translate(F.col("_text"), UPPER, LOWER)

    def step(a, s):
        word = F.substr(low, s["start"] + 1, s["end"] - s["start"])
        gone = (s["kind"] == NAMES.index("term")) & F.exists("told", lambda t: (t["term"] == word) & (t["disclosed"] >= REMOVE))
        mark = F.when(gone, F.lit("")).otherwise(F.get(names, s["kind"]))
        more = F.struct(F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), mark).alias("out"),
                        s["end"].alias("at"))
        return F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(more)

    longest = F.array_sort("spans", lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"])
                           .when(x["end"] != y["end"], y["end"] - x["end"]).otherwise(x["kind"] - y["kind"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(longest, start, step, lambda a: F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1)))
    text_out = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(clean)
    return both.select("_row", text_out.alias("_clean")).select(
        *[F.col("_clean").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == NAMES.index(kind))).cast("long").alias(f"n_{kind}")

    return got.select(F.col("id").alias("doc_id"), *[number(k) for k in KINDS],
                      F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SQL_VALID = {
    "email": "TRUE",
    "ip": "list_bool_and([length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) <= 255 FOR x IN string_split(m, '.')])",
    "card": "length(g) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (length(g) - i) % 2 = 0 THEN g[i]::INT ELSE (g[i]::INT * 2) // 10 + (g[i]::INT * 2) % 10 END "
            "FOR i IN range(1, length(g) + 1)]) % 10 = 0",
    "phone": "length(g) BETWEEN 10 AND 15",
}
_SQL_ENTITY = {"email": "lower(m)", "ip": "m", "card": "g", "phone": "g"}


def oracle_sql() -> str:
    """The patterns in their plain form, and the method, in DuckDB SQL."""
    parts = ["d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)",
             "nw AS (SELECT sum(length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS n FROM d)"]
    low = f"translate(x, '{UPPER}', '{LOWER}')"
    for i, (kind, pattern) in enumerate(_SQL_PATTERNS.items()):
        parts.append(f"""a{i} AS (SELECT r, text, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS h FROM d
  WHERE regexp_matches(text, '{pattern}'))""")
        parts.append(f"""u{i} AS (SELECT r, i, h[i] AS m, p[i] AS before, p[i + 1] AS behind,
  regexp_replace(h[i], '[^0-9]', '', 'g') AS g FROM (SELECT r, p, h, unnest(range(1, len(h) + 1)) AS i FROM a{i}))""")
        parts.append(f"""k{i} AS MATERIALIZED (SELECT r, {i} AS kind, z AS start, z + length(m) AS stop, '{kind}:' || ({_SQL_ENTITY[kind]}) AS entity,
  CASE WHEN length(before) > {REACH} THEN regexp_replace(right(before, {REACH}), '^{LETTERS}', '') ELSE before END || ' ' ||
  CASE WHEN length(behind) > {REACH} THEN regexp_replace(left(behind, {REACH}), '{LETTERS}$', '') ELSE behind END AS x
  FROM (SELECT *, (sum(length(before) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m))::BIGINT AS z FROM u{i}) WHERE {_SQL_VALID[kind]})""")
    parts += [
        "k AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(_SQL_PATTERNS))) + ")",
        f"""near AS MATERIALIZED (SELECT entity, t, text, count(*) AS c FROM (SELECT entity, text, unnest(regexp_extract_all({low}, '{LETTERS}')) AS t
  FROM k JOIN d USING (r)) WHERE length(t) >= {MIN_TERM} GROUP BY ALL)""",
        "ce AS (SELECT entity, sum(c) AS c_e FROM near GROUP BY entity)",
        f"""pairs AS (SELECT entity, t, sum(c) AS c_et FROM near GROUP BY entity, t HAVING count(*) >= {SUPPORT})""",
        f"""held AS MATERIALIZED (SELECT r, t, count(*) AS c FROM (SELECT r, unnest(regexp_extract_all({low.replace('x,', 'text,')}, '{LETTERS}')) AS t FROM d)
  WHERE t IN (SELECT t FROM pairs) GROUP BY ALL)""",
        "ct AS (SELECT t, sum(c) AS c_t FROM held GROUP BY t)",
        f"""told AS (SELECT DISTINCT t FROM pairs JOIN ce USING (entity) JOIN ct USING (t), nw WHERE c_e < n AND
  round(ln(least(c_et, c_t)::DOUBLE * n / (c_t::DOUBLE * c_e::DOUBLE)) / ln(n / c_e::DOUBLE), 9) >= {GENERALISE})""",
        f"""hit AS (SELECT r, string_split_regex(text, '{LETTERS}') AS p, regexp_extract_all(text, '{LETTERS}') AS h FROM d
  WHERE r IN (SELECT r FROM held JOIN told USING (t)))""",
        """tok AS (SELECT *, (sum(length(before) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m))::BIGINT AS start
  FROM (SELECT r, i, h[i] AS m, p[i] AS before FROM (SELECT r, p, h, unnest(range(1, len(h) + 1)) AS i FROM hit)))""",
        f"""terms AS (SELECT r, 4 AS kind, start, start + length(m) AS stop FROM tok WHERE {low.replace('x,', 'm,')} IN (SELECT t FROM told)
  AND NOT EXISTS (SELECT 1 FROM k WHERE k.r = tok.r AND k.start < tok.start + length(m) AND k.stop > tok.start))""",
        """spans AS (SELECT r, kind, start, stop, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop AS s
  FROM (SELECT r, kind, start, stop FROM k UNION ALL SELECT * FROM terms))""",
        """sums AS (SELECT r, """ + ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{n}" for i, n in enumerate(_SQL_PATTERNS)) + """,
  string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind < 4) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY r)"""]
    return ("WITH " + ",\n".join(parts) + "\nSELECT doc_id, " + ", ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n in _SQL_PATTERNS)
            + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN sums USING (r)")


OP13_SQL = oracle_sql()
