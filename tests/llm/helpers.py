"""Small tables with every awkward case, and brute-force versions of the operators."""

import re
from collections import defaultdict

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = ("the quick river carries small stones past quiet villages while farmers mend their nets and children count the "
         "boats that drift below old bridges toward a distant harbour where gulls argue over scraps and bells ring twice "
         "before every evening meal is laid on long wooden tables under strings of paper lamps and the smell of bread").split()


def prose(seed, n):
    """``n`` words that differ by seed."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + ("" if r.random() < 0.4 else str(r.randrange(60))) for _ in range(n))


def near(text, seed, changes):
    import random

    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def messy_rows():
    base = prose(1, 120)
    line = "This line stands in many documents of the table."
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, near(base, 2, 2), "en", None, 1), (3, near(base, 3, 4), None, "b", 1),
        (4, None, None, "b", None), (5, "", "en", "b", 0), (6, " \t\n ", "en", "c", 4), (7, "one", "en", "c", 3), (8, "one two", "en", "d", 7),
        (9, "one", "fr", "d", 3), (10, prose(4, 9000), "en", "a", 1), (11, "\n".join([line] * 5 + [prose(5, 60)]), "en", "a", 1),
        (12, line + "\r\n  " + line.upper() + " \n" + prose(6, 70), "de", "a", 1), (13, prose(7, 80) + "\n" + line, "de", "a", 1),
        (14, "ÄÖ é ñ " * 30, "de", "e", 1), (15, "12 34 %% ## !!", "en", "e", 1), (None, prose(8, 90), "en", "a", 1),
        (None, None, None, None, None), (16, prose(9, 70) + "\n\n", "es", "a", 1), (17, "%%% " * 60 + prose(10, 60), "en", "a", 1),
        (18, "same words here " * 40, "en", "a", 1),
    ]
    return rows


#: columns whose names the operators also use inside
CLASHES = ("size", "h", "d", "t", "x", "n", "p", "w", "key", "kept", "taken", "node", "sig", "rule", "score", "item", "host",
           "n_words", "n_lines", "component_id", "c", "l", "r", "fp", "at", "target", "times", "source_size", "held_out")


def frame(spark, rows, schema=SCHEMA, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns]) if clash else df


def duck(sql, **tables):
    """Run ``sql`` over Spark frames given by name."""
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    return c.execute(sql).fetchall()


def same(df, sql, cols, **tables):
    """Whether a frame's rows equal the SQL's."""
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    c = ", ".join(cols)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(duck(f"SELECT {c} FROM ({sql})", **tables), key=key)
    assert got == want, [(g, w) for g, w in zip(got, want) if g != w][:5] or (len(got), len(want))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def components(ids, links):
    """Smallest reachable id by id."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_links(rows, k, percent=80):
    """All linked pairs ``(id, id)`` of ``(id, text)`` rows."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    by = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(n)
    out = set()
    for n, (i, s) in enumerate(sets):
        for m in set().union(*(by[x] for x in s)) if s else ():
            if m > n and 100 * len(s & sets[m][1]) >= percent * len(s | sets[m][1]):
                out.add((i, sets[m][0]))
    return out
