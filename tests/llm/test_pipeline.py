"""The pipeline on a small table against plain Python, stage by stage."""

import re

import corpus_pipeline as P
from hydrolake.llm import mixing, quality
from tests.llm.helpers import SCHEMA, brute_links, components, duck, frame, lower, messy_rows, near, prose


def test_pipeline(spark, tmp_path):
    rows = messy_rows()
    hot = "one more line that several documents of the table hold"
    for i in range(30):
        rows.append((200 + i, prose(200 + i, 80) + ("\n" + hot if i % 2 else ""), "en", f"s{i % 4}", 1))
    rows += [(300 + i, near(prose(200, 80), i, 1), "en", "s1", 1) for i in range(5)]
    rows += [(400, prose(400, 60) + " " + prose(77, 20), "en", "s2", 1), (401, " ".join(w + "%%%" for w in prose(401, 80).split()), "en", "s2", 1)]
    frame(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(77, 20)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    assert 4 <= len(P.STAGES) <= 5
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    seen = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{i}"))
        seen.append(spark.read.parquet(str(tmp_path / f"out{i}")))
        if i < len(P.STAGES) - 1:
            assert out.columns == names
    at = [[tuple(r)[:2] for r in d.collect()] for d in seen]
    # quality: base rules always, and prose with symbols
    bad = {i for i, t in at[0] if len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) < 50} | {18, 401}
    assert {i for i, _ in at[1]} >= {i for i, _ in at[0] if i is not None} - bad - {11, 14, 17} and not {i for i, _ in at[1]} & (bad - {None})
    # lines: by brute force
    key = lambda s: lower(s.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in at[1]:
        for s in t.split("\n"):
            holders.setdefault(key(s), set()).add(-1 if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = sorted((i if i is not None else -1, "\n".join(s for s in t.split("\n") if key(s) not in gone or gone[key(s)] == i)) for i, t in at[1])
    assert sorted((i if i is not None else -1, t) for i, t in at[2]) == want
    # near duplicates: the smallest of each component
    comp = components([i for i, _ in at[2] if i is not None], brute_links(at[2], 5))
    assert {i for i, _ in at[3] if i is not None} == {i for i, c in comp.items() if i == c}
    # benchmark
    assert {i for i, _ in at[3]} - {i for i, _ in at[4]} == {400}
    # mix
    got = {r.doc_id: r.taken for r in seen[5].collect()}
    assert got == {r[0]: r[5] for r in duck(mixing.OP1_SQL, documents=seen[4]) if r[5]}
    # run() is the same
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    cols = names + ["size", "source_size", "target", "taken", "times"]
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).select(*cols).collect()), key=str) == sorted(map(tuple, seen[5].select(*cols).collect()), key=str)


def test_stages_on_empty_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([(1, prose(77, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (frame(spark, []), frame(spark, messy_rows())):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            out.count()


def test_quality_votes_are_bounded():
    assert len(quality.RULES) <= 10
