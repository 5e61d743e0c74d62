"""Mixing, quality rules, line dedup, decontamination, URL filter and WARC against SQL and plain Python."""

import re

import pytest

from hydrolake.llm import common, decontaminate, lines, mixing, quality, urls, warc
from tests.llm.helpers import SCHEMA, duck, frame, lower, messy_rows, prose, same, words


@pytest.fixture(scope="module")
def messy(spark):
    return frame(spark, messy_rows()).cache()


@pytest.fixture(scope="module")
def unique(messy):
    return messy.filter("doc_id is not null").cache()


# ---- operator 1
OP1 = ["doc_id", "size", "source_size", "target", "taken"]


def test_mix_equals_sql(messy):
    same(mixing.mix(messy), mixing.OP1_SQL, OP1, documents=messy)


def test_mix_many_sources_without_broadcast(spark, monkeypatch):
    from hydrolake.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    docs = frame(spark, [(i, prose(i, 3 + i % 50), "en", f"s{i % 7}" if i % 3 else "s0", 1) for i in range(400)])
    same(mixing.mix(docs), mixing.OP1_SQL, OP1, documents=docs)


def test_mix_targets(spark):
    docs = frame(spark, [(i, prose(i, 40), "en", "big" if i % 10 else "tiny", 1) for i in range(600)])
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in by.values()) - total) < 1e-6
    for s, (target, size) in by.items():
        assert target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in rows if r.source == s) - target) <= 40
    assert all(r.taken <= 3 * r["size"] for r in rows)


def test_mix_is_nested_and_repeats(spark):
    docs = frame(spark, [(i, prose(i, 10), "en", f"s{i % 2}", 1) for i in range(300)])
    a = {r.doc_id: r.taken for r in mixing.mix(docs, weights=(1, 9)).collect()}
    b = {r.doc_id: r.taken for r in mixing.mix(docs, weights=(2, 8)).collect()}
    assert a == {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), weights=(1, 9)).collect()}
    assert all(a[i] <= b[i] for i in a if i % 2 == 0)  # a larger budget keeps what a smaller one took


def test_mix_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, [(1, None, None, None, None)])).count() == 0


# ---- operator 3
def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit |= {i, i + 1, i + 2}
    solid = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(solid) - len(set(solid)), len(hit))


def test_quality_measures(messy):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = [r for r in quality.judge(messy).select("text", *cols, "base_failed", "kept").collect() if len(r.text or "") < 20_000]
    assert len(rows) > 15
    for r in rows:
        want = brute_measures(r.text)
        assert tuple(r[1:6]) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_em_finds_bad_documents(spark):
    rows = [(i, prose(i, 100), "en", "a", 1) for i in range(160)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(i, 100).split()), "en", "a", 1) for i in range(20)]
    rows += [(2000 + i, " ".join(w.upper() + "!!" for w in prose(i, 100).split()), "en", "a", 1) for i in range(20)]
    kept = {r.doc_id for r in quality.kept_documents(frame(spark, rows)).collect()}
    assert kept == set(range(160))


def test_quality_plan_is_native(messy):
    plan = quality.judge(messy)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_empty(spark):
    assert quality.judge(frame(spark, [])).count() == 0
    out = quality.kept_documents(frame(spark, [(1, prose(1, 80), "en", "a", 1)], clash=False))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]


# ---- operator 7
OP7 = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def op7(df):
    from pyspark.sql import functions as F

    return lines.dedup(df).select("doc_id", "n_lines", "n_dropped", lines.digest(F.col("kept_text")).alias("kept_sha256"))


@pytest.mark.parametrize("bitmaps", [200_000, 0])
def test_line_dedup_equals_sql(unique, monkeypatch, bitmaps):
    monkeypatch.setattr(lines, "BITMAPS", bitmaps)
    same(op7(unique), lines.OP7_SQL, OP7, documents=unique)


def test_line_dedup_hot_line_over_partitions(spark):
    hot = "a line that every single document of this table holds"
    rows = [(i, "\n".join([hot, prose(i, 8) + " some more words", f"second common line {i % 5} of the table", hot]), "en", "a", 1) for i in range(500)]
    docs = frame(spark, rows).repartition(7)
    same(op7(docs), lines.OP7_SQL, OP7, documents=docs)


def test_line_dedup_stream_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_line_dedup_hot_line_over_partitions(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("bitmaps", [200_000, 0])
def test_line_dedup_repeated_ids_and_nulls(spark, monkeypatch, bitmaps):
    monkeypatch.setattr(lines, "BITMAPS", bitmaps)
    hot = "a line that stands in more than two documents"
    docs = frame(spark, [(1, hot, "", "", 1), (1, hot, "", "", 1), (None, hot, "", "", 1), (2, hot + "\nx", "", "", 1), (2, "y\n" + hot, "", "", 1)])
    got = sorted(((r.doc_id or -1), r.kept_text) for r in lines.dedup(docs).collect())
    # ids 1, 2 and null are three documents; the largest keeps its lines in both of its rows
    assert got == [(-1, ""), (1, ""), (1, ""), (2, hot + "\nx"), (2, "y\n" + hot)]


def test_line_dedup_empty(spark):
    assert lines.dedup(frame(spark, [])).count() == 0


# ---- operator 6
OP6 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def op6(docs, items):
    from pyspark.sql import functions as F

    out = decontaminate.contamination(docs, items)
    return out.select(F.col("d").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@pytest.fixture(scope="module")
def items(spark):
    w = words(messy_rows()[0][1])
    rows = [(10, " ".join(w[20:45])), (2, " ".join(w[20:45]).upper() + "."), (3, "one two"), (4, ""), (5, None), (6, "one"),
            (7, " ".join(words(prose(4, 9000))[8000:8013])), (8, " ".join(w[30:39])), (9, "nothing like this is anywhere in the table at all, really nothing")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_equals_sql(unique, items):
    same(op6(unique, items), decontaminate.OP6_SQL, OP6, documents=unique, benchmark=items)


def test_decontamination_nulls_and_repeats(messy, items):
    both = messy.unionByName(messy)
    assert op6(both, items).count() == both.count()


def test_winnowing_guarantee():
    import numpy as np

    from hydrolake.llm import text as T

    for seed in range(30):
        shared = prose(1000 + seed, 10)
        a, b = (prose(seed * 2 + i, 30) + " " + shared + " " + prose(seed * 3 + i, 25) for i in (0, 1))
        prints = []
        for x in (a, b):
            data = np.frombuffer(x.encode(), np.uint8)
            h, doc, _, _ = T.words(data, np.array([0, len(data)]), T.LOWERED, T.ALNUM)
            prints.append(set(decontaminate.fingerprints(h, doc)[1].tolist()))
        assert prints[0] & prints[1]


def test_decontamination_empty(spark, messy, items):
    assert op6(frame(spark, []), items).count() == 0
    assert op6(messy, items.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.clean_documents(messy, items.filter("false")).count() == messy.count()


# ---- operator 8
OP8 = ["page_id", "host", "path", "rule", "verdict"]
PAGES = [(1, "http://WWW.example.com/en/x?y#z"), (2, "https://example.com/en/"), (3, "https://a.net/es/1"), (4, "https://net/es/1"), (5, None),
         (6, "no scheme"), (7, "http://x.free-bets.example.org/de/9/"), (8, "http://x.free-bets.example.org/de/9#q"), (9, "http://good.example.org/a"),
         (10, "ftp://host.com"), (11, "http://evilnet/es/"), (12, "://"), (13, "http://a.com?x=/en/"), (14, "http://b.NET/fr/é"), (14, "http://b.NET/fr/é"),
         (15, "http://x.free-bets.example.org/de/99"), (None, "http://free-bets.example.org/"), (16, "http://A.net/de/7/"), (17, "http://a.net/de/7?x"),
         (18, "http://a.net/de/8"), (19, "http://a.net/de/9"), (20, "http://c.net/es/1"), (21, "http://c.net/1"), (22, "http://c.net/2"), (23, "http://c.net/3"),
         (24, "http://c.net/4")]


@pytest.mark.parametrize("rows", [20_000, 0])
def test_urls_equal_sql(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    pages = frame(spark, PAGES, "page_id long, url string")
    same(urls.judge(pages, urls.site_list(pages)), urls.OP8_SQL, OP8, pages=pages)
    # one page of four blocked by a rule is enough, one of five is not
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages, urls.site_list(pages)).collect()}
    assert [verdicts[k] for k in (16, 17, 18, 19, 21, 22)] == ["allow"] * 6
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages, urls.site_list(pages.filter("page_id not in (19, 24)"))).collect()}
    assert [verdicts[k] for k in (16, 17, 18, 21, 22, 24)] == ["block"] * 5 + ["allow"]


def test_urls_hot_and_empty(spark):
    pages = frame(spark, [(i, f"http://x.net/{'es' if i % 4 == 1 else 'de'}/x" if i % 2 else f"http://h{i}.org/") for i in range(300)], "page_id long, url string")
    same(urls.judge(pages, urls.site_list(pages)), urls.OP8_SQL, OP8, pages=pages)
    assert urls.judge(pages.filter("false"), urls.site_list(pages)).count() == 0
    assert urls.judge(pages, spark.createDataFrame([], "url string")).filter("verdict = 'block' and rule is null").count() == 0


def test_urls_of_a_list_counted_large_are_not_broadcast(spark, monkeypatch):
    """Spark's estimate does not see that a list is repeated under salts: the driver would hold all copies."""
    pages = frame(spark, [(i, f"http://h{i % 40}.net/{'es' if i % 3 else 'de'}/{i % 150}") for i in range(600)], "page_id long, url string")
    small = urls.judge(pages, urls.site_list(pages))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    for module in (common, urls):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 10)
    sites = urls.site_list(pages)
    large = urls.judge(pages, sites)
    for df in (sites, large):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    same(large, urls.OP8_SQL, OP8, pages=pages)
    assert large.exceptAll(small).count() == 0 and small.exceptAll(large).count() == 0


def test_urls_listed_in_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# a comment\n\nhttp://X.free-bets.example.org/de/9/\n  good.example.org/a \nhttp://good.example.org/a/?q\n")
    listed = urls.url_list(spark.read.text(str(tmp_path / "list.txt")), "value")
    assert sorted(r.url for r in listed.collect()) == ["good.example.org/a", "x.free-bets.example.org/de/9"]
    pages = frame(spark, PAGES, "page_id long, url string")
    got = {r.page_id for r in urls.judge(pages, listed).filter("verdict = 'block' and rule is null").collect()}
    assert got == {7, 8, 9}


def test_bloom_has_no_false_negatives(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from hydrolake.llm import bloom

    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    bits = bloom.build(keys, "h")
    h = np.array([r[0] for r in keys.collect()], np.int64)
    assert bloom.test(bits, h).all()
    other = np.array([r[0] for r in spark.range(50_000, 70_000).select(F.xxhash64("id")).collect()], np.int64)
    assert bloom.test(bits, other).mean() < 0.02


# ---- operator 9
OP9 = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
HTML = [(1, "http://b.org/1", "<p>é"), (2, "http://a.org/\r\n2", "<p>é"), (3, None, None), (4, "http://a.org/2", ""),
        (5, "http://c.org", "WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\nWARC/1.0\r\nWARC/1.0\r\n"), (6, "http://a.org/2#f", "\r\n\r\n"),
        (7, "http://a.org/2", "long " * 50_000), (8, "x", "end\r\n\r\n")]


def op9(df):
    from pyspark.sql import functions as F

    return warc.histories(df).select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                     F.col("kind").alias("record_type"), "refers_to")


def test_warc_round_trip_equals_sql(spark):
    pages = frame(spark, HTML, "page_id long, url string, html string")
    same(op9(pages), warc.OP9_SQL, OP9, pages=pages)
    assert warc.histories(pages).filter("not intact").count() == 0


def test_warc_global_order(spark):
    pages = frame(spark, [(i, f"http://h{i * 7 % 13}.org/{i % 3}", f"<p>{i % 50}") for i in range(700)], "page_id long, url string, html string").repartition(6)
    rows = [(r.key, r.time, r.page_id) for r in warc.histories(pages).collect()]
    assert rows == sorted(rows) and len(rows) == 700
    same(op9(pages), warc.OP9_SQL, OP9, pages=pages)


def test_warc_many_repeated_payloads(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    rows = [(i, f"http://h{i % 7}.org/{i}", f"<p>{i % 40 if i % 3 else i}") for i in range(500)] + [(7, "http://again.org", "<p>7"), (None, "u", "<p>1"), (None, "u", None)]
    pages = frame(spark, rows, "page_id long, url string, html string").repartition(5)
    whole = pages.filter("page_id is not null")
    same(op9(whole), warc.OP9_SQL, OP9, pages=whole)
    got = warc.records(pages).filter("page_id is null").select("kind", "top").collect()
    assert len(got) == 2 and {r.kind for r in got} == {"response", "revisit"}
    assert warc.histories(pages).filter("not intact").count() == 0
    plan = warc.records(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftOuter" not in plan


def test_warc_mark_in_payload(spark):
    pages = frame(spark, [(1, "http://a.org", warc.MARK * 20_000), (2, "http://b.org", "x" + warc.MARK)], "page_id long, url string, html string")
    got = {r.page_id: (r.n, r.intact) for r in warc.histories(pages).collect()}
    assert got == {1: (20_000 * len(warc.MARK), True), 2: (len(warc.MARK) + 1, True)}


def test_warc_nulls_repeats_empty(spark):
    pages = frame(spark, [(None, "u", "a"), (None, "u", "a"), (1, "u", "b"), (1, "u", "b"), (None, "u", "b")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in op9(pages).collect())
    assert got == [(0, "response", None), (0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert op9(pages.filter("false")).count() == 0


def test_loser_tree():
    import random

    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_duck_helper(messy):
    assert duck("SELECT count(*) FROM documents", documents=messy)[0][0] == messy.count() and lower("ÄA") == "Äa"
