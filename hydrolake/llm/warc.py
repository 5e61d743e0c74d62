"""WARC archives and the merge of their indexes (operator 9).

Writing: every page becomes a record.  Of pages with equal payloads the one with
the largest id is a ``response``, the others ``revisit`` it without a payload.
Each task sorts its captures by URL key and time and writes them through
Spark's text writer (a record is a "line" that ends in two CRLF), so any file
system works and lost tasks are written again: each file is a locally sorted
capture run.

Reading: records are cut at ``WARC/1.0``; a payload that holds this text itself
is put together again by its Content-Length.  Files are gzipped as a whole and
so are never split.

Merging: the key range is cut by sampled boundaries into ranges of bounded size;
in each, a loser tree merges the sections of all runs.  The ranges in order are
the globally ordered capture histories.

Defined cases: a null or empty payload has 0 bytes and takes part like any
other; a null URL has an empty key and no target header; a page with a null id
never stands for others with the same payload unless all their ids are null;
rows that repeat an id and a payload are all responses or all revisits; captures
equal in key and time follow their ids; a very long payload is one record; an
empty table gives an empty archive and an empty index; other columns do not
matter.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import bloom
from hydrolake.llm.common import BROADCAST_ROWS, LOWER, UPPER, join_small, stored, table
from hydrolake.session import scratch_path

CRLF = "\r\n"
MARK = "WARC/1.0\r\n"
#: captures a file, and captures a range of the merge, at most about so many
RUN_ROWS, RANGE_ROWS = 50_000, 200_000

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four digits for each five hexadecimal ones."""
    h = F.sha1(payload.cast("binary"))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]), _HEX32, _BASE32)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then the rest without the fragment; empty without a URL."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^/?#]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.when(rest != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)).otherwise("")


def capture_time(page_id: Column) -> Column:
    """The tables hold no times: pages count as captured a second apart, in order of their ids."""
    return F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(page_id.cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _kinds(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("top").isNull() | F.col("page_id").eqNullSafe(F.col("top")), "response").otherwise("revisit")
    return df.withColumn("kind", kind).withColumn("key", url_key(F.col("url"))).withColumn("time", capture_time(F.col("page_id")))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id url html`` plus key, time, size, digest, ``top`` (the response's id) and ``kind``.

    Few repeated payloads are broadcast.  With more, the kinds are settled on narrow rows:
    revisits are made of these (their ``html`` is empty, as in their records) and pages
    that a Bloom filter clears of being one stay where they are; only pages that it takes for
    revisits by mistake are looked up by name.
    """
    df = pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    df = df.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", sha1_base32(F.col("html")))
    # payloads that occur more than once, folded before the shuffle
    tops = stored(df.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.max("page_id").alias("top"))
                  .filter("c > 1 and top is not null").select("digest", "top"), "tops")
    n_tops = tops.count()
    if n_tops <= BROADCAST_ROWS:
        return _kinds(join_small(df, tops, ["digest"], n_tops, F.xxhash64("page_id"), "left"))
    name = F.concat_ws(":", "digest", F.col("page_id").cast("string"))
    narrow = stored(df.drop("html").withColumn("name", name), "payloads")
    revisits = join_small(narrow, tops, ["digest"], n_tops, F.xxhash64("page_id", "url"))
    revisits = stored(revisits.filter(~F.col("page_id").eqNullSafe(F.col("top"))), "revisits")
    names = stored(revisits.select("name").distinct(), "names")
    wrong = bloom.marked(narrow.select("name"), names, "name", "may").filter("may").select("name").distinct()
    wrong = stored(wrong.join(names, "name", "left_anti"), "wrong")
    both = bloom.marked(df.withColumn("name", name), names, "name", "may")
    responses = both.filter("not may").drop("may").unionByName(bloom.semi_join(both.filter("may").drop("may"), wrong, "name"))
    return _kinds(responses.withColumn("top", F.lit(None).cast(tops.schema["top"].dataType))
                  .unionByName(revisits.withColumn("html", F.lit("")))).drop("name")


def _safe(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_text(df: DataFrame) -> Column:
    """A record without the two CRLF that end it."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    revisit = F.col("kind") == "revisit"
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return F.concat(
        F.lit(MARK), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", _safe(F.col("url"))), F.lit("")), line("WARC-Date", F.col("time")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
                                 line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("top").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("X-Key", _safe(F.col("key"))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF), F.when(revisit, F.lit("")).otherwise(F.col("html")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, run_rows: int = RUN_ROWS) -> None:
    """Write ``path/*.gz``, each a run sorted by URL key, time and id."""
    df = records(pages, min_bytes).sortWithinPartitions("key", "time", "page_id")
    (df.select(record_text(df).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", run_rows).text(path))


_INDEX = ("key string, time string, page_id long, kind string, digest string, n long, refers_to long, run string, seq long, "
          "intact boolean")
_NAMES = [f.split()[0] for f in _INDEX.split(", ")]


def _parse(batches):
    """Index rows of records; the pieces of one record are collected and joined once, by Content-Length."""
    mark = MARK.encode()
    run, seq = None, 0
    pieces: list[bytes] = []  # of the open record
    head, body, need = None, 0, 0  # its header fields, the bytes after them and how many these must be

    def page(value: str | None):
        value = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value not in ("", "null") else None

    for b in batches:
        out = []
        for piece, name in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
            if name != run:
                if pieces:
                    raise ValueError(f"{run}: the last record is not complete")
                run, seq = name, 0
            if not piece and not pieces:
                continue  # what stands before the first mark
            pieces += [mark, piece] if pieces else [piece]
            if head is None:
                first, end, rest = b"".join(pieces).partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in first.decode("utf-8", "replace").split(CRLF) if ": " in x)
                if not end or "Content-Length" not in fields:
                    continue
                head, pieces, body, need = fields, [rest], len(rest), int(fields["Content-Length"]) + 4
            else:
                body += len(mark) + len(piece)
            if body < need:
                continue
            payload = b"".join(pieces)[:need - 4]
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            intact = head["WARC-Type"] == "revisit" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
            out.append((head.get("X-Key", ""), head["WARC-Date"], page(head["WARC-Record-ID"]), head["WARC-Type"], digest,
                        int(head["X-Payload-Length"]), page(head.get("WARC-Refers-To")), run, seq, intact))
            head, pieces = None, []
            seq += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], names=_NAMES)
    if pieces:
        raise ValueError(f"{run}: the last record is not complete")


_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in _INDEX.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row per record of the archives, in the order of each run."""
    raw = spark.read.option("lineSep", MARK).text(path).select("value", F.col("_metadata.file_name").alias("run"))
    return raw.mapInArrow(_parse, _INDEX)


class LoserTree:
    """A tournament over sorted runs: each inner node keeps the loser, the top the smallest head."""

    def __init__(self, runs: list):
        self.runs, self.at, self.n = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(self.n, 1)
        winner = [0] * (2 * self.n)
        for i in range(self.n):
            winner[self.n + i] = i
        for node in range(self.n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winner[1] if self.n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        return x and (not y or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b))

    def __iter__(self):
        while self.n:
            w = self.tree[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (self.n + w) // 2
            while node:
                if self._before(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.tree[0] = w


def _merge(batches):
    """Merge the sections of all runs in one key range; rows come run by run, each in order."""
    parts = list(batches)
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    key, time, page, run, seq = (t.column(c).to_pylist() for c in ("key", "time", "page_id", "run", "seq"))
    runs: list[list] = []
    for i, r in enumerate(run):
        if not i or r != run[i - 1]:
            runs.append([])
        runs[-1].append((key[i], time[i], page[i] is not None, page[i] or 0, r, seq[i], i))
    order = [x[-1] for x in LoserTree(runs)]
    yield from t.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)


def merge_indexes(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index ordered by URL key, time and id over all its partitions."""
    index = stored(index, "runs")
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // range_rows + 1)
    # a much repeated URL is cut by time and id
    ranged = index.repartitionByRange(parts, "key", "time", "page_id").sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(_merge, _INDEX)


def histories(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and merge their indexes."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return merge_indexes(read_archives(spark, path))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histories(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                      F.col("kind").alias("record_type"), "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha1(html) AS hex FROM p),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 8), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> 15) & 31) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> 10) & 31) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> 5) & 31) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * i + 1, 5))::BIGINT & 31) + 1, 1)), '') AS digest FROM h),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""
