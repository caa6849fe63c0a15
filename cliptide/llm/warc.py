"""WARC archives with revisit records, and a merged index of their captures.

Pages become WARC/1.1 records: a payload's response, and revisits for equal
payloads of at least LEAST_BYTES bytes. Only pages whose digest a Bloom filter of
the repeated ones lets pass are moved to learn that. Every record is a gzip member of its own, so an
index entry's offset and length address the stored file. Spark's text writer puts the
members into files of the shared store, so executors need nothing but Spark's own
access to it; its separator is the zero byte that ends a member (the last byte of a
size below 16 MB; a larger record is followed by an empty member, which readers skip).

Archives hold at most RECORDS records and about VOLUME_BYTES bytes. Reading parses
them member by member, checks every response's payload against its digest, and yields
one capture run per archive, sorted by URL key and timestamp and written to the shared
store. Runs are cut at common range boundaries, as many as leave about RANGE_ROWS
captures in a range; each range merges its pieces of all runs with a loser tree, one
comparison a level for each capture, so the ranges in order are the global capture
history and no task holds more than a range.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.llm._common import Bloom, Scratch, hot_join

LEAST_BYTES = 1000
#: Records of one archive at most, bytes of one archive and captures of one merged range, about.
RECORDS, VOLUME_BYTES, RANGE_ROWS = 5000, 64 << 20, 200_000
#: Bytes that a member is read by at a time.
STEP = 1 << 16
END = "\r\n\r\n"
PAGE = "<urn:cliptide:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, offset long, length long"
)
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(value): the text of each page's record, without the blank lines at its end, which ``write_archives`` adds.

    A page captured at second page_id of 2024 (modulo a year; a null id at its
    start). Of records with equal long payloads the one of the largest page_id is
    the response (all of that id, if rows repeat); null ids never are while
    another id has the payload. Null html is an empty payload.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    rows = rows.withColumn("short", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    first = rows.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "short").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = scratch.save(first.select(F.col("digest").alias("of"), "short", "first"))
    among = Bloom(first, "short").test()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = among(batch.column("short").to_numpy()) & (batch.column("bytes").to_numpy() >= LEAST_BYTES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(open_)], [*batch.schema.names, "open"])

    tested = rows.mapInArrow(split, "id long, url string, html string, bytes long, digest string, short long, open boolean")
    alone = tested.filter("NOT open").select("id", "url", "html", "bytes", "digest", F.lit(None).cast("string").alias("of"), F.lit(None).cast("long").alias("first"))
    met = hot_join(tested.filter("open").drop("open", "short"), first.withColumnRenamed("of", "digest").drop("short").withColumn("of", F.col("digest")), "digest", "left")
    rows = alone.unionByName(met)
    again = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    second = F.pmod(F.coalesce("id", F.lit(0)), F.lit(31_536_000)).cast("decimal(18,6)")
    date = F.concat(F.replace((F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    name = lambda c: F.concat(F.lit(PAGE), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]+", "%20")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))), F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body).alias("value"))


def member(record: bytes) -> bytes:
    """A gzip member of one record that ends in a zero byte, by an empty member if need be."""
    out = gzip.compress(record, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 6, mtime=0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members without their last byte, which the writer puts behind each, and the number of the task's archive."""
    volume = held = records_ = 0
    for batch in batches:
        members, volumes = [], []
        for value in batch.column(0).cast(pa.binary()):
            m = member(value.as_py() + END.encode())
            if records_ == RECORDS or (records_ and held + len(m) > VOLUME_BYTES):
                volume, held, records_ = volume + 1, 0, 0
            held, records_ = held + len(m), records_ + 1
            members.append(m[:-1])
            volumes.append(volume)
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(volumes, pa.int32())], ["member", "volume"])


def write_archives(recs: DataFrame, path: str) -> None:
    """Archives, volume=N/part-*: gzip members in a row."""
    members = recs.mapInArrow(_packed, "member binary, volume int")
    members.select(F.col("member").cast("string").alias("value"), "volume").write.partitionBy("volume").option("lineSep", "\0").text(path)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query, lower-cased."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    return (",".join(reversed(host.split("."))) + ")" + parts.path + (f"?{parts.query}" if parts.query else "")).lower()


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive that hold something."""
    at = 0
    while at < len(data):
        reader, start, out = zlib.decompressobj(31), at, []
        while not reader.eof:
            if at >= len(data):
                raise ValueError(f"the member at {start} is cut off")
            part = data[at : at + STEP]
            out.append(reader.decompress(part))
            at += len(part)
        at -= len(reader.unused_data)
        if content := b"".join(out):
            yield start, at - start, content


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head = record.index(b"\r\n\r\n")
    version, *lines = record[:head].split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("no record")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    return headers, record[head + 4 : head + 4 + int(headers["Content-Length"])]


def _page(name: str | None) -> int | None:
    found = name[len(PAGE) : -1] if name else "none"
    return None if found == "none" else int(found)


def capture(headers: dict[str, str], block: bytes) -> tuple:
    """The index fields of one record; a response whose payload doesn't match its digest is an error."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    return url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), size, digest, kind, _page(headers.get("WARC-Refers-To"))


def order_of(row: tuple) -> tuple:
    """URL key, timestamp, then page id (none first)."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            archive = "/".join(path.as_py().rsplit("/", 2)[-2:])
            run = [(*capture(*parse(record)), archive, at, length) for at, length, record in members(memoryview(content.as_buffer()))]
            run.sort(key=order_of)
            yield _batch(run)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, _INDEX.split(", "), strict=True)], _NAMES)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of every archive, sorted within each: the capture runs."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(_runs, _INDEX)


class LoserTree:
    """Merges sorted lists. An inner place holds the loser of the match played there; the winner goes up."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.keys = [[order_of(r) for r in run] for run in runs]
        self.at = [0] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._build(1) if runs else -1

    def _build(self, place: int) -> int:
        if place >= len(self.runs):
            return place - len(self.runs)
        left, right = self._build(2 * place), self._build(2 * place + 1)
        won, lost = (left, right) if self._less(left, right) else (right, left)
        self.losers[place] = lost
        return won

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.keys[a]):
            return False
        if self.at[b] >= len(self.keys[b]):
            return True
        return (self.keys[a][self.at[a]], a) < (self.keys[b][self.at[b]], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.at[self.winner] < len(self.keys[self.winner]):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            place = (run + len(self.runs)) // 2
            while place:
                if self._less(self.losers[place], run):
                    self.losers[place], run = run, self.losers[place]
                place //= 2
            self.winner = run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            runs.setdefault(row[7], []).append(row)
    for run in runs.values():  # in order already, unless the exchange delivers a run's blocks in another
        run.sort(key=order_of)
    out = []
    for row in LoserTree([runs[k] for k in sorted(runs)]):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs in one global order, range after range. Ranges are as many as keep each at about
    RANGE_ROWS; captures of one URL part by timestamp, page id and place."""
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    # Arrow batches keep the order within a partition, so partitions in order are the history.
    return runs.repartitionByRange(ranges, "urlkey", "timestamp", "page_id", "archive", "offset").mapInArrow(_merged, _INDEX)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, timestamp, archive,
    offset, length: the merged index of the archives written from ``pages``, one row per input row.

    offset and length are the place of a record's gzip member in its archive. Null
    URLs have an empty key. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    path = f"{scratch.root}/archives"
    write_archives(records(pages, scratch, id_col, url_col, html_col), path)
    runs = scratch.save(read_runs(pages.sparkSession, path))
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "archive", "offset", "length")


#: The contract's columns in DuckDB.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> top THEN top END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
