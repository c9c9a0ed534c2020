"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Reading checks each record: version line, header block, length, the blank
lines after it, and the digest of its block. After a failed check it looks
for the next version line or gzip member, whichever comes first, from which a
whole valid record can be read, and reports the bytes between as a gap of
kind ``gap``. Of a damaged member, the records that inflate before its failure
and whose block digest proves them whole are given too, at the member's offset,
before the gap that the member lies in. A damaged record costs itself only, and
no bytes whatever make the reader fail.

Archives of any size are read through one buffer: a reader holds a record, or
the content of a gzip member, at a time. Those of up to ``WHOLE_BYTES`` come
through Spark from any storage that it opens; larger ones are streamed by
pyarrow, which has to know the storage. Quarantined gaps are rows beside the
records, and ``salvaged`` parts them and logs them.

Nulls: a null payload is empty, a null URL is written as an empty target, null
ids come back null and are never referred to while the group has another id.
Repeated rows of a page are written once each; if their payload is the group's
first, all are responses. Payloads may be as long as a string of Spark. Other
columns aren't read; an empty table gives no records. Equal payloads aren't
gathered: only their digests are grouped.
"""

from __future__ import annotations

import base64
import hashlib
import io
import logging
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.sources.objects import open_file

log = logging.getLogger(__name__)

#: Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive file on average.
FILE_BYTES = 8 << 20
#: Bytes of an archive up to which it is one value of Spark's; beyond, it is streamed.
WHOLE_BYTES = 64 << 20
#: Bytes buffered of an archive; of a gzip member inflated at once; of payloads in a frame of rows; greatest header.
READ, STEP, FRAME_BYTES, HEADER = 1 << 20, 1 << 16, 16 << 20, 1 << 20

_version = re.compile(rb"WARC/\d\.\d\r?\n")
_gzip = re.compile(rb"\x1f\x8b\x08")
_start = re.compile(_version.pattern + b"|" + _gzip.pattern)
_end = re.compile(re.escape(END))
#: Bytes that a pattern above can span.
SPAN = 16


class Source:
    """Random access to the bytes of an archive, through one buffer."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.held, self.at = b"", 0
        self.known: dict[re.Pattern, tuple[int, int]] = {}

    @classmethod
    def of(cls, data: bytes) -> Source:
        out = cls(io.BytesIO(data), len(data))
        out.held = data
        return out

    def fill(self, at: int) -> None:
        self.file.seek(at)
        self.held, self.at = self.file.read(min(READ, self.size - at)), at
        if not self.held:  # shorter than it was said to be
            self.size = at

    def get(self, at: int, n: int, keep: bool = True) -> bytes:
        """The bytes from ``at``, fewer at the end; ``keep`` says whether the buffer may move there."""
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            if n > READ or not keep:
                self.file.seek(at)
                return self.file.read(n)
            self.fill(at)
        return self.held[at - self.at : at - self.at + n]

    def search(self, pattern: re.Pattern, at: int) -> int:
        """Where the pattern next begins, or the size. What was found is kept, so bytes aren't searched again from another start."""
        first, found = self.known.get(pattern, (0, -1))
        if first <= at <= found:
            return found
        start, found = at, self.size
        while at < self.size:
            if not self.at <= at < self.at + len(self.held):
                self.fill(at)
            end = self.at + len(self.held)
            if m := pattern.search(self.held, at - self.at):
                found = self.at + m.start()
                break
            if end >= self.size:
                break
            at = max(at + 1, end - SPAN)
            self.fill(at)
        found = min(found, self.size)
        self.known[pattern] = (start, found)
        return found


def whole_number(x: str | None) -> int | None:
    """A whole number that fits into 64 bits, or None."""
    return int(x) if x and re.fullmatch(r"-?[0-9]{1,18}", x) else None


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, with built-in functions."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), CONV32, BASE32)


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null for responses).

    Payloads of under ``least`` bytes are never revisits. Digests are grouped
    with partial counts; the few rows that revisit something are joined back
    by id and digest, broadcast only while they are few.
    """
    spark = pages.sparkSession
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    full = full.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    ids = common.materialise(full.filter(F.octet_length("html") >= least).select("page_id", "payload_digest"), "digests")
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = ids.join(first, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = common.materialise(again, "revisits")
    again = again.select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to")
    few = again.count() <= common.BROADCAST_ROWS
    on = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest"))
    return full.join(F.broadcast(again) if few else again, on, "left").drop("again_id", "again_digest")


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(rows: DataFrame, date: str) -> DataFrame:
    """One WARC record per row of ``marked``, without the blank lines after it."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.select("*", F.when(revisit, http).otherwise(F.concat(http, F.col("html"))).alias("block"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return rows.select(
        F.concat(
            F.lit(VERSION.decode()),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", record_id(F.col("page_id"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", url),
            line("X-Page-ID", text(F.col("page_id"))),
            F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"))), line("X-Refers-To-Page-ID", text(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block").cast("binary")))),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("value")
    )


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the pages as WARC files in the folder ``path``.

    Spark's text writer commits the files, so retried tasks leave no half
    files; the blank lines that end a record are its line separator.
    """
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    each = max(1, int(FILE_BYTES / max(1.0, (size["b"] or 0) / max(1, size["n"]) + 600)))
    out = records(marked(pages, least), date)
    out.write.option("lineSep", END.decode()).option("maxRecordsPerFile", each).text(path)


def parse(data: Source, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """(end, header, block) of the record at ``at``, or what is wrong with it."""
    if not (m := _version.match(data.get(at, SPAN))):
        return "no version line"
    first = at + m.end()
    stop = data.search(_end, first - 2)
    if stop >= data.size or stop - first > HEADER:
        return "unended header"
    header = {}
    for x in data.get(first, stop - first).decode("utf-8", "replace").split("\r\n"):
        name, colon, value = x.partition(":")
        if not colon and x:
            return "bad header line"
        header[name.strip().lower()] = value.strip()
    length = whole_number(header.get("content-length"))
    if length is None or length < 0:
        return "no length"
    start = stop + len(END)
    end = start + length
    if end > data.size or data.get(end, len(END), False) != END:
        return "bad end of record"
    block = data.get(start, length)
    said = header.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != sha1_32(block):
        return "wrong block digest"
    return end + len(END), header, block


def salvage_plain(data: bytes | Source) -> Iterator[tuple]:
    """('record', offset, length, header, block) and ('gap', offset, length, reason, None) in order; they cover all bytes."""
    data = Source.of(data) if isinstance(data, bytes) else data
    at, bad, why = 0, None, ""
    while at < data.size:
        got = parse(data, at)
        if not isinstance(got, str):
            if bad is not None:
                yield "gap", bad, at - bad, why, None
                bad = None
            end, header, block = got
            yield "record", at, end - at, header, block
            at = end
            continue
        if bad is None:
            bad, why = at, got
        at = data.search(_version, at + 1)
    if bad is not None:
        yield "gap", bad, data.size - bad, why, None


def member(data: Source, at: int) -> tuple[int, bytes, bool]:
    """(end, content, whole) of the gzip member at ``at``; of a damaged one, what inflates before its failure."""
    unzip, out, step = zlib.decompressobj(31), [], 1 << 12
    while at < data.size and not unzip.eof:
        before, part = unzip.copy(), data.get(at, step)
        try:
            out.append(unzip.decompress(part))
        except zlib.error:
            try:
                for k in range(len(part)):
                    out.append(before.decompress(part[k : k + 1]))
            except zlib.error:
                pass
            return at, b"".join(out), False
        at += len(part)
        step = min(4 * step, STEP)  # small members don't have much behind them cut off and copied
    return at - len(unzip.unused_data), b"".join(out), unzip.eof


def salvage(data: bytes | Source) -> Iterator[tuple]:
    """Records and gaps of a plain or gzip archive, or of one that is part of each; offsets of gzip records are their members'."""
    data = Source.of(data) if isinstance(data, bytes) else data
    at, bad, why = 0, None, ""
    while at < data.size:
        found, reason = [], "bad gzip member"
        if _gzip.match(data.get(at, SPAN)):
            end, content, whole = member(data, at)
            inside = list(salvage_plain(content))
            if whole and (bad is None or any(x[0] == "record" for x in inside)):
                found = [(kind, at, end - at, what, block) for kind, _, _, what, block in inside] or [("gap", at, end - at, "empty gzip member", None)]
            elif not whole:
                for x in inside:
                    if x[0] == "record" and x[3].get("warc-block-digest", "").startswith("sha1:"):
                        yield "record", at, max(1, end - at), x[3], x[4]
        elif not isinstance(got := parse(data, at), str):
            end, header, block = got
            found = [("record", at, end - at, header, block)]
        else:
            reason = got
        if found:
            if bad is not None:
                yield "gap", bad, at - bad, why, None
                bad = None
            yield from found
            at = end
            continue
        if bad is None:
            bad, why = at, reason
        at = data.search(_start, at + 1)
    if bad is not None:
        yield "gap", bad, data.size - bad, why, None


SCHEMA = "kind string, path string, offset long, length long, reason string, record_type string, page_id long, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def row(path: str, kind: str, offset: int, length: int, what, block: bytes | None, payloads: bool) -> tuple:
    if kind == "gap":
        return (kind, path, offset, length, what, None, None, None, None, None, None, None)
    head, _, payload = block.partition(END)
    if what.get("warc-type") == "revisit":
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
        size, digest, payload = int(said[1]) if said else None, what.get("warc-payload-digest", "").removeprefix("sha1:"), None
    else:
        size, digest = len(payload), sha1_32(payload)
    return (kind, path, offset, length, None, what.get("warc-type"), whole_number(what.get("x-page-id")), whole_number(what.get("x-refers-to-page-id")), what.get("warc-target-uri"), digest, size, payload if payloads else None)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    for c in ("page_id", "refers_to", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def frames(name: str, data: Source, payloads: bool) -> Iterator[pd.DataFrame]:
    """The rows of one archive, in frames of bounded numbers of rows and bytes."""
    rows, held = [], 0
    for x in salvage(data):
        rows.append(row(name, *x, payloads))
        held += len(rows[-1][-1] or b"")
        if len(rows) >= 2000 or held > FRAME_BYTES:
            yield frame(rows)
            rows, held = [], 0
    yield frame(rows)


def read_warc(spark: SparkSession, path: str, payloads: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Rows of kind ``record``, and of kind ``gap`` for quarantined bytes (path, offset, length, reason)."""

    def run(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                yield from frames(name, Source.of(data), payloads)

    def stream(batches):
        for b in batches:
            for name, size in zip(b["path"], b["length"]):
                with open_file(name) as f:
                    yield from frames(name, Source(f, int(size)), payloads)

    files = spark.read.format("binaryFile").load(path)
    out = files.filter(F.col("length") <= whole_bytes).select("path", "content").mapInPandas(run, SCHEMA)
    large = files.select("path", "length").filter(F.col("length") > whole_bytes)
    if n := large.count():
        # an archive is a task's work, and a file's listing says nothing of that
        out = out.unionByName(large.repartition(n, "path").mapInPandas(stream, SCHEMA))
    return out


def salvaged(spark: SparkSession, path: str, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records, and gaps (path, offset, length, reason), of the archives below a path, read once; gaps are logged."""
    rows = common.materialise(read_warc(spark, path, payloads), "salvaged")
    gaps = rows.filter("kind = 'gap'").select("path", "offset", "length", "reason")
    n, size = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n:
        log.warning("quarantined %d gaps of %d bytes below %s", n, size, path)
        for r in gaps.limit(20).collect():
            log.warning("gap in %s at %d of %d bytes: %s", *r)
    return rows.filter("kind = 'record'").drop("kind", "reason"), gaps


def query(spark, sf_dir):
    path = common.shared_path(spark, "warc")
    write_warc(common.table(spark, sf_dir, "pages"), path)
    records, _ = salvaged(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the table itself, for DuckDB.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, h,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
