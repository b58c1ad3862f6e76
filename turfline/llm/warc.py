"""WARC archives: pages written as records, and captures assembled from records.

Writing is DataFrame work: every page becomes a request, a response (or revisit) and a metadata
record, and Spark's text writer lays them out one after another, gzipped. Reading streams each
archive through the text reader and cuts records by their Content-Length. Assembly joins the
records of a transaction through their WARC-Concurrent-To identifiers into one nested row.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.store import map_arrow, stored

#: What ends a record, and a header: two line ends.
GAP = "\r\n\r\n"
#: RFC 4648 letters, for the digits that ``conv`` writes.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Parts into which the rows of one key are dealt before they meet what that key refers to.
PARTS = 64
#: Date of written records, where the pages have none.
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four base32 ones."""
    code = F.sha1(content)
    parts = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def with_best(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds the greatest ``value``, which tells rows apart, among the rows of one ``key``.

    Rows of a key are dealt to ``PARTS`` parts: each part has its greatest, the key the greatest
    of those, which goes back to the parts. No task gets all rows of a frequent key.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(PARTS)))
    parts = rows.groupBy(key, "_part").agg(F.max(value).alias(name))
    best = parts.groupBy(key).agg(F.max(name).alias(name))
    return rows.join(parts.select(key, "_part").join(best, key), [key, "_part"]).drop("_part")


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` joined (left) with the one row of ``table`` that has their ``key``; the rows of a
    frequent key are dealt to parts, each of which gets that row."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if not _is_map(rows, c)]), F.lit(PARTS)))
    wanted = rows.where(F.col(key).isNotNull()).select(key, "_part").distinct()
    return rows.join(wanted.join(table, key), [key, "_part"], "left").drop("_part")


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record: header lines, a blank line, the block. A header with a null value is left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), F.concat(F.lit("WARC-Record-ID: "), record_id, F.lit("\r\n"))]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(GAP))
    return F.concat(*lines, length, block)


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Writes the pages (page_id, url, html) as gzipped WARC files below ``path``.

    Every row gives a request, a metadata record and a response or revisit. The payload is the
    UTF-8 html (null: empty). Of the rows with equal payloads of at least ``least`` bytes, the one
    with the largest page_id (null: smallest; ties: the greatest url, then one of them) is
    written as response; the others are revisits that name it and have no payload of their own.
    Line ends in a url are percent-encoded, a null url is left out. Equal rows are separate
    captures. Other columns are not read. An empty frame writes no record.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": base32_sha1(F.col("html"))})
    me = F.struct(F.col("page_id"), F.col("url"), F.col("row"))  # nulls sort first
    # equal payloads have equal SHA-1, size and xxHash64; those too short for revisits are groups of their own
    same = F.concat_ws(":", F.col("digest"), F.col("size").cast("string"), F.xxhash64("html").cast("string"))
    rows = rows.withColumn("payload", F.when(F.col("size") >= least, same).otherwise(F.col("row").cast("string")))
    rows = with_best(rows, "payload", me, "first")

    def urn(kind: str, page_id: Column, row: Column) -> Column:
        code = F.sha2(F.concat_ws("/", F.lit(kind), page_id.cast("string"), row.cast("string")), 256)
        cuts = [F.substring(code, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))

    first = F.col("first")
    is_first = F.col("row") == first["row"]
    capture = urn("capture", F.col("page_id"), F.col("row"))
    target = ("WARC-Target-URI", F.col("url"))
    common = [("WARC-Date", date), target]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(GAP))
    payload = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", "application/http; msgtype=response")]
    response = _record("response", capture, common + payload, F.concat(http, "html"))
    revisit = _record("revisit", capture, common + payload + [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", urn("capture", first["page_id"], first["row"])),
        ("WARC-Refers-To-Target-URI", first["url"])], http)
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    asked = F.coalesce(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/?#]*", ""), "#.*$", ""), F.lit(""))
    request = _record("request", urn("request", F.col("page_id"), F.col("row")),
                      [*common, ("WARC-Concurrent-To", capture), ("Content-Type", "application/http; msgtype=request")],
                      F.concat(F.lit("GET "), F.when(asked.startswith("/"), asked).otherwise(F.concat(F.lit("/"), asked)),
                               F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(GAP)))
    about = _record("metadata", urn("metadata", F.col("page_id"), F.col("row")),
                    [*common, ("WARC-Concurrent-To", capture), ("Content-Type", "application/warc-fields")],
                    F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")))
    records = rows.select(F.explode(F.array(request, F.when(is_first, response).otherwise(revisit), about)).alias("value"))
    # archives are read once or twice: the fastest level of gzip
    records.write.option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip", lineSep=GAP)


RECORDS = ("file string, position long, warc_type string, record_id string, target_uri string, date string, "
           "concurrent_to array<string>, refers_to string, content_type string, payload_digest string, "
           "headers map<string,string>, http map<string,string>, payload_bytes long, payload_sha1 string, payload binary")
#: Named headers, in the order of the columns after ``position``.
NAMED = ["warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-concurrent-to", "warc-refers-to", "content-type",
         "warc-payload-digest"]


def _fields(raw: bytes) -> list[tuple[str, str]]:
    """Header lines as (lower-case name, value); a line that begins with white space goes on the last."""
    fields: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append((name.strip().lower(), value.strip()))
    return fields


def _as_record(file: str, position: int, head: bytes, block: bytes) -> tuple:
    fields = _fields(head.split(b"\r\n", 1)[1] if b"\r\n" in head else b"")
    several = [v for n, v in fields if n == "warc-concurrent-to"]
    first = dict(reversed(fields))
    http: dict[str, str] = {}
    payload = block
    if first.get("content-type", "").startswith("application/http"):
        top, gap, rest = block.partition(b"\r\n\r\n")
        if gap:
            http, payload = dict(reversed(_fields(top))), rest
    named = [several if n == "warc-concurrent-to" else first.get(n) for n in NAMED]
    sha1 = b32encode(hashlib.sha1(payload).digest()).decode()
    return (file, position, *named, list(first.items()), list(http.items()), len(payload), sha1, payload)


def _length(head: bytes) -> int | None:
    """Content-Length of a record header, None if there is none."""
    if not head.lstrip(b"\r\n").startswith(b"WARC/"):
        return None
    value = next((v for n, v in _fields(head) if n == "content-length"), "")
    return int(value) if value.isdigit() else None


class Cutter:
    """Cuts the bytes of one archive, which come in parts, into records by their stated lengths."""

    def __init__(self, file: str):
        self.file, self.at, self.buffer, self.head, self.need = file, 0, bytearray(), b"", 0

    def feed(self, part: bytes) -> Iterator[tuple]:
        self.buffer += part
        while len(self.buffer) >= self.need:
            if not self.head:
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                self.head = bytes(self.buffer[:end])
                length = _length(self.head)
                if length is None:  # not a record: skipped up to the next gap
                    del self.buffer[:end + 4]
                    self.at, self.head = self.at + end + 4, b""
                    continue
                self.need = end + 4 + length + 4
                continue
            begin, end = len(self.head) + 4, self.need - 4
            yield _as_record(self.file, self.at, self.head, bytes(self.buffer[begin:end]))
            del self.buffer[:self.need]
            self.at, self.head, self.need = self.at + self.need, b"", 0


def read_records(spark: SparkSession, path: str | list[str], whole_files: bool = True) -> DataFrame:
    """All records of the WARC files: file, position (byte of the unpacked file), types, identifiers,
    headers (of the record and of HTTP) and payload (without the HTTP header), with its size and the base32
    of its SHA-1 as read.

    Spark's text reader brings the parts of a file in order, so a task holds one record at a
    time. Gzipped files are never split. With ``whole_files`` false (unpacked archives that
    Spark may split) the parts are first sorted by file and place, a shuffle. What is no record is
    skipped up to the next blank line; a record whose file ends too early is left out. A folder without records gives an
    empty frame.
    """
    parts = spark.read.text(path, lineSep=GAP).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))
    if not whole_files:
        parts = parts.withColumn("place", F.monotonically_increasing_id())
        parts = parts.repartition("file").sortWithinPartitions("file", "block", "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            done, held = [], 0
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if cutter is None or cutter.file != file:
                    cutter = Cutter(file)
                for record in cutter.feed(value.as_py() + b"\r\n\r\n"):
                    done.append(record)
                    held += len(record[-1])
                    if held > 1 << 24:
                        yield table(done)
                        done, held = [], 0
            if done:
                yield table(done)

    def table(records: list[tuple]) -> pa.RecordBatch:
        text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
        types = [text, pa.int64(), *[pa.list_(text) if n == "warc-concurrent-to" else text for n in NAMED], pairs, pairs, pa.int64(), text, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records), types)], names=names)

    names = [f.strip().split(" ")[0] for f in RECORDS.replace("map<string,string>", "map").split(",")]
    return map_arrow(parts.select("file", "value"), cut, RECORDS)


def capture_of(records: DataFrame) -> DataFrame:
    """record_id -> capture (the record_id of its response or revisit), for all other records that belong to one.

    WARC-Concurrent-To counts in both directions. Records linked with a capture come first; those that are
    linked over other records only (a metadata record that names the request that the response names)
    follow round by round, until none is left. Of several captures a record goes to the least.
    """
    is_capture = F.col("warc_type").isin("response", "revisit")
    captures = records.where(is_capture).select(F.col("record_id").alias("capture"), "concurrent_to")
    others = records.where(~is_capture & F.col("record_id").isNotNull())
    named = others.select("record_id", F.explode("concurrent_to").alias("other"))
    ids = captures.select(F.col("capture").alias("other"), "capture")
    direct = named.join(ids, "other").select("record_id", "capture").unionByName(
        captures.select(F.explode("concurrent_to").alias("record_id"), "capture"))
    known = stored(direct.groupBy("record_id").agg(F.min("capture").alias("capture")), "captures")
    left = stored(others.select("record_id").join(known, "record_id", "left_anti").distinct(), "left")
    if left.isEmpty():
        return known
    links = stored(named.union(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct(), "links")
    new = known
    while True:
        found = links.join(left, "record_id", "left_semi").join(new.withColumnRenamed("record_id", "other"), "other")
        new = stored(found.groupBy("record_id").agg(F.min("capture").alias("capture")), "linked")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        left = stored(left.join(new, "record_id", "left_anti"), "left")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture, target_uri, date, warc_type (response or revisit),
    refers_to, payload_digest (of the header), response struct(http, payload_bytes, payload_sha1, payload),
    request struct(http, payload) (null if none), metadata: for each metadata record its fields (name, value).

    Requests and metadata find their response through concurrent-to identifiers. Records of a
    transaction without a response or revisit give no row; of records with a repeated identifier the
    first counts. Only narrow columns are grouped; a payload moves once, to the rest of its
    capture, and not at all where no one asks for it.
    """
    records = stored(records, "records", compression="zstd")  # cut once, then read by column
    rest = records.where(F.col("warc_type").isin("request", "metadata")).join(capture_of(records), "record_id").dropDuplicates(["record_id"])
    lines = F.filter(F.split(F.col("payload").cast("string"), "\r\n"), lambda x: F.contains(x, F.lit(":")))
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
                                                   F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    asked = F.col("warc_type") == "request"
    rest = rest.groupBy("capture").agg(
        F.min_by(F.when(asked, F.struct("http", "payload")), F.when(asked, F.col("record_id"))).alias("request"),
        F.collect_list(F.when(~asked, fields)).alias("metadata"))
    here = F.struct("file", "position")
    head = records.where(F.col("warc_type").isin("response", "revisit")).withColumnRenamed("record_id", "capture")
    firsts = head.groupBy("capture").agg(F.min(here).alias("_first"))
    head = head.join(firsts, "capture").where(here == F.col("_first")).select(
        "capture", "target_uri", "date", "warc_type", "refers_to", "payload_digest",
        F.struct("http", "payload_bytes", "payload_sha1", "payload").alias("response"))
    none = F.array().cast("array<array<struct<name: string, value: string>>>")
    return head.join(rest, "capture", "left").withColumn("metadata", F.coalesce("metadata", none))


def page_report(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures: size and
    digest of a response are those of its payload as read, those of a revisit from its headers."""
    full = F.col("warc_type") == "response"
    rows = captures.select(
        "capture", F.get(F.filter(F.flatten("metadata"), lambda f: f["name"] == "page-id"), F.lit(0))["value"].cast("long").alias("page_id"), F.col("warc_type").alias("record_type"),
        F.when(~full, F.col("refers_to")).alias("refers_to"),
        F.when(full, F.col("response.payload_bytes"))
         .otherwise(F.col("response.http")["content-length"].cast("long")).alias("payload_bytes"),
        F.when(full, F.col("response.payload_sha1")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"))
    rows = stored(rows, "captures")
    table = rows.where("record_type = 'response'").select(F.col("capture").alias("refers_to"), F.col("page_id").alias("of"))
    return looked_up(rows, "refers_to", table).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("of").alias("refers_to"))
