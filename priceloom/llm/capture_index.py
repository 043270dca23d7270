"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records (a payload seen before becomes a revisit of the page with the smallest id), written by
Spark's text writer: a record ends with CR LF CR and the writer's line end, so files are plain WARC on any file system.

The index is made from the archives alone. Captures are sorted by their reversed-host URL key into compressed blocks of
BLOCK_LINES lines; the directory holds one entry per block, its first and last key, in a file for each range of the sort.
A lookup sorts the keys: a task goes through its keys and holds the directory of one range at a time, of which only the
bounds, one pair for each range, pass through the driver. It binary-searches the bounds, the directory, then the lines of
the blocks that may hold a key, and reads the records by byte range, in tasks of about READ_BYTES.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import new_path, written

BLOCK_LINES = 512
#: Records of one archive file; files are read by ranges, so their bytes need no bound.
RECORDS_PER_FILE = 1000
#: Bytes that a scan holds at a time (a longer header is read whole), and those it first looks for a header in.
WINDOW_BYTES = 1 << 20
HEADER_BYTES = 1 << 12
#: Captures of one Arrow batch, and tasks that scan archives at most.
BATCH_ROWS = 10_000
TASKS = 10_000
#: Bytes of records that a task reads, and that are read from one place of an archive.
READ_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
CAPTURE_DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

CAPTURE = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(text: Column) -> Column:
    """The base32 form of a text's SHA-1: each 5 hexadecimal digits are 4 digits of base 32."""
    hexadecimal = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: com,example,www)/path?query. An empty string for null."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(host, r":(80|443)?$", "")
    rest = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One WARC record per row, into files under path. A null html is an empty payload, a null URL or id has no header of
    its own, equal rows are records each; an empty table gives no record. Other columns are not read."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html")})
    # Only payloads that several pages have are joined; the table is small on most crawls, and Spark sees its size.
    firsts = written(
        rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "warc-firsts",
    )
    rows = rows.join(firsts, ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    body = F.when(revisit, "").otherwise(F.col("html"))
    name = lambda page_id: F.concat(F.lit("<urn:page:"), page_id, F.lit(">"))

    def line(key: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        line("WARC-Date", F.lit(CAPTURE_DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, name(F.col("first_id")))),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        http,
        body,
        F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_headers(block: bytes) -> dict[str, str]:
    """Only blanks and tabs around a value are not part of it: a URL may begin or end with other kinds of space."""
    return {k.strip(" \t").lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def page_number(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name else None


def scan_archive(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and headers of each record of an archive of that size, of which read(count, offset) gives bytes.

    Records are stepped over by their Content-Length, so only WINDOW_BYTES are held at a time, however long a record is.
    """
    at, window, begin = 0, b"", 0

    def part(offset: int, count: int) -> bytes:
        nonlocal window, begin
        if not begin <= offset <= offset + count <= begin + len(window):
            window, begin = read(min(max(count, WINDOW_BYTES), size - offset), offset), offset
        return window[offset - begin : offset - begin + count]

    while at < size:
        span = HEADER_BYTES
        while (end := (head := part(at, min(span, size - at))).find(b"\r\n\r\n")) < 0 and at + span < size:
            span *= 4
        if not head.startswith(VERSION) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = parse_headers(head[:end])
        length = end + 4 + int(headers["content-length"]) + 4
        if part(at + length - 4, 4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield at, length, headers
        at += length


def opened(path: str) -> pa.NativeFile:
    system, place = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(place)


@dataclass
class CaptureIndex:
    """blocks: (part, block, first_key, last_key, data); parts: for each range, in key order, its first and last key and the
    file of its directory, whose lines are the first key, last key and number of its blocks."""

    blocks: DataFrame
    parts: list[tuple[str, str, int, str]]  # first key, last key, part, directory file


class Directory:
    """The blocks that may hold a key. Keys come in order, so the directory of one range is held at a time."""

    def __init__(self, parts: list[tuple[str, str, int, str]]) -> None:
        self.parts = parts
        self.firsts, self.lasts = [p[0] for p in parts], [p[1] for p in parts]
        self.held: tuple[int, list[str], list[str], list[str]] | None = None

    def blocks(self, key: str) -> Iterator[tuple[int, int]]:
        for _, _, part, path in self.parts[bisect.bisect_left(self.lasts, key) : bisect.bisect_right(self.firsts, key)]:
            if not self.held or self.held[0] != part:
                with opened(path) as file:
                    entries = [json.loads(x) for x in file.read().splitlines()]
                self.held = (part, *map(list, zip(*entries, strict=True)))
            _, firsts, lasts, numbers = self.held
            for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                yield part, int(numbers[i])


def build_index(spark: SparkSession, archives: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """The index of all archive files under a path. Records without a URL have an empty key; repeated records are captures
    each; archives without records give an index without blocks."""
    schema = T.StructType([T.StructField("url", T.StringType()), *CAPTURE.fields[1:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as file:
                    records = scan_archive(lambda count, offset, file=file: file.read_at(count, offset), size)
                    while rows := [(h.get("warc-target-uri"), page_number(h.get("warc-record-id")), path, at, n) for at, n, h in itertools.islice(records, BATCH_ROWS)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=schema.names)

    # The contents are not selected, so Spark lists the files and the tasks read them by ranges.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select("path", "length")
    files = files.repartition(max(1, min(files.count(), TASKS)))
    captures = files.mapInArrow(scan, schema).select(url_key(F.col("url")).alias("url_key"), *CAPTURE.names[1:])
    captures = written(captures, "captures")
    block = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("first_key", T.StringType()),
            T.StructField("last_key", T.StringType()),
            T.StructField("data", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        part, number = None, 0

        def flush() -> pa.RecordBatch:
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "first_key": lines[0][0], "last_key": lines[-1][0], "data": data}], pa.schema([(n, t) for n, t in zip(block.names, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)]))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *line, p in zip(*columns, strict=True):
                part = p
                lines.append(tuple(line))
                if len(lines) == block_lines:
                    yield flush()
                    lines, number = [], number + 1
        if lines:
            yield flush()

    order = ["url_key", "path", "offset"]
    ranges = captures.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = written(ranges.mapInArrow(pack, block), "index-blocks")
    path = new_path(spark, "index-directory")
    entry = F.to_json(F.array("first_key", "last_key", F.col("block").cast("string")))
    pieces = blocks.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", entry.alias("entry")))), lambda x: x["entry"]), "\n").alias("entries"))
    pieces.select("part", "entries").write.partitionBy("part").text(path)
    part = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("int").alias("part")
    files = {r["part"]: r["path"] for r in spark.read.format("binaryFile").load(path).select(part, "path").collect()}
    bounds = blocks.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("part").collect()  # a row for each range
    return CaptureIndex(blocks, [(r["first"], r["last"], r["part"], files[r["part"]]) for r in bounds])


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """The captures (CAPTURE) of all rows of a table of distinct url_key, none of them null. Keys that the index lacks give
    no rows; neither does an empty table or an empty index."""
    schema = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType())])
    parts = index.parts

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(parts)
        for batch in batches:
            rows = [(key, *found) for key in batch.column(0).to_pylist() for found in directory.blocks(key)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)], names=schema.names)

    wanted = keys.select("url_key").repartitionByRange("url_key").sortWithinPartitions("url_key").mapInArrow(locate, schema)
    # A block is opened once for all of its keys; at most block_lines keys fall into one, so the list is bounded.
    asked = wanted.groupBy("part", "block").agg(F.sort_array(F.collect_set("url_key")).alias("keys"))
    opened = index.blocks.join(asked, ["part", "block"]).select("keys", "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = [json.loads(x) for x in zlib.decompress(data).split(b"\n")]
                names = [x[0] for x in lines]
                rows = [lines[i] for k in keys for i in range(bisect.bisect_left(names, k), bisect.bisect_right(names, k))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=CAPTURE.names)

    return opened.mapInArrow(search, CAPTURE)


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None, str | None, bytes]:
    """The fields of RECORD; the digest of a response is computed from its payload and must agree with its header."""
    body = data.index(b"\r\n\r\n") + 4
    headers = parse_headers(data[: body - 4])
    block = data[body : body + int(headers["content-length"])]
    payload_at = block.index(b"\r\n\r\n") + 4
    declared = int(parse_headers(block[: payload_at - 4])["content-length"])
    payload, digest = block[payload_at:], headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != declared:
            raise ValueError(f"the payload of {headers.get('warc-record-id')} does not match its digest")
    return page_number(headers.get("warc-record-id")), declared, digest, headers["warc-type"], page_number(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload


def read_records(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records (RECORD) of a written table of captures, each read by its byte range, neighbours by one task. Null page
    ids and URLs come back as null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[str | None, pa.NativeFile | None] = (None, None)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            rows = []
            for path, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if current[0] != path:
                    current = (path, opened(path))
                record = parse_record(current[1].read_at(length, offset))
                rows.append(record if with_payload else (*record[:-1], None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)

    total = captures.agg(F.sum("length").alias("total")).first()["total"] or 0
    places = captures.select("path", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("place"))
    dealt = places.repartition(max(1, min(-(-total // READ_BYTES), TASKS)), "path", "place").sortWithinPartitions("path", "offset")
    return dealt.select("path", "offset", "length").mapInArrow(read, RECORD)


def archived_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes df's pages as archives in the shared folder, indexes them, looks every URL up and reads the records back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload. Of
    equal payloads the rows with the smallest id are responses, so repeats of a row get equal results.
    """
    spark = df.sparkSession
    archives = new_path(spark, "archives")
    write_archives(df, archives, id_col, url_col, html_col, min_bytes)
    index = build_index(spark, archives)
    stored = F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20]", "%20")
    keys = df.select(url_key(stored).alias("url_key")).distinct()
    return read_records(written(lookup(index, keys), "found"), with_payload=False).drop("url", "payload")
