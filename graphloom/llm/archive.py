"""WARC archives, a Zstandard frame for each record, with an embedded dictionary.

A table of pages becomes a folder of archives (one a partition).  Each archive
starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each
record is a frame of its own, compressed with it.  The dictionary is trained on
`sample` records of least hash (of all, at most `sample_bytes` of each): this
bounded sample decides sizes only, never results.  Tables too small for training
get archives without a dictionary.

Spark's text writer puts the frames into files, on any file system and with its
commit protocol, so a lost executor leaves no half archive.  Its line separator is
a further skippable frame (magic 0x184D2A50) of 16 letters drawn for each write: a
decoder skips it, and a reader can split a long archive at it.  A frame that holds
the separator by chance is written with one more empty line until it does not.

Records with equal payloads (the html in UTF-8, compared by SHA-256) are one
`response`, of the least page_id, and `revisit` records without payload, which name
it in WARC-Refers-To.  The payload's length stands in the HTTP header.

Defined cases: null html is an empty payload; empty payloads are revisited too.  A
page_id that repeats with one payload has a response for each row if it is the
least.  Null page_ids come last, so a payload of null ids alone has only responses.
A null url has no target header; control characters and spaces in urls are written
as %XX.  Long payloads are kept whole, one record at a time.  No rows give no rows.
Columns of pages other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bounded_batches

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPED_MAGIC = 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 112_640
MAX_DICTIONARIES = 64
BATCH_BYTES = 8 << 20
READ_COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def separator() -> str:
    """A skippable frame of plain characters, other for each write."""
    return skippable(SKIPPED_MAGIC, uuid.uuid4().hex[:16].encode()).decode("ascii")


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: the response with its payload, or a revisit of refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """READ_COLUMNS of a record.  A response's length and digest are those of the
    payload that was read, which must have the digest that its header names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if not revisit and (sha1(payload), len(payload)) != (named, length):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not the one that was written")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": named, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": None if revisit else payload}


def trained(pages: DataFrame, sample: int = 1000, sample_bytes: int = 32_768, size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the records of least hash; b'' where they are too few.

    At most sample * sample_bytes (32 MB) reach the driver.
    """
    h = F.xxhash64("page_id", "url", F.length("html"))
    # hashes below a bound leave about 1.5 * sample rows of any number, so tasks send few
    n = max(pages.count(), 1)
    share = min(1.0, 1.5 * sample / n)
    asked = pages.select(h.alias("h"), "page_id", "url", F.substring("html", 1, sample_bytes).alias("html")).where(F.col("h") <= min(int((share * 2 - 1) * 2**63), 2**63 - 1))
    least = asked.orderBy("h", "page_id", "url").limit(sample)
    rows = least.collect()
    records = [record(r.page_id, r.url, (r.html or "").encode(), None, "1970-01-01T00:00:00Z") for r in rows]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, records)) // 8), records).as_bytes() if len(records) > 7 else b""
    except zstandard.ZstdError:
        return b""


def with_targets(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    # texts that repeat: a narrow aggregate, one row each, so a hot payload's join can be split
    first = rows.groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.withColumn("digest", digest).join(first, "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", dictionary: bytes | None = None) -> str:
    """Write pages as archives into a new folder; returns their separator."""
    bounded_batches(pages.sparkSession)
    dictionary = trained(pages) if dictionary is None else dictionary
    mark = separator()
    inside = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, dict_data=known) if known else zstandard.ZstdCompressor(level=3)
        frames, held, begun = [], 0, not dictionary
        for batch in batches:
            if batch.num_rows and not begun:
                frames, begun = [skippable(DICTIONARY_MAGIC, dictionary)], True
            for page_id, url, html, refers_to in zip(*batch.columns):
                raw = record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), date)
                frame = press.compress(raw)
                while inside in frame:  # empty lines after a record may be more than two
                    raw += b"\r\n"
                    frame = press.compress(raw)
                frames.append(frame)
                held += len(frame)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["value"])
                    frames, held = [], 0
        if frames:
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["value"])

    frames = with_targets(pages).mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", mark).text(path)
    return mark


def read(spark: SparkSession, path: str, mark: str, payloads: bool = True) -> DataFrame:
    """READ_COLUMNS of every record of a folder of archives; mark: their separator.
    Without `payloads` they are read and checked, but stay in the tasks.

    An archive may be read by several tasks, so the dictionaries, which stand only
    at the start, are gathered first: at most MAX_DICTIONARIES of bounded size.
    """
    bounded_batches(spark)
    frames = spark.read.option("lineSep", mark).text(path).select(F.col("value").cast("binary").alias("value"))
    leading = F.substring("value", 1, 4) == F.lit(struct.pack("<I", DICTIONARY_MAGIC))
    found = [bytes(r.value[8:]) for r in frames.where(leading).distinct().limit(MAX_DICTIONARIES + 1).collect()]
    if len(found) > MAX_DICTIONARIES:
        raise ValueError(f"more than {MAX_DICTIONARIES} dictionaries")
    schema = T.StructType.fromDDL(READ_COLUMNS)
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {d.dict_id(): zstandard.ZstdDecompressor(dict_data=d) for d in map(zstandard.ZstdCompressionDict, found)}
        by_id[0] = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held = [], 0
            for value in batch.column(0):
                frame = value.as_py()
                row = parsed(by_id[zstandard.get_frame_parameters(frame).dict_id].decompress(frame))
                rows.append(row if payloads else row | {"payload": None})
                held += len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return frames.where(~leading & (F.length("value") > 0)).mapInArrow(run, schema)
