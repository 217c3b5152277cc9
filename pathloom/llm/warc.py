"""WARC archives with revisit resolution.

Headers (id, payload digest, length) are read once, shuffled by digest and reduced to the
smallest id of each digest that occurs more than once; that record is the response, all others
become revisit records that refer to it and hold the original's HTTP headers without its
payload.  Payloads are not shuffled while the list of revisit records is short enough to be
broadcast back to the pages.  Archives are written by Spark's text writer with a record as a
line and two line ends as the line separator, so any file system that Spark reaches will do.
``SIZES`` bounds a file's bytes: small records share files, a large one has its own.  Archives
are read back as binary files and parsed by Content-Length, so payloads may hold anything;
``resolved`` joins revisit records to their original responses.

Defined results: a null payload is empty; equal payloads of fewer than ``least`` bytes are
all responses; a null id is written as a record of its own that is always a response; of
rows with one id and one payload each is written; other columns of pages, of any name, are not
read; a single record must stay below 2 GB. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import drop_table, lean, materialize, new_folder

#: Payloads up to so many bytes are written so many to a file at most; longer ones alone.
SIZES = ((1 << 16, 1000), (1 << 20, 64), (None, 1))
#: Payload bytes that are handed on at a time when archives are read.
READ_BYTES = 4 << 20
#: Revisit records of at most this many rows (about 90 MB) are broadcast; with more, pages are shuffled to them.
BROADCAST_REVISITS = 500_000
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = "\r\n\r\n"
#: The alphabets of base 32 and of Spark's conv() to base 32.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary column: four runs of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*runs), CONV32, BASE32)


def record_id(page: Column) -> Column:
    """A record id that holds the 64-bit page id."""
    digits = F.lpad(F.lower(F.hex(page)), 16, "0")
    return F.concat(F.lit("<urn:uuid:00000000-0000-8000-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12), F.lit(">"))


def headers(pages: DataFrame, least: int = 0) -> DataFrame:
    """(payload_digest, original): the response of every digest that occurs more than once, counts aggregated before the shuffle."""
    own = pages.where(f"payload_bytes >= {least} and page_id is not null").groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("other"))
    return own.where("original <> other").drop("other")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_REVISITS else df


def revisits(heads: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_digest, original) of every header that repeats a response's payload."""
    originals = materialize(headers(heads, least), "originals")
    repeats = heads.join(_small(originals), "payload_digest").where("page_id <> original").select("page_id", "payload_digest", "original")
    return materialize(repeats.distinct(), "revisits")


def with_digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of pages (page_id, url, html)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))


def records(full: DataFrame, repeats: DataFrame) -> DataFrame:
    """One line (a WARC record without its final line ends) for each page that with_digest gave, and its revisit among repeats."""
    joined = full.join(_small(repeats), ["page_id", "payload_digest"], "left")
    revisit = F.col("original").isNotNull()
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(end + end))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    # A line end inside a url would end its header.
    target = F.regexp_replace("url", "[\r\n]", "")
    lines = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: "),
        F.coalesce(record_id(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-4000-0000-000000000000>")),
        F.lit(f"{end}WARC-Date: {DATE}{end}WARC-Target-URI: "),
        target,
        F.lit(f"{end}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Refers-To: "), record_id(F.col("original")), F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "),
        size.cast("string"),
        F.lit(end + end),
        http,
    )
    return joined.select(F.concat(lines, F.when(revisit, "").otherwise(F.col("payload").cast("string"))).alias("record"))


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write deduplicated archives of pages (page_id, url, html) into a new folder, in one folder for each class of SIZES."""
    full = with_digest(pages)
    heads = materialize(full.select("page_id", "payload_digest", "payload_bytes"), "heads")
    repeats = revisits(heads, least)
    low = -1
    for i, (high, most) in enumerate(SIZES):
        sized = f"payload_bytes > {low}" + (f" and payload_bytes <= {high}" if high else "")
        low = high
        # The first class is written even without records, so that there is a folder to read.
        if i == 0 or not heads.where(sized).isEmpty():
            records(full.where(sized), repeats).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", most).text(f"{folder}/size{i}")
    for used in (heads, repeats):
        drop_table(used)


def _named(head: bytes) -> dict[bytes, bytes]:
    return {name.lower(): value.strip() for name, _, value in (line.partition(b":") for line in head.split(b"\r\n"))}


def _page(record: bytes | None) -> int | None:
    if record is None or b"-8000-" not in record:
        return None
    return int.from_bytes(bytes.fromhex(record.rpartition(b"-8000-")[2].rstrip(b">").replace(b"-", b"").decode()), "big", signed=True)


def parse(raw: bytes) -> Iterator[dict]:
    """The records of an archive."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/1.", at):
            raise ValueError("a record must begin here")
        head = _named(raw[at:stop])
        size = int(head[b"content-length"])
        block = raw[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError("a record ends early")
        at = stop + 4 + size + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        yield {
            "page_id": _page(head[b"warc-record-id"]),
            "url": head[b"warc-target-uri"].decode("utf-8", "replace"),
            "record_type": head[b"warc-type"].decode(),
            "payload_digest": head[b"warc-payload-digest"].removeprefix(b"sha1:").decode(),
            "payload_bytes": int(_named(http)[b"content-length"]),
            "refers_to": _page(head.get(b"warc-refers-to")),
            "payload": payload if head[b"warc-type"] == b"response" else None,
        }


_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(spark, folder: str) -> DataFrame:
    """All records of a folder's archives; a revisit record has no payload of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for record in parse(batch.column(0)[i].as_py()):
                    rows.append(record)
                    size += len(record["payload"] or b"")
                    if len(rows) == 500 or size >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(lean(run), _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """records whose revisits have what their original response (of the page that they refer to, and of their digest) holds: payload, payload_bytes and payload_digest."""
    known = [c for c in ("payload", "payload_bytes", "payload_digest") if c in records.columns]
    asked = records.where("record_type = 'revisit'")
    wanted = _small(materialize(asked.select("refers_to", "payload_digest").distinct(), "referred"))
    found = records.where("record_type = 'response'").withColumnRenamed("page_id", "refers_to_page").join(
        wanted.select(F.col("refers_to").alias("refers_to_page"), F.col("payload_digest").alias("asked_digest")), "refers_to_page"
    )
    found = found.where("payload_digest = asked_digest").select("refers_to_page", "asked_digest", *(F.col(c).alias(f"found_{c}") for c in known)).dropDuplicates(["refers_to_page", "asked_digest"])
    met = asked.join(found, (F.col("refers_to") == F.col("refers_to_page")) & (F.col("payload_digest") == F.col("asked_digest")), "left")
    answered = met.select(*(F.col(f"found_{c}").alias(c) if c in known else F.col(c) for c in records.columns))
    return records.where("record_type = 'response'").union(answered)


def digests(pages: DataFrame) -> DataFrame:
    """The op10 row of every page, read back from the archives: digest and size are computed from stored payloads, a revisit's from its original's."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder)
    own = F.col("payload").isNotNull()
    light = read(pages.sparkSession, folder).select(
        "page_id",
        F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    return resolved(materialize(light, "records"))


def oracle() -> str:
    """DuckDB SQL for the op10 query."""
    runs = " || ".join(
        f"substr('{BASE32}', 1 + CAST((v{i} // {32 ** (7 - j)}) % 32 AS INTEGER), 1)" for i in range(4) for j in range(8)
    )
    values = ", ".join(f"CAST('0x' || substr(s, {1 + 10 * i}, 10) AS BIGINT) AS v{i}" for i in range(4))
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, payload_bytes, {runs} AS payload_digest FROM (SELECT *, {values} FROM p)),
o AS (SELECT payload_digest, min(page_id) AS original FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d JOIN o USING (payload_digest)"""
