"""WARC archives by way of a legacy archive converter.

Legacy (ARC) files begin with a version block that names the fields of the header lines to
come: version 1 has five, version 2 adds result code, checksum, location, offset and file
name. Every record is one such line and as many bytes as it declares. The converter reads
the version and the field names from the version block, splits each header line by them, takes
the declared length, and synthesises what a WARC record needs and an ARC record lacks: an
identifier (a name-based UUID), a timestamp with zone, a type, content types and digests.

Pages of equal payloads of some size are archived once, in full for the largest page
identifier; the others become revisit records that refer to it by its record identifier. Which
pages those are is known from payload digests before anything is written.

Archives are written by Spark into the shared folder, every record a gzip member of its own (a zero
byte, which gzip takes for padding, ends each), and read back by parsing them record by record.

Null payloads count as empty, null addresses as 'unknown:'; bytes that an ARC header line
can't hold are percent-encoded. Payloads are bytes, whether they are UTF-8 or not. Null identifiers come before all others, and their records
are responses. Rows repeated with one identifier and payload are all responses, or all
revisits. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, join_groups, scratch, settings, small_enough

#: Payloads below so many bytes are never revisits.
REVISIT_BYTES = 1000
#: Groups of equal payloads that may go by broadcast: at some 150 bytes each, 30 MB.
BROADCAST_REVISITS = 200_000
#: Records in one archive file.
FILE_RECORDS = 2000
#: Of compression.
LEVEL = 6
CAPTURED = "20000101000000"

# Fixed values of the two archive formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGE, DIGEST, TARGET = "X-Page-ID", "X-Payload-SHA1", "X-Revisit-Of"


def _word(text: str | None) -> str:
    """text as one field of a header line."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogateescape")) for c in text or "") or "-"


def arc_file(records: list[tuple[str, bytes]], version: int, captured: str = CAPTURED, name: str = "pages.arc") -> bytes:
    """A legacy file of (address, block) records."""
    names = f"{version} 0 weftline\n{' '.join(ARC_FIELDS[version])}\n".encode()
    own = {"IP-address": "0.0.0.0", "Archive-date": captured, "Result-code": "200", "Checksum": "-", "Location": "-", "Filename": name}
    out = io.BytesIO()

    def put(url: str, kind: str, block: bytes) -> None:
        fields = own | {"URL": url, "Content-type": kind, "Archive-length": str(len(block)), "Offset": str(out.tell())}
        out.write((" ".join(fields[f] for f in ARC_FIELDS[version]) + "\n").encode() + block + b"\n")

    put(f"filedesc://{name}", "text/plain", names)
    for url, block in records:
        put(url, "text/html", block)
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the header line, block) of every record after the version block."""
    # the version block's own line has that version's fields; address, date and length come first, third and last in both
    at = data.index(b"\n")
    size = int(data[:at].rsplit(b" ", 1)[1])
    version, fields = data[at + 1 : at + 1 + size].decode().split("\n")[:2]
    names = fields.split(" ")
    if names != ARC_FIELDS.get(int(version.split(" ")[0])):
        raise ValueError(f"a version block that no version has: {version!r}, {fields!r}")
    at += 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without an end")
        values = data[at:end].decode().split(" ")
        if len(values) != len(names):
            raise ValueError(f"a header line of {len(values)} fields for {len(names)}")
        record = dict(zip(names, values))
        size = int(record["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError("a record shorter than its declared length")
        yield record, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def record_id(url: str, date: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {date} {url}')}>"


def _date(arc: str) -> str:
    return f"{arc[:4]}-{arc[4:6]}-{arc[6:8]}T{arc[8:10]}:{arc[10:12]}:{arc[12:14]}Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode("utf-8", "surrogateescape").split("\r\n")[1:] if ": " in line)


def to_warc(record: dict[str, str], block: bytes) -> bytes:
    """A WARC record, without the blank lines after it, from a legacy one that holds an HTTP response."""
    url, date = record["URL"], _date(record["Archive-date"])
    head, _, payload = block.partition(END)
    told = _headers(head)
    lines = {"WARC-Record-ID": record_id(url, date, told.get(PAGE, "")), "WARC-Date": date, "WARC-Target-URI": url, "WARC-IP-Address": record["IP-address"]}
    if TARGET in told:
        digest = "sha1:" + base64.b32encode(bytes.fromhex(told[DIGEST])).decode()
        lines |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": told[TARGET]}
    else:
        digest = _sha1(payload)
        lines["WARC-Type"] = "response"
    lines |= {"WARC-Payload-Digest": digest, "WARC-Block-Digest": _sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in lines.items()).encode() + END + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzipped archive, by declared lengths."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    while first := stream.readline():
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        told = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            told[name] = value
        block = stream.read(size := int(told["Content-Length"]))
        if len(block) != size:
            raise ValueError("an archive that ends within a record")
        yield told, block


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("unknown:")).cast("binary").alias("url"), payload.alias("payload"))
    # a public digest can be made to collide: equal payloads agree in length and a second hash too
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("same", F.concat_ws(" ", "sha1", F.octet_length("payload"), F.xxhash64("payload")))
    sized = rows.select("page_id", "url", "same", F.octet_length("payload").alias("size")).filter(F.col("size") >= REVISIT_BYTES)
    kept = sized.groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 and kept.page_id is not null")
    # a group of copies may be large: what is joined is a row per group, and only groups of two and more
    kept = cut(kept.select("same", F.col("kept.page_id").alias("kept_id"), F.col("kept.url").alias("kept_url"), "n"))
    joined = rows.join(F.broadcast(kept), "same", "left") if small_enough(kept, BROADCAST_REVISITS) else join_groups(rows, kept, ["same"], "n", "left")
    again = (F.col("page_id") != F.col("kept_id")) & (F.octet_length("payload") >= REVISIT_BYTES)
    joined = joined.select("page_id", "url", F.when(again, F.lit(b"").cast("binary")).otherwise(F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "sha1", F.when(again, F.col("kept_id")).alias("kept_id"), F.when(again, F.col("kept_url")).alias("kept_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks: list[tuple[str, bytes]] = []
            for page, url, data, size, sha1, other, other_url in zip(*(c.to_pylist() for c in batch.columns)):
                url, other_url = (None if x is None else x.decode("utf-8", "surrogateescape") for x in (url, other_url))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n{PAGE}: {'' if page is None else page}\r\n{DIGEST}: {sha1}"
                if other is not None:
                    head += f"\r\n{TARGET}: {record_id(_word(other_url), _date(CAPTURED), str(other))}"
                blocks.append((_word(url), head.encode() + END + data))
            # one legacy file of either version, converted record by record
            out = [to_warc(*r) for version in ARC_FIELDS for r in read_arc(arc_file(blocks[version - 1 :: 2], version))]
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x + END, LEVEL, mtime=0) for x in out], pa.binary())], names=["value"])

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
        # bytes become a string unread, and are written as they are
        joined.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_id, record_type, refers_to_id, payload_bytes, payload_digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"]
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = [[] for _ in names]
                for told, block in read_warc(content.as_py()):
                    head, _, payload = block.partition(END)
                    http = _headers(head)
                    digest = base64.b32decode(told["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if told["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"a payload that differs from its digest: {told['WARC-Record-ID']}")
                    page = http[PAGE]
                    for column, value in zip(rows, (int(page) if page else None, told["WARC-Record-ID"], told["WARC-Type"], told.get("WARC-Refers-To"), int(http["Content-Length"]), digest)):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    write_archives(pages, path := scratch(spark, "warc"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):
        records = cut(read_archives(spark, path))
    wanted = records.filter("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = cut(records.join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct())
    held = records.join(F.broadcast(targets) if small_enough(targets, BROADCAST_REVISITS) else targets, "refers_to_id", "left")
    return held.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as h, row_number() over () as rid from pages),
q as (select rid, page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest from p),
k as (select payload_digest, max(page_id) as kept from q where payload_bytes >= {REVISIT_BYTES} group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id < kept and payload_bytes >= {REVISIT_BYTES} then 'revisit' else 'response' end as record_type,
 case when page_id < kept and payload_bytes >= {REVISIT_BYTES} then kept end as refers_to from q left join k using (payload_digest)
"""
