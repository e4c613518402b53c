"""Content-addressed archive of web records in WARC 1.1 form.

Two tables make an archive: ``payloads`` holds the bytes of each distinct payload once, under
its SHA-256, and ``headers`` holds the exact head of every record (WARC and HTTP header lines)
with the digest of its payload. Joining the two gives back the records, byte for byte. Payloads
are packed by zstandard before they are shuffled or written, and unpacked after the join only: each record is
rebuilt from its head and payload, both digests and the stated length are checked on it, and a
mismatch stops the job.

Of records with equal payloads of at least ``min_bytes``, that with the largest id is a
response and the others are revisits that refer to it. Rows that repeat the largest id are
responses too; rows without an id revisit a response that has one, and are known by a digest of
their URL and payload. Null payloads are empty. Characters that no header line may hold are
percent-coded in URLs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize

MIN_BYTES = 1000
#: Level of packing, and unpacked bytes of a batch that is handed on.
LEVEL, PIECE = 3, 1 << 24
CRLF = "\r\n"
HEADERS = "page_id long, sha256 string, record_type string, head string"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page_id: Column) -> Column:
    own = F.concat(F.lit("none-"), F.sha1(F.concat(F.coalesce("url", F.lit("")).cast("binary"), F.lit(b"\0"), F.col("sha256").cast("binary"))))
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), own), F.lit(">"))


def _uri(url: Column) -> Column:
    coded = url
    for code in (*range(33), 127):
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), coded).otherwise(F.coalesce(url, F.lit("urn:unknown")))


def records(pages: DataFrame, min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A head per row of ``pages`` (page_id, url, html): page_id, sha256, record_type, head."""
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = materialize(pages.select("page_id", "url", F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("sha1"), F.sha2(html.cast("binary"), 256).alias("sha256")), "digests")
    # one row for each payload that occurs more than once: counted within tasks before the shuffle
    shared = slim.filter(F.col("bytes") >= min_bytes).groupBy("sha256").agg(F.count("*").alias("n"), F.max("page_id").alias("origin"))
    shared = materialize(shared.filter("n > 1 and origin is not null").select(F.col("sha256").alias("_sha"), "origin"), "shared")
    df = slim.join(shared, F.col("sha256") == F.col("_sha"), "left")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _urn(F.col("origin"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    return df.select(F.col("page_id").cast("long").alias("page_id"), "sha256", F.when(revisit, "revisit").otherwise("response").alias("record_type"), head.alias("head"))


def payloads(pages: DataFrame) -> DataFrame:
    """sha256 and payload (packed bytes), one row per distinct payload; copies meet within tasks first."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            packed = [packer.compress(x.as_buffer()) for x in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array(packed, pa.binary())], names=["sha256", "payload"])

    return pages.select(F.sha2(body, 256).alias("sha256"), body.alias("payload")).mapInArrow(pack, "sha256 string, payload binary").groupBy("sha256").agg(F.first("payload").alias("payload"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the two tables below ``path``."""
    records(pages, min_bytes).write.option("compression", "zstd").parquet(f"{path}/headers")
    payloads(pages).write.option("compression", "none").parquet(f"{path}/payloads")


def rebuilt(head: str, record_type: str, sha256: str, packed: bytes | None) -> tuple[bytes, str]:
    """A record's payload and its SHA-1, if head and payload agree in both digests and in length.

    The stated length is that of the HTTP head, which follows the first empty line, and of a response's payload.
    """
    bad = ValueError(f"payload does not match its record {sha256}")
    try:
        payload = zstandard.ZstdDecompressor().decompress(packed, allow_extra_data=False)
    except (zstandard.ZstdError, TypeError) as e:
        raise bad from e
    sha1 = hashlib.sha1(payload).hexdigest()
    warc, _, http = head.partition(CRLF * 2)
    record = http.encode() + (payload if record_type == "response" else b"")
    stated = {line.partition(": ")[0]: line.partition(": ")[2] for line in warc.split(CRLF)}
    if hashlib.sha256(payload).hexdigest() != sha256 or stated.get("WARC-Payload-Digest") != f"sha1:{sha1}" or stated.get("Content-Length") != str(len(record)):
        raise bad
    return payload, sha1


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, record_type, head, payload (of revisits too),
    payload_bytes, payload_digest.

    Both sides of the join are plain scans, so a payload that many records share is split
    among tasks at run time; it is unpacked once for neighbouring records.
    """
    head = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    body = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    joined = head.join(body.withColumnRenamed("sha256", "_sha"), F.col("sha256") == F.col("_sha"), "left").drop("_sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known, size = [], None, 0
            heads, kinds, digests = (batch.column(c).to_pylist() for c in ("head", "record_type", "sha256"))
            at = 0
            for i, (h, kind, sha) in enumerate(zip(heads, kinds, digests, strict=True)):
                key = (kind, sha, h.partition(CRLF * 2)[2], field_of(h, "WARC-Payload-Digest"), field_of(h, "Content-Length"))
                if known is None or known[0] != key:
                    known = (key, rebuilt(h, kind, sha, batch.column("payload")[i].as_py()))
                rows.append(known[1])
                size += len(known[1][0])
                if size > PIECE or i + 1 == batch.num_rows:  # what is unpacked may be many times as large
                    part = batch.slice(at, i + 1 - at)
                    cells = [pa.array([r[0] for r in rows], pa.binary()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in ("page_id", "sha256", "record_type", "head")] + cells, names=["page_id", "sha256", "record_type", "head", "payload", "payload_bytes", "payload_digest"])
                    at, rows, size = i + 1, [], 0

    return joined.mapInArrow(run, f"{HEADERS}, payload binary, payload_bytes long, payload_digest string")


def field_of(head: str, name: str) -> str | None:
    """A WARC header field's value out of a record's head."""
    at = head.find(f"{CRLF}{name}: ")
    return None if at < 0 else head[at + len(name) + 4 : head.find(CRLF, at + 2)]


def field(name: str, pattern: str) -> Column:
    """A header field's value out of a record's head; null if the head has none."""
    found = F.regexp_extract("head", f"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def described(read: DataFrame) -> DataFrame:
    """What the heads and payloads of rebuilt records say of each."""
    return read.select(
        field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
    )


def write_warc(read: DataFrame, path: str, per_file: int = 5000) -> None:
    """Standard WARC files of an archive's records; the text sink's separator ends each record.

    Only payloads that are text can be written so; revisits carry their head alone.
    """
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    read.select(F.concat("head", body).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """head and payload of every record of WARC files, split by their stated lengths.

    A task holds one file at a time; ``write_warc`` bounds the records of a file.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                at, rows = 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    length = int(next(x for x in data[at:end].split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    cut = data.index(b"\r\n\r\n", end) + 4
                    rows.append((data[at:cut].decode(), data[cut : end + length]))
                    at = end + length + 4
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=["head", "payload"])
                        rows = []
                yield pd.DataFrame(rows, columns=["head", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(split, "head string, payload binary")
