"""Legacy web archives (ARC) to WARC.

An ARC file starts with a version block, whose first line tells version 1 or
2; the version says which fields the header line of each record has. The last
field is the record's declared length, and the body follows. Conversion gives
each record what WARC wants and ARC lacks: an identifier (a UUID made from the
record's content, so a task that runs twice writes the same), a timestamp in
ISO form, a type, and block and payload digests. Of records with equal
payloads one is the response and the others revisit it.

Archives are written and read by Spark's own sources: the text writer puts
one record per row with the archive's record separator, and ``binaryFile``
hands whole archives to the tasks, which parse them as streams by declared
lengths. Any file system that Spark can reach will do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.store import new_path

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: zlib level of the archives, below the default: half the CPU seconds for little more space.
LEVEL = "THREE"
#: Header-line fields of both versions, in order.
FIELDS = {1: ("url", "ip", "date", "type", "length"),
          2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length")}
TITLES = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
DATE = "20240102030405"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = b"X-Record-Key"


def _one_word(text: str | None) -> str:
    """A header-line field: no white space or control characters, never empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text or "") or "-"


def arc_file_start(name: str, version: int) -> bytes:
    block = f"{version} 0 quarry\n{TITLES[version]}\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{extra} {len(block)}\n".encode() + block


def arc_record(url: str | None, body: bytes, version: int, date: str = DATE) -> bytes:
    values = {"url": _one_word(url), "ip": "0.0.0.0", "date": date, "type": "text/html", "status": "200", "checksum": "-",
              "location": "-", "offset": "0", "filename": "-", "length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body


def http_response(payload: bytes, key: object) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n".encode()
    return head + ID_HEADER + b": " + ("" if key is None else str(key)).encode() + b"\r\n\r\n" + payload


def read_arc(stream) -> Iterator[dict]:
    """Records of an ARC stream as dictionaries with the version's fields and
    ``body``. Blank lines between records are skipped. A header line that does
    not fit its version, or a body that ends early, raises ValueError."""
    version = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        words = line.decode("utf-8", "replace").split()
        if version is None:
            if not words or not words[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with its version block")
            block = _exactly(stream, int(words[-1]))
            version = int(block.split(None, 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if len(words) != len(FIELDS[version]):
            raise ValueError(f"{len(words)} fields in a version {version} header line")
        record = dict(zip(FIELDS[version], words))
        yield record | {"version": version, "body": _exactly(stream, int(record["length"]))}


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("the archive ends inside a record")
    return data


def split_http(body: bytes) -> tuple[dict[bytes, bytes], bytes, bytes]:
    """(headers, head with its blank line, payload)."""
    head, gap, payload = body.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    return fields, head + gap, payload


def warc_date(date: str) -> str:
    """An ARC date (up to 14 digits; missing ones are zeros or the first day) in ISO form."""
    full = date[:14] + "00000101000000"[len(date[:14]):]
    return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*parts: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'\0'.join(parts)).digest()[:16], version=4)}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its end; two line ends follow each record."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by declared lengths."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            fields[k] = v
        yield fields, _exactly(stream, int(fields["Content-Length"]))


def _write(records: DataFrame, path: str, separator: str) -> None:
    # bytes as they are: a cast from binary to string keeps them
    (records.select(F.col("record").cast("string")).write.option("lineSep", separator)
     .option("compression", "gzip").option("zlib.compress.level", LEVEL).text(path))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """One gzip ARC file per partition, of version 1 and 2 in turn."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        yield pa.RecordBatch.from_arrays([pa.array([arc_file_start(f"part-{part}.arc", version)], pa.binary())], names=["record"])
        for batch in batches:
            rows = [arc_record(u.as_py(), http_response((h.as_py() or "").encode("utf-8"), k.as_py()), version)
                    for k, u, h in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])

    _write(pages.select(id_col, url_col, body_col).mapInArrow(run, "record binary"), path, "\n")


def arc_records(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """The records of all ARC files under a folder, with what WARC wants:
    key, uri, ip, date, head, payload, payload_bytes, digest, record_id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()),
                            ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                            ("digest", pa.string()), ("record_id", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in read_arc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    fields, head, payload = split_http(r["body"])
                    key, digest = fields.get(ID_HEADER, b""), hashlib.sha256(payload).hexdigest()
                    rows.append((key.decode() or None, r["url"], r["ip"], warc_date(r["date"]), head, payload, len(payload), digest,
                                 record_id(r["url"].encode(), r["date"].encode(), key, digest.encode())))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out = _archives(spark, path).mapInArrow(
        run, "key string, uri string, ip string, date string, head binary, payload binary, payload_bytes long, "
             "digest string, record_id string")
    return out.withColumn("key", F.col("key").cast(id_type))


def convert(spark: SparkSession, arc_path: str, warc_path: str, id_type: str = "long") -> None:
    """Write one gzip WARC file per partition from a folder of ARC files. Of
    records with equal payloads of REVISIT_BYTES or more, the one with the
    smallest key (nulls last) is the response. Only digests are grouped; the
    largest group of copies is a partial aggregate like any other."""
    records = arc_records(spark, arc_path, id_type)
    firsts = (records.filter(F.col("payload_bytes") >= REVISIT_BYTES)
              .groupBy("digest", "payload_bytes")
              .agg(F.count("*").alias("copies"),
                   F.min(F.struct(F.col("key").isNull().alias("none"), "key", "record_id")).alias("f"))
              .filter("copies > 1")
              .select("digest", "payload_bytes", F.col("f.key").alias("first_key"), F.col("f.record_id").alias("first_id")))
    whole = records.join(firsts, ["digest", "payload_bytes"], "left").select(*records.columns, "first_key", "first_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part = str(TaskContext.get().partitionId())
        info = f"software: quarry\r\nformat: WARC File Format 1.1\r\npart: {part}\r\n".encode()
        yield pa.RecordBatch.from_arrays([pa.array([warc_record(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(b"warcinfo", part.encode())), ("WARC-Date", warc_date(DATE)),
             ("Content-Type", "application/warc-fields")], info)], pa.binary())], names=["record"])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                again = r["first_id"] is not None and r["first_id"] != r["record_id"]
                block = r["head"] if again else r["head"] + r["payload"]
                fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", r["record_id"]),
                          ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]),
                          ("Content-Type", "application/http; msgtype=response"),
                          ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
                          ("WARC-Payload-Digest", "sha256:" + r["digest"])]
                if again:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["first_id"]),
                               ("X-Refers-To-Key", "" if r["first_key"] is None else str(r["first_key"]))]
                rows.append(warc_record(fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])

    _write(whole.mapInArrow(run, "record binary"), warc_path, "\r\n\r\n")


def warc_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The response and revisit records of all WARC files under a folder:
    page_id, payload_bytes, payload_digest, record_type, refers_to, record_id,
    target_uri, warc_date. Digests of blocks and payloads are verified."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
                    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                    rows.append((http.get(ID_HEADER, b"").decode() or None, int(http[b"Content-Length"]), digest,
                                 fields["WARC-Type"], fields.get("X-Refers-To-Key") or None, fields["WARC-Record-ID"],
                                 fields["WARC-Target-URI"], fields["WARC-Date"]))
                types = [pa.string(), pa.int64(), *[pa.string()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    out = _archives(spark, path).mapInArrow(
        run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
             "record_id string, target_uri string, warc_date string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Pages through ARC files to WARC files and back, one row per page (see
    ``warc_records``). A null body is an empty payload, a null URL ``-``.
    Rows alike in id, URL and body have one record identifier: they are copies
    of one record, and the first id among equal payloads is a response each
    time it occurs."""
    spark, id_type = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, body_col)
    convert(spark, arc, warc, id_type)
    return warc_records(spark, warc, id_type)
