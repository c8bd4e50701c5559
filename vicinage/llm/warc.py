"""WARC archives: pages written as gzip members in tasks, and archives read back by byte ranges.

A range of a file is read by one task. The task looks for the magic bytes of gzip, takes a place for the start of a record only
if a member decodes there (checksum included) to a WARC header and a block of the length it names, and owns the records that
start in its range; it reads on past the end of the range to complete the last one. A damaged member is passed over: reading
goes on at the next magic bytes. A record that lies within another's block (an archive stored in an archive) is never taken for
one of the file: where a range begins inside such a block, ``whole_records`` drops what starts before the outer record ends.

Cases: a null or empty page has an empty payload; payloads of any length are stored whole; a page without an address has no
target; pages with a null key are responses and nothing refers to them; of repeated rows all with the largest key are responses.
An empty table gives no archive and no records. Only the named columns are read, so extra columns cannot clash.
Archives lie where pyarrow's file systems reach them (local or mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .media import _flushed

#: Payloads from so many bytes on are stored once.
LEAST_BYTES = 1000
#: A task begins a new archive after so many bytes; readers take ranges of so many.
ARCHIVE_BYTES, RANGE_BYTES = 1 << 30, 8 << 20
#: Ranges are dealt over at most so many tasks.
MOST_TASKS = 20_000
#: Copies of a payload meet their response in so many shares, where the list of responses is too long to be sent to all tasks.
SALTS = 64
#: Fixed values of the formats: first bytes of a gzip member, the profile of records that name an earlier equal payload.
MAGIC, PROFILE = b"\x1f\x8b\x08", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_RECORDS = "path string, range_start long, start long, stop long, type string, key string, target string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean"


# --- writing ---------------------------------------------------------------------------------------------------------


def with_references(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url", least: int = LEAST_BYTES, broadcast_rows: int = tables.BROADCAST_ROWS) -> DataFrame:
    """(key, url, payload, refers_to): ``refers_to`` is the largest key of an equal payload, where that is another row's and the payload
    has ``least`` bytes."""
    text = F.coalesce(F.col(payload), F.lit(""))
    address = F.col(url).cast("string") if url else F.lit(None).cast("string")
    rows = pages.select(F.col(key).alias("key"), address.alias("url"), text.alias("payload")).withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    copies = rows.filter("same is not null").groupBy("same").agg(F.max("key").alias("latest"), F.count(F.lit(1)).alias("n"))
    copies = tables.kept(copies.filter("n > 1 and latest is not null").drop("n"))
    if copies.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(F.broadcast(copies), "same", "left")
    else:
        salt = F.pmod(F.xxhash64("key", "url"), F.lit(SALTS))
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
        alone = F.concat(F.lit("-"), F.xxhash64("key", "payload"))  # small payloads are spread, not gathered under null
        rows = rows.withColumn("same", F.coalesce("same", alone)).withColumn("salt", salt).join(copies, ["same", "salt"], "left")
    return rows.select("key", "url", "payload", F.when(F.col("key") != F.col("latest"), F.col("latest")).alias("refers_to"))


def _uri(key) -> str:
    return f"<urn:page:{'' if key is None else quote(str(key), safe='')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def record(key, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One gzip member: a response with its payload, or, with ``refers_to``, a revisit that has only the header of the reply."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    fields += [("WARC-Payload-Digest", _sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    reply = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _member(fields, reply if refers_to is not None else reply + payload)


def write_warc(rows: DataFrame, folder: str, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (key, url, payload, refers_to) as archives; (path, size) of them, as a written table. Every attempt of a task writes files of its own
    names, and only those of the attempts that counted are in the result, so a lost executor leaves nothing that is read."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size = None, "", 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([size])], ["path", "size"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, refers_to = (column[i].as_py() for column in batch.columns)
                member = record(key, url, payload.encode() if isinstance(payload, str) else payload, refers_to, date)
                if out is not None and size + len(member) > archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                    start = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(start)
                    size = len(start)
                out.write(member)
                size += len(member)
        if out is not None:
            yield closed()

    return tables.written(rows.select("key", "url", "payload", "refers_to").mapInArrow(run, "path string, size long"), "warc-files")[0]


# --- reading ---------------------------------------------------------------------------------------------------------


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files of a folder or pattern; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def byte_ranges(files: DataFrame, split: int = RANGE_BYTES) -> DataFrame:
    """(path, begin, end, size), dealt evenly over tasks."""
    many = F.ceil(F.col("size") / split)
    n = files.agg(F.sum(many)).first()[0] or 1
    begin = F.col("k") * split
    rows = files.filter("size > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return rows.select("path", begin.alias("begin"), F.least(begin + split, "size").alias("end"), "size").repartition(max(1, min(int(n), MOST_TASKS)))


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space continues the one before."""
    out, last = {}, ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, sep, value = line.decode("utf-8", "replace").partition(":")
        if sep:
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def decode(read, at: int, size: int) -> tuple[int, dict[str, str], bytes] | None:
    """(stop, header, block) of the record in the gzip member at a place, or None if there is none whole. ``read(a, b)`` gives bytes."""
    unpack, parts, step, checked = zlib.decompressobj(31), [], 4096, False
    try:
        while not unpack.eof:
            chunk = read(at, min(at + step, size)) if at < size else b""
            if not chunk:
                return None
            at, step = at + len(chunk), min(2 * step, 1 << 20)
            parts.append(unpack.decompress(chunk))
            if not checked and sum(map(len, parts)) >= 7:
                if not b"".join(parts).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    plain = b"".join(parts)
    head, found, rest = plain.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = _headers(head.split(b"\r\n")[1:])
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields or "warc-record-id" not in fields or len(rest) < int(length):
        return None
    return at - len(unpack.unused_data), fields, rest[: int(length)]


def members(read, begin: int, end: int, size: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, stop, header, block) of the records that start within a range."""
    held = read(begin, min(end + len(MAGIC) - 1, size))
    at = held.find(MAGIC)
    while at >= 0 and begin + at < end:
        place = begin + at
        got = decode(lambda a, b: held[a - begin : b - begin] if a < begin + len(held) else read(a, b), place, size)
        if got is None:
            at = held.find(MAGIC, at + 1)
            continue
        yield place, *got
        at = held.find(MAGIC, got[0] - begin)


def _hex_digest(value: str) -> str | None:
    kind, _, text = value.partition(":")
    try:
        return None if kind.lower() != "sha1" else (text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex())
    except ValueError:
        return None


def _key(uri: str | None) -> str | None:
    """The key in an id of ours, or the id itself."""
    if uri is None:
        return None
    inner = uri.strip("<>")
    return (unquote(inner[9:]) or None) if inner.startswith("urn:page:") else inner


def summary(fields: dict[str, str], block: bytes) -> tuple[tuple, bytes | None]:
    """What is known of a record, and its payload (None for a revisit, whose lengths and digest are those of the payload left out)."""
    kind, stated = fields["warc-type"], _hex_digest(fields.get("warc-payload-digest", ""))
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(head.split(b"\r\n")[1:])
    block_ok = _hex_digest(fields.get("warc-block-digest", "")) in (None, hashlib.sha1(block).hexdigest())
    if kind == "revisit":
        length = http.get("content-length", "")
        size, digest, payload = int(length) if length.isascii() and length.isdigit() else None, stated, None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        block_ok = block_ok and stated in (None, digest)
    target = fields.get("warc-target-uri")
    return (kind, _key(fields["warc-record-id"]), target, _key(fields.get("warc-refers-to")), size, digest, block_ok), payload


def read_warc(files: DataFrame, split: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """The records of archives (path, size): their place, type, ids, length and SHA-1 of the payload, whether the digests in the record
    hold, and the payload if asked for. A revisit's length and digest are those it names. Pass the written rows to ``whole_records``."""
    types = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema([*zip([c.split()[0] for c in _RECORDS.split(", ")], types), *([("payload", pa.binary())] if payload else [])])

    def rows(batches):
        from pyarrow import fs

        for batch in batches:
            for path, begin, end, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    for start, stop, fields, block in members(lambda a, b: file.read_at(b - a, a), begin, end, size):
                        known, content = summary(fields, block)
                        yield 400 + len(content or b"") * payload, (path, begin, start, stop, *known, *([content] if payload else []))

    return byte_ranges(files, split).mapInArrow(lambda batches: _flushed(rows(batches), schema), _RECORDS + (", payload binary" if payload else ""))


def whole_records(records: DataFrame) -> DataFrame:
    """Records that start in no other record of their file. ``records`` is read twice, so it should be a written table. A range's first
    records are nested only if the record that runs into the range ends after them; of a file, only ends of ranges are compared."""
    from pyspark.sql.window import Window

    ends = records.groupBy("path", "range_start").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    before = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    inside = ends.withColumn("until", F.max("last").over(before)).filter("first < until").select("path", "range_start", "until")
    inside = tables.kept(inside)
    if not inside.take(1):
        return records
    return records.join(tables.small(inside), ["path", "range_start"], "left").filter("until is null or start >= until").drop("until")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{tables.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_warc(with_references(pages), folder)
    records, _ = tables.written(read_warc(files, payload=False), "warc-records")
    tables.drop(spark, folder)  # the records that were read back are written
    kind = pages.schema["page_id"].dataType
    rows = whole_records(records).filter("type in ('response', 'revisit')")
    return rows.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "digest_ok")


SQL = """WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages), l AS (SELECT s, max(page_id) AS latest FROM d WHERE n >= 1000 GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.s AS payload_digest, CASE WHEN page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to, true AS digest_ok FROM d LEFT JOIN l ON l.s = d.s AND n >= 1000"""
