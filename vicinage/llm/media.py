"""Media columns: texts stored as MPEG audio, and MPEG audio read back.

Cases: a null or empty text is stored as one unit of spaces; texts of any length are stored whole; repeated rows give
equal bytes; an empty table gives an empty table; a null stream has null results, and bytes without any frame have no
frames and a duration of 0. Of the input, only the columns named in ``keep`` go on, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import mpeg

_FEATURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, n_samples long, sample_rate int, duration_s double, skipped_bytes long, bad_crc long, frame_offsets array<long>"
)
#: A batch of results goes on when it has so many bytes, so that a task's memory does not follow the batch's rows.
FLUSH_BYTES = 8 << 20


def _flushed(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)


def store_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``media``: the UTF-8 bytes of the text as an MPEG audio stream."""
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            schema = pa.schema([(key, batch.schema.field(0).type), ("media", pa.binary())])
            yield from _flushed(((len(m), (k, m)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in [mpeg.write((t.as_py() or "").encode())]), schema)

    return df.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, media binary")


def features(media: bytes | None) -> tuple:
    """Results for one stream, in the order of the schema."""
    if media is None:
        return (None,) * 14
    got = mpeg.parse(media)
    held = mpeg.payload(media, got)
    seconds = got["samples"] / got["rate"] if got["rate"] else 0.0
    table = got["table"]
    feature = f"v{got['version']}:l{got['layer']}:{got['rate']}Hz:{len(got['offsets'])}f:{got['samples']}s:{table['kind'] + ('' if table['fits'] else '!') if table else '-'}:{got['checked'] - got['bad']}/{got['checked']}ok"
    n = got["tags"].get("TXXX:payload_bytes", "")
    return (int(n) if n.isdigit() else None, len(held), hashlib.sha256(held).hexdigest(), mpeg.tail_crc(held), len(media), hashlib.sha256(media).hexdigest(), feature, len(got["offsets"]), got["samples"], got["rate"], seconds, got["skipped"], got["bad"], got["offsets"])


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Key and what the stream holds: payload length and hash, exact duration, frame offsets, checksum results, feature."""
    kind = df.schema[key].dataType

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        for batch in batches:
            schema = pa.schema([(key, batch.schema.field(0).type), *zip(names, types)])
            yield from _flushed(((8 * (row[7] or 0) + 400, (k, *row)) for k, m in zip(batch.column(0).to_pylist(), batch.column(1)) for row in [features(m.as_py())]), schema)

    return df.select(key, media).mapInArrow(run, f"{key} {kind.simpleString()}, {_FEATURES}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_media(store_text(docs))
