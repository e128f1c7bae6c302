"""Operator 5: token ids as length-delimited binary records with a separate offset index.

A record is ``length (u64) | masked checksum of the length (u32) | payload |
masked checksum of the payload (u32)``, little-endian.  The payload is ``id width
in bytes (u8) | 1 if there is a document id (u8) | document id (i64) | token ids``.
The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a
checksum stored inside checked data does not weaken it.

Files hold documents in ascending order of their id.  A task writes one file under
a name of its own attempt; only files that the index names belong to the data set,
so a repeated or lost task does no harm.  The index (one row per record) is a
Parquet table: any record can be read alone, in any order.

Empty and null texts give a record with the end id only.  Null document ids come
first.  Rows with equal ids each get a record.  An empty table gives no file and an
empty index.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import common, tokens

INDEX_SCHEMA = "file string, part int, doc_id long, at long, size long, start long, n_tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
READ_BYTES = 16 << 20
_HEAD = struct.Struct("<QI")
_FRONT = struct.Struct("<BBq")


class DamagedRecord(ValueError):
    """A length or payload does not fit its checksum."""


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_checksum(length)), payload, struct.pack("<I", masked_checksum(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one framed record; raises ``DamagedRecord``."""
    if len(record) < _HEAD.size + 4:
        raise DamagedRecord("record is cut short")
    length, check = _HEAD.unpack_from(record)
    if masked_checksum(record[:8]) != check or len(record) != _HEAD.size + length + 4:
        raise DamagedRecord("length does not fit")
    payload = record[_HEAD.size : -4]
    if masked_checksum(payload) != struct.unpack("<I", record[-4:])[0]:
        raise DamagedRecord("payload does not fit its checksum")
    return payload


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.rec"
    files, path = open_folder(folder)
    out, at, start = None, 0, 0
    for batch in batches:
        ids_of_docs = batch.column("doc_id").to_pylist()
        for row, ids, bounds in tokens.encode_column(tokenizer, batch.column("text")):
            if out is None:
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(f"{path}/{name}", buffer_size=4 << 20)
            end = np.array([end_id], ids.dtype).tobytes()
            raw, width = ids.tobytes(), ids.dtype.itemsize
            sizes, counts = [], []
            docs = ids_of_docs[row : row + len(bounds) - 1]
            for i, doc in enumerate(docs):
                front = _FRONT.pack(width, doc is not None, doc or 0)
                record = frame(front + raw[bounds[i] * width : bounds[i + 1] * width] + end)
                out.write(record)
                sizes.append(len(record))
                counts.append(int(bounds[i + 1] - bounds[i]) + 1)
            size, count = np.array(sizes, np.int64), np.array(counts, np.int64)
            yield pa.record_batch(
                {
                    "file": pa.array([name] * len(docs), pa.string()),
                    "part": pa.array(np.full(len(docs), part, np.int32)),
                    "doc_id": pa.array(docs, pa.int64()),
                    "at": pa.array(at + np.cumsum(size) - size),
                    "size": pa.array(size),
                    "start": pa.array(start + np.cumsum(count) - count),
                    "n_tokens": pa.array(count),
                }
            )
            at, start = at + int(size.sum()), start + int(count.sum())
    if out is not None:
        out.close()


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents as record files in ``folder`` and return their stored index.

    ``tokenizer`` is a tokenizers file that executors can read; ``end_id`` closes
    every document.  In the index ``start`` counts all ids before a record.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    index = common.stored(ordered.mapInArrow(lambda batches: _write(batches, folder, tokenizer, end_id), INDEX_SCHEMA), "record-index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("_tokens"))
    files = files.withColumn("_before", F.coalesce(F.sum("_tokens").over(before), F.lit(0))).select("file", "_before")
    # One row per file, and a file per shuffle partition at most: small whatever the corpus holds.
    return index.join(F.broadcast(files), "file").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, path = open_folder(folder)
    name, source = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "at", "size", "start", "n_tokens")]
        docs, starts, counts, ids, held = [], [], [], [], 0
        for file, at, size, start, count in zip(*columns, strict=True):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, files.open_input_file(f"{path}/{file}")
            payload = unframe(source.read_at(size, at))
            width, has_id, doc = _FRONT.unpack_from(payload)
            found = np.frombuffer(payload, f"<u{width}", offset=_FRONT.size)
            if len(found) != count:
                raise DamagedRecord(f"{file} at {at} holds {len(found)} ids, the index says {count}")
            docs.append(doc if has_id else None)
            starts.append(start)
            counts.append(len(found))
            ids.append(found.astype("<u4").tobytes())
            held += len(ids[-1])
            if held > 4 << 20:
                yield _found(docs, starts, counts, ids)
                docs, starts, counts, ids, held = [], [], [], [], 0
        if docs:
            yield _found(docs, starts, counts, ids)
    if source is not None:
        source.close()


def _found(docs: list, starts: list, counts: list, ids: list) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.record_batch([pa.array(x, k) for x, k in zip((docs, starts, counts, ids), kinds.values(), strict=True)], list(kinds))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names, which may be any rows of it, and check every sum.

    ``ids`` are unsigned 32-bit little-endian.  Work is dealt by file and by
    ``READ_BYTES`` of it, so a task reads neighbouring records.
    """
    total = index.agg(F.sum("size")).first()[0] or 0
    dealt = index.repartition(max(1, -(-total // READ_BYTES)), "file", F.floor(F.col("at") / READ_BYTES))
    return dealt.sortWithinPartitions("file", "at").mapInArrow(lambda batches: _read(batches, folder), READ_SCHEMA)
