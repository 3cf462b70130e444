"""Token ids in length-delimited binary files with a separate offset index.

A shard holds records in order of the documents' ids. A record is

    length of the payload, 8 bytes | masked CRC-32 of those 8 bytes, 4 bytes
    payload                        | masked CRC-32 of the payload, 4 bytes

all little-endian; a payload is a byte of flags (1: null id), the id (8 bytes), the ids' width in bytes (2 or
4, 1 byte) and the ids. A checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32. The index beside the
shard (.idx) has the records' byte offsets, 8 bytes each, closed by the file's size, so that any record
can be read without the others, in any order.

Texts are range partitioned by id (ties: order of rows), one task writes one shard as a stream, under a name of its own
attempt, and reports it; only reported shards count, so a lost or repeated task leaves no trace in the result.
Files go to the shared folder through pyarrow's file systems. Null text counts as empty (the end id alone);
null ids come first; repeated rows are records of their own; an empty table gives no shards; extra columns are
ignored. Long texts are one record each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXTS, shared_dir, written
from .tokenize import encoder
from .words import slices, trim

END, BUFFER = 1, 1 << 22


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def record(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = struct.pack("<BqB", doc_id is None, doc_id or 0, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", mask(zlib.crc32(size))) + payload + struct.pack("<I", mask(zlib.crc32(payload)))


def parse(raw: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the token ids of one record; ValueError if a length or checksum doesn't hold."""
    (size,) = struct.unpack_from("<Q", raw)
    payload = raw[12 : 12 + size]
    if len(raw) != size + 16 or mask(zlib.crc32(raw[:8])) != struct.unpack_from("<I", raw, 8)[0] or mask(zlib.crc32(payload)) != struct.unpack_from("<I", raw, 12 + size)[0]:
        raise ValueError("damaged record")
    null, doc_id, width = struct.unpack_from("<BqB", payload)
    return None if null else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=10)


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, path: str, folder: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns a table of them: shard, file, records, tokens, base (tokens in the shards before)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")

    def run(batches: Iterator[pa.RecordBatch]):
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        enc, tail, at, tokens, offsets, out = encoder(path), np.array([end], dtype="<u4").tobytes(), 0, 0, [], None
        for b in batches:
            ids_of = b.column(0).to_pylist()
            for i, j, texts in slices(b.column(2)):
                out = out or system.open_output_stream(f"{root}/{name}.rec", buffer_size=BUFFER)
                for d, ids in zip(ids_of[i:j], enc.encode(texts), strict=True):
                    raw = record(d, np.frombuffer(ids + tail, dtype="<u4"))
                    out.write(raw)
                    offsets.append(at)
                    at += len(raw)
                    tokens += len(ids) // 4 + 1
        if out is None:
            return
        out.close()
        trim()
        with system.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.array([*offsets, at], dtype="<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(offsets)], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "file", "records", "tokens"])

    made = written(rows.mapInArrow(run, "shard bigint, file string, records bigint, tokens bigint"), "shards", TEXTS)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written(made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "files")


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one shard in order, read through its index in pieces of about BUFFER bytes."""
    system, root = _system(uri)
    with system.open_input_stream(f"{root}.idx") as f:
        at = np.frombuffer(f.read(), dtype="<u8").astype(np.int64)
    with system.open_input_file(f"{root}.rec") as f:
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + BUFFER, side="right")) - 1)
            raw = f.read_at(int(at[j] - at[i]), int(at[i]))
            for k in range(i, j):
                yield parse(raw[at[k] - at[i] : at[k + 1] - at[i]])
            i = j


def read_record(uri: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record, for shuffled reads."""
    system, root = _system(uri)
    with system.open_input_file(f"{root}.idx") as f:
        begin, end = struct.unpack("<QQ", f.read_at(16, 8 * number))
    with system.open_input_file(f"{root}.rec") as f:
        return parse(f.read_at(end - begin, begin))


def read_shards(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files."""

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[list] = [[], [], [], []]
                for d, ids in read_file(uri):
                    for column, v in zip(out, (d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(v)
                    start += len(ids)
                    if len(out[0]) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "base").repartition(max(1, files.count())).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark)}/records"))
