"""Token sequences as length-delimited binary records with an offset index.

A record is framed as: payload length (unsigned 64 bit), masked crc32 of those eight bytes (unsigned 32 bit), payload,
masked crc32 of the payload; all little-endian. The payload is one sequence: doc_id (signed 64 bit), number of ids
(unsigned 64 bit), bytes per id (2 or 4), one when doc_id is given, then the ids. The index is a Parquet table with one row
per record; a file counts only when the index names it, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.tokens import END_ID, encoder, ids_crc32, vocabulary_path

# Fixed value: added to a rotated checksum, so that checksums of data holding checksums stay sound.
MASK = 0xA282EAD8
LENGTH, CHECK, HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qQBB")
INDEX = "doc_id bigint, part int, file string, offset bigint, n_bytes bigint, n_tokens bigint"
SEQUENCES = "doc_id bigint, start bigint, n_tokens bigint, ids binary, width int"
# Rows given on at a time, and files that a task of shuffled reads holds open.
ROWS, OPEN_FILES = 512, 64


def masked(data: bytes) -> int:
    check = zlib.crc32(data)
    return ((check >> 15 | check << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = HEAD.pack(doc_id or 0, len(ids), ids.dtype.itemsize, doc_id is not None) + ids.tobytes()
    length = LENGTH.pack(len(payload))
    return length + CHECK.pack(masked(length)) + payload + CHECK.pack(masked(payload))


def read_frame(source) -> tuple[int | None, np.ndarray] | None:
    """The next record of a file, None at its end; ValueError when a checksum does not fit."""
    head = source.read(LENGTH.size + CHECK.size)
    if not head:
        return None
    length = head[: LENGTH.size]
    if len(head) < LENGTH.size + CHECK.size or CHECK.unpack_from(head, LENGTH.size)[0] != masked(length):
        raise ValueError("damaged record length")
    size = LENGTH.unpack(length)[0]
    rest = source.read(size + CHECK.size)
    payload = rest[:size]
    if len(rest) < size + CHECK.size or CHECK.unpack_from(rest, size)[0] != masked(payload):
        raise ValueError("damaged record")
    doc_id, n, width, given = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, np.dtype(f"<u{width}"), n, HEAD.size)
    return (doc_id if given else None), ids


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None,
                  vocabulary: str | None = None) -> DataFrame:
    """Encode ``docs`` into record files below ``folder``, ascending by ``doc_id``, and give back their index.

    Files hold ranges of ids: part 0 the smallest (NULL first), rows of one id by text. A NULL text is an empty one; every
    sequence ends in id 0. Texts move once, before they are encoded, as they are smaller than their ids. ``folder`` must
    be shared by all executors. An empty table writes no file and an empty index.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.records"
        encode, kind = encoder(path).encode_batch, encoder(path).kind
        at, out = 0, None
        try:
            for batch in batches:
                encoded = encode(batch.column(1))
                for lo in range(0, batch.num_rows, ROWS):
                    index = []
                    for key, found in zip(batch.column(0).slice(lo, ROWS).to_pylist(), encoded):
                        ids = np.append(found, END_ID).astype(kind)
                        record = frame(key, ids)
                        if out is None:
                            out = store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                        out.write(record)
                        index.append((key, part, name, at, len(record), len(ids)))
                        at += len(record)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(
                            zip(*index), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                        names=["doc_id", "part", "file", "offset", "n_bytes", "n_tokens"],
                    )
        finally:
            if out is not None:
                out.close()

    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _walk(index: DataFrame, folder: str, emit, schema: str) -> DataFrame:
    """``emit`` of all sequences of the files, one task per file, front to end.

    What a file starts with is the sum over the files before it, a table of one row per file. The counts of the index are
    checked against the files.
    """
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))
    by_part = Window.orderBy("part")
    files = files.withColumns({
        "base": F.coalesce(F.sum("tokens").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "slot": (F.row_number().over(by_part) - 1).cast("int"),
    })
    slots = max(1, index.select("file").distinct().count())

    def read(batches):
        store, root = _open(folder)
        for row in (row for batch in batches for row in batch.to_pylist()):
            start, seen, rows, size = row["base"], 0, [], 0
            with store.open_input_stream(f"{root}/{row['file']}", buffer_size=1 << 20) as source:
                while (found := read_frame(source)) is not None:
                    key, ids = found
                    rows.append((key, start, ids))
                    start, seen, size = start + len(ids), seen + 1, size + ids.nbytes
                    if len(rows) >= ROWS or size > 1 << 23:
                        yield emit(rows)
                        rows, size = [], 0
                if rows:
                    yield emit(rows)
            if seen != row["records"] or start - row["base"] != row["tokens"]:
                raise ValueError(f"{row['file']} does not hold what its index says")

    return files.repartitionById(slots, F.col("slot")).mapInArrow(read, schema)


def read_in_order(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, width) of all sequences; ``start`` counts the ids of all sequences before."""
    return _walk(index, folder, _sequences, SEQUENCES)


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all sequences, the ids themselves left in the tasks."""

    def emit(rows):
        keys, starts, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (keys, starts, map(len, ids), map(ids_crc32, ids))],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _walk(index, folder, emit, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    keys, starts, ids = zip(*rows)
    columns = [(keys, pa.int64()), (starts, pa.int64()), (map(len, ids), pa.int64()),
               ([i.tobytes() for i in ids], pa.binary()), ([i.dtype.itemsize for i in ids], pa.int32())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in columns], names=["doc_id", "start", "n_tokens", "ids", "width"])


def read_shuffled(wanted: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids, width) of the records that rows of the index name, in the order of those rows."""

    def read(batches):
        store, root = _open(folder)
        opened = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = []
                for row in batch.slice(lo, ROWS).to_pylist():
                    if row["file"] not in opened:
                        if len(opened) >= OPEN_FILES:
                            opened.clear()
                        opened[row["file"]] = store.open_input_file(f"{root}/{row['file']}")
                    opened[row["file"]].seek(row["offset"])
                    key, ids = read_frame(opened[row["file"]])
                    rows.append((key, 0, ids))
                yield _sequences(rows)

    return wanted.select("file", "offset").mapInArrow(read, SEQUENCES).select("doc_id", "n_tokens", "ids", "width")
