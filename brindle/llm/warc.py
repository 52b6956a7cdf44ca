"""Web archives through a chunked record table.

A payload is a run of rows, one per chunk of bounded size, named by record and chunk number. Each chunk row carries the digests and
the length of the payload up to its end, so that the last chunk of a record tells those of all of it and no step after the scan
holds a whole payload: the writer knows length, digest and record type from a table without payloads before the first chunk
comes, and the reader gives chunks back as it finds them. Archives are files of one gzip member per record; the Parquet
index written with them names the files that count, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.joins import join_per_key

CHUNK_BYTES = 1 << 18
# Rows and bytes given on at a time.
ROWS, BYTES, SLICE = 2048, 1 << 23, 256
# Stands for a chunk number in the row that tells a record's type, before its chunks.
TYPE = -1
CHUNKS = "record long, page_id long, url string, chunk int, last boolean, data binary, so_far long, sha1 binary, sha256 binary"
PLACES = "record long, page_id long, record_type string, file string, offset long, n_bytes long"
FOUND = (
    "page_id long, uri string, record_type string, refers_to_uri string, refers_to long, target string, chunk int, last boolean, data binary, "
    "so_far long, sha1 binary, payload_bytes long, payload_digest string"
)
# The format's version line, the profile of a repeated payload, and the head of the stored response.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
WRITTEN_AT = "1970-01-01T00:00:00Z"


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def _batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


class Gathered:
    """Rows put together into batches of bounded size."""

    def __init__(self, schema: str):
        self.schema, self.names = schema, [part.split()[0] for part in schema.split(", ")]
        self.rows, self.size = [], 0

    def add(self, row: tuple, size: int = 0) -> pa.RecordBatch | None:
        self.rows.append(row)
        self.size += size
        return self.flush() if len(self.rows) >= ROWS or self.size >= BYTES else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        out = _batch(dict(zip(self.names, map(list, zip(*self.rows)))), self.schema)
        self.rows, self.size = [], 0
        return out


def chunk_table(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", size: int = CHUNK_BYTES) -> DataFrame:
    """Write the chunked record table of ``pages`` below ``folder`` and give it back; a NULL payload is an empty one.

    ``record`` is a number given to the row; it is written, so it never changes. The payload is cut by the engine and its
    chunks reach Python one after another; digests run on from chunk to chunk.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        payload.alias("payload"))
    last = F.greatest(F.ceil(F.octet_length("payload") / size) - 1, F.lit(0)).cast("int")
    rows = rows.withColumn("last", last).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
    rows = rows.select(
        "record", "page_id", "url", "chunk", (F.col("chunk") == F.col("last")).alias("last"),
        F.substring("payload", F.col("chunk") * size + 1, F.lit(size)).alias("data"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha1 = sha256 = None
        so_far = 0
        for batch in batches:
            ends, ones, others = [], [], []
            for chunk, data in zip(batch.column(3).to_pylist(), batch.column(5)):
                if chunk == 0:
                    sha1, sha256, so_far = hashlib.sha1(usedforsecurity=False), hashlib.sha256(), 0
                part = data.as_buffer()
                sha1.update(part)
                sha256.update(part)
                so_far += len(part)
                ends.append(so_far)
                ones.append(sha1.digest())
                others.append(sha256.digest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends, pa.int64()), pa.array(ones, pa.binary()), pa.array(others, pa.binary())], names=names)

    names = [part.split()[0] for part in CHUNKS.split(", ")]
    rows.mapInArrow(carry, CHUNKS).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    return pages.sparkSession.read.schema(CHUNKS).parquet(f"{folder}/chunks")


def record_types(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record, n_bytes, sha1, first, first_page): of records with equal payloads that with the smallest page_id comes first.

    ``first`` is NULL where the record itself is the first or the payload is shorter than ``least_bytes``. Records without a page_id come last, those that
    repeat one in the order of their rows. Payloads are equal when sha256 and length are.
    """
    ends = chunks.filter("last").select("record", "page_id", F.col("so_far").alias("n_bytes"), "sha1", "sha256")
    long_ = ends.filter(F.col("n_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "record")
    groups = long_.groupBy("sha256", "n_bytes").agg(F.min(order).alias("head"), F.count("*").alias("n")).filter("n > 1")
    again = groups.select("sha256", "n_bytes", F.col("head.record").alias("first"), F.col("head.page_id").alias("first_page"), "n")
    known = join_per_key(ends, again, ["sha256", "n_bytes"], "n", "left")
    itself = F.col("first") == F.col("record")
    return known.select("record", "n_bytes", "sha1", *[F.when(~itself, F.col(c)).alias(c) for c in ("first", "first_page")])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _uri(space: uuid.UUID, record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(space, str(record))}>"


def _field(text: str) -> str:
    """A header value; control characters, which could end the line, become escapes."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def _head(space: uuid.UUID, row: dict) -> tuple[str, bytes]:
    """(record type, headers and block up to the payload)."""
    revisit = row["first"] is not None
    kind = "revisit" if revisit else "response"
    length = len(RESPONSE_HEAD) + (0 if revisit else row["n_bytes"])
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(space, row['record'])}", f"WARC-Date: {WRITTEN_AT}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_field(row['url'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}")
    if row["page_id"] is not None:
        lines.append(f"Page-ID: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Refers-To: {_uri(space, row['first'])}", f"WARC-Profile: {SAME_PAYLOAD}", f"Payload-Length: {row['n_bytes']}"]
        if row["first_page"] is not None:
            lines.append(f"Refers-To-Page-ID: {row['first_page']}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return kind, "\r\n".join(lines).encode() + RESPONSE_HEAD


def write_archives(chunks: DataFrame, types: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` and give back their index: record, page_id, record_type, file, offset and n_bytes of every record.

    Rows of a record meet in one task, its type before its chunks; they are dealt by record, so equal payloads spread over all tasks.
    """
    spark = chunks.sparkSession
    space = uuid.uuid4()
    rows = chunks.select("record", "chunk", "page_id", "url", "last", "data").unionByName(
        types.withColumn("chunk", F.lit(TYPE)), allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "record").sortWithinPartitions("record", "chunk")
    names = rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, out, told = f"part-{uuid.uuid4().hex}.warc.gz", None, Gathered(PLACES)
        at, known = 0, {}
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, SLICE):
                    for row in zip(*[c.slice(lo, SLICE).to_pylist() for c in batch.columns]):
                        row = dict(zip(names, row))
                        if row["chunk"] == TYPE:
                            known = row
                            continue
                        if out is None:
                            out = store.open_output_stream(f"{root}/{name}", None, 1 << 20)
                        if row["chunk"] == 0:
                            start, packer = at, zlib.compressobj(6, zlib.DEFLATED, 31)
                            kind, head = _head(space, known | {"page_id": row["page_id"], "url": row["url"]})
                            at += out.write(packer.compress(head))
                        if kind == "response":
                            at += out.write(packer.compress(row["data"]))
                        if row["last"]:
                            at += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                            if (full := told.add((row["record"], row["page_id"], kind, name, start, at - start))) is not None:
                                yield full
            if (rest := told.flush()) is not None:
                yield rest
        finally:
            if out is not None:
                out.close()

    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    rows.mapInArrow(write, PLACES).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PLACES).parquet(f"{folder}/index")


class Member(io.RawIOBase):
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source, held: bytes):
        self.source, self.unpack, self.held, self.plain = source, zlib.decompressobj(31), held, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.plain and not self.unpack.eof:
            if not self.held and not (more := self.source.read(1 << 16)):
                raise ValueError("archive ends inside a record")
            self.plain = self.unpack.decompress(self.held or more, 1 << 16)
            self.held = self.unpack.unconsumed_tail
        n = min(len(into), len(self.plain))
        into[:n] = self.plain[:n]
        self.plain = self.plain[n:]
        return n

    def after(self) -> bytes:
        """What was read of the file beyond the member."""
        return self.unpack.unused_data


def members(source) -> Iterator[io.BufferedReader]:
    """The records of an archive. A member is read to its end before the next one."""
    held = b""
    while held or (held := source.read(1 << 16)):
        raw = Member(source, held)
        reader = io.BufferedReader(raw, 1 << 16)
        yield reader
        while reader.read(1 << 16):
            pass
        held = raw.after()


def _lines(reader) -> Iterator[str]:
    while (line := reader.readline()) not in (b"\r\n", b""):
        yield line.rstrip(b"\r\n").decode()


def read_record(reader, size: int) -> Iterator[tuple]:
    """The chunk rows of one record, in the columns of ``FOUND``; ValueError when length or digest do not fit.

    A revisit has one row without data, with the length and digest its headers give.
    """
    if reader.readline().strip() != VERSION.encode():
        raise ValueError("not an archive record")
    head = dict(line.split(": ", 1) for line in _lines(reader))
    number = {name: int(head[name]) if name in head else None for name in ("Page-ID", "Refers-To-Page-ID", "Payload-Length")}
    left = int(head["Content-Length"])
    for line in iter(reader.readline, b"\r\n"):
        if not line:
            raise ValueError("record without a head of its response")
        left -= len(line)
    left -= 2
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    about = (number["Page-ID"], head["WARC-Record-ID"], head["WARC-Type"], head.get("WARC-Refers-To"), number["Refers-To-Page-ID"],
             head.get("WARC-Target-URI"))
    if head["WARC-Type"] == "revisit":
        yield (*about, 0, True, None, number["Payload-Length"], None, number["Payload-Length"], digest)
        return
    sha1, so_far, chunk = hashlib.sha1(usedforsecurity=False), 0, 0
    while True:
        data = reader.read(min(size, left))
        left -= len(data)
        so_far += len(data)
        sha1.update(data)
        if left and not data:
            raise ValueError("record is shorter than its length")
        if not left and base32(sha1.digest()) != digest:
            raise ValueError("payload does not fit its digest")
        yield (*about, chunk, not left, data, so_far, sha1.digest(), None if left else so_far, None if left else digest)
        if not left:
            return
        chunk += 1


def read_archives(index: DataFrame, folder: str, size: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """Chunk rows of all records of the archives that the index names, read front to end, a file a task.

    With ``data`` false only the last row of each record comes, without its bytes; payloads are read and checked all the same. A
    file that holds another number of records than its index says is an error.
    """
    # one row per file
    files = index.groupBy("file").agg(F.count("*").alias("records"))
    files = files.withColumn("slot", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))
    slots = max(1, index.select("file").distinct().count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        told = Gathered(FOUND)
        for row in (row for batch in batches for row in batch.to_pylist()):
            seen = 0
            with store.open_input_stream(f"{root}/{row['file']}", None, 1 << 20) as source:
                for reader in members(source):
                    seen += 1
                    for found in read_record(reader, size):
                        if not data:
                            if not found[7]:
                                continue
                            found = (*found[:8], None, *found[9:])
                        if (full := told.add(found, len(found[8] or b""))) is not None:
                            yield full
            if seen != row["records"]:
                raise ValueError(f"{row['file']} does not hold what its index says")
        if (rest := told.flush()) is not None:
            yield rest

    return files.repartitionById(slots, F.col("slot")).mapInArrow(read, FOUND)


def archive(pages: DataFrame, folder: str, least_bytes: int = 0, size: int = CHUNK_BYTES, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """Write ``pages`` as archives below ``folder``, which all executors share, and give back their index.

    One record per row, rows without a page_id or url and repeated rows included. Of equal payloads of at least ``least_bytes`` bytes one is a
    response, others revisit it. An empty table writes no archive and an empty index.
    """
    chunks = chunk_table(pages, folder, page_id, url, html, size)
    return write_archives(chunks, record_types(chunks, least_bytes), folder)


def payload(column: str = "data", chunk: str = "chunk") -> Column:
    """Aggregate that puts the chunks of a record of moderate size together again."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(chunk), F.coalesce(F.col(column), F.lit(b"")).alias("d"))))
    return F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["d"]))


def report(pages: DataFrame, folder: str, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read back from archives written below ``folder``."""
    index = archive(pages, folder, **options)
    found = read_archives(index, folder, options.get("size", CHUNK_BYTES), data=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

