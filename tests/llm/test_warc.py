import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.llm import warc

SCHEMA = "page_id long, url string, html string, so_far int"


def pages_of(frame, rows):
    return frame([(*r, 1) for r in rows], SCHEMA)


def brute(rows, least=0):
    """Rows in the order of page_id, those without one last."""
    seen, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = len(data) >= least and data in seen
        out.append((page, len(data), digest, "revisit" if again else "response", seen[data] if again else None))
        seen.setdefault(data, page)
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [
    (5, "http://a/1", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a/3", None), (2, "", ""),
    (None, "http://b", "<p>other</p>"), (None, "http://c", "<p>other</p>"), (None, "http://d", "<p>same</p>"),
    (7, "http://e\r\nX: y", "é" * 700 + "\r\n\r\nWARC/1.1\r\n" + " " * 900), (8, "http://f", "0123456789" * 500), (8, "http://f", "0123456789" * 500), (4, "http://g", "x"),
]


@pytest.mark.parametrize("least, size", [(0, 64), (8, 1000), (10**6, 7)])
def test_against_brute_force(frame, tmp_path, least, size):
    out = warc.report(pages_of(frame, ROWS), str(tmp_path), least_bytes=least, size=size)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got(out) == brute(ROWS, least)


def test_payloads_come_back_in_chunks(frame, tmp_path):
    folder = str(tmp_path)
    index = warc.archive(pages_of(frame, ROWS), folder, size=64)
    found = warc.read_archives(index, folder, size=50)
    assert found.agg(F.max(F.length("data"))).first()[0] == 50
    whole = found.filter("record_type = 'response'").groupBy("uri", "page_id").agg(
        warc.payload().alias("data"), F.max("chunk").alias("last"), F.count("*").alias("n"), F.max("so_far").alias("size"))
    rows = whole.collect()
    assert all(r.n == r["last"] + 1 and r.size == len(r.data) for r in rows)
    distinct = {(html or "").encode() for _, _, html in ROWS}
    assert sorted(bytes(r.data) for r in rows) == sorted(distinct)
    revisits = found.filter("record_type = 'revisit'")
    assert revisits.filter("data IS NOT NULL").count() == 0
    named = revisits.join(found.filter("record_type = 'response'").select(F.col("uri").alias("refers_to_uri"), F.col("page_id").alias("p")).distinct(), "refers_to_uri")
    assert named.count() == revisits.count() and named.filter("NOT refers_to <=> p").count() == 0


def test_digests_run_on_from_chunk_to_chunk(frame, tmp_path):
    chunks = warc.chunk_table(pages_of(frame, ROWS), str(tmp_path), size=100)
    by_record = {}
    for r in chunks.orderBy("record", "chunk").collect():
        before = by_record.get(r.record, b"")
        assert len(r.data) <= 100 and r.so_far == len(before) + len(r.data)
        by_record[r.record] = before + bytes(r.data)
        assert r.sha1 == hashlib.sha1(by_record[r.record]).digest() and r.sha256 == hashlib.sha256(by_record[r.record]).digest()
    assert len(by_record) == len(ROWS)


def test_archives_are_plain_records(frame, tmp_path):
    index = warc.archive(pages_of(frame, ROWS), str(tmp_path)).collect()
    assert len(index) == len(ROWS)
    for r in index:
        member = (Path(tmp_path) / r.file).read_bytes()[r.offset : r.offset + r.n_bytes]
        head, _, block = gzip.decompress(member).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and fields["WARC-Type"] == r.record_type and "X" not in fields
        assert len(block) == int(fields["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")


def test_damage_and_stray_files(frame, tmp_path):
    folder = str(tmp_path)
    index = warc.archive(pages_of(frame, ROWS), folder)
    (tmp_path / "part-stray.warc.gz").write_bytes(b"left by a lost task")
    assert got(warc.read_archives(index, folder, data=False).select("page_id")) == sorted(((r[0],) for r in ROWS), key=str)
    name = next(r.file for r in index.collect() if r.page_id == 4)
    whole = (tmp_path / name).read_bytes()
    (tmp_path / name).write_bytes(whole[:-30])
    with pytest.raises(Exception, match="ends inside|does not hold|Error"):
        warc.read_archives(index, folder).collect()


def test_payload_that_does_not_fit_its_digest():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 4\r\n\r\n\r\nab"
    import io
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_record(io.BytesIO(good), 10))


def test_empty_table(frame, tmp_path):
    assert warc.report(pages_of(frame, []), str(tmp_path)).collect() == []


def test_long_payload_in_small_chunks(frame, tmp_path):
    rows = [(i, "u", "ab" * 400_000 + str(i % 2)) for i in range(4)]
    assert got(warc.report(pages_of(frame, rows), str(tmp_path), size=4096)) == brute(rows)
