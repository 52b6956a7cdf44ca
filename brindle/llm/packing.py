"""Packing of token sequences into windows of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.memory import give_back
from brindle.llm.tokens import END_ID, encoder, ids_crc32, vocabulary_path

WINDOW = 1024
# Context sizes, longest first; each is a power of two, so that a full window of any of them needs no padding.
TIERS = (1024, 512, 256, 128)
# Documents packed together. Full windows are dealt apart from the rest of their document, so a share stays small.
SHARE = 2048
STEP_TOKENS = 64 * WINDOW
ROWS = 256

CUTS = "share bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, tier int, step_id bigint")


def _dealt(doc_id: int | None, start: int, check: int, shares: int) -> int:
    """Share of a piece: that of its document, or for full windows one per million ids of it.

    ``check``, a checksum of the ids, parts documents without an id and those that repeat one.
    """
    return zlib.crc32(f"{doc_id}/{start >> 20}/{check}".encode()) % shares


def cut(docs: DataFrame, shares: int, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """Full windows with their checksum, and the rest of each document with its ids."""
    def cut_batches(batches):
        encode, kind = encoder(vocabulary).encode_batch, encoder(vocabulary).kind
        for batch in batches:
            encoded = encode(batch.column(1))
            for lo in range(0, batch.num_rows, ROWS):
                rows = []
                for key, found in zip(batch.column(0).slice(lo, ROWS).to_pylist(), encoded):
                    ids = np.append(found, END_ID).astype(kind)
                    full = len(ids) // WINDOW * WINDOW
                    for at in range(0, full, WINDOW):
                        part = ids[at : at + WINDOW]
                        rows.append((_dealt(key, at + 1, 0, shares), key, at, WINDOW, ids_crc32(part), len(ids), None))
                    if full < len(ids):
                        rest = ids[full:].astype("<u4").tobytes()
                        rows.append((_dealt(key, 0, zlib.crc32(rest), shares), key, full, len(ids) - full, None, len(ids), rest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.binary()])],
                    names=["share", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        give_back()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut_batches, CUTS)


class Pool:
    """Pieces (key, start, ids, tag) by length; the smallest key among equals comes first."""

    def __init__(self, pieces: list[tuple]):
        self.by_length: dict[int, list] = {}
        for p in sorted(pieces, key=lambda p: (p[0], p[1]), reverse=True):
            self.by_length.setdefault(len(p[2]), []).append(p)
        self.lengths = sorted(self.by_length)

    def take(self, length: int) -> tuple:
        some = self.by_length[length]
        piece = some.pop()
        if not some:
            del self.by_length[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        return piece

    def put(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append(piece)

    def longest(self, most: int) -> int | None:
        """The greatest length up to ``most``."""
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else None

    def shortest_above(self, least: int) -> int | None:
        at = bisect_right(self.lengths, least)
        return self.lengths[at] if at < len(self.lengths) else None


def pack(pieces: list[tuple], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple]]]:
    """(tier, pieces) of each window, for pieces up to the longest tier.

    A piece belongs to the smallest tier that holds it. From the longest tier down, each window starts with the longest piece
    of its tier; the gap takes the longest whole pieces of shorter tiers that fit, then the head of the shortest
    piece that is longer than what is left, of any tier. Only the last window can stay open.
    """
    pool, windows = Pool(pieces), []
    for tier, below in zip(tiers, (*tiers[1:], 0)):
        while pool.lengths and pool.lengths[-1] > below:
            inside = [pool.take(pool.lengths[-1])]
            gap = tier - len(inside[0][2])
            while gap and (length := pool.longest(gap)) is not None:
                inside.append(pool.take(length))
                gap -= length
            if gap and (length := pool.shortest_above(gap)) is not None:
                key, start, ids, tag = pool.take(length)
                inside.append((key, start, ids[:gap], tag))
                pool.put((key, start + gap, ids[gap:], tag))
            windows.append((tier, inside))
    return windows


def balanced_steps(costs: list[int], size: int) -> list[int]:
    """Step of each window of one tier: dealt by cost there and back, so that steps of ``size`` windows cost alike."""
    steps = max(1, -(-len(costs) // size))
    out = [0] * len(costs)
    for rank, at in enumerate(sorted(range(len(costs)), key=lambda i: (-costs[i], i))):
        turn, place = divmod(rank, steps)
        out[at] = place if turn % 2 == 0 else steps - 1 - place
    return out


def _pack_share(table: pa.Table) -> pa.Table:
    share = table.column("share")[0].as_py()
    windows, rest = [], []
    for r in table.drop_columns(["share"]).to_pylist():
        tag = (r["doc_id"], r["doc_tokens"])
        if r["ids"] is None:
            windows.append((WINDOW, [(r["start"], r["length"], r["ids_crc32"], tag)]))
        else:
            key = (r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"], r["ids"])
            rest.append((key, r["start"], np.frombuffer(r["ids"], "<u4"), tag))
    windows.sort(key=lambda w: [(p[3][0] is not None, p[3][0] or 0, p[0], p[2]) for p in w[1]])
    for tier, inside in pack(rest):
        windows.append((tier, [(start, len(ids), ids_crc32(ids), tag) for _, start, ids, tag in inside]))
    step_of, base = [0] * len(windows), 0
    for tier in TIERS:
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        steps = balanced_steps([sum(p[1] ** 2 for p in windows[i][1]) for i in own], STEP_TOKENS // tier)
        for i, s in zip(own, steps):
            step_of[i] = base + s
        base += max(steps, default=-1) + 1
    out = []
    for n, (tier, inside) in enumerate(windows):
        offset = 0
        for start, length, crc, (doc_id, tokens) in inside:
            out.append((doc_id, start, length, crc, tokens, share << 32 | n, offset, tier, share << 32 | step_of[n]))
            offset += length
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                   share: int = SHARE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    Every document becomes its ids and id 0 and is cut into pieces that lie gapless in sequences. Full windows of
    a document are sequences of their own and never leave the task that encoded them but as a checksum; the rests are packed
    in shares of about ``share`` documents, chosen by a hash of the id, so a rerun packs alike on any number of machines.
    At most one sequence per share is not filled. Steps hold windows of one tier with about the same number of
    tokens and the same cost of attention. NULL texts are empty ones (one id); repeated rows are packed once each; NULL ids
    stay NULL; an empty table gives no piece. Other columns are not read.
    """
    shares = max(1, -(-docs.count() // share))
    cuts = cut(docs, shares, doc_id, text, vocabulary or vocabulary_path())
    return cuts.groupBy("share").applyInArrow(_pack_share, PIECES)
