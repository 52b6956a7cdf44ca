"""Token ids of whole texts; every distinct word of a batch is encoded once and nothing is remembered between batches."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
# Words put together into one text for the tokenizer, and bytes of texts encoded at a time (one text may be longer).
JOINED_WORDS, TEXT_BYTES = 4096, 1 << 24

# White space as the tokenizer sees it: the separators 1C-1F are not part of it.
_SPACE = r"[^\S\x1c-\x1f]"
_PIECES = re.compile(rf"{_SPACE}*(?:\S|[\x1c-\x1f])+|{_SPACE}+").findall
# A blank or line break after white space of any kind.
_RUN = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}][ \n]"
_MARK = "\x00"
# A word of Latin letters with one mark after it, which the tokenizer always parts.
_MARKED = r"^[ \n]?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[.,;:!?]$"
_OPEN = r"^[ \n]"
_CLOSED = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Texts to ids.

    A byte-level tokenizer never joins white space to what stands before it, so a text may be cut in front of every run of
    white space and the ids of the cuts follow each other as those of the text do. Other tokenizers get
    whole texts, and so do texts that spell one of the vocabulary's added tokens.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        self.by_word = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not parts.get("normalizer") and not parts.get("post_processor")
        )
        self.added = [t["content"] for t in parts.get("added_tokens") or []]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        if self.by_word:
            # a token is written with one letter per byte
            self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        ids, counts = [np.empty(0, self.kind)], np.zeros(len(texts), np.int64)
        for lo in range(0, len(texts), JOINED_WORDS):
            for i, e in enumerate(self.tokenizer.encode_batch_fast(texts[lo : lo + JOINED_WORDS], add_special_tokens=False), lo):
                ids.append(np.array(e.ids, self.kind))
                counts[i] = len(ids[-1])
        return np.concatenate(ids), counts

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that start with white space and end without: put together they are cut as they are apart.

        Ids are told to words by the bytes they stand for.
        """
        ids, counts = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for lo in range(0, len(words), JOINED_WORDS):
            some = words.slice(lo, JOINED_WORDS)
            own = np.array(self.tokenizer.encode_batch_fast(["".join(some.to_pylist())], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.bytes[own]), np.cumsum(np.asarray(pc.binary_length(some), np.int64)), "left") + 1
            ids.append(own)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of distinct words."""
        joined = np.asarray(pc.and_(pc.match_substring_regex(words, _OPEN), pc.invert(pc.match_substring_regex(words, _CLOSED))))
        ids, n = self._joined(words.filter(pa.array(joined)))
        rest_ids, rest_n = self._whole(words.filter(pa.array(~joined)).to_pylist())
        counts = np.empty(len(words), np.int64)
        counts[joined], counts[~joined] = n, rest_n
        starts = np.empty(len(words), np.int64)
        starts[joined] = np.cumsum(n) - n
        starts[~joined] = len(ids) + np.cumsum(rest_n) - rest_n
        return np.concatenate([ids, rest_ids]), starts, counts

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of distinct pieces; those that only differ in a last mark share the ids before it."""
        marked = pc.match_substring_regex(pieces, _MARKED)
        cores = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        ids, starts, counts = self._words(cores.dictionary)
        core, marked = np.asarray(cores.indices), np.asarray(marked)
        marks = pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), -1, None).dictionary_encode()
        own = counts[core]
        total = own + marked
        first = np.cumsum(total) - total
        out = np.empty(total.sum(), self.kind)
        out[_spread(first, own)] = ids[_spread(starts[core], own)]
        if len(marks):
            mark_ids, _ = self._whole(marks.dictionary.to_pylist())
            out[(first + own)[marked]] = mark_ids[np.asarray(marks.indices)]
        return out, first, total

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text in turn; NULL counts as empty."""
        # offsets of 64 bits, as one text may be very long
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        upto = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TEXT_BYTES, "right")))
            yield from self._slice(texts.slice(lo, hi - lo))
            lo = hi

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = np.zeros(len(texts), bool) if self.by_word else np.ones(len(texts), bool)
        for token in self.added if self.by_word else ():
            whole |= np.asarray(pc.match_substring(texts, token))
        if not self.by_word:
            for text in texts.to_pylist():
                yield self._whole([text])[0]
            return
        slow = np.asarray(pc.or_(pc.match_substring_regex(texts, _RUN), pc.match_substring(texts, _MARK)))
        plain = texts.filter(pa.array(~slow & ~whole))
        for sign in (" ", "\n"):
            plain = pc.replace_substring(plain, sign, _MARK + sign)
        cut = pc.split_pattern(plain, _MARK)
        others = [[] if w else _PIECES(t) for t, w in zip(texts.filter(pa.array(slow | whole)).to_pylist(), whole[slow | whole])]
        counts = np.zeros(len(texts), np.int64)
        counts[~slow & ~whole] = np.asarray(cut.value_lengths())
        counts[slow | whole] = list(map(len, others))
        flat = pa.concat_arrays([cut.flatten(), pa.array([p for o in others for p in o], pa.large_string())])
        coded = flat.dictionary_encode()
        ids, starts, sizes = self._pieces(coded.dictionary)
        places = np.asarray(coded.indices)
        # pieces of plain texts stand before those of the others
        before = np.empty(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(~slow & ~whole), np.flatnonzero(slow | whole)])
        before[order] = np.cumsum(counts[order]) - counts[order]
        for row in range(len(texts)):
            if whole[row]:
                yield self._whole([texts[row].as_py()])[0]
                continue
            own = places[before[row] : before[row] + counts[row]]
            yield ids[_spread(starts[own], sizes[own])]

    def encode(self, text: str | None) -> bytes:
        """Packed ids of one text; NULL counts as empty."""
        return next(self.encode_batch(pa.array([text], pa.string()))).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
