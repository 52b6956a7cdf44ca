import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from brindle.llm import packing, tokens

PLAIN = Tokenizer.from_file(tokens.vocabulary_path())


def check(pairs, out):
    """Every id in one piece, sequences gapless, little padding; gives the share of padding."""
    docs = defaultdict(list)
    for i, t in pairs:
        docs[i].append(np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for i, want in docs.items():
        if len(want) > 1:
            assert sum(r.length for r in pieces[i]) == sum(map(len, want))
            continue
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[0])
            assert r.ids_crc32 == zlib.crc32(want[0][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[0])
    padding = total = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW and len({r.step_id for r in rows}) == len({r.tier for r in rows}) == 1
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding, total


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "réal", "tion", "\n", "12"]
    return [(i, " ".join(rng.choices(words, k=int(rng.paretovariate(0.8)) % 6000))) for i in range(n)]


def test_pieces_cover_documents(docs_of):
    pairs = corpus(300) + [(1000, None), (1001, ""), (1002, "word " * 30_000), (7, "twice"), (7, "twice"), (None, "no id")]
    out = packing.pack_documents(docs_of(pairs), share=100).collect()
    padding, total = check(pairs, out)
    assert padding <= 4 * packing.WINDOW
    again = packing.pack_documents(docs_of(pairs).repartition(3), share=100).collect()
    assert sorted(out, key=str) == sorted(again, key=str)


def test_long_rests_only_and_small_tables(docs_of):
    pairs = [(i, "the " * 600) for i in range(40)]
    padding, _ = check(pairs, packing.pack_documents(docs_of(pairs)).collect())
    assert padding < packing.WINDOW
    assert packing.pack_documents(docs_of([])).count() == 0
    check([(1, "a")], packing.pack_documents(docs_of([(1, "a")])).collect())


def test_clashing_columns(frame):
    docs = frame([(1, "a b", 3, 4)], "doc_id long, text string, share int, sequence_id int")
    assert packing.pack_documents(docs).columns[:2] == ["doc_id", "start"]


def test_tiers_and_steps():
    rng = np.random.default_rng(0)
    pieces = [((i,), 0, np.zeros(n, "<u4"), i) for i, n in enumerate(rng.integers(1, 1024, 500))]
    windows = packing.pack(pieces)
    sizes = [sum(len(p[2]) for p in inside) for _, inside in windows]
    assert sum(sizes) == sum(len(p[2]) for p in pieces)
    assert all(n == tier for n, (tier, _) in zip(sizes[:-1], windows)) and {t for t, _ in windows} >= {1024}
    steps = packing.balanced_steps([1, 9, 5, 5, 2, 8], 2)
    assert sorted(steps) == [0, 0, 1, 1, 2, 2] and steps[1] == steps[0]
