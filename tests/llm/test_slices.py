import hashlib
import math

import numpy as np
import pytest

from brindle.llm import slices

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, entries, parts, rounds):
    """[(id, code, error, label error)] and codebooks, every part measured against every entry in whole numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def best(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        homes = [[best(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for n in range(len(books[p])):
                own = [v[p] for v, h in zip(cut, homes) if h[p] == n]
                if own:
                    books[p][n] = [sum(x) // len(own) for x in zip(*own)]
    coded = [[best(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{n:02x}" for _, n in c), e, by_label[label]) for (i, _, label), c, e in zip(kept, coded, errors)), key=str), books


def table(frame, rows):
    return frame([(i, v, label, "x") for i, v, label in rows], SCHEMA)


def result(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, d, entries", [(300, 8, 70), (150, 16, 256), (90, 4, 3)])
def test_against_every_distance(frame, n, d, entries):
    rng = np.random.default_rng(n)
    rows = [(int(i), v.astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(rng.normal(size=(n, d)) * 0.2)]
    got = slices.report(table(frame, rows), entries=entries)
    want, books = brute(rows, entries, 4, 4)
    assert result(got) == want
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got.collect()} == {sha}


def test_ties_repeats_and_vectors_that_take_no_part(frame):
    one, two = [0.5, 0.0, 1.0, -1.0], [0.5, 0.25, 1.0, -0.9]
    rows = [(3, one, 1), (3, one, 1), (1, two, None), (9, [0.5, 0.125, 1.0, -1.0], None), (None, one, 2), (4, None, 1), (5, [None, 1.0, 1.0, 1.0], 1),
            (6, [float("nan"), 1.0, 1.0, 1.0], 1), (7, [float("inf"), 1.0, 1.0, 1.0], 1)]
    assert result(slices.report(table(frame, rows))) == brute(rows, 256, 4, 4)[0]


def test_other_lengths_and_empty_table(frame):
    rows = [(1, [1.0] * 4, 1), (2, [1.0] * 4, 1), (3, [1.0] * 8, 1), (4, [1.0] * 5, 1), (5, [], 1)]
    assert {r.vec_id for r in slices.report(table(frame, rows)).collect()} == {1, 2}
    assert slices.report(table(frame, [])).collect() == []


def test_candidates_hold_the_nearest_and_leave_some_out():
    rng = np.random.default_rng(2)
    entries = rng.integers(-300, 300, (130, 3))
    search = slices.Slices(entries)
    x = rng.integers(-300, 300, (500, 3))
    inside, r = search.candidates(x), search.radius(x)
    apart = np.abs(x[:, None, :] - entries[None]).max(axis=2)
    assert (inside == (apart <= r[:, None])).all() and inside.mean() < 0.5
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    entry, least = search.nearest(x)
    assert (entry == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_decode_gives_the_entries(frame):
    rows = [(i, [i / 8, 0.0, -i / 4, 1.0], 1) for i in range(6)]
    codes, books = slices.compress(table(frame, rows))
    back = {r.id: r.vector for r in slices.decode(codes, books).collect()}
    assert back == {i: v for i, v, _ in rows}
