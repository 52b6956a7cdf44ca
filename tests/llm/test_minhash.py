import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import graph, minhash
from brindle.llm.shingles import shingle_sets


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\x1c\xa0", max_size=25)), max_size=6), st.integers(1, 4))
def test_sets_are_as_large_and_as_equal(texts, k):
    got = shingle_sets(pa.array(texts, pa.string()), k)
    want = [shingles(t, k) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for g, w in zip(got, want):
        for h, v in zip(got, want):
            assert len(np.intersect1d(g, h)) == len(w & v)


def components(n, links):
    up = {i: i for i in n}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in n}


def brute(pairs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in pairs]
    links = [(i, j) for n, (i, s) in enumerate(sets) for j, t in sets[:n]
             if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    of = components({i for i, _ in pairs}, links)
    return sorted({(i, len(s), of[i], of[i] == i) for i, s in sets}, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, passage = [], rng.choices(vocabulary, k=40)
    for base in range(14):
        text = rng.choices(vocabulary, k=rng.randrange(20, 160))
        for copy in range(rng.choice([1, 2, 6, 15])):
            other = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else rng.choice(vocabulary) for w in text]
            out.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in other))
            text = other if rng.random() < 0.5 else text
    out += [" ".join(passage + rng.choices(vocabulary, k=20)) for _ in range(30)]
    out += [None, "", "  \n", "one", "ONE", "one two", "one two three", "x " * 30_000]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5)])
def test_components_like_brute_force(docs_of, seed, k):
    pairs = [*corpus(seed), (None, "one two three"), (None, None)]
    out = minhash.near_duplicates(docs_of(pairs), shingle=k).collect()
    assert len(out) == len(pairs)
    assert sorted({tuple(r) for r in out}, key=str) == brute(pairs, k, 80)


def test_repeated_rows_empty_table_and_clashing_columns(frame, docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    docs = frame([(5, "a b c d e f", 1), (5, "a b c d e f", 1), (7, "A b c d e f", 2)], "doc_id long, text string, component_id int")
    assert [tuple(r) for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [(5, 2, 5, True)] * 2 + [(7, 2, 5, False)]


def test_chains_of_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300), (7, None)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100}


def test_unconnected_classes_meet_after_the_pivots(spark):
    rows = spark.createDataFrame([(1, i, 10) for i in (3, 5, 8, 9)] + [(2, 3, 10), (2, 9, 10)], "table long, class_id long, n long")
    found = spark.createDataFrame([(3, 3), (9, 3)], "node long, component long")
    assert {tuple(r) for r in minhash.open_classes(rows, found).collect()} == {(3, 3), (9, 3), (5, 5), (8, 8)}
    assert minhash.open_classes(rows.filter("table = 2"), found).isEmpty()


def test_rare_shingles_lead_to_all_similar_pairs(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(rng.choices([f"w{i}" for i in range(500)], k=70)) for _ in range(40)]
    texts += [t + " end" for t in texts[:15]]
    rows = [(i, i if i < 50 else 0, t) for i, t in enumerate(texts)]
    got = {tuple(r) for r in minhash.open_pairs(spark.createDataFrame(rows, "class_id long, of long, text string"), 4, 80).collect()}
    sets = [shingles(t, 4) for t in texts]
    want = {(i, j) for i in range(55) for j in range(i + 1, 55) if rows[i][1] != rows[j][1] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want <= got and len(got) < 3 * len(want)
