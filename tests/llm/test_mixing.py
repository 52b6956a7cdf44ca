import random
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import mixing


def least_cost(sizes, quotas, passes):
    """Min-cost flow by single augmenting paths of least cost (Bellman-Ford), one word at a time."""
    patterns, names = sorted(sizes), sorted(quotas)
    arcs = []

    def arc(a, b, room, cost):
        arcs.append([a, b, room, cost])
        arcs.append([b, a, 0, -cost])

    for p in patterns:
        for k in range(passes):
            arc("S", p, sizes[p], k)
        for s in p:
            arc(p, s, 10**9, 0)
    for s in names:
        arc(s, "T", quotas[s], 0)
    flow = cost = 0
    while True:
        dist, via = {"S": 0}, {}
        for _ in range(len(patterns) + len(names) + 2):
            for i, (a, b, room, c) in enumerate(arcs):
                if room and a in dist and dist[a] + c < dist.get(b, 10**9):
                    dist[b], via[b] = dist[a] + c, i
        if "T" not in dist:
            return flow, cost
        at = "T"
        while at != "S":
            i = via[at]
            arcs[i][2] -= 1
            arcs[i ^ 1][2] += 1
            at = arcs[i][0]
        flow, cost = flow + 1, cost + dist["T"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sets(st.sampled_from("abcd"), min_size=1).map(lambda s: tuple(sorted(s))), st.integers(0, 6), min_size=1, max_size=6),
       st.lists(st.integers(0, 12), min_size=4, max_size=4))
def test_flow_is_greatest_and_cheapest(sizes, wanted):
    quotas = {s: q for s, q in zip("abcd", wanted) if any(s in p for p in sizes)}
    got = mixing.routed(sizes, quotas, 3)
    cost = 0
    for p, n in got.items():
        assert 0 <= n <= 3 * sizes[p]
        cost += sum(k * max(0, min(sizes[p], n - k * sizes[p])) for k in range(3))
    assert (sum(got.values()), cost) == least_cost(sizes, quotas, 3)


def test_targets_stop_and_are_reshared():
    got = mixing.water_filled(100.0, {"a": 5.0, "b": 2.0, "c": 1.0}, {"a": 30.0, "b": 300.0, "c": 3.0})
    assert got == pytest.approx({"a": 30.0, "b": 67.0, "c": 3.0})
    assert mixing.water_filled(0.0, {"a": 1.0}, {"a": 0.0}) == {"a": 0.0}


def corpus(frame, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choices(["b", "a", "ä", "B", None], [70, 15, 10, 4, 3])[0]
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1))), source, 1))
    rows += [(1000, None, "a", 1), (1001, "", "zero", 1), (1002, "\t \n", None, 1), (7, "again and again", "b", 1), (7, "again and again", "b", 1),
             (None, "no id", "a", 1)]
    return frame(rows, "doc_id long, text string, source string, size int")


def test_sources_meet_their_targets(frame):
    docs = corpus(frame)
    out = docs.select("source", "text", F.col("doc_id").alias("d")).join(
        mixing.mix_report(docs), F.col("d").eqNullSafe(F.col("doc_id"))).dropDuplicates(["d"]).collect()
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.doc_id: r.size for r in rows}[1000] == 0
    names = sorted({r.source for r in out}, key=lambda s: (s is None, s or ""))
    taken, size, target = defaultdict(int), {}, {}
    for r in mixing.mixed(docs).select("source", "__mix.*").collect():
        taken[r.source] += r.taken
        size[r.source], target[r.source] = r.source_size, r.target
    total = sum(r.size for r in rows)
    want = mixing.water_filled(float(total), {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(names)}, {n: 3.0 * size[n] for n in names})
    assert target == pytest.approx(want)
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    assert all(a <= b for a, b in pairwise([0, *sorted(taken.values())]))
    again = mixing.mix_report(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    other = mixing.mix_report(docs, seed=99).collect()
    assert sorted(map(str, rows)) != sorted(map(str, other))


def test_documents_of_the_mix(frame):
    """Whole documents only; one that is taken in part is there once more when half of it or more is taken."""
    docs = corpus(frame)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert out.exceptAll(docs.withColumn("n", F.lit(3)).withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")).count() == 0
    copies = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for r in mixing.mix_report(docs).filter("taken > 0").collect():
        times, part = divmod(r.taken, r.size)
        want[r.doc_id] += times + (2 * part >= r.size)
    assert copies == +want


def test_a_long_boundary_document_stays_whole_or_goes(frame):
    rows = [(1, "w " * 30_000, "a"), (2, "w " * 10, "b"), (3, "w " * 50_000, "c"), (4, "w " * 10, "c")]
    docs = frame(rows, "doc_id long, text string, source string")
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[r.doc_id] for r in mixing.mix_documents(docs).collect())


def test_overlapping_sources(frame):
    rows = [(i, "a b c d", ["x"] if i % 3 else ["x", "y"]) for i in range(30)] + [(99, "a", []), (98, "a", None)]
    docs = frame(rows, "doc_id long, text string, sources array<string>")
    out = mixing.mixed(docs, sources=F.col("sources"), weights=(1.0, 1.0)).select("doc_id", "sources", "__mix.*").collect()
    both = sum(r.taken for r in out if r.sources and len(r.sources) == 2)
    assert both >= 60 and sum(r.taken for r in out) >= 120 and all(r.taken == 0 for r in out if not r.sources)


def test_empty_table(docs_of):
    assert mixing.mix_report(docs_of([])).count() == 0 and mixing.mix_documents(docs_of([])).count() == 0
