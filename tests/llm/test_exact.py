import hashlib
import random

import pytest

from brindle.llm import exact


def brute(pairs):
    low = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in pairs]
    out = []
    for i, t in low:
        ids = [j for j, u in low if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def cases():
    rng = random.Random(3)
    pool = ["", "a", "A", "ä", "Ä", "x y", "X y", "long " * 40_000, "\n", " "]
    return [(i, rng.choice(pool)) for i in range(150)] + [(900 + i, "hot") for i in range(200)]


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_groups_like_brute_force(docs_of, fan_in):
    pairs = cases()
    assert rows(exact.exact_duplicates(docs_of(pairs), fan_in=fan_in)) == brute(pairs)


def test_null_texts_null_ids_and_repeated_rows(docs_of):
    pairs = [(1, None), (2, ""), (None, "a"), (3, "A"), (None, "b"), (4, "c"), (4, "C"), (5, "d"), (5, "A")]
    docs = docs_of(pairs)
    assert rows(exact.exact_duplicates(docs)) == brute(pairs)
    left = [(r.doc_id, (r.text or "").lower()) for r in exact.drop_exact_duplicates(docs).collect()]
    assert sorted(left, key=str) == sorted([(2, ""), (None, "b"), (4, "c"), (5, "d"), (5, "a")], key=str)


def test_empty_table_and_columns_of_the_caller(frame, docs_of):
    assert exact.exact_duplicates(docs_of([])).count() == 0
    docs = frame([(1, "a", 7, "x"), (2, "A", 8, "y")], "doc_id long, text string, keep_id int, digest string")
    assert rows(exact.exact_duplicates(docs)) == brute([(1, "a"), (2, "A")])
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and [r.keep_id for r in left.collect()] == [8]


def test_plan_has_no_python(docs_of):
    plan = exact.exact_duplicates(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
