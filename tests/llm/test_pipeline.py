import random
from collections import Counter, defaultdict

import test_langid
import test_minhash
import test_packing
from brindle.llm import langid, mixing
from brindle.session import fresh_path

import corpus_pipeline
import __spark_entry__ as entry


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(90):
        lang = rng.choice(sorted(test_langid.LINES))
        words = rng.choices(test_langid.LINES[lang].split(), k=rng.randrange(8, 60))
        rows.append([i, " ".join(words), lang, rng.choice(["a", "b", None])])
    for i in range(90, 130):
        text = rows[rng.randrange(90)][1]
        words = text.split()
        kind = i % 3
        rows.append([i, text if kind == 0 else text.upper() if kind == 1 else " ".join([*words, "end"]), "en", "c"])
    rows += [[200, None, "en", "a"], [201, "", None, "a"], [202, "12 34 %%", "de", "b"], [203, "the and there " * 8000, "en", "a"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def test_stages_like_brute_force(spark, docs_of):
    folder = fresh_path(spark, "corpus")
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "pack":
            assert out.dtypes == docs.dtypes, name
        path = fresh_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()

    lettered = {r[0] for r in rows if test_langid.slow_sequences(r[1])}
    assert {r.doc_id for r in seen["language_id"]} == lettered
    last = {}
    for i, t, *_ in sorted(rows):
        if i in lettered:
            last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)] = i
    assert sorted(r.doc_id for r in seen["exact_dedup"]) == sorted(last.values())
    pairs = [(r.doc_id, r.text) for r in seen["exact_dedup"]]
    kept = sorted(i for i, _, _, stays in test_minhash.brute(pairs, 5, 80) if stays)
    assert sorted(r.doc_id for r in seen["near_dedup"]) == kept

    texts = {r.doc_id: r.text for r in seen["near_dedup"]}
    source = {r.doc_id: r.source for r in seen["near_dedup"]}
    taken, size = Counter(), Counter()
    for r in seen["near_dedup"]:
        size[source[r.doc_id]] += len(r.text.split())
    for r in seen["mix"]:
        assert texts[r.doc_id] == r.text and r.n_chars == len(r.text)
        taken[source[r.doc_id]] += len(r.text.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.water_filled(float(sum(size.values())), dict(zip(names, (5.0, 2.0, 1.0, 5.0))), {s: 3.0 * n for s, n in size.items()})
    # within half of the document on the edge
    longest = {s: max(len(r.text.split()) for r in seen["near_dedup"] if r.source == s) for s in names}
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in names)

    mixed = defaultdict(list)
    for r in seen["mix"]:
        mixed[r.doc_id].append(r.text)
    test_packing.check([(i, t) for i, ts in mixed.items() for t in ts], seen["pack"])


def test_registered_once_with_all_operators():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, docs_of):
    folder = fresh_path(spark, "corpus")
    docs_of([]).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_model_is_fitted_on_its_stage_input(docs_of):
    docs = docs_of([(i, "the ring of things") for i in range(8)])
    assert langid.train_on_rest(docs).languages == ["en"]
