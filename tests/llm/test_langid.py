import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import langid


def slow_sequences(text):
    out, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = "\0" + word + "\0"
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
            word = ""
    return out


def slow_vector(text, vectors):
    total = np.zeros(vectors.dimensions)
    for s, n in slow_sequences(text).items():
        a, b, c = (vectors.letter(ord(x)).astype(float) for x in s)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


TEXTS = ["Été à la mer.", "", None, "12 %% 3", "a", "x  y\n\nzz", "日本語 text", "Straße İ"]


def test_bundles_like_letter_by_letter():
    vectors = langid.Vectors(64)
    owner, codes = langid.sequences(TEXTS)
    got = vectors.bundled(owner, codes, None, len(TEXTS))
    assert np.array_equal(got, [slow_vector(t, vectors) for t in TEXTS])


def test_many_letters_and_blocks(monkeypatch):
    monkeypatch.setattr(langid, "HELD_SEQUENCES", 7)
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 300))) + " ab"
    vectors = langid.Vectors(32)
    owner, codes = langid.sequences([text])
    assert np.array_equal(vectors.bundled(owner, codes, None, 1)[0], slow_vector(text, vectors))


LINES = {"en": "the ring of things that were here and there", "fr": "les eaux de la mer que nous avons été",
         "de": "der das und nicht für über schließen zug"}


def labelled(spark):
    rows = []
    for i in range(60):
        lang = sorted(LINES)[i % 3]
        words = LINES[lang].split()
        rows.append((i, " ".join(words[i % 5 :] + words[: i % 3]), None if i == 9 else lang, 1))
    rows += [(100, None, "en", 1), (101, "12 %%", "de", 1), (None, "les eaux", "fr", 1), (1, "les eaux", "xx", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_prototypes_and_predictions_like_brute_force(spark):
    docs = labelled(spark)
    model = langid.train_on_rest(docs)
    vectors = langid.Vectors()
    rows = docs.collect()
    kept = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = {}
    for r in kept:
        if r.lang and slow_sequences(r.text):
            want[r.lang] = want.get(r.lang, 0) + slow_vector(r.text, vectors)
    assert model.languages == sorted(want)
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by_text = {r.doc_id: r for r in rows if r.doc_id != 1}
    for r in out:
        if r.doc_id == 1:
            continue
        v = slow_vector(by_text[r.doc_id].text, vectors)
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in want.items()}
        assert cos[r.lang_pred] == pytest.approx(max(cos.values())) and r.score == pytest.approx(max(0, max(cos.values())))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97


def test_nothing_to_learn_and_empty_table(spark, docs_of):
    assert langid.identify(docs_of([])).count() == 0
    out = langid.identify(docs_of([(1, "a b"), (2, None)], lang=None)).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}
    docs = labelled(spark)
    left = langid.keep_identified(docs, langid.train_on_rest(docs))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {0, 2, 3} and left.filter("doc_id in (100, 101)").count() == 0


def test_unlearned_scripts_and_noise_go_and_short_texts_stay(spark, docs_of):
    docs = labelled(spark)
    model = langid.train_on_rest(docs)
    strange = ["Это просто русский текст о погоде и природе нашей большой страны и её людей", "这是一个中文文本关于天气和自然" * 6,
               "Αυτό είναι ένα ελληνικό κείμενο για τον καιρό και τη φύση της χώρας μας", "यह मौसम और प्रकृति के बारे में एक हिंदी पाठ है जो काफी लंबा है और चलता रहता है",
               "xq zvkj wpt bqhz kkxv qqjj zzpw vxkq jzzq wqkx pzvq kqxj zzkw vqpx jkwz qxzv", "ЖЩ" * 300]
    assert all(len(t) >= langid.SHORT_TEXT for t in strange)
    rows = docs_of([*enumerate(strange), (50, "the"), (51, "Ж"), (52, "12"), (53, None)])
    assert {r.doc_id for r in langid.keep_identified(rows, model).collect()} == {50, 51}


def test_all_documents_with_letters_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train_on_rest(docs)
    gone = docs.exceptAll(langid.keep_identified(docs, model))
    assert gone.filter(F.col("text").rlike(r"\p{L}")).count() == 0
