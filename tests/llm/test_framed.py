import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import framed, tokens
from brindle.session import fresh_path

PATH = tokens.vocabulary_path()
PLAIN = Tokenizer.from_file(PATH)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def ids_of(text):
    return np.frombuffer(tokens.encoder(PATH).encode(text), np.uint16).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\0\x0b\x1c\x1f.,;?ÿ×\x85  　ab'sé!1<|>日", max_size=40))
def test_cut_texts_give_the_ids_of_whole_texts(text):
    assert ids_of(text) == plain(text)


@pytest.mark.parametrize("text", [" a", "a ", "\n\na  b\n", "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>\n\n<|endoftext|>", "Ends. Here, so!\nNew: a;b", "it's we'll", "a\r\nb", "x" * 5000, "I  \n\n am"])
def test_special_spellings(text):
    assert ids_of(text) == plain(text)


def test_batches_of_real_texts_give_the_ids_of_whole_texts():
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).combine_chunks()
    texts = pa.concat_arrays([rows, pa.array([None, "", "a <|endoftext|> b", "x" * 9000, "a\n\n  b \t\n", "nul\0 in a text"])])
    found = [ids.tolist() for ids in tokens.encoder(PATH).encode_batch(texts)]
    assert found == [plain(t) for t in texts.to_pylist()]


def brute(pairs):
    out, start = [], 0
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = np.array([*plain(t), 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def pairs():
    rng = random.Random(1)
    words = ["the", "Éré", "x", "\n", "", "12", "don't"]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(80)]
    return out + [(200, None), (201, ""), (5, "twice"), (5, "twice"), (None, "no id"), (300, "long word " * 20_000)]


def test_round_trip(spark, docs_of):
    folder = fresh_path(spark, "records")
    index = framed.write_records(docs_of(pairs()), folder, files=5)
    got = sorted(map(tuple, framed.read_digests(index, folder).collect()), key=lambda r: r[1])
    assert got == brute(pairs())
    some = index.filter("doc_id % 3 = 0").orderBy("n_tokens", "doc_id").coalesce(1)
    back = [(r.doc_id, np.frombuffer(r.ids, f"<u{r.width}").tolist()) for r in framed.read_shuffled(some, folder).collect()]
    texts = dict(pairs())
    assert [i for i, _ in back] == [r.doc_id for r in some.collect()]
    assert all(ids == [*plain(texts[i]), 0] for i, ids in back)
    whole = framed.read_in_order(index, folder).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(r.ids) // r.width for r in whole)


def test_damage_is_seen(spark, docs_of):
    folder = fresh_path(spark, "records")
    index = framed.write_records(docs_of([(1, "some text here")]), folder, files=1)
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    path = f"{root}/{index.first().file}"
    data = bytearray(store.open_input_file(path).read())
    data[30] ^= 1
    with store.open_output_stream(path) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="damaged record"):
        framed.read_digests(index, folder).collect()


def test_empty_table(spark, docs_of):
    folder = fresh_path(spark, "records")
    assert framed.read_digests(framed.write_records(docs_of([]), folder), folder).count() == 0
