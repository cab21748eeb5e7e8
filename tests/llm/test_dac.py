import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamdex.llm import dac
from loamdex.session import shared_dir

FILE = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_round_trip_and_random_access(ids):
    reader = dac.Reader(dac.encode(np.array(ids, np.uint32)))
    assert reader.all().tolist() == ids
    assert [reader.at(i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        reader.at(len(ids))


ODD = ["", "  ", "<|endoftext|> x<|startoftext|>", "Ünï\tcode　x é é ́a", "it's a 'S don'T", "a\x00b \r\n c", None, "≠ A̸.̸ x.y-z 12.5% ½ 中文。", "İstanbul ΑΣ. ẞ ﬁ", "k <|ENDOFTEXT|> (a).b", "ǅ ᾈ *̸ a&̸b"]


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=40) | st.sampled_from(ODD), max_size=8))
@settings(max_examples=150, deadline=None)
def test_remembered_parts_equal_whole_texts(texts):
    want = [e.ids for e in Tokenizer.from_file(FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)] if texts else []
    ids, n = dac.encoder(FILE).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def written(spark, docs):
    path = f"{shared_dir(spark)}/test-tokens-{uuid.uuid4().hex}"
    dac.write(docs, FILE, path)
    return path


def test_written_documents_read_back(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    path = written(spark, docs)
    own, start, want, flat = Tokenizer.from_file(FILE), 0, {}, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        flat += ids
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in dac.documents(spark, path).collect()}
    assert got == want
    places = [0, 1, 77, 77, start // 2, start - 1, start, -1, None]
    found = dac.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    at = {r.place: r.id for r in found}
    assert at == {p: flat[p] for p in places if p is not None and 0 <= p < start} and len(found) == len(at)


def test_edge_rows(spark, make_docs):
    path = written(spark, make_docs((2, None), (1, ""), (2, "a"), (2, None)))
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in dac.documents(spark, path).collect()) == [(1, 0, 1), (2, 1, 1), (2, 2, 1), (2, 3, 2)]
    assert dac.documents(spark, written(spark, make_docs((1, "a")).limit(0))).count() == 0


def test_long_texts_fill_segments_and_names_may_clash(spark, make_docs):
    rows = [(i, "token stream " * 40_000) for i in range(3)] + [(None, "no id")]
    docs = make_docs(*rows)
    for name in ("shard", "seq", "payload", "ids", "n_tokens"):
        docs = docs.withColumn(name, F.lit("clash"))
    path = written(spark, docs)
    found = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in dac.documents(spark, path).collect())
    assert [d for _, d, _ in found] == [-1, 0, 1, 2] and [s for s, *_ in found] == np.cumsum([0, *(n for *_, n in found[:-1])]).tolist()
    ends = [s + n - 1 for s, _, n in found]
    assert {r.id for r in dac.tokens_at(spark, path, spark.createDataFrame([(p,) for p in ends], "place long")).collect()} == {2}
