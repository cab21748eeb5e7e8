"""Portions of batches, and operators whose batches hold more than one."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamdex.functions import batches
from loamdex.functions import text as T
from loamdex.operators import chunking, lexical, retrieval


def test_portions_hold_so_much_and_lose_no_row():
    texts = [None, "", "x" * 50, "é" * 30, "y", None, "z" * 9, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts), pa.array([[0] * len(t or "") for t in texts])], ["k", "text", "items"])
    found = list(batches.portions([batch, batch.slice(2, 3), batch.slice(0, 0)], "text", most=10))
    assert [p.column("k").to_pylist() for p in found] == [[0, 1], [2], [3], [4, 5, 6], [7], [2], [3], [4]]
    assert [p.column("k").to_pylist() for p in batches.portions([batch], "items", most=40)] == [[0, 1], [2], [3, 4, 5, 6], [7]]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)] + ["Straße", "car", "ÉCOLE"]
    return [None, "", *(" ".join(rng.choices(words, k=rng.choice([1, 40, 900]))) + "\n" for _ in range(60)), " ".join(rng.choices(words, k=40_000))]


def test_operators_over_several_portions(spark, texts):
    """Whatever a portion holds, results are those of one row at a time; texts here are longer than a portion together, and one is by itself."""
    assert sum(len(t or "") for t in texts) < 3 * batches.TEXT_BYTES
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tripled = rows.withColumn("text", F.repeat("text", 4))
    got = {r.doc_id: (r.len, {t.term: t.tf for t in r.terms}) for r in lexical.index(tripled).collect()}
    want = {i: Counter(re.findall("[a-z0-9]+", (t * 4).lower())) for i, t in enumerate(texts) if t}
    assert got == {i: (sum(c.values()), dict(c)) for i, c in want.items()}
    assert {r.doc_id for r in chunking.chunks(tripled).collect()} == set(want)
    assert [r.f for r in tripled.orderBy("doc_id").select(T.folded("text").alias("f")).collect()] == [None if t is None else " ".join((t * 4).casefold().split()) for t in texts]
    tokens = rows.select("doc_id", F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "").alias("tokens"))
    made = {r.doc_id: np.array(r.embedding) for r in retrieval.hash_embedding(tokens).collect()}
    for r in tokens.collect():
        total = sum((retrieval.hash_vector(retrieval.SYNONYMS.get(w, w)) for w in r.tokens or ()), np.zeros(retrieval.EMBED_DIMS))
        norm = np.linalg.norm(total)
        assert np.allclose(made[r.doc_id], total / norm if norm else total)


def test_pairs_of_words_are_counted_in_their_row(spark, texts):
    """One row for each of a text's pairs, with how often it has it; a pair doesn't cross texts."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = Counter()
    for t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        want.update(Counter(f"{a} {b}" for a, b in zip(w, w[1:])).items())
    assert Counter((r.bigram, r.n) for r in lexical.bigrams(rows).collect()) == want
