import numpy as np
import xxhash
from pyspark.sql import functions as F

from loamdex.llm import simhash
from loamdex.operators import components


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    names = list(range(len(prints)))

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                names[b] = a
    return [top(i) for i in range(len(prints))]


def test_fingerprints_match_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    for r in docs.collect():
        assert found[r.doc_id] == brute_print(r.text)


def test_groups_match_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    docs = spark.createDataFrame(rows)
    want = brute_components([brute_print(r.text) for r in rows])
    got = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    assert got == {r.doc_id: rows[k].doc_id for r, k in zip(rows, want)}


def test_edge_rows(make_docs):
    docs = make_docs((3, None), (1, ""), (2, "A b"), (2, "A b"), (5, "a  B"), (None, "a b"), (None, "lone words here in a row"))
    got = {(r.doc_id, r.fp == 0): r.component_id for r in simhash.groups(docs.withColumn("fp", F.lit("x"))).collect()}
    assert got[3, True] == got[1, True] == 1
    assert got[2, False] == got[5, False] == 2
    assert simhash.groups(docs.limit(0)).count() == 0
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.keep_first(docs).collect())
    assert kept == [(-1, "lone words here in a row"), (1, ""), (2, "A b")]


def test_large_buckets_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    prints = {base}
    for _ in range(120):
        x = sorted(prints)[int(rng.integers(len(prints)))]
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints | {int(x) for x in rng.integers(0, 2**62, 50)})
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"))
    parts = {r.node: r.component for r in components.components(links).collect()}
    want = brute_components(prints)
    names = [parts.get(s[0], s[0]) for s in signed]
    assert [[names.index(n) for n in names]] == [[want.index(w) for w in want]]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 1), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
