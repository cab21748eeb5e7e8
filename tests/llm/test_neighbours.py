import numpy as np
from pyspark.sql import functions as F

from loamdex.llm import neighbours as N


def exact(rows, queries, top):
    """Brute force over (vec_id, vector) rows."""
    out = {}
    for q, v in queries:
        scores = sorted(((-float((np.array(x) * np.array(v)).sum()), i) for i, x in rows if i != q))
        out[q] = scores[:top]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = [(r.vec_id, r.embedding) for r in rows.collect()]
    want = exact(held, [x for x in held if x[0] % 20 == 0], 20)
    got = found(N.search(rows, rows.filter("vec_id % 20 = 0")))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.95
    truth = dict(held)
    for q, hits in got.items():
        assert hits == sorted(hits)
        assert all(abs(-s - float(np.dot(np.array(truth[q]), np.array(truth[i])))) < 1e-9 for s, i in hits)


def test_lengths_matter_and_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=8) * rng.uniform(0.1, 5)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(N.search(df, df.filter("vec_id % 20 = 0"), 25)), exact(rows, [rows[0], rows[20]], 25)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


def test_odd_vectors_ties_and_repeats(spark):
    v = [1.0, 0.0]
    rows = [(0, v), (1, v), (2, v), (2, v), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (None, v), (20, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = found(N.search(df, df.filter("vec_id % 20 = 0"), 3))
    assert {q: [i for _, i in x] for q, x in got.items()} == {0: [1, 2, 10]}
    assert N.search(df.limit(0), df, 3).count() == 0 and N.search(df, df.limit(0), 3).count() == 0
