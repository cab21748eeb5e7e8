"""The stored index against one built anew, and clusters against plain rounds."""

import glob
import hashlib
import math
import os
import random

import numpy as np

from loamdex.operators import buckets, clusters, lexical
from loamdex.plans import stored
from loamdex.plans.catalogue import ORACLES


def made(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_deltas_equal_an_index_built_anew(spark, tmp_path, monkeypatch):
    rng, words = random.Random(6), [f"w{i}" for i in range(80)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    texts, path, fresh = {i: text() for i in range(40)}, str(tmp_path / "kept"), str(tmp_path / "fresh")
    buckets.build(made(spark, texts), path, buckets=16)
    for _ in range(3):
        new = {rng.randrange(50): text() for _ in range(6)}
        gone = rng.sample(sorted(texts), 5)
        texts = {k: v for k, v in texts.items() if k not in gone} | new
        delta = made(spark, new), spark.createDataFrame([(k,) for k in gone] + [(999,), (None,)], "doc_id long")
        buckets.apply(path, *delta, buckets=16)
        buckets.build(made(spark, texts), fresh, buckets=16)
        assert buckets.fold(spark, path) == buckets.fold(spark, fresh)
    buckets.apply(path, *delta, buckets=16)  # once more, as after an interruption
    assert buckets.fold(spark, path) == buckets.fold(spark, fresh)
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w70 nothing"), (3, "")], "query_id int, query string")
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(buckets.search(queries, path, buckets=16)) == order(lexical.bm25(queries, lexical.index(made(spark, texts))))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "kept")
    buckets.build(made(spark, {i: f"word{i}" for i in range(60)}), path, buckets=32)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/postings/bucket=*/*.parquet")}
    none = spark.createDataFrame([], "doc_id long")
    buckets.apply(path, made(spark, {}), none, buckets=32)
    assert before == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/postings/bucket=*/*.parquet")}
    buckets.apply(path, made(spark, {3: "word4"}), none, buckets=32)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/postings/bucket=*/*.parquet")}
    changed = {os.path.dirname(f) for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert 1 <= len(changed) <= 2
    # a bucket whose last row goes is empty, not what it was
    buckets.apply(path, made(spark, {}), spark.createDataFrame([(i,) for i in range(60)], "doc_id long"), buckets=32)
    assert buckets.fold(spark, path)[0] == buckets.fold(spark, path)[2] == 0


def test_what_stays_is_not_written_apart_and_files_stay_few(spark, tmp_path, monkeypatch):
    rng, words, written, cut = random.Random(9), [f"w{i}" for i in range(60)], [], buckets.cut

    def counted(df, name):
        out = cut(df, name)
        written.append(out.count())
        return out

    texts, path, fresh = {i: " ".join(rng.choices(words, k=20)) for i in range(120)}, str(tmp_path / "kept"), str(tmp_path / "fresh")
    buckets.build(made(spark, texts), path, buckets=4)
    monkeypatch.setattr(buckets, "cut", counted)
    monkeypatch.setattr(buckets, "MOST_FILES", 3)
    most = []
    for n in range(4):
        texts[n] = " ".join(rng.choices(words, k=20))
        buckets.apply(path, made(spark, {n: texts[n]}), spark.createDataFrame([], "doc_id long"), buckets=4)
        most.append(max(len(glob.glob(f"{path}/postings/bucket={b}/*.parquet")) for b in range(4)))
    assert sum(written) < 4 * 20  # the other 119 rows' postings are some 2,000
    assert max(most) <= 6 and most[-1] <= most[1] + 1
    monkeypatch.undo()
    buckets.build(made(spark, texts), fresh, buckets=4)
    assert buckets.fold(spark, path) == buckets.fold(spark, fresh)


def plain_kmeans(vectors, k, rounds, seed):
    order = sorted(vectors, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    centres, seen = [], set()
    for i in order:
        if tuple(vectors[i]) not in seen and len(centres) < k:
            seen.add(tuple(vectors[i]))
            centres.append(list(vectors[i]))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (round(sum((a - b) ** 2 for a, b in zip(v, centres[c])), 9), c))
    for _ in range(rounds):
        own = {i: nearest(v) for i, v in vectors.items()}
        for c in range(len(centres)):
            held = [vectors[i] for i in own if own[i] == c]
            if held:
                centres[c] = [sum(x) / len(held) for x in zip(*held)]
    own = [nearest(v) for v in vectors.values()]
    return sorted(((own.count(c), [round(x, 6) for x in centres[c]]) for c in set(own)), key=lambda s: -s[0])


def test_kmeans_equals_plain_rounds(spark):
    rng = np.random.default_rng(8)
    vectors = {i * 7: (rng.integers(-3, 4, 4) * 2.0 + rng.normal(scale=0.1, size=4)).tolist() for i in range(150)}
    rows = [(i, v) for i, v in vectors.items()] + [(1, None), (2, [1.0, None, 0.0, 0.0]), (3, [0.0] * 4), (5, [1.0]), (None, [1.0] * 4), (6, [float("nan")] * 4)]
    got = {}
    for r in clusters.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), k=9, rounds=6).orderBy("cluster", "dim").collect():
        got.setdefault((r.cluster, r["size"]), []).append(r.value)
    want = plain_kmeans(vectors, 9, 6, clusters.SEED)
    assert [s for _, s in sorted(got)] == [s for s, _ in want]
    assert np.allclose(sorted(got.values()), sorted(c for _, c in want), atol=2e-6)
    assert clusters.kmeans(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_strided_is_every_so_manyth(spark, monkeypatch):
    monkeypatch.setattr(clusters, "RANGES", 5)
    ids = sorted(random.Random(3).choices(range(400), k=103))
    rows = spark.createDataFrame([(i, [float(n)]) for n, i in enumerate(ids)], "vec_id long, embedding array<double>").repartition(6)
    got = sorted(r.embedding[0] for r in clusters.strided(rows, 20).collect())
    assert got == [float(n) for n in range(0, 100, 5)]
    assert clusters.strided(rows, 200).count() == 103


def test_clusters_of_many_vectors_are_those_of_their_sql(spark, tmp_path, monkeypatch):
    """The SQL takes every so many-th vector too, and leaves out what the query leaves out."""
    import duckdb

    rng = random.Random(3)
    rows = [(i * 3, [rng.gauss(5 * (i % 4), 1) for _ in range(6)]) for i in range(clusters.SAMPLE + 300)]
    rows = [*rows, *((i * 3 + 1, [rng.gauss(5 * (i % 4), 1) for _ in range(6)]) for i in range(clusters.SAMPLE))]
    rows += [(None, [1.0] * 6), (2, None), (5, []), (8, [0.0] * 6), (11, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (14, [float("nan")] * 6), (17, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, stored.vector_clusters(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["vector_clusters"]).fetchall())
    assert len(got) == len(want) == 16 * 6
    assert all(g[:2] == w[:2] and g[3] == w[3] and abs(g[2] - w[2]) < 1e-9 and abs(g[4] - w[4]) < 1.5e-6 for g, w in zip(got, want))


def test_every_term_finds_and_scores(spark, tmp_path, monkeypatch):
    """Of twenty terms the most widespread one finds rows too, and all of them score, in blocks of any size."""
    rng, words, path = random.Random(2), [f"w{i:02d}" for i in range(40)], str(tmp_path / "kept")
    texts = {i: " ".join(w for n, w in enumerate(words) if rng.random() < (n + 1) / 50) for i in range(90)}
    texts[90] = "w39"
    texts = {i: t for i, t in texts.items() if t}
    buckets.build(made(spark, texts), path, buckets=8)
    asked = {1: words[20:], 2: words[::2], 3: words}
    queries = spark.createDataFrame([(q, " ".join(ws)) for q, ws in asked.items()], "query_id int, query string")
    rows = {i: t.split() for i, t in texts.items()}
    mean, df = sum(map(len, rows.values())) / len(rows), {w: sum(w in r for r in rows.values()) for w in words}
    want = []
    for q, ws in asked.items():
        score = {i: sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(r) / mean)) for w in ws if w in r) for i, r in rows.items()}
        listed = sorted((i for i in rows if score[i] > 0), key=lambda i: (-round(score[i], 6), i))
        want += [(q, n + 1, i, round(score[i], 6)) for n, i in enumerate(listed[:100])]
    assert (1, 90) in {(q, i) for q, _, i, _ in want}
    for most in (2, 1024):
        monkeypatch.setattr(lexical, "QUERY_BLOCK", most)
        monkeypatch.setattr(lexical, "ROW_BLOCK", most * 8)
        got = sorted(map(tuple, buckets.search(queries, path, top=100, buckets=8).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)
