import hashlib

import numpy as np
from pyspark.sql import functions as F

from loamdex.llm import codes


def plain(vectors, rounds=4):
    """Lloyd's rounds from their definition, in Python's own integers; vectors in order of id."""
    width = -(-max(len(v) for v in vectors) // 4)
    full = [[int(np.floor(1024 * c)) for c in v] + [0] * (4 * width - len(v)) for v in vectors]
    parts = [[v[p * width : (p + 1) * width] for p in range(4)] for v in full]
    books = [[parts[i][p] for i in range(min(256, len(parts)))] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(4)] for v in parts]

    for _ in range(rounds):
        own = assign()
        for p in range(4):
            for k in range(len(books[p])):
                held = [v[p] for v, o in zip(parts, own) if o[p][1] == k]
                if held:
                    books[p][k] = [sum(c) // len(held) for c in zip(*held)]
    own = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return ["".join(f"{k:02x}" for _, k in o) for o in own], [sum(d for d, _ in o) for o in own], digest


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 8))
    vectors = [(middles[i % 40] + rng.normal(scale=0.2, size=8)).astype(np.float32) for i in range(500)]
    rows = spark.createDataFrame([(i * 3, i % 3, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<float>").repartition(5)
    made, books = codes.encode(rows, ["label"])
    got = {r.vec_id // 3: r for r in made.collect()}
    code, error, digest = plain(vectors)
    assert [got[i].code for i in range(500)] == code and [got[i].error for i in range(500)] == error
    assert books.digest() == digest and all(got[i].label == i % 3 for i in range(500))
    back = {r.vec_id // 3: np.array(r.embedding) for r in codes.decode(made, books).collect()}
    assert all(abs(1024**2 * ((back[i] - vectors[i]) ** 2).sum() - error[i]) <= 8 * (2 * error[i] ** 0.5 + 8) for i in range(500))


def test_bounds_skip_scans_and_lose_nothing():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-900, 900, (60, 4, 6)), rng.integers(-9, 9, (3000, 4, 6)) + rng.integers(-900, 900, (60, 4, 6))[rng.integers(0, 60, 3000)]])
    books, state, work, rounds = codes.Codebooks(x[:256].transpose(1, 0, 2).copy()), None, [], 8
    for _ in range(rounds):
        state, error, n = books.assign(codes.State.unpack(state.pack()) and x if state else x, state)
        full = np.stack([codes.distances(x[:, p], books.now[p]) for p in range(4)], axis=1)
        assert (full.argmin(axis=2) == state.own).all() and (full.min(axis=2) == error).all()
        work.append(n)
        book = books.now.copy()
        for p in range(4):
            for k in np.unique(state.own[:, p]):
                book[p, k] = x[state.own[:, p] == k, p].sum(axis=0) // (state.own[:, p] == k).sum()
        books.add(book)
    assert work[0] == len(x) * 4 * 256 and work[-1] < work[0] / 4
    # a net displacement is no more than the steps it is made of
    steps = sum(np.sqrt(((a - b).astype(float) ** 2).sum(axis=2)) for a, b in zip(books.history, books.history[1:]))
    assert (np.sqrt(((books.history[-1] - books.history[0]).astype(float) ** 2).sum(axis=2)) <= steps + 1e-6).all()


def test_edge_rows(spark):
    rows = [(5, None, [1.0, 2.0, 3.0, 4.0]), (5, None, [1.0, 2.0, 3.0, 4.0]), (2, 1, [0.0]), (3, 1, None), (4, 1, [1.0, None]), (6, 1, [float("nan")]), (7, 1, [float("inf")]), (None, 1, [1.0]), (1, 2, []), (9, 2, [3.0e38, -3.0e38, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit("x")).withColumn("state", F.lit(1))
    made, books = codes.encode(df, ["label"])
    got = sorted((r.vec_id or 99, r.label or 0, r.code, r.error) for r in made.collect())
    assert [(g[0], g[3]) for g in got] == [(1, 0), (2, 0), (5, 0), (5, 0), (9, 0), (99, 0)]
    assert got[0][2] == got[1][2] == "00000000" and got[2] == got[3] and books.now.shape == (4, 6, 1)
    made, books = codes.encode(df.limit(0), ["label"])
    assert made.count() == 0 and books is None and made.columns == ["vec_id", "label", "code", "error"]
    made, books = codes.encode(df.filter("vec_id = 1"))
    assert [tuple(r) for r in made.collect()] == [(1, "00000000", 0)]


def test_large_components_stay_exact():
    x, e = np.array([[2**27, -(2**27)]]), np.array([[2**27 - 1, -(2**27)], [-(2**27), 2**27]])
    assert codes.distances(x, e).tolist() == [[1, 2 * 2**56]]
