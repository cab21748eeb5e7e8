import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamdex.llm import joins as J
from loamdex.llm import suffixes as S


def brute(rows, n, first_stays=False):
    """Rows of (doc_id, text): removed bytes by the definition."""
    texts = [(t or "").encode() for _, t in rows]
    seen, out = Counter(x[i : i + n] for x in texts for i in range(len(x) - n + 1)), {}
    known = set()
    for (doc_id, _), x in sorted(zip(rows, texts), key=lambda r: r[0][0]):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - n + 1):
            w = x[i : i + n]
            if w in known if first_stays else seen[w] > 1:
                gone[i : i + n] = True
            known.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        rest = bytes(np.frombuffer(x, np.uint8)[~gone]) if x else b""
        out[doc_id] = (len(x), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


def table(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@given(st.lists(st.integers(0, 5), min_size=1, max_size=400), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_least_places(values, width):
    h = np.array(values, np.uint64)
    if len(h) < width:
        return
    want = [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]
    assert S.least_places(h, width).tolist() == want


@given(st.text("ab", min_size=1, max_size=120), st.integers(1, 40), st.randoms())
@settings(max_examples=150, deadline=None)
def test_factors_are_the_longest_before_and_behind(text, length, rng):
    buf = np.frombuffer(text.encode(), np.uint8)
    place = np.arange(max(len(buf) - length + 1, 0))
    if not len(place):
        return
    position = np.array(rng.sample(range(len(place)), len(place)))
    made = S.Suffixes(buf, place, length)
    assert made.order.tolist() == sorted(place.tolist(), key=lambda i: (text[i : i + length], i))

    def shared(i, j):
        return next((k for k in range(length) if text[i + k] != text[j + k]), length)

    want = [[max([shared(i, j) for j in place if way * position[j] < way * position[i]], default=0) for i in place] for way in (1, -1)]
    assert [x.tolist() for x in made.factors(position)] == want


@given(st.lists(st.integers(0, 9), max_size=60))
@settings(max_examples=100, deadline=None)
def test_nearest_smaller(values):
    want = [next((j for j in range(i - 1, -1, -1) if values[j] < v), -1) for i, v in enumerate(values)]
    assert S.nearest_smaller(np.array(values, np.int64)).tolist() == want


@pytest.mark.parametrize("group", [4096, 1])
def test_texts_of_one_id_are_told_apart(spark, make_docs, monkeypatch, group):
    """Two strings of one crc32, which once stood for a row's text, under one id and under none."""
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(1)
    tail = "".join(rng.choice(list("abcdefghij "), 400))
    for doc_id in (7, None):
        rows = [(doc_id, "plumless" + tail), (doc_id, "buckeroo" + tail), (9, "plumless" + tail[:300])]
        got = sorted((r.n_bytes, r.n_removed) for r in S.dedup(make_docs(*rows), first_stays=False).collect())
        assert got == [(308, 308), (408, 400), (408, 408)]


def test_anchors_of_many_stretches_are_dealt_out(spark, make_docs, monkeypatch):
    monkeypatch.setattr(J, "LEAST", 20)
    rng = np.random.default_rng(8)
    line = "This line is part of very many documents and holds no less than sixty-four bytes."
    rows = [(i, "".join(rng.choice(list("abcdef "), 180)) + line + "".join(rng.choice(list("abcdef "), 180)) * (1 + i % 2)) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(40)]
    for group in (4096, 2):
        monkeypatch.setattr(S, "GROUP", group)
        for first_stays in (False, True):
            assert table(S.dedup(make_docs(*rows), first_stays=first_stays)) == brute(rows, 200, first_stays)


@pytest.mark.parametrize("group", [4096, 1])
@pytest.mark.parametrize("first_stays", [False, True])
def test_matches_brute_force(spark, data, monkeypatch, group, first_stays):
    monkeypatch.setattr(S, "GROUP", group)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 200, first_stays)
    assert any(x[1] for x in want.values())
    assert table(S.dedup(docs, first_stays=first_stays)) == want


def test_very_long_text(spark, make_docs):
    rng = np.random.default_rng(9)
    part = "".join(rng.choice(list("abcdefghij "), 3000))
    rows = [(1, "".join(rng.choice(list("abcdefghij "), 60_000)) + part), (2, part + "z" * 5000)]
    assert table(S.dedup(make_docs(*rows), first_stays=False)) == brute(rows, 200)


def test_short_lengths_and_odd_rows(spark, make_docs):
    rows = [(1, "abcabcabcabc"), (2, "xxabcabx"), (3, None), (4, ""), (5, "aaaaaaaaaaaaaaa"), (6, "ñandú ñandú"), (7, "q"), (8, "zabcabcz" * 3)]
    docs = make_docs(*rows).withColumn("list", F.lit(1)).withColumn("own", F.lit(2))
    for n in (3, 5, 7):
        assert table(S.dedup(docs, n, False)) == brute(rows, n)
        assert table(S.dedup(docs, n, True)) == brute(rows, n, True)
    assert S.dedup(docs.limit(0), 5).count() == 0
    twice = S.dedup(make_docs((1, "abcdefgh"), (1, "abcdefgh"), (None, "12345678")), 5, False).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, 0), (1, 8), (1, 8)]
