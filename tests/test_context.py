"""Rebuilding documents against a plain walk over each query's documents."""

import random

import pytest
from pyspark.sql import functions as F

from loamdex.operators import context


def plain(docs, max_chars, whole_chars, budget, large):
    """Rows (place, doc, chunks, included, truncated, text) of one query: documents as (doc, size, whole, blocks, anchors) in order."""
    out, spent = [], 0
    for place, (doc, size, whole, blocks, anchors) in enumerate(docs, 1):
        if spent >= budget:
            continue
        allowance = min(whole_chars if whole else max_chars, budget - spent)
        n, asked = len(blocks), [0]
        if not whole and size > large:
            asked = sorted({i for a in anchors for i in (a - 1, a, a + 1) if 0 <= i < n} | {0})
        else:
            asked += anchors
            for a in anchors:
                asked += [a + 1, a - 1, a + 2, a - 2]
            asked += range(n)
        used, kept = 0, set()
        for i in asked:
            if 0 <= i < n and i not in kept and used + len(blocks[i]) + 2 <= allowance:
                used += len(blocks[i]) + 2
                kept.add(i)
        if not kept:
            text, shown = blocks[asked[0]][:allowance], 1
        else:
            pieces, last = [], None
            for i in sorted(kept):
                if last is not None and i > last + 1:
                    pieces.append(f"--- … {i - last - 1} chunk(s) omitted … ---")
                pieces.append(blocks[i])
                last = i
            if last < n - 1:
                pieces.append(f"--- … {n - 1 - last} chunk(s) omitted … ---")
            text, shown = "\n\n".join(pieces), len(kept)
        spent += len(text)
        if text:
            out.append((place, doc, n, shown, len(kept) < n, text))
    return out


@pytest.mark.parametrize("budget", [60_000, 700, 90])
def test_rebuild_equals_a_plain_walk(spark, budget):
    rng = random.Random(budget)
    chunks, files, hits, want = [], [], [], {}
    limits = {"max_chars": 300, "whole_chars": 500, "budget": budget, "large": 400}
    blocks = {}
    for doc in range(12):
        n = rng.randint(1, 9)
        for i in range(n):
            text, heading = "x" * rng.choice([0, 5, 40, 90, 350]) + str(i), rng.choice(["", "A > B", None])
            chunks.append((doc, i, 10 * i + 1, 10 * i + 9, text, heading))
            blocks.setdefault(doc, []).append(f"--- lines {10 * i + 1}-{10 * i + 9}{' · ' + heading if heading else ''} ---\n{text}")
        files.append((doc, rng.choice([100, 900]), rng.random() < 0.3))
    for q in range(15):
        listed = [(d, i) for d in rng.sample(range(12), 5) for i in rng.sample(range(len(blocks[d])), min(2, len(blocks[d])))]
        rng.shuffle(listed)
        hits += [(q, r + 1, d, i) for r, (d, i) in enumerate(listed)]
        order = list(dict.fromkeys(d for d, _ in listed))[:3]
        want[q] = plain([(d, files[d][1], files[d][2], blocks[d], sorted(i for e, i in listed if e == d)) for d in order], **limits)
    made = context.rebuild(
        spark.createDataFrame(hits, "query_id int, rank int, doc_id long, chunk_index int"),
        spark.createDataFrame(chunks, "doc_id long, chunk_index int, start_line int, end_line int, text string, heading string"),
        spark.createDataFrame(files, "doc_id long, size int, whole boolean"),
        documents=3, **limits,
    )
    got = {}
    for r in made.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.place, r.doc_id, r.chunks, r.included, r.truncated, r.text))
    assert got == {q: w for q, w in want.items() if w}
    assert any(r[4] for w in want.values() for r in w)


def test_what_is_too_long_is_passed_over():
    assert context.claim([5, 50, 5, 5], [0, 1, 2, 3], 21) == [0, 2, 3]
    assert context.claim_order(6, [3], False) == [0, 3, 4, 2, 5, 1]
    assert context.claim_order(9, [5, 8], True) == [0, 4, 5, 6, 7, 8]


def test_empty_tables(spark):
    hits = spark.createDataFrame([], "query_id int, rank int, doc_id long, chunk_index int")
    chunks = spark.createDataFrame([(1, 0, 1, 2, None)], "doc_id long, chunk_index int, start_line int, end_line int, text string")
    files = spark.createDataFrame([(1, 5, False)], "doc_id long, size int, whole boolean")
    assert context.rebuild(hits, chunks, files).count() == 0
    hits = hits.unionByName(spark.createDataFrame([(1, 1, 1, 0), (1, 2, 9, 0)], hits.schema))
    assert [r.text for r in context.rebuild(hits, chunks, files).withColumn("x", F.lit(1)).collect()] == ["--- lines 1-2 ---\n"]
