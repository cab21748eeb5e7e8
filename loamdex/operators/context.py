"""Rebuilding what a query reads: the documents of its hits, put together from chunks within budgets of characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of one document, of one that must stay whole, and of all documents of a query.
MAX_CHARS, WHOLE_CHARS, BUDGET = 6000, 24_000, 60_000
#: Bytes from which on only what is around the hits is taken, and documents of a query.
LARGE, DOCUMENTS = 40_000, 8
#: How far from a hit chunks are claimed next: of a large document, and of others.
NEAR_LARGE, NEAR = 1, 2
#: Between two blocks, and what stands for chunks that are left out.
BETWEEN = "\n\n"
OMITTED = "--- … {} chunk(s) omitted … ---"


def label(rows: DataFrame) -> Column:
    """The line above a chunk: its lines, and its heading where there is one."""
    parts = [F.format_string("lines %d-%d", "start_line", "end_line")]
    if "heading" in rows.columns:
        parts.append(F.when(F.trim("heading") != "", F.trim("heading")))
    said = F.concat_ws(" · ", *parts)
    return F.when(said == "", "").otherwise(F.concat(F.lit("--- "), said, F.lit(" ---\n")))


def claim_order(n: int, anchors: list[int], large: bool) -> list[int]:
    """Which of ``n`` chunks are asked first: the opening, the hits, then outwards from each hit, then the rest; of a large document only the hits' surroundings, in order."""
    if large:
        around = {0}.union(*(range(a - NEAR_LARGE, a + NEAR_LARGE + 1) for a in anchors))
        return sorted(i for i in around if 0 <= i < n)
    outwards = [a + side * far for a in anchors for far in range(1, NEAR + 1) for side in (1, -1)]
    return [i for i in dict.fromkeys([0, *anchors, *outwards, *range(n)]) if 0 <= i < n]


def claim(costs: list[int], order: list[int], allowance: int) -> list[int]:
    """The chunks that fit, asked in order; one that is too long is passed over, and later ones may still fit."""
    left, taken = allowance, []
    for i in order:
        if costs[i] + len(BETWEEN) <= left:
            left -= costs[i] + len(BETWEEN)
            taken.append(i)
    return sorted(taken)


_CLAIMED = "query_id {0}, place int, doc_id {1}, chunks int, included int, truncated boolean, chunk_index int, chars int, gap int, rest int"


def claims(wanted: DataFrame, max_chars: int = MAX_CHARS, whole_chars: int = WHOLE_CHARS, budget: int = BUDGET, large: int = LARGE) -> DataFrame:
    """What each document of a query may show, of rows (query_id, place, doc_id, size, whole, chunk_index, cost, anchor).

    Documents are served in order of ``place`` from what is left of the budget. A row of the result is a chunk that is
    shown, with how many are left out before it, and after the last one; ``chars`` is set where a chunk is cut, as
    nothing else of its document fits. Only lengths come together here, one query at a time.
    """

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("chunk_index", "ascending")])
        out, spent, at = [], 0, 0
        listed = rows.select(["place", "doc_id", "size", "whole", "chunk_index", "cost", "anchor"]).to_pylist()
        while at < len(listed):
            head, to = listed[at], at
            while to < len(listed) and listed[to]["place"] == head["place"]:
                to += 1
            own, at = listed[at:to], to
            if spent >= budget:
                continue
            allowance = min(whole_chars if head["whole"] else max_chars, budget - spent)
            order = claim_order(len(own), [i for i, r in enumerate(own) if r["anchor"]], not head["whole"] and head["size"] > large)
            costs = [r["cost"] for r in own]
            taken, cut = claim(costs, order, allowance), None
            if not taken:
                taken, cut = order[:1], allowance
            if cut is None:
                gaps = [taken[0], *(b - a - 1 for a, b in zip(taken, taken[1:]))]
                rest = len(own) - 1 - taken[-1]
            else:
                gaps, rest = [0], 0
            shown = [0, *gaps[1:], rest]  # what is left out before the first chunk isn't said
            spent += sum(costs[i] for i in taken) if cut is None else min(cut, costs[taken[0]])
            spent += len(BETWEEN) * (len(taken) - 1) + sum(len(OMITTED.format(g)) + len(BETWEEN) for g in shown if g)
            truncated = cut is not None or len(taken) < len(own)
            for n, i in enumerate(taken):
                out.append((rows.column("query_id")[0].as_py(), head["place"], head["doc_id"], len(own), len(taken), truncated, own[i]["chunk_index"], cut, shown[n], rest if n == len(taken) - 1 else 0))
        kinds = [rows.schema.field("query_id").type, pa.int32(), rows.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 4]
        names = [c.split()[0] for c in _CLAIMED.split(", ")]
        return pa.table({c: pa.array([r[n] for r in out], k) for n, (c, k) in enumerate(zip(names, kinds))})

    kinds = dict(wanted.dtypes)
    return wanted.groupBy("query_id").applyInArrow(fold, _CLAIMED.format(kinds["query_id"], kinds["doc_id"]))


def rebuild(hits: DataFrame, chunks: DataFrame, files: DataFrame, documents: int = DOCUMENTS, **limits: int) -> DataFrame:
    """(query_id, place, doc_id, chunks, included, truncated, text): the documents of each query's first hits, in order of their best one.

    ``hits`` are (query_id, rank, doc_id, chunk_index), ``chunks`` (doc_id, chunk_index, start_line, end_line, text,
    perhaps heading), ``files`` (doc_id, size in bytes, whole): code and settings are ``whole``, as half of one is worth
    nothing; a large text shows its hits and their neighbours. Chunks claim their place by what they are worth, one that
    is too long is skipped, and what is left out is said in between.

    A query without hits, and a document that nothing is left for, have no row. Lengths meet the hits by a join; the
    texts that move are those that are shown.
    """
    best = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"), F.collect_set("chunk_index").alias("anchors"))
    order = Window.partitionBy("query_id").orderBy("best", "doc_id")
    served = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= documents)
    served = served.join(files.select("doc_id", "size", "whole"), "doc_id")
    blocks = chunks.select("doc_id", "chunk_index", F.concat(label(chunks), F.coalesce("text", F.lit(""))).alias("block"))
    costs = served.join(blocks.select("doc_id", "chunk_index", F.length("block").alias("cost")), "doc_id")
    wanted = costs.select("query_id", "place", "doc_id", "size", "whole", "chunk_index", "cost", F.array_contains("anchors", F.col("chunk_index")).alias("anchor"))
    shown = claims(wanted, **limits).join(blocks, ["doc_id", "chunk_index"])
    say = lambda n: F.format_string(OMITTED.replace("{}", "%d"), n)
    whole = F.when(F.col("chars").isNotNull(), F.expr("left(block, chars)")).otherwise(F.col("block"))
    piece = F.concat_ws(BETWEEN, F.when(F.col("gap") > 0, say("gap")), whole, F.when(F.col("rest") > 0, say("rest")))
    by = ["query_id", "place", "doc_id", "chunks", "included", "truncated"]
    listed = shown.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk_index", piece.alias("piece")))).alias("pieces"))
    return listed.select(*by, F.array_join(F.col("pieces.piece"), BETWEEN).alias("text")).filter("text != ''")
