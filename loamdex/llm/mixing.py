"""Mixing sources to target weights by Pfair scheduling.

Every source's documents make a stream that is cut into blocks of equal size. Block j of a source with weight w
may run from slot floor((j - 1) / w) on and must run before slot ceil(j / w); earliest deadline first over one
period gives every block a slot, and after any number of slots each source is less than one block away from its
share. Weights are whole numbers of slots in a period, so the schedule repeats: only one period is ever laid
out, and every document finds its slot by arithmetic on its place in its source's stream.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of one period; weights are rounded to whole slots by largest remainder.
PERIOD = 1024
#: Characters in a block.
BLOCK = 4096
#: Sources that the schedule can hold; more than that is an error, as the period's table is broadcast.
MOST_SOURCES = 50_000
#: Exponent of the default weights: a source's share is its size to this power.
FLATTEN = 0.5
#: Buckets over which each source's stream is dealt out at least, and characters of a bucket beyond that.
SPREAD, BUCKET_CHARS = 256, 1 << 26
#: Characters of a partition of the mixed table, and places at which its volume is tabled.
PART_CHARS, CELLS = 1 << 27, 1024


def slots_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots by source: at least one each, in all one period, the rest by largest remainder, ties by name."""
    names = sorted(n for n, w in weights.items() if w > 0)
    if not names:
        return {}
    period = max(period, 2 * len(names))
    total = sum(weights[n] for n in names)
    spare = period - len(names)
    exact = {n: spare * weights[n] / total for n in names}
    out = {n: 1 + int(exact[n]) for n in names}
    for n in sorted(names, key=lambda n: (-(exact[n] - int(exact[n])), n))[: period - sum(out.values())]:
        out[n] += 1
    return out


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block within the period from 1, slot within the period) by earliest deadline first."""
    period = sum(slots.values())
    waiting = [(0, -(-period // n), name, 1) for name, n in sorted(slots.items())]  # (release, deadline, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, deadline, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, name, block))
        deadline, name, block = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        out.append((name, block, slot))
        if block < slots[name]:
            heapq.heappush(waiting, (block * period // slots[name], -(-(block + 1) * period // slots[name]), name, block + 1))
    return out


def _source(c: Column) -> Column:
    """A null source is one of its own, apart from an empty name."""
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def source_sizes(docs: DataFrame) -> dict[str, int]:
    """Characters by source, counted over all documents; a row a source."""
    rows = docs.groupBy(_source(F.col("source")).alias("s")).agg(F.sum(_size()).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r.s: r.n for r in rows}


def _size() -> Column:
    return F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD, spread: int = SPREAD, flatten: float = FLATTEN, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``docs`` with mix_slot and mix_start, in whose order the sources have their target weights.

    Of the columns only those that ``keep`` names are carried along, or all where it isn't given.

    A source's stream holds its documents by a hash of doc_id and text, then doc_id, so that texts needn't be
    shuffled where they aren't asked for. mix_start is a document's first character in that stream, block =
    mix_start div ``block``, and mix_slot the slot of that block, so a long document takes the slot of its first
    block. ``weights`` are by source (None for null sources); sources that it doesn't name and, without it, all
    sources get their size to the power ``flatten``. Where a source runs out its slots stay empty and the others
    go on in their proportions; no row is dropped or repeated. A null or empty text counts as one character, and
    a null doc_id is a value like any other. Rows that are equal in doc_id and text are in any order. An empty
    table stays empty. Only columns of ``docs`` that are named mix_slot or mix_start are replaced.
    """
    names = [c for c in (keep or docs.columns) if c.lower() not in ("mix_slot", "mix_start")]
    sizes = source_sizes(docs)
    placed = _placed(docs, names, sizes, _slots(sizes, weights, period, flatten), block, spread)
    return placed.select(*[F.col(f"row.`{c}`") for c in names], "mix_slot", "mix_start")


def _slots(sizes: dict[str, int], weights: dict[str | None, float] | None, period: int, flatten: float) -> dict[str, int]:
    share = {n: float(s) ** flatten for n, s in sizes.items()}
    if weights is not None:
        named = {"0" if n is None else f"1{n}": float(w) for n, w in weights.items()}
        if any(named.get(n, 1.0) <= 0 for n in share):
            raise ValueError("every source needs a weight above zero")
        scale = sum(share.values()) or 1.0
        share = {n: named.get(n, s / scale) for n, s in share.items()}
    return slots_of(share, period)


def _placed(docs: DataFrame, keep: list[str], sizes: dict[str, int], slots: dict[str, int], block: int, spread: int) -> DataFrame:
    """(row, id, mix_slot, mix_start): what is kept of each row of ``docs`` is packed, so that no name clashes."""
    spark, length = docs.sparkSession, sum(slots.values())
    plan = spark.createDataFrame([(n, b, s) for n, b, s in schedule(slots)], "source string, number long, place long")
    streams = spark.createDataFrame([(n, slots[n], max(spread, -(-sizes[n] // BUCKET_CHARS))) for n in slots], "source string, slots long, buckets long")

    rows = docs.select(_source(F.col("source")).alias("source"), _size().alias("size"), F.xxhash64("doc_id", "text").alias("hash"), F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    # a bucket holds neighbours by hash, so each source's stream is dealt out over many tasks and keeps its order
    rows = rows.join(F.broadcast(streams), "source").withColumn("bucket", F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("buckets")))  # a row a source
    counted = rows.groupBy("source", "bucket").agg(F.sum("size").alias("own"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("source", "bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(counted, ["source", "bucket"])
    placed = placed.withColumn("mix_start", F.col("before") + F.col("upto") - F.col("size"))
    number = F.floor(F.col("mix_start") / block)
    placed = placed.withColumns({"turn": F.floor(number / F.col("slots")), "number": number % F.col("slots") + 1})
    done = placed.join(F.broadcast(plan), ["source", "number"])  # a row a slot of one period
    return done.select("row", "id", (F.col("turn") * length + F.col("place")).alias("mix_slot"), "mix_start")


def _range_of(slot: Column, sizes: dict[str, int], slots: dict[str, int], block: int, parts: int) -> Column:
    """The range of slots, of ``parts`` that hold about as many characters each, in which a slot lies.

    A source fills its slots until its characters run out, so what lies before any slot follows from the sizes;
    it is tabled for CELLS slots that are equally far apart, and lies on straight lines between them.
    """
    length = sum(slots.values())
    own = np.array([slots[n] for n in slots], float)
    ends = np.array([sizes[n] for n in slots], float) / block / own * length + 1  # where each source runs out
    step = max(1, int(np.ceil((ends.max() + length) / CELLS)))
    before = [float((np.minimum(at * step, ends) * own).sum()) for at in range(CELLS + 1)]
    cell = F.least(F.floor(slot / step), F.lit(CELLS - 1)).cast("int")
    table = F.array(*[F.lit(x / before[-1]) for x in before])
    low, high = F.get(table, cell), F.get(table, cell + 1)
    share = low + (high - low) * F.least((slot / step - cell), F.lit(1.0))
    return F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int")


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD, spread: int = SPREAD, flatten: float = FLATTEN, parts: int | None = None) -> DataFrame:
    """The rows and columns of ``docs``, laid out in the mixed order: by partition, and by row within each.

    Partitions are ranges of slots of about equal volume; there are ``parts``, or else as many as the session's
    shuffles have, and more where that is over PART_CHARS characters each. Null and empty texts, repeated rows, ties, null
    ids, clashing names and empty tables are treated as in ``mix``.
    """
    sizes = source_sizes(docs)
    if not sizes:
        return docs
    slots = _slots(sizes, weights, period, flatten)
    parts = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // PART_CHARS))
    placed = _placed(docs, docs.columns, sizes, slots, block, spread)
    # the partition is known from the slot, so no sample of the rows is read before they are dealt
    dealt = placed.repartitionById(parts, _range_of(F.col("mix_slot"), sizes, slots, block, parts))
    return dealt.sortWithinPartitions("mix_slot", "mix_start", "id").select("row.*")
