"""Repeated byte strings by longest-previous-factor arrays, over a corpus that is dealt out by content.

Only factors of at least LENGTH bytes count, so suffixes are told apart by their first LENGTH bytes, a window.
Windows meet by anchor: of a window's inner strings of ANCHOR bytes the one of least hash, which is the same
wherever the window occurs. Neighbouring windows with one anchor make a stretch, the unit that is shuffled.
Equal stretches are counted without looking inside; they are equal by two hashes of 64 bits. Where one anchor has
different stretches, their suffixes are put in order by their bytes: ranks of strings of doubling length make a suffix
array. In it, the previous and next smaller positions of each suffix share the most with it of all earlier ones, which
is its longest previous factor; the previous and next larger positions give its longest next factor. A window with
either of LENGTH bytes is a repeat; keeping the first copy takes the previous factor alone.

A row is known by its doc_id and 120 bits of its text's SHA-256, as two numbers, so that rows which share an id, or have none, are told
apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import text as T
from loamdex.llm.joins import spread_join
from loamdex.session import cut

LENGTH = 200
#: Bytes of the strings whose least hash in a window of LENGTH bytes names the window's group.
ANCHOR = 64
#: Different stretches of one anchor, about 1 MB of text, that one task puts in order; of larger groups single
#: windows are dealt out.
GROUP = 4096
#: Bytes of the digests by which windows of large groups are told apart.
OWN = 16
#: Bytes of stretches that a task puts in order at a time.
ORDER_BYTES = 1 << 21


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours the place of its least value, the leftmost of equal ones."""
    n = len(h)
    rows = -(-n // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1))
    grid[:n] = h
    grid = grid.reshape(rows, width)
    place = np.arange(rows * width).reshape(rows, width)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    right_at = np.minimum.accumulate(np.where(grid == right, place, rows * width)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    left = np.minimum.accumulate(grid, axis=1)
    fresh = np.ones(grid.shape, bool)
    fresh[:, 1:] = grid[:, 1:] < left[:, :-1]
    left_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).reshape(-1)
    a, b = right.reshape(-1)[: n - width + 1], left.reshape(-1)[width - 1 : n]
    return np.where(a <= b, right_at[: n - width + 1], left_at[width - 1 : n])


def stretches(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows of ``length`` bytes that share their anchor, the string of least hash.

    A run covers text[start : start + windows + length - 1]. Equal windows have equal anchors, so any repeat
    of a window lies in a run of the same anchor hash.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return {"doc": none, "start": none, "windows": none, "anchor": none, "content": none}
    sums = T.prefix_sums(buf)
    place = np.arange(len(buf) - anchor + 1)
    h = T.span_hashes(buf, place, place + anchor, sums, salt=11)
    least = least_places(h, length - anchor + 1)
    window = np.arange(len(least))
    doc = np.searchsorted(ends, window, "right")
    window, doc, least = (x[ends[doc] - window >= length] for x in (window, doc, least))
    if not len(window):
        return {"doc": none, "start": none, "windows": none, "anchor": none, "content": none}
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([first, [len(window)]]))
    start, doc = window[first], doc[first]
    content = T.span_hashes(buf, start, start + count + length - 1, sums, salt=13)
    return {"doc": doc, "start": start - (ends - sizes)[doc], "windows": count, "anchor": h[least[first]].view(np.int64), "content": content.view(np.int64)}


_STRETCHES = "doc_id long, own long, two long, start long, windows int, anchor long, content long"


def _find(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """All stretches of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            digests = [hashlib.sha256(x).hexdigest() for x in texts]
            own, two = (np.array([int(d[a : a + 15], 16) for d in digests], np.int64) for a in (0, 15))
            found = stretches(texts, length, anchor)
            columns = [
                part.column("doc_id").take(pa.array(found["doc"])), pa.array(own[found["doc"]]), pa.array(two[found["doc"]]), pa.array(found["start"]),
                pa.array(found["windows"].astype(np.int32)), pa.array(found["anchor"]), pa.array(found["content"]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "two", "start", "windows", "anchor", "content"])

    return docs.mapInArrow(run, _STRETCHES)


_PIECES = "anchor long, content long, n long, doc_id long, own long, two long, start long, windows int, at int, window binary, bytes binary"


def _pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted stretch, or where its group is large a row for each of its windows instead."""
    lists = wanted.groupBy("doc_id", "own", "two").agg(F.collect_list(F.struct("anchor", "content", "n", "start", "windows", "large")).alias("list"))
    joined = _with_text(docs, lists, "inner")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            rows = []
            for doc_id, own, two, text, listed in zip(*(part.column(c).to_pylist() for c in ("doc_id", "own", "two")), texts, part.column("list").to_pylist()):
                for x in listed:
                    piece = text[x["start"] : x["start"] + x["windows"] + length - 1]
                    head = (x["anchor"], x["content"], x["n"], doc_id, own, two, x["start"], x["windows"])
                    if x["large"]:
                        rows += [(*head, i, hashlib.blake2b(piece[i : i + length], digest_size=OWN).digest(), None) for i in range(x["windows"])]
                    else:
                        rows.append((*head, None, None, piece))
            columns = zip(*rows) if rows else [[]] * 11
            kinds = [*[pa.int64()] * 7, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return joined.mapInArrow(run, _PIECES)


def _with_text(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents with what belongs to their doc_id and text."""
    right = lists.withColumnsRenamed({"doc_id": "own_id", "own": "own_own", "two": "own_two"})
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    number = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")
    keyed = docs.withColumns({"own": number(1), "two": number(16)})
    same = keyed["doc_id"].eqNullSafe(right["own_id"]) & (keyed["own"] == right["own_own"]) & (keyed["two"] == right["own_two"])
    return keyed.join(right, same, how).select("doc_id", "own", "two", "text", "list")


class Suffixes:
    """The suffixes of ``buf`` at some places, in order of their first ``length`` bytes, then of place.

    Strings of 8 bytes are ranked, then strings twice as long by pairs of ranks, up to ``length``. Places must have
    ``length`` bytes before the buffer, or the text they are in, ends.
    """

    def __init__(self, buf: np.ndarray, places: np.ndarray, length: int):
        base = min(8, 1 << (length.bit_length() - 1))
        self.length, self.places, n = length, places, len(buf)
        self.buf = np.concatenate([buf, np.zeros(length + 8, np.uint8)])
        packed = np.zeros(n, np.uint64)
        for i in range(base):
            packed = (packed << np.uint64(8)) | self.buf[i : i + n]
        ranks = {base: self._ranked(packed)}
        while 2 * base <= length:
            ranks[2 * base] = self._ranked(self._pair(ranks[base], np.arange(n), np.minimum(np.arange(n) + base, n - 1)))
            base *= 2
        self.ranks = ranks
        whole = self._ranked(self._pair(ranks[base], places, places + length - base)) if base < length else ranks[base][places]
        self.order = np.argsort(whole, kind="stable")  # places ascend

    @staticmethod
    def _ranked(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.uint32)

    @staticmethod
    def _pair(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (rank[a].astype(np.uint64) << np.uint64(32)) | rank[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at two places share, ``length`` at most."""
        out = np.zeros(len(a), np.int64)
        for k in sorted(self.ranks, reverse=True):
            fits = out + k <= self.length
            rank, at = self.ranks[k], np.where(fits, out, 0)
            out += k * (fits & (rank[np.minimum(a + at, len(rank) - 1)] == rank[np.minimum(b + at, len(rank) - 1)]))
        going = out < self.length
        for _ in range(min(self.ranks) - 1):
            going &= self.buf[a + np.minimum(out, self.length)] == self.buf[b + np.minimum(out, self.length)]
            out += going
            going &= out < self.length
        return out

    def factors(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of the longest previous factor, of the longest next factor) of each place's suffix, ``length`` at most.

        ``position`` says which suffix is earlier. Of all earlier suffixes, those at the nearest smaller positions before and
        behind it in suffix order share the most with a suffix; of all later ones, those at the nearest larger positions.
        """
        own = position[self.order]
        previous, following = (np.maximum(self._shared(nearest_smaller(x)), self._shared(self._mirrored(x))) for x in (own, -own))
        out = np.empty((2, len(own)), np.int64)
        out[:, self.order] = previous, following
        return out[0], out[1]

    @staticmethod
    def _mirrored(values: np.ndarray) -> np.ndarray:
        behind = nearest_smaller(values[::-1])[::-1]
        return np.where(behind < 0, -1, len(values) - 1 - behind)

    def _shared(self, other: np.ndarray) -> np.ndarray:
        there = np.flatnonzero(other >= 0)
        out = np.zeros(len(other), np.int64)
        places = self.places[self.order]
        out[there] = self.common(places[there], places[other[there]])
        return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Of each value the index of the nearest smaller one before it, or -1. Each step jumps over what others have already jumped over."""
    out = np.arange(len(values)) - 1
    going = np.flatnonzero(out >= 0)
    while len(going):
        going = going[values[out[going]] >= values[going]]
        out[going] = out[out[going]]
        going = going[out[going] >= 0]
    return out


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags that don't cross owners: (owner, first, last + 1)."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on, on
    first = np.concatenate([[True], (np.diff(on) > 1) | (owner[on][1:] != owner[on][:-1])])
    begin = on[first]
    end = on[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(on) - 1]])] + 1
    return owner[begin], begin, end


def _ordered_groups(pieces: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """(anchor, content, runs) of repeated windows within each stretch of a small group."""

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = pa.Table.from_batches(rows).combine_chunks()
        col = lambda c: all_rows.column(c).combine_chunks().fill_null(-(2**63)).to_numpy() if c == "doc_id" else all_rows.column(c).to_numpy()
        texts = all_rows.column("bytes").to_pylist()
        n = col("windows").astype(np.int64)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        place = begin[owner] + at
        buf = np.frombuffer(b"".join(texts), np.uint8)
        anchor, content = col("anchor"), col("content")
        position = np.empty(len(owner), np.int64)
        position[np.lexsort((col("start")[owner] + at, col("two")[owner], col("own")[owner], col("doc_id")[owner]))] = np.arange(len(owner))
        previous, following = Suffixes(buf, place, length).factors(position)
        flags = previous >= length if first_stays else (previous >= length) | (following >= length)
        who, a, b = _runs(flags, owner)
        base = (np.cumsum(n) - n)[who]
        yield pa.RecordBatch.from_arrays([pa.array(anchor[who]), pa.array(content[who]), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], ["anchor", "content", "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # close at the last row that begins another group, so that a group is never cut
            keys = batch.column("anchor").to_numpy()
            if not len(keys):
                continue
            if size >= ORDER_BYTES:
                begins = np.flatnonzero(np.concatenate([[keys[0] != held[-1].column("anchor")[-1].as_py()], keys[1:] != keys[:-1]]))
                if len(begins):
                    if begins[0]:
                        held.append(batch.slice(0, begins[0]))
                    yield from flush(held)
                    held, size, batch = [], 0, batch.slice(begins[0])
            held.append(batch)
            size += batch.column("bytes").nbytes
        if held:
            yield from flush(held)

    dealt = pieces.filter("bytes is not null").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, content long, a int, b int").groupBy("anchor", "content").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def _dealt_windows(pieces: DataFrame, first_stays: bool) -> DataFrame:
    """The same for large groups: windows are counted by 128 bits of their BLAKE2b, summed before they are shuffled."""
    rows = pieces.filter("bytes is null").withColumn("position", F.struct("doc_id", "own", "two", (F.col("start") + F.col("at")).alias("place")))
    known = rows.groupBy("anchor", "window").agg(F.sum("n").alias("total"), F.min("position").alias("first"))
    # a stretch that occurs twice is known to repeat, so only single ones need their windows marked
    asked = rows if first_stays else rows.filter("n = 1")
    joined = spread_join(asked, known.filter("total > 1"), ["anchor", "window"], ["content"])
    if first_stays:
        joined = joined.filter("position != first")
    return joined.groupBy("anchor", "content").agg(F.transform(F.collect_set("at"), lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))).alias("runs"))


def repeats(docs: DataFrame, length: int = LENGTH, first_stays: bool = False, anchor: int | None = None) -> DataFrame:
    """(doc_id, own, two, list): the byte ranges of each text that lie in repeated strings of ``length`` bytes, unmerged."""
    anchor = anchor or max(1, length * ANCHOR // LENGTH)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(_find(docs, length, anchor), "stretches")
    shared = found.groupBy("anchor").count().filter("count > 1").select("anchor")
    # an anchor inside a frequent line has many stretches, so its rows are dealt out in every join on it
    found = cut(spread_join(found, shared, ["anchor"], ["content", "doc_id", "start"], "left_semi"), "shared-stretches")
    place = F.struct("doc_id", "own", "two", "start")
    kinds = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.first("windows").alias("windows"))
    kinds = cut(kinds, "kinds-of-stretches")
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1" if first_stays else "kinds > 1 and least = 1")
    wanted = spread_join(kinds, mixed, ["anchor"], ["content"]).select("anchor", "content", "n", "first.*", "windows", (F.col("kinds") > GROUP).alias("large"))
    pieces = cut(_pieces(docs, wanted, length), "pieces")
    inside = _ordered_groups(pieces, length, first_stays).unionByName(_dealt_windows(pieces, first_stays))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    known = kinds.join(inside, ["anchor", "content"], "left").select("anchor", "content", "n", "first", "runs")
    if first_stays:  # a later copy of a whole stretch goes; the first one keeps what no earlier stretch holds
        known = known.filter("n > 1 or runs is not null")
        runs = F.when(F.struct("doc_id", "own", "two", "start").eqNullSafe(F.col("first")), F.col("runs")).otherwise(whole)
    else:
        known = known.filter("n > 1 or runs is not null")
        runs = F.when(F.col("n") > 1, whole).otherwise(F.col("runs"))
    hits = spread_join(found, known, ["anchor", "content"], ["doc_id", "start"]).select("doc_id", "own", "two", "start", F.explode(runs).alias("r"))
    span = F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (length - 1)).alias("b"))
    return hits.select("doc_id", "own", "two", span.alias("s")).groupBy("doc_id", "own", "two").agg(F.collect_list("s").alias("list"))


def dedup(docs: DataFrame, length: int = LENGTH, first_stays: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) for each row of ``docs``, whatever other columns it has.

    Removes each byte covered by a string of ``length`` bytes of UTF-8 that also starts elsewhere in any text,
    its own included; with ``first_stays`` only where it starts earlier too, by doc_id, the text's SHA-256 and
    place, so that first copies stay. Repeats are judged on the input, overlaps count, and none crosses texts.
    A null text is empty. Repeated rows are copies of one another: without ``first_stays`` each gives the same
    row, and with it they count as one. A null doc_id is a value like any other, and different texts may share an id.
    A text of more than 1 MB is a step of its own in its task. An empty table gives no row. ``kept`` are the remaining bytes.
    """
    lists = repeats(docs, length, first_stays)
    joined = _with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lists, "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            removed, digests, kept, spans = [], [], [], []
            for text, listed in zip(texts, part.column("list").to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in listed or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *(x for m in merged for x in m), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                removed.append(len(text) - len(rest)), digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest), spans.append([{"start": a, "end": b} for a, b in merged])
            columns = [
                part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()),
                pa.array(digests), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")
