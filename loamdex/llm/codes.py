"""Vector code compression: product codes from exact integer k-means whose scans are skipped by norm-of-sum bounds.

Every part of a vector keeps, for each group of codebook entries, a lower bound of its distance to all of them but its
own, and the round in which that bound was exact. All codebooks so far are retained, so a bound is loosened by how far
the group's entries have come from that round's places to today's: the norm of the sum of their steps, which is never
more and mostly less than the sum of the steps' norms. Only groups whose loosened bound doesn't exceed the exact
distance to the own entry are scanned anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import cut, widen

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of entries that share a bound.
GROUPS = 16
#: Vectors that are assigned at a time inside a task.
STEP = 4096
_FAR = np.iinfo(np.int64).max


def greatest(width: int) -> int:
    """The greatest component that is told apart: squared distances of parts of ``width`` then fit into 62 bits."""
    return int((2**62 / max(width, 1)) ** 0.5) // 2


def integers(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """(vectors, PARTS, width) of floor(SCALE * x), with zeros after a shorter vector's end."""
    out = np.zeros((len(vectors), PARTS * width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    most = greatest(width)
    return np.clip(np.floor(out * SCALE), -most, most).astype(np.int64).reshape(len(vectors), PARTS, width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:  # then products of doubles are exact
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


@dataclass
class State:
    """Of each vector's parts: the own entry, and each group's bound and the round it is from."""

    own: np.ndarray
    low: np.ndarray
    stamp: np.ndarray

    @staticmethod
    def size() -> int:
        return PARTS * (1 + 5 * GROUPS)

    def pack(self) -> np.ndarray:
        n = len(self.own)
        return np.concatenate([self.own, self.low.astype("<f4").reshape(n, -1).view(np.uint8), self.stamp.reshape(n, -1)], axis=1)

    @classmethod
    def unpack(cls, raw: np.ndarray) -> State:
        n, low = len(raw), PARTS + 4 * PARTS * GROUPS
        bounds = np.ascontiguousarray(raw[:, PARTS:low]).view("<f4").reshape(n, PARTS, GROUPS)
        return cls(raw[:, :PARTS].copy(), bounds.copy(), raw[:, low:].reshape(n, PARTS, GROUPS).copy())


class Codebooks:
    """The codebooks of every round so far, each (PARTS, entries, width)."""

    def __init__(self, first: np.ndarray):
        self.history = [first]
        seeds = first[:, :GROUPS]
        self.group = np.stack([distances(e, s).argmin(axis=1) if len(s) else np.zeros(0, np.int64) for e, s in zip(first, seeds)])
        self._measure()

    def add(self, book: np.ndarray) -> None:
        self.history.append(book)
        self._measure()

    def _measure(self) -> None:
        """The greatest net displacement of each group's entries from each earlier round to now, rounded up."""
        self.now = self.history[-1]
        self.moved = np.zeros((len(self.history), PARTS, GROUPS))
        for then, book in enumerate(self.history):
            way = np.sqrt(((self.now - book).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-9)
            for p in range(PARTS):
                np.maximum.at(self.moved[then, p], self.group[p], way[p])

    def assign(self, x: np.ndarray, state: State | None) -> tuple[State, np.ndarray, int]:
        """(state, squared distance of each part to its entry, distances computed) of vectors (n, PARTS, width)."""
        n, rounds, k = len(x), len(self.history) - 1, self.now.shape[1]
        at, work = np.arange(n), 0
        out = State(np.zeros((n, PARTS), np.uint8), np.full((n, PARTS, GROUPS), np.inf, np.float32), np.full((n, PARTS, GROUPS), rounds, np.uint8))
        error = np.zeros((n, PARTS), np.int64)
        for p in range(PARTS):
            found = np.full((n, k), _FAR)
            scan, bound = np.ones((n, GROUPS), bool), None
            if state is not None:
                own = state.own[:, p].astype(np.int64)
                found[at, own] = ((x[:, p] - self.now[p][own]) ** 2).sum(axis=1)
                reach = np.sqrt(found[at, own].astype(np.float64)) * (1 + 1e-9)
                bound = state.low[:, p].astype(np.float64) - self.moved[state.stamp[:, p], p, np.arange(GROUPS)]
                scan = bound <= reach[:, None]
            members = [np.flatnonzero(self.group[p] == g) for g in range(GROUPS)]
            for g, entries in enumerate(members):
                rows = np.flatnonzero(scan[:, g])
                if len(rows) and len(entries):
                    found[np.ix_(rows, entries)] = distances(x[rows, p], self.now[p][entries])
                    work += len(rows) * len(entries)
            best = found.argmin(axis=1)  # the first of equal ones
            out.own[:, p], error[:, p] = best, found[at, best]
            found[at, best] = _FAR
            for g, entries in enumerate(members):
                if not len(entries):
                    continue
                least = found[:, entries].min(axis=1)
                exact = np.nextafter(np.where(least == _FAR, np.inf, np.sqrt(least.astype(np.float64))).astype(np.float32), np.float32(-np.inf))
                out.low[:, p, g] = exact
                if state is not None:
                    left = ~scan[:, g]
                    parted = left & (self.group[p][own] == g) & (own != best)  # the entry that was left behind joins its group again
                    out.low[left, p, g], out.stamp[left, p, g] = state.low[left, p, g], state.stamp[left, p, g]
                    out.low[parted, p, g] = np.nextafter(np.minimum(bound[parted, g], exact[parted]).astype(np.float32), np.float32(-np.inf))
                    out.stamp[parted, p, g] = rounds
        return out, error, work

    def digest(self) -> str:
        """SHA-256 of the latest entries' components in order."""
        return hashlib.sha256(",".join(map(str, self.now.reshape(-1).tolist())).encode()).hexdigest()


def _fine(rows: DataFrame, keep: list[str]) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, vector.alias("embedding")).filter(vector.isNotNull() & finite)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])


def _unbinary(column: pa.Array, kind: str, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), width)


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _round(rows: DataFrame, books: Codebooks, keep: list[str], width: int, first: bool) -> DataFrame:
    """The rows with their new state, and each task's sums of the parts of every entry (cell, n, total) in rows of their own."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries for each round
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["vec_id", *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = shared.value, shared.value.now.shape[1]
        total, count = np.zeros((PARTS * k, width), np.int64), np.zeros(PARTS * k, np.int64)
        schema = None
        for part in _steps(batches):
            n = part.num_rows
            x = integers(_vectors(part.column("embedding")), width) if first else _unbinary(part.column("x"), "<i4", PARTS * width).astype(np.int64).reshape(n, PARTS, width)
            state = None if first else State.unpack(_unbinary(part.column("state"), np.uint8, State.size()))
            state = own.assign(x, state)[0]
            cell = state.own.astype(np.int64) + np.arange(PARTS) * k
            np.add.at(total, cell.reshape(-1), x.reshape(-1, width))
            count += np.bincount(cell.reshape(-1), minlength=PARTS * k)
            empty = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            made = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _binary(x.reshape(n, -1).astype("<i4")), _binary(state.pack()), *empty], [*names, "x", "state", "cell", "n", "total"])
            schema = made.schema
            yield made
        held = np.flatnonzero(count)
        if schema is not None and len(held):
            sums = pa.array(total[held].tolist(), pa.list_(pa.int64()))
            blank = [pa.nulls(len(held), schema.field(c).type) for c in [*names, "x", "state"]]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(held, pa.int32()), pa.array(count[held], pa.int64()), sums], schema=schema)

    kinds = ", ".join(f"`{c}` {fields[c]}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, x binary, state binary, cell int, n long, total array<long>")


def _updated(sums: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook of means, rounded down, of the tasks' sums; an entry without parts stays."""
    counts = sums.groupBy("cell").agg(F.sum("n").alias("n"))
    totals = sums.select("cell", F.posexplode("total").alias("i", "v")).groupBy("cell", "i").agg(F.sum("v").alias("v"))
    found = totals.join(counts, "cell").toArrow()  # as many rows as a codebook has components
    flat = book.reshape(-1, book.shape[2]).copy()
    cell, i, v, n = (found.column(c).to_numpy() for c in ("cell", "i", "v", "n"))
    flat[cell, i] = v // n
    return flat.reshape(book.shape)


def encode(rows: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, keep..., code, error), codebooks): each vector's product code and its squared distance from what the code stands for.

    ``rows`` hold vec_id, embedding and whatever else. Components are floor(1024 * x); a vector is cut into 4 equal
    parts, and each part position has a codebook of 256 entries, which starts as the parts of the smallest vec_ids
    (of equal ones, the smaller vector first) and takes 4 rounds of assigning and averaging. A code names its parts'
    entries in order, two hex digits each. Ties go to the lower entry.

    Rows with a null vector or null or non-finite components drop out. Repeated rows and ids count each for itself, and
    null ids come last. Vectors whose size is not that of four equal parts of the longest one are filled up with zeros.
    Fewer than 256 rows make fewer entries; an empty table gives no row and no codebooks. Components beyond
    ``greatest`` (268 million for parts of 16) count as that.

    Each round reads the last one's written table and writes the next; only sums of parts by task and entry are
    shuffled, and the driver holds codebooks alone.
    """
    keep = keep or []
    fine = _fine(rows, keep)
    size = fine.agg(F.max(F.size("embedding")).alias("size")).first()["size"]
    if size is None:
        empty = fine.select("vec_id", *keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.limit(0), None
    width = max(1, -(-size // PARTS))
    seeds = fine.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()  # ENTRIES vectors
    books = Codebooks(integers([np.array(r.embedding, float) for r in seeds], width).transpose(1, 0, 2).copy())
    state = widen(fine)
    for n in range(ROUNDS):
        state = cut(_round(state, books, keep, width, first=n == 0), f"codes-{n}")
        books.add(_updated(state.filter("cell is not null").select("cell", "n", "total"), books.now))
        state = state.filter("cell is null").drop("cell", "n", "total")
    return _coded(state, books, keep, width), books


def _coded(state: DataFrame, books: Codebooks, keep: list[str], width: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(books)  # as above
    fields = {f.name: f.dataType.simpleString() for f in state.schema}
    names = ["vec_id", *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            n = part.num_rows
            x = _unbinary(part.column("x"), "<i4", PARTS * width).astype(np.int64).reshape(n, PARTS, width)
            made, error, _ = shared.value.assign(x, State.unpack(_unbinary(part.column("state"), np.uint8, State.size())))
            code = pa.array([row.tobytes().hex() for row in made.own], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), code, pa.array(error.sum(axis=1), pa.int64())], [*names, "code", "error"])

    kinds = ", ".join(f"`{c}` {fields[c]}" for c in names)
    return state.mapInArrow(run, f"{kinds}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, embedding) that codes stand for: the middle of what each entry's components were rounded down from."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(bytes.fromhex(c), np.uint8) for c in batch.column("code").to_pylist()]
            made = [((shared.value.now[np.arange(PARTS), c] + 0.5) / SCALE).reshape(-1).tolist() for c in own]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")
