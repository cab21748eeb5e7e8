"""Sparse logistic regression by follow-the-regularised-leader updates, and its scores as sparse dot products."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm import text as T

#: (texts) -> (index of the text, bucket), distinct pairs in order of the text
Features = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
#: (texts) -> (index of the text, a copy of it in which one group's name is swapped)
Swapped = Callable[[list[bytes]], Iterator[tuple[int, bytes]]]


@dataclass(frozen=True)
class Settings:
    """Parameters of a fit. ``sample`` bounds the labelled rows that it reads: chosen by hashes of doc_id."""

    bits: int = 22
    sample: int = 8192
    epochs: int = 3
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0
    bias_l1: float = 0.0
    pair_weight: float = 1.0
    #: How often a row of label 1 counts.
    ones: float = 1.0
    #: Each example is also learnt from this many of its buckets at most, drawn at random: short texts count too.
    part: int = 24


@dataclass(frozen=True)
class Model:
    """Weights that aren't zero, by bucket in ascending order."""

    bits: int
    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Logistic of the sparse dot product of each of ``n`` texts."""
        logit = np.full(n, self.bias)
        if len(self.buckets) and len(bucket):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            logit += np.bincount(doc[hit], self.weights[at[hit]], minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


@dataclass(frozen=True)
class Examples:
    """Sampled rows: buckets and label of each, and for each of its swapped copies (row, buckets it loses, buckets it gains)."""

    rows: list[np.ndarray]
    labels: np.ndarray
    swaps: list[tuple[int, np.ndarray, np.ndarray]]


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(examples: Examples, of: Settings) -> Model:
    """FTRL-proximal over the examples in a fixed shuffled order.

    After an example's own step each of its swapped copies costs ``pair_weight`` times the squared difference
    of the two scores; an example without swapped copies costs nothing more.
    """
    if not examples.rows:
        return Model(of.bits, 0.0, np.zeros(0, np.int64), np.zeros(0))
    # Buckets are numbered by a map of all 2**bits, so that besides the examples one flat array of 32-bit numbers is all that is made.
    seen = np.zeros(1 << of.bits, bool)
    for x in (*examples.rows, *(gained for _, _, gained in examples.swaps)):
        seen[x] = True
    names = np.flatnonzero(seen).astype(np.int32)
    number = np.cumsum(seen, dtype=np.int32) - np.int32(1)
    ends = np.cumsum([len(x) + 1 for x in examples.rows])
    flat = np.full(ends[-1], len(names), np.int32)  # each row ends with the bias
    rows = [flat[end - len(x) - 1 : end] for x, end in zip(examples.rows, ends)]
    for row, x in zip(rows, examples.rows):
        row[:-1] = number[x]
    swaps: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, lost, gained in examples.swaps:
        swaps.setdefault(i, []).append((number[lost], number[gained]))
    z, n, w = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    l1 = np.full(len(names) + 1, of.l1)
    l1[-1] = of.bias_l1  # the last weight is the bias

    def step(at: np.ndarray, g: float | np.ndarray) -> None:
        root = np.sqrt(n[at])
        n[at] += g * g
        after = np.sqrt(n[at])
        z[at] += g - (after - root) / of.alpha * w[at]
        short = np.abs(z[at]) <= l1[at]
        w[at] = np.where(short, 0.0, -(z[at] - np.sign(z[at]) * l1[at]) / ((of.beta + after) / of.alpha + of.l2))

    def even_out(row: np.ndarray, lost: np.ndarray, gained: np.ndarray) -> None:
        logit = w[row].sum()
        p, q = _logistic(logit), _logistic(logit - w[lost].sum() + w[gained].sum())
        if p == q:
            return
        own, other = p * (1 - p), q * (1 - q)  # slopes of the two scores
        g = np.full(len(row), own - other)
        g[np.isin(row, lost)] = own
        step(np.concatenate([row, gained]), 2 * of.pair_weight * (p - q) * np.concatenate([g, np.full(len(gained), -other)]))

    order = np.random.default_rng(7)
    for _ in range(of.epochs):
        for i in order.permutation(len(rows)):
            few = order.choice(rows[i], order.integers(of.part + 1)) if of.part else rows[i]
            for at in (rows[i], np.union1d(few, rows[i][-1:])) if of.part else (rows[i],):
                p = _logistic(w[at].sum())
                step(at, (p - 1.0) * of.ones if examples.labels[i] else p)
            for lost, gained in swaps.get(i, ()) if of.pair_weight else ():
                even_out(rows[i], lost, gained)
    keep = np.flatnonzero(w[:-1])
    return Model(of.bits, float(w[-1]), names[keep].astype(np.int64), w[keep])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text falls into the part that isn't learnt from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled rows that aren't held out, by hash of doc_id; null ids or labels are no labels."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
    n = known.count()
    if n > rows:  # a share by hash that holds somewhat more than ``rows``, so that no task ranks more than that
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_200_000 * rows / n) + 100)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")


def examples_of(sample: DataFrame, features: Features, swapped: Swapped | None = None) -> Examples:
    """Buckets, label and swapped copies of each sampled row, made in tasks, in a fixed order; the buckets share one Arrow buffer.

    A doc_id with several texts or labels gives one example, the first by the buckets' checksum, then label, so
    that repeated rows don't outgrow the sample's bound.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            doc, bucket = features(texts)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows = [bucket[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            packed = [x.astype("<i4").tobytes() for x in rows]
            lost: list[list[bytes]] = [[] for _ in texts]
            gained: list[list[bytes]] = [[] for _ in texts]
            for i, copy in swapped(texts) if swapped else ():
                other = features([copy])[1]
                lost[i].append(np.setdiff1d(rows[i], other).astype("<i4").tobytes())
                gained[i].append(np.setdiff1d(other, rows[i]).astype("<i4").tobytes())
            tie = pa.array([zlib.crc32(x) for x in packed], pa.int64())
            columns = [part.column("doc_id"), part.column("y"), tie, pa.array(packed, pa.binary()), pa.array(lost, pa.list_(pa.binary())), pa.array(gained, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "tie", "x", "lost", "gained"])

    kind = dict(sample.dtypes)["doc_id"]
    made = sample.mapInArrow(run, f"doc_id {kind}, y int, tie long, x binary, lost array<binary>, gained array<binary>")
    made = made.groupBy("doc_id").agg(F.min_by(F.struct("y", "tie", "x", "lost", "gained"), F.struct("tie", "y")).alias("r")).select("doc_id", "r.*")
    rows = made.toArrow()  # no more than the bounded sample
    order = pc.sort_indices(rows.select(["doc_id"]), [("doc_id", "ascending")]).to_numpy()
    unpacked = lambda v: np.frombuffer(v.as_buffer(), "<i4") if v.is_valid else np.zeros(0, "<i4")
    x = [unpacked(v) for chunk in rows.column("x").chunks for v in chunk]
    place = np.argsort(order)
    swaps = []
    pairs = zip((v for c in rows.column("lost").chunks for v in c), (v for c in rows.column("gained").chunks for v in c))
    for i, (lost, gained) in enumerate(pairs):
        swaps += [(int(place[i]), unpacked(a), unpacked(b)) for a, b in zip(lost.values, gained.values)]
    return Examples([x[i] for i in order], rows.column("y").to_numpy()[order].astype(np.int64), sorted(swaps, key=lambda s: s[0]))


def score(docs: DataFrame, model: Model, features: Features, keep: str) -> DataFrame:
    """(``keep``, score) of each row's whole text, whatever other columns it has; a null text is an empty one, which has the bias alone.

    Rows that repeat or have a null ``keep`` give one row each, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # no more weights than buckets of the bounded sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, texts in T.steps(batches):
            doc, bucket = features(texts)
            yield pa.RecordBatch.from_arrays([part.column(keep), pa.array(own.scores(doc, bucket, len(texts)))], [keep, "score"])

    kind = dict(docs.dtypes)[keep]
    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, score double")
