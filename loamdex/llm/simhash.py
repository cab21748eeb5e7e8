"""SimHash near-duplicates found through pivot distance tables: by bands first, then by pivots.

Every distinct fingerprint gets its Hamming distances to reference fingerprints (pivots), band by band. Two
fingerprints that differ in at most three bits leave at least three of six bands untouched, and so agree there on
every pivot distance: such triples of bands are the keys that bring candidates together. Among them a pair is
discarded where any of its whole pivot distances differs by more than three, and only survivors are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm import text as T
from loamdex.operators import components as C
from loamdex.session import cut

BITS, WORDS, DIFFER, SEED = 64, 3, 3, 42
#: Shingles that are hashed and counted at a time.
CHUNK = 1 << 17
#: Bits of the six bands, from the lowest.
BANDS = (11, 11, 11, 11, 10, 10)
#: Pivots whose distances are tabled; 16 tell apart all but few of a band's values.
PIVOTS = tuple(int(x) for x in np.random.default_rng(64).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.arange(16, dtype=np.uint64) % np.uint64(2))
#: Fingerprints in one bucket that are compared at once; beyond it the bucket is split by finer keys.
BUCKET = 2048


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text over its shingles of three words, with ASCII letters lower-cased."""
    words = [x.lower().split() for x in texts]
    out = np.zeros((len(texts), BITS), np.int64)
    total = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owner: list[int] = []
    sizes: list[int] = []

    def count() -> None:
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.cumsum([0, *sizes[:-1]])
        np.add.at(out, owner, np.add.reduceat(bits, begin, axis=0, dtype=np.int64))
        np.add.at(total, owner, sizes)
        hashes.clear(), owner.clear(), sizes.clear()

    digest = xxhash.xxh64_intdigest
    for i, w in enumerate(words):
        if not w:
            continue
        line = b" ".join(w)
        if len(w) <= WORDS:
            hashes.append(digest(line, SEED)), owner.append(i), sizes.append(1)
            continue
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        start = [0, *(gaps[: -WORDS + 1] + 1).tolist()]
        end = [*gaps[WORDS - 1 :].tolist(), len(line)]
        for at in range(0, len(start), CHUNK):
            hashes += [digest(line[a:b], SEED) for a, b in zip(start[at : at + CHUNK], end[at : at + CHUNK])]
            owner.append(i), sizes.append(len(start[at : at + CHUNK]))
            if len(hashes) >= CHUNK:
                count()
    count()
    set_bits = (2 * out > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): fp holds the unsigned fingerprint in a signed long; a null text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            whole = np.array([xxhash.xxh64_intdigest(x, SEED) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(texts).view(np.int64)), pa.array(whole)], ["doc_id", "fp", "text_hash"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, text_hash long")


def _masks(bands: tuple[int, ...]) -> list[int]:
    out, at = [], 0
    for n in bands:
        out.append(((1 << n) - 1) << at)
        at += n
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _distances(fp: Column, mask: int) -> list[Column]:
    """Hamming distances to every pivot within the bits of ``mask``."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)).cast("long")).bitwiseAND(F.lit(_signed(mask)).cast("long"))) for p in PIVOTS]


def _band_key(fp: Column, mask: int) -> Column:
    """The tuple of a band's pivot distances as one number, four bits each: a band has at most 11 bits."""
    key = F.lit(0).cast("long")
    for d in _distances(fp, mask):
        key = F.shiftleft(key, 4).bitwiseOR(d.cast("long"))
    return key


def buckets(prints: DataFrame) -> DataFrame:
    """(key, fp): one row for each triple of bands of each distinct fingerprint."""
    keyed = prints.select("fp", *[_band_key(F.col("fp"), m).alias(f"b{i}") for i, m in enumerate(_masks(BANDS))])
    triples = [F.xxhash64(F.lit(n), *[F.col(f"b{i}") for i in c]) for n, c in enumerate(combinations(range(len(BANDS)), 3))]
    return keyed.select("fp", F.explode(F.array(*triples)).alias("key"))


def finer_buckets(rows: DataFrame) -> DataFrame:
    """(key, fp) with the key of a large bucket joined to each triple of twelve bands: what it shares grows to 48 bits and more.

    Two fingerprints of a bucket that differ in at most three bits leave at least nine of the twelve half
    bands untouched. All that agree in nine half bands agree in one of the sets of nine, and a bucket of
    such a set holds no more fingerprints than the remaining bits can tell apart.
    """
    halves = [x for n in BANDS for x in (n - n // 2, n // 2)]
    keyed = rows.select("fp", "key", *[_band_key(F.col("fp"), m).alias(f"h{i}") for i, m in enumerate(_masks(tuple(halves)))])
    nines = [F.xxhash64(F.col("key"), F.lit(n), *[F.col(f"h{i}") for i in range(12) if i not in c]) for n, c in enumerate(combinations(range(12), 3))]
    return keyed.select("fp", F.explode(F.array(*nines)).alias("key"))


def _near(one: np.uint64, others: np.ndarray, table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of ``others`` differ from ``one`` in at most DIFFER bits: the pivot table discards, survivors are compared."""
    left = np.flatnonzero(np.abs(table[:, 0] - own[0]) <= DIFFER)
    for j in range(1, table.shape[1]):
        if len(left) < 8:
            break
        left = left[np.abs(table[left, j] - own[j]) <= DIFFER]
    left = left[np.abs(table[left] - own).max(axis=1, initial=0) <= DIFFER]
    return left[np.bitwise_count(others[left] ^ one) <= DIFFER]


def linked(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links among one bucket's distinct fingerprints, with one tree for each component."""
    table = np.stack([np.bitwise_count(prints ^ np.uint64(p)) for p in PIVOTS], axis=1).astype(np.int8)
    rest = np.ones(len(prints), bool)
    a, b = [], []
    for root in range(len(prints)):
        if not rest[root]:
            continue
        rest[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            left = np.flatnonzero(rest)
            if not len(left):
                break
            found = left[_near(prints[x], prints[left], table[left], table[x])]
            rest[found] = False
            a += [x] * len(found)
            b += found.tolist()
            queue += found.tolist()
    return prints[a], prints[b]


def _links_in_buckets(rows: DataFrame, split: bool) -> DataFrame:
    """(u, v, key): links in each bucket; with ``split``, rows with a null v hold the buckets that are too large."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.uint64)

        def out(u, v, key) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.uint64).view(np.int64)), v, pa.array(key, pa.int64())], ["u", "v", "key"])

        def of(key: int, prints: np.ndarray) -> pa.RecordBatch | None:
            if len(prints) < 2:
                return None
            if split and len(prints) > BUCKET:
                return out(prints, pa.nulls(len(prints), pa.int64()), np.full(len(prints), key))
            u, v = linked(prints)
            return out(u, pa.array(v.view(np.int64)), np.full(len(u), key)) if len(u) else None

        large = False
        for batch in batches:
            keys, prints = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            # single fingerprints need no step, but the first and the last run may go on in another batch
            for i in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}) if len(keys) else []:
                key, here = keys[cuts[i]], prints[cuts[i] : cuts[i + 1]]
                if key == held_key:
                    if large:
                        yield out(here, pa.nulls(len(here), pa.int64()), np.full(len(here), key))
                        continue
                    here = np.concatenate([held, here])
                elif held_key is not None and not large and (made := of(held_key, held)) is not None:
                    yield made
                held_key, held, large = key, here, False
                if split and len(here) > BUCKET:
                    yield of(key, here)
                    held, large = held[:0], True
        if held_key is not None and not large and (made := of(held_key, held)) is not None:
            yield made

    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "u long, v long, key long")


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints which differ in at most three bits."""
    first = cut(_links_in_buckets(buckets(prints), True), "simhash-links")
    large = first.filter("v is null").select("key", F.col("u").alias("fp"))
    found = first.filter("v is not null").select("u", "v")
    if large.isEmpty():
        return found
    return found.unionByName(_links_in_buckets(finer_buckets(large), False).select("u", "v"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash, component_id) for each row of ``docs``, whatever other columns it has.

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts have no
    words and fingerprint zero, which links like any other. Repeated rows are linked and give one row each. A
    null doc_id is never a component's name unless the component has no other.
    """
    rows = cut(fingerprints(docs), "simhash-prints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = C.components(links(rows.select("fp").distinct()))
    named = least.join(parts.select(F.col("node").alias("fp"), F.col("component")), "fp", "left")
    named = cut(named.select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-components")
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(heads, "component").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "fp", "text_hash", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all columns of ``docs``; repeated rows stay once.

    Rows that repeat the kept doc_id with another text stay too. Rows without a doc_id stay, once for each
    text, where their group holds no row with one.
    """
    found = groups(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["text_hash"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
