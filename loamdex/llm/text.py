"""Byte-level helpers that run inside tasks: batches, token spans and span hashes, all on NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step inside a task handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
_random = np.random.default_rng(20240229)
#: One random odd word for each byte value.
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_classes(word: Iterable[int], mark: Iterable[int] = ()) -> np.ndarray:
    """Class of each byte: 1 belongs to a word, 2 to a run of marks, 0 separates."""
    table = np.zeros(256, np.uint8)
    table[list(word)] = 1
    table[list(mark)] = 2
    return table


#: Letters, digits and all of UTF-8's bytes beyond ASCII make words, other visible characters make marks.
PROSE = byte_classes(
    [b for b in range(256) if b >= 0x80 or chr(b).isalnum()],
    [b for b in range(0x21, 0x7F) if not chr(b).isalnum()],
)
#: Letters and digits alone.
WORDS = byte_classes([b for b in range(256) if b >= 0x80 or chr(b).isalnum()])


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes, about ``size`` bytes each; a null text is empty."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            part = batch.slice(at, to - at)
            yield part, [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
            at = to


def lowered(texts: list[bytes]) -> list[bytes]:
    """Lower case for all of Unicode."""
    return [x.decode("utf-8", "replace").lower().encode() for x in texts]


class Spans:
    """Maximal runs of one byte class in several texts: ``doc`` is a run's text, ``start`` and ``end`` its place in ``buf``."""

    def __init__(self, texts: list[bytes], classes: np.ndarray):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kinds = classes[self.buf]
        edges = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(kinds)]])
        start, end = edges[:-1], edges[1:]
        self.kind = kinds[start]
        keep = self.kind != 0
        self.start, self.end, self.kind = start[keep], end[keep], self.kind[keep]
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, "right")
        self.texts = len(texts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _power(n: int, base: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * STEP_BYTES:  # a very long text's powers aren't kept
            _powers[name] = have
    return have[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of byte words times powers of an odd base, modulo 2**64, before each place."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(len(buf), _BASE, "up"), out=out[1:])
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``, equal for equal bytes wherever they lie.

    They tell spans apart by chance alone, and some made-up strings of 1,024 bytes and more not at all, so where
    equality decides a result bytes are compared too.
    """
    sums = prefix_sums(buf) if sums is None else sums
    inverse = _power(len(buf) + 1, pow(_BASE, -1, 2**64), "down")
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) + np.uint64(salt))


def equal_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each ``buf[start:end]`` holds the same bytes as its ``other[other_start:other_end]``."""
    out = end - start == other_end - other_start
    at = np.flatnonzero(out & (end > start))
    if len(at):
        n = end[at] - start[at]
        first = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        same = buf[np.repeat(start[at], n) + inside] == other[np.repeat(other_start[at], n) + inside]
        out[at] = np.logical_and.reduceat(same, first)
    return out


def grams_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-byte strings inside the given spans: (index of the span, place in buf)."""
    counts = np.maximum(end - start - n + 1, 0)
    of = np.repeat(np.arange(len(start)), counts)
    first = np.cumsum(counts) - counts
    return of, np.arange(len(of)) - first[of] + start[of]


def letters(buf: np.ndarray) -> np.ndarray:
    """Places where UTF-8's characters begin, and the end of ``buf``."""
    return np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))


def letter_grams_of(places: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of n characters inside the given spans: (index of the span, first byte, byte after the last); ``places`` are ``letters``."""
    begin = np.searchsorted(places, start)
    counts = np.maximum(np.searchsorted(places, end) - begin - n + 1, 0)
    of = np.repeat(np.arange(len(start)), counts)
    at = np.arange(len(of)) - (np.cumsum(counts) - counts)[of] + begin[of]
    return of, places[at], places[at + n]


def distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) pairs with their counts, in order."""
    if not len(doc):
        return doc[:0], key[:0], np.zeros(0, np.int64)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
    at = np.flatnonzero(first)
    return d[at], k[at], np.diff(np.concatenate([at, [len(d)]]))
