"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Training words are streamed through the automaton, which tracks the longest match that ends at each word. Where
the match is long enough to hold a window of an item, the window's words are hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamdex.llm import text as T
from loamdex.session import cut

WINDOW = 13
#: A document is contaminated when hit words are at least one in so many.
COVERAGE = 20
#: Words of items in one automaton, and automata that are broadcast at a time; a larger benchmark takes more passes over the texts.
AUTOMATON_WORDS, AUTOMATA = 400_000, 4

#: What is no word: ASCII but for digits and letters; A-Z are lower-cased.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII digits, letters and whatever lies beyond ASCII."""
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences; each state knows the items whose windows end there."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min((min(len(w), window) for _, w in items if w), default=0)
        # a window is named by the state that holds it and its length, as one state may hold several lengths
        self.ends: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            n = min(len(words), window)
            state, length = 0, 0
            for i, w in enumerate(words):
                state, length = self.step(state, length, w)
                if i + 1 >= n > 0:
                    at = state
                    while self.length[self.link[at]] >= n:
                        at = self.link[at]
                    self.ends.setdefault(at, {}).setdefault(n, set()).add(name)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.next.append(follow), self.length.append(length), self.link.append(0)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0

    def windows(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of every item window that occurs in the words."""
        state = length = 0
        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            if length < self.shortest:
                continue
            at = state
            while at > 0:
                for n, names in self.ends.get(at, {}).items():
                    if n <= length:
                        yield i + 1, n, names
                at = self.link[at]


class Matcher:
    """An automaton with the vocabulary of its items, and the pairs of neighbouring words that they hold."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        names = sorted({w for _, words in items for w in words})
        self.ids = {w: i for i, w in enumerate(names)}
        coded = [(name, [self.ids[w] for w in words]) for name, words in items]
        self.automaton = Automaton(coded, window)
        n = len(names)
        self.pairs = np.unique(np.array([a * n + b for _, w in coded for a, b in zip(w, w[1:])], np.int64))
        self.words = T.Spans(names, T.WORDS) if names else None
        hashes = self.words.hashes() if names else np.zeros(0, np.uint64)
        self.place = np.argsort(hashes)
        self.hashes = hashes[self.place]

    def coded(self, spans: T.Spans) -> np.ndarray:
        """Each word's number among the items' words, -1 for others. Hashes find a word, and its bytes decide."""
        out = np.full(len(spans.doc), -1)
        if not len(self.hashes) or not len(out):
            return out
        h = spans.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        known = self.place[at[hit]]
        same = T.equal_spans(spans.buf, spans.start[hit], spans.end[hit], self.words.buf, self.words.start[known], self.words.end[known])
        out[hit[same]] = known[same]
        for i in hit[~same].tolist():  # two words of one hash
            out[i] = self.ids.get(spans.buf[spans.start[i] : spans.end[i]].tobytes(), -1)
        return out

    def hits(self, spans: T.Spans) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) of item windows in the words of all texts, none across texts.

        Only stretches in which every pair of neighbours is some item's pair are streamed, as no window
        lies elsewhere.
        """
        code = self.coded(spans)
        n, least = len(self.ids), self.automaton.shortest
        if not least or not len(code):
            return
        known = code >= 0
        pair = np.where(known[:-1] & known[1:] & (spans.doc[:-1] == spans.doc[1:]), code[:-1] * n + code[1:], -1)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = self.pairs[at] == pair
        else:
            joined = np.zeros(len(pair), bool)
        breaks = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(code)]])
        worth = np.flatnonzero((np.diff(breaks) >= least) & known[breaks[:-1]])
        for a, b in zip(breaks[worth].tolist(), breaks[worth + 1].tolist()):
            for end, size, names in self.automaton.windows(code[a:b].tolist()):
                yield a + end - size, a + end, names


def matchers(benchmark: DataFrame, window: int) -> Iterator[list[Matcher]]:
    """Automata of all items with words, so many at a time as are broadcast together; the items come to the driver one after another."""
    items, size, out = [], 0, []
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        words = words_of((r.text or "").encode())
        if r.item_id is None or not words:
            continue
        if items and size + len(words) > AUTOMATON_WORDS:
            out.append(Matcher(items, window))
            items, size = [], 0
            if len(out) == AUTOMATA:
                yield out
                out = []
        items.append((r.item_id, words))
        size += len(words)
    yield [*out, Matcher(items, window)] if items else out


_HITS = "array<struct<a: int, b: int, item: string>>"


def _hits(part: pa.RecordBatch, spans: T.Spans, own: list[Matcher], held: str | None) -> tuple[list[int], list[int], list[set[str]]]:
    """(first words, words after the last, items by text) of all windows found, those of earlier passes included."""
    start, end, items = [], [], [set() for _ in range(spans.texts)]
    if held:
        first = np.searchsorted(spans.doc, np.arange(spans.texts))
        for d, listed in enumerate(part.column(held).to_pylist()):
            for x in listed or ():
                start.append(int(first[d]) + x["a"]), end.append(int(first[d]) + x["b"])
                items[d].add(x["item"])
    for m in own:
        for a, b, names in m.hits(spans):
            start.append(a), end.append(b)
            items[spans.doc[a]] |= names
    return start, end, items


def _earlier_passes(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, Broadcast, str | None]:
    """``docs``, the automata of the last pass, and the column that holds the hits of the passes before it, if there are any."""
    held, name = None, next(n for n in (f"hits{'_' * i}" for i in range(len(docs.columns) + 1)) if n.lower() not in {c.lower() for c in docs.columns})
    groups = matchers(benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(next(groups))
    for more in groups:
        before, schema = held, f"{name} {_HITS}"

        def run(batches: Iterable[pa.RecordBatch], own=shared, before=before) -> Iterator[pa.RecordBatch]:
            for part, texts in T.steps(batches):
                spans = T.Spans([x.translate(_FOLD) for x in texts], T.WORDS)
                first = np.searchsorted(spans.doc, np.arange(spans.texts))
                rows = [list(x or ()) for x in part.column(before).to_pylist()] if before else [[] for _ in texts]
                for m in own.value:
                    for a, b, names in m.hits(spans):
                        d = spans.doc[a]
                        rows[d] += [{"a": int(a - first[d]), "b": int(b - first[d]), "item": x} for x in sorted(names)]
                column = pa.array(rows, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("item", pa.string())])))
                kept = [c for c in part.schema.names if c != before]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), column], [*kept, name])

        fields = [f for f in docs.schema.fields if f.name != before]
        docs = cut(docs.mapInArrow(run, StructType([*fields, *StructType.fromDDL(schema).fields])), "decontamination-pass")
        shared.unpersist()
        shared, held = docs.sparkSession.sparkContext.broadcast(more), name
    return docs, shared, held


def _covered(start: list[int], end: list[int], words: int) -> np.ndarray:
    """Words that lie in any of the ranges."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge)[:-1] > 0


def inspect(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """One row for each row of ``docs``, whatever other columns it has: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, items (ids sorted as text) and spans, the byte ranges of the hit runs in the text's UTF-8.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window. Null and
    empty texts have no words and aren't contaminated; items that are null or have no words match nothing;
    repeated items count once. A text is contaminated with any hit word where hit words are at least one in
    ``coverage``.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs, shared, held = _earlier_passes(docs.select("doc_id", "text"), benchmark, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            spans = T.Spans([x.translate(_FOLD) for x in texts], T.WORDS)
            total = np.bincount(spans.doc, minlength=len(texts))
            start, end, items = _hits(part, spans, shared.value, held)
            hit = _covered(start, end, len(spans.doc))
            n_hit = np.bincount(spans.doc[hit], minlength=len(texts))
            base = np.cumsum([0, *(len(x) + 1 for x in texts[:-1]), 0])[: len(texts)]
            runs: list[list[dict]] = [[] for _ in texts]
            at = np.flatnonzero(hit)
            if len(at):
                edges = np.flatnonzero((np.diff(at) > 1) | (np.diff(spans.doc[at]) > 0)) + 1
                for g in np.split(at, edges):
                    d = spans.doc[g[0]]
                    runs[d].append({"start": int(spans.start[g[0]] - base[d]), "end": int(spans.end[g[-1]] - base[d])})
            names = [sorted(x) for x in items]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(total, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array((n_hit > 0) & (coverage * n_hit >= total)),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, end: long>>"
    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, cut_spans: bool = False) -> DataFrame:
    """``docs`` without contaminated texts, with all their columns and in the same pass over the text.

    With ``cut_spans`` the hit spans of the other texts are taken out too; without, they stay as they are. Null
    and empty texts stay, repeated rows stay or go together, and an empty table or benchmark changes nothing.
    """
    names, wanted = docs.columns, docs.schema
    docs, shared, held = _earlier_passes(docs, benchmark, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            spans = T.Spans([x.translate(_FOLD) for x in texts], T.WORDS)
            total = np.bincount(spans.doc, minlength=len(texts))
            start, end, _ = _hits(part, spans, shared.value, held)
            hit = _covered(start, end, len(spans.doc))
            part = part.select(names)
            n_hit = np.bincount(spans.doc[hit], minlength=len(texts))
            keep = (n_hit == 0) | (coverage * n_hit < total)
            if cut_spans and (keep & (n_hit > 0)).any():
                part = _cut(part, texts, spans, hit, names)
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, wanted)


def _cut(part: pa.RecordBatch, texts: list[bytes], spans: T.Spans, hit: np.ndarray, names: list[str]) -> pa.RecordBatch:
    base = np.cumsum([0, *(len(x) + 1 for x in texts)])
    out = [bytearray(x) for x in texts]
    for i in np.flatnonzero(hit)[::-1]:
        d = spans.doc[i]
        del out[d][spans.start[i] - base[d] : spans.end[i] - base[d]]
    column = names.index("text")
    old = part.column(column)
    fresh = pa.array([None if not v.is_valid else bytes(x).decode("utf-8", "replace") for v, x in zip(old, out)], old.type)
    return part.set_column(column, part.schema.field(column), fresh)
