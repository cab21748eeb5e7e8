"""Toxicity classifier with counterfactual regularisation.

Labelled sentences that name a group are copied with the name swapped for another of its kind, and training
penalises the squared difference between the scores of a sentence and of its copies, so that neutral mentions of
a group don't raise the score. A sentence that names no group has no copies, and nothing of it is penalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import linear
from loamdex.llm import text as T

#: Of three parts by crc32 of doc_id, the part that is held out.
PARTS, PART = 3, 1
TOXIC_AT = 0.7
SETTINGS = linear.Settings(sample=20_000, l1=1.0, pair_weight=5.0, part=0, ones=3.0)

Groups = tuple[tuple[str, ...], ...]
#: Names of groups by kind; a swap puts the next name of the same kind in place of one.
IDENTITY: Groups = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("immigrant", "refugee", "native", "foreigner"), ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden"), ("ausländer", "flüchtlinge", "deutsche"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs"), ("étrangers", "réfugiés", "français"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos"), ("extranjeros", "refugiados", "españoles"),
)

def features(bits: int):
    """Distinct buckets of words and marks, and of their beginnings and inner strings of four bytes."""
    mask = np.uint64((1 << bits) - 1)

    def of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        spans = T.Spans(T.lowered(texts), T.PROSE)
        sums = T.prefix_sums(spans.buf)
        word = T.span_hashes(spans.buf, spans.start, spans.end, sums)
        # strings inside words are made once for each distinct word of this step
        names, first, at = np.unique(word, return_index=True, return_inverse=True)
        s, e = spans.start[first], spans.end[first]
        of_gram, place = T.grams_of(spans.buf, s, e, 4)
        gram = T.span_hashes(spans.buf, place, place + 4, sums, salt=1)
        long = np.flatnonzero(e - s >= 4)
        head = T.span_hashes(spans.buf, s[long], s[long] + 4, sums, salt=2)
        owner = np.concatenate([np.arange(len(names)), of_gram, long])
        bucket = (np.concatenate([names, gram, head]) & mask).astype(np.int64)
        by_word = np.argsort(owner, kind="stable")
        bucket, sizes = bucket[by_word], np.bincount(owner, minlength=len(names))
        begin = np.cumsum(sizes) - sizes
        doc, index, _ = T.distinct(spans.doc, at.reshape(-1))
        n = sizes[index]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[index], n)
        key = np.unique(np.repeat(doc, n).astype(np.int64) << np.int64(bits) | bucket[inner])
        return key >> np.int64(bits), key & np.int64((1 << bits) - 1)

    return of


def swaps(groups: Groups = IDENTITY) -> dict[bytes, bytes]:
    """By group name the name that takes its place: the next one of its kind."""
    return {a.lower().encode(): kind[(i + 1) % len(kind)].lower().encode() for kind in groups for i, a in enumerate(kind) if len(kind) > 1}


def swapped(groups: Groups = IDENTITY) -> linear.Swapped:
    """Copies of texts, one for each name that a text holds as a word, with every mention of that name swapped."""
    other = swaps(groups)
    names = sorted(other)

    def of(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        if not names:
            return
        low = T.lowered(texts)
        spans = T.Spans(low, T.WORDS)
        wanted = T.Spans(names, T.WORDS).hashes()
        maybe = np.flatnonzero(np.isin(spans.hashes(), wanted))
        base = np.cumsum([0, *(len(x) + 1 for x in low)])
        found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for i in maybe.tolist():
            d = int(spans.doc[i])
            a, b = int(spans.start[i] - base[d]), int(spans.end[i] - base[d])
            if low[d][a:b] in other:
                found.setdefault((d, low[d][a:b]), []).append((a, b))
        for (d, name), places in sorted(found.items()):
            edges = [0, *(x for p in places for x in p), len(low[d])]
            yield d, other[name].join(low[d][a:b] for a, b in zip(edges[::2], edges[1::2]))

    return of


def fit(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS, groups: Groups = IDENTITY) -> linear.Model:
    """Learn ``labels.toxic`` from at most ``settings.sample`` rows that aren't held out, and from their swapped copies.

    ``groups`` are names by kind, each a single word; a corpus with names of its own passes them.
    """
    sample = linear.labelled_sample(docs, labels, "toxic", PARTS, PART, settings.sample)
    return linear.fit(linear.examples_of(sample, features(settings.bits), swapped(groups)), settings)


def classify(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS, groups: Groups = IDENTITY) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, whatever other columns it has.

    A null text counts as empty; an empty text gets the model's prior. Repeated rows and repeated or
    null ids give one row each (a null id counts as held out). Without usable labels every score is 0.5.
    """
    model = fit(docs, labels, settings, groups)
    scored = linear.score(docs.select("doc_id", "text"), model, features(settings.bits), "doc_id")
    return scored.select(
        "doc_id",
        linear.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
    )
