"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL, scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import linear
from loamdex.llm import text as T

#: Of four parts by crc32 of doc_id, the part that is held out.
PARTS, PART = 4, 2
#: A document is kept from this score on.
KEEP_AT = 0.7
SETTINGS = linear.Settings(sample=16_384)


def features(bits: int):
    """Distinct buckets of words, runs of marks and pairs of neighbours in each text, and of its share of pairs of equal words."""
    mask = np.uint64((1 << bits) - 1)

    def of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        spans = T.Spans(T.lowered(texts), T.PROSE)
        one = spans.hashes()
        near = spans.doc[1:] == spans.doc[:-1]
        two = T.mixed(one[:-1] * np.uint64(3) + one[1:] + np.uint64(1))[near]
        same = np.bincount(spans.doc[:-1][near & (one[1:] == one[:-1])], minlength=len(texts))
        share = np.ceil(8 * same / np.maximum(np.bincount(spans.doc, minlength=len(texts)), 1)).astype(np.uint64)
        doc = np.concatenate([spans.doc, spans.doc[:-1][near], np.flatnonzero(share)])
        equal = T.mixed(share[share > 0] + np.uint64(1 << 40))
        d, b, _ = T.distinct(doc, (np.concatenate([one, two, equal]) & mask).astype(np.int64))
        return d, b

    return of


def fit(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS) -> linear.Model:
    """Learn ``labels.quality`` from at most ``settings.sample`` rows that aren't held out."""
    sample = linear.labelled_sample(docs, labels, "quality", PARTS, PART, settings.sample)
    return linear.fit(linear.examples_of(sample, features(settings.bits)), settings)


def classify(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, whatever other columns it has.

    A null text counts as empty; an empty text gets the model's prior. Repeated rows and repeated or
    null ids give one row each (a null id counts as held out). Without usable labels every score is 0.5.
    """
    model = fit(docs, labels, settings)
    scored = linear.score(docs.select("doc_id", "text"), model, features(settings.bits), "doc_id")
    return scored.select(
        "doc_id",
        linear.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, model: linear.Model, settings: linear.Settings = SETTINGS) -> DataFrame:
    """``docs`` with all their columns and without the texts that the model rejects, in one pass over the text.

    A null or empty text has the model's prior for its score. Repeated rows are kept or go together, whatever
    their ids and other columns are, and an empty table stays empty.
    """
    make = features(settings.bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # no more weights than buckets of the bounded sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            doc, bucket = make(texts)
            yield part.filter(pa.array(shared.value.scores(doc, bucket, len(texts)) >= KEEP_AT))

    return docs.mapInArrow(run, docs.schema)
