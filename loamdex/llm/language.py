"""Language ID by word-first backoff.

A word that the training texts hold is scored by its log frequency in each language; any other word falls back to
its character n-grams, the longest known ones first. Counts are made over all documents that aren't held out, and
every count serves: the most frequent words are broadcast, and the others meet the full tables by shuffled joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm import linear
from loamdex.llm import text as T
from loamdex.llm.joins import spread_join
from loamdex.session import cut

#: Of four parts by crc32 of doc_id, the part that is held out.
PARTS, PART = 4, 2
#: Lengths of the n-grams in characters, the longest first; an unseen word asks for a group of lengths at a time.
GRAMS = (5, 4, 3, 2, 1)
ASKED = ((5, 4), (3, 2, 1))
#: Words that are broadcast, the most frequent ones, and cells of their table, a column for each language: fewer words where
#: there are many languages. This bounds memory and changes no result.
WORDS, CELLS = 300_000, 2_400_000
#: Log frequencies are summed as whole multiples of this, so that no order of summing shows.
UNIT = 2.0**-30
#: What is added to each count.
SMOOTH = 0.1
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """All words (word, logs) and n-grams (size, gram, logs) that were learnt, with log probabilities by language.

    ``hashes`` and ``logs`` hold the most frequent of the words, ``floor`` the languages' own log frequencies.
    """

    langs: list[str]
    hashes: np.ndarray
    logs: np.ndarray
    floor: np.ndarray
    words: DataFrame | None = None
    grams: DataFrame | None = None


def _letters(texts: list[bytes]) -> list[bytes]:
    """Lower case with digits taken out, as they tell nothing of a language."""
    return [x.translate(None, b"0123456789") for x in T.lowered(texts)]


def _strings(spans: T.Spans, s: np.ndarray, e: np.ndarray) -> pa.Array:
    raw = spans.buf.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e)], pa.string())


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n), summed within each step of a task before it is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches):
            spans = T.Spans(_letters(texts), T.WORDS)
            langs = part.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[spans.doc]
            word = spans.hashes()
            names, first = np.unique(word, return_index=True)
            k, i, n = T.distinct(lang, np.searchsorted(names, word))
            words = _strings(spans, spans.start[first], spans.end[first])
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(k)), words.take(pa.array(i)), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _grams(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of all n-grams of ``size`` characters inside the texts' words."""
    spans = T.Spans(texts, T.WORDS)
    of, start, end = T.letter_grams_of(T.letters(spans.buf), spans.start, spans.end, size)
    return spans.doc[of], T.span_hashes(spans.buf, start, end, salt=size).view(np.int64)


def _gram_counts(words: DataFrame) -> DataFrame:
    """(size, gram, lang, n): n-grams of each distinct word, weighted by the word's count; a gram is its hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches, "word", 1 << 18):
            langs = part.column("lang").dictionary_encode()
            code, weight = langs.indices.to_numpy(zero_copy_only=False), part.column("n").to_numpy()
            for size in GRAMS:
                doc, h = _grams(texts, size)
                order = np.lexsort((h, code[doc]))
                k, g, w = code[doc][order], h[order], weight[doc][order]
                if not len(k):
                    continue
                at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])]))
                columns = [pa.array(np.full(len(at), size, np.int32)), pa.array(g[at]), langs.dictionary.take(pa.array(k[at])), pa.array(np.add.reduceat(w, at))]
                yield pa.RecordBatch.from_arrays(columns, ["size", "gram", "lang", "n"])

    made = words.select("lang", "word", "n").mapInArrow(run, "size int, gram long, lang string, n long")
    return made.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, rows: int) -> DataFrame:
    """The rows with the greatest n, all down to some count, as many as fit into ``rows``.

    Counts are put into buckets of three leading digits, so that the cut is found from a few thousand sums
    instead of every task's best rows.
    """
    scale = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10("n")) - 2, F.lit(0)))
    bucket = (F.floor(F.col("n") / scale) * scale).cast("long")
    upto, least = 0, None
    for r in sorted(counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        upto += r.k
        if upto > rows:
            break
        least = r.b
    return counts.filter(F.lit(False)) if least is None else counts.filter(bucket >= least)


def _counts(langs: list[str]) -> Column:
    return F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in langs])


def _logs(totals: list[int], rows: int) -> Column:
    """Smoothed log frequencies by language of ``by_lang``; ``rows`` is how many words or n-grams of one length there are."""
    return F.array(*[F.log((F.col("by_lang")[k] + SMOOTH) / (n + SMOOTH * rows)) for k, n in enumerate(totals)])


def fit(docs: DataFrame, words: int = WORDS) -> Model:
    """Count words and n-grams of all documents with a language that aren't held out; ``words`` are broadcast."""
    learn = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~linear.held_out(F.col("doc_id"), PARTS, PART))
    counted = cut(_word_counts(learn), "language-words")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))
    size = np.array([max(totals[x], 1) for x in langs], float)
    by_word = cut(counted.groupBy("word").agg(_counts(langs).alias("by_lang"), F.sum("n").alias("n")), "language-vocabulary")
    full = by_word.select("word", "n", _logs([totals[x] for x in langs], by_word.count()).alias("logs"))
    words = min(words, max(1, CELLS // len(langs)))
    top = _most_frequent(full, words).orderBy("word").toArrow()  # no more than ``words`` rows
    hashes = T.Spans([w.encode() for w in top.column("word").to_pylist()], T.WORDS).hashes() if len(top) else np.zeros(0, np.uint64)
    logs = top.column("logs").combine_chunks().flatten().to_numpy().reshape(len(hashes), len(langs))
    logs = np.rint(logs / UNIT) * UNIT  # summed exactly, like those that aren't broadcast
    order = np.argsort(hashes)
    counts = cut(_gram_counts(counted).groupBy("size", "gram").agg(_counts(langs).alias("by_lang")), "language-grams")
    sums = [F.sum(F.col("by_lang")[k]).alias(f"n{k}") for k in range(len(langs))]
    levels = {r["size"]: r for r in counts.groupBy("size").agg(F.count(F.lit(1)).alias("rows"), *sums).collect()}
    by_level = F.lit(None)
    for n, r in levels.items():
        by_level = F.when(F.col("size") == n, _logs([r[f"n{k}"] for k in range(len(langs))], r["rows"])).otherwise(by_level)
    grams = counts.select("size", "gram", by_level.cast("array<double>").alias("logs"))
    return Model(langs, hashes[order], logs[order], np.log(size / size.sum()), full.select("word", "logs"), grams)


def _words(texts: list[bytes]) -> tuple[T.Spans, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words: spans, hashes, starts and ends of the distinct ones, whether those hold a letter, and each span's index."""
    spans = T.Spans(_letters(texts), T.WORDS)
    # what str.isalpha calls no letter anywhere in a word (a dash or sign beyond ASCII) makes no word of a language
    names, first, at = np.unique(spans.hashes(), return_index=True, return_inverse=True)
    s, e = spans.start[first], spans.end[first]
    beyond = np.zeros(len(spans.buf) + 1, np.int64)
    np.cumsum(spans.buf >= 0x80, out=beyond[1:])
    plain = beyond[e] - beyond[s] < e - s
    raw = spans.buf.tobytes()
    for i in np.flatnonzero(~plain):
        plain[i] = any(c.isalpha() for c in raw[s[i] : e[i]].decode("utf-8", "replace"))
    return spans, names, s, e, plain, at.reshape(-1)


def _first_sums(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, total, any_word, rest) of each row: sums over the broadcast words, and the other words with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = range(len(model.langs))
        for part, texts in T.steps(batches):
            spans, names, s, e, plain, at = _words(texts)
            place = np.minimum(np.searchsorted(model.hashes, names), max(len(model.hashes) - 1, 0))
            hit = model.hashes[place] == names if len(model.hashes) else np.zeros(len(names), bool)
            by_word = np.zeros((len(names), len(langs)))
            by_word[hit & plain] = model.logs[place[hit & plain]]
            total = np.stack([np.bincount(spans.doc, by_word[at, k], minlength=len(texts)) for k in langs], axis=1).astype(float)
            other = (plain & ~hit)[at]
            doc, word, n = T.distinct(spans.doc[other], at[other])
            used, index = np.unique(word, return_inverse=True)
            words = _strings(spans, s[used], e[used]).take(pa.array(index.reshape(-1)))
            ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words, pa.array(n, pa.int32())], ["word", "n"]))
            any_word = np.bincount(spans.doc, plain[at], minlength=len(texts)) > 0
            totals = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(langs), pa.int32()), pa.array(total.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), totals, pa.array(any_word), rest], ["doc_id", "total", "any_word", "rest"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, total array<double>, any_word boolean, rest array<struct<word: string, n: int>>")


def _whole(value: Column) -> Column:
    return F.round(value / UNIT).cast("long")


def _by_grams(words: DataFrame, model: Model, sizes: tuple[int, ...]) -> DataFrame:
    """(id, logs) of words (id, word): means over their longest n-grams of these lengths that were learnt."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in T.steps(batches, "word", 1 << 18):
            for size in sizes:
                doc, gram, n = T.distinct(*_grams(texts, size))
                columns = [part.column("id").take(pa.array(doc)), pa.array(np.full(len(doc), size, np.int32)), pa.array(gram), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "gram", "n"])

    means = F.array(*[F.sum(F.col("n") * _whole(F.col("logs")[k])) * UNIT / F.sum("n") for k in range(len(model.langs))])
    known = words.mapInArrow(run, "id long, size int, gram long, n int").join(model.grams, ["size", "gram"])
    return known.groupBy("id", "size").agg(means.alias("logs")).groupBy("id").agg(F.max_by("logs", "size").alias("logs"))


def _scores(words: DataFrame, model: Model) -> DataFrame:
    """(id, logs) of distinct words (word): by the word itself, else by its n-grams; id is the word's hash."""
    found = cut(words.join(model.words, "word", "left").select(F.xxhash64("word").alias("id"), F.when(F.col("logs").isNull(), F.col("word")).alias("word"), "logs"), "language-others")
    scored, unseen = [found.filter("logs is not null").select("id", "logs")], found.filter("logs is null").select("id", "word")
    for sizes in ASKED:
        more = cut(_by_grams(unseen, model, sizes), "language-backoff")
        scored.append(more)
        unseen = unseen.join(more.select("id"), "id", "left_anti")
    return scored[0].unionByName(scored[1]).unionByName(scored[2])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``, whatever other columns it has.

    A null text, or one without any letter, is ``und`` with score 0, as is every text where nothing was learnt.
    A word none of whose n-grams was learnt tells nothing, and a text of such words gets the languages' own shares.
    Repeated rows and repeated or null ids give one row each. Equal scores go to the first language by name. A text of
    more than 1 MB is a step of its own in its task. An empty table gives no row.
    """
    model = fit(docs) if model is None else model
    held = linear.held_out(F.col("doc_id"), PARTS, PART).alias("held_out")
    if not model.langs:
        return docs.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = dict(docs.dtypes)["doc_id"]
    small = Model(model.langs, model.hashes, model.logs, model.floor)
    shared = docs.sparkSession.sparkContext.broadcast(small)  # at most WORDS rows

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.langs, UNKNOWN], object)
        for part in batches:
            if part.num_rows:
                total = part.column("total").flatten().to_numpy().reshape(part.num_rows, -1) + own.floor
                any_word = part.column("any_word").to_numpy(zero_copy_only=False)
                first = np.where(any_word, np.argmax(total, axis=1), -1)
                p = np.where(any_word, 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[first], pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    first = cut(_first_sums(docs, shared).withColumn("row", F.monotonically_increasing_id()), "language-sums")
    rest = first.select("row", F.inline("rest"))
    scores = _scores(rest.select("word").distinct(), model)
    more = F.array(*[F.sum(F.col("n") * _whole(F.col("logs")[k])) * UNIT for k in range(len(model.langs))])
    found = spread_join(rest.select("row", F.xxhash64("word").alias("id"), "n"), scores, ["id"], ["row"]).groupBy("row").agg(more.alias("more"))
    total = F.when(F.col("more").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda a, b: a + b))
    summed = first.select("doc_id", "total", "any_word", "row").join(found, "row", "left").select("doc_id", total.alias("total"), "any_word")
    return summed.mapInArrow(best, f"doc_id {kind}, lang_pred string, score double").select("doc_id", held, "lang_pred", "score")
