"""Ranked text search over postings: document frequencies, weighted BM25, structural prior, vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.functions.batches import portions
from loamdex.session import cut, small

K1, B = 1.2, 0.75
#: Weights of the fields of a chunk.
FIELDS = {"title": 8.0, "path": 3.0, "heading": 2.0, "text": 1.0}
#: Rarest query terms of which a hit holds one, and rarest that are scored.
MATCH_TERMS, SCORE_TERMS = 4, 12
#: Slash depth, test folder and sample folder each make a hit costlier.
DEPTH, TEST, SAMPLE = 0.05, 0.60, 0.30
FLOOR, PREFER = 0.25, 0.35
#: Query terms that are broadcast at most.
MOST_TERMS = 200_000
Prior = DataFrame | Callable[[DataFrame], DataFrame] | None


def index(chunks: DataFrame, key: str = "doc_id", fields: dict[str, float] | None = None) -> DataFrame:
    """(key, len, terms array of (term, tf)): one row for each row with tokens; counts and length are weighted by field.

    Terms are counted inside their row, a portion of a batch at a time. Nothing is shuffled, and only the named columns are read.
    """
    fields = {"text": 1.0} if fields is None else fields
    kind = dict(chunks.dtypes)[key]
    lowered = chunks.select(key, *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"__{n}") for n, c in enumerate(fields)])
    weights = list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile("[a-z0-9]+").findall
        for batch in portions(batches, *(f"__{n}" for n in range(len(weights)))):
            terms, counts, ends, lengths, rows = [], [], [0], [], []
            for row, texts in enumerate(zip(*(batch.column(n + 1).to_pylist() for n in range(len(weights))))):
                tf: Counter = Counter(words(texts[0]))
                if len(weights) > 1 or weights[0] != 1.0:
                    tf = Counter({t: weights[0] * n for t, n in tf.items()})
                    for w, text in zip(weights[1:], texts[1:]):
                        for t, n in Counter(words(text)).items():
                            tf[t] += w * n
                if tf:
                    rows.append(row)
                    terms += tf.keys()
                    counts += tf.values()
                    ends.append(len(terms))
                    lengths.append(float(sum(tf.values())))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.float64())], ["term", "tf"])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.float64()), listed], [key, "len", "terms"])

    return lowered.mapInArrow(run, f"{key} {kind}, len double, terms array<struct<term: string, tf: double>>")


def postings(indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, len) of an index."""
    return indexed.select(key, "len", F.explode("terms").alias("t")).select(key, F.col("t.term").alias("term"), F.col("t.tf").alias("tf"), "len")


def bigrams(rows: DataFrame) -> DataFrame:
    """(bigram, n) of each row (text): its pairs of neighbouring words and how often it has them, counted inside the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile("[a-z0-9]+").findall
        for batch in portions(batches, "text"):
            pairs, counts = [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                found = Counter(zip(w, w[1:]))
                pairs += map(" ".join, found.keys())
                counts += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array(counts, pa.int64())], ["bigram", "n"])

    return rows.select(F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, "bigram string, n long")


def word_runs(rows: DataFrame, key: str, words: int, bits: list[int] | None = None, of: int = 0) -> DataFrame:
    """(key, run, hash): each row's runs of so many words, repeats included, with a hash; rows are (key, text) in lower case.

    With ``bits`` only runs whose hash modulo ``of`` is among them: what is sought sets its bits, and equality is then tested
    on the few that are left. Hashes of a portion's runs are made in one pass from those of its different words.
    """
    kind = dict(rows.dtypes)[key]
    marks = np.zeros(of, bool)
    marks[bits or []] = True
    packed = None if bits is None else np.packbits(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile("[a-z0-9]+").findall
        held = None if packed is None else np.unpackbits(packed).view(bool)
        for batch in portions(batches, "text"):
            texts = [split(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = [w for t in texts for w in t]
            known = {w: zlib.crc32(w.encode()) for w in set(flat)}
            each = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
            begins = np.cumsum(sizes) - sizes
            runs = np.maximum(sizes - words + 1, 0)
            owner = np.repeat(np.arange(len(texts)), runs)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(begins, runs)
            total = np.zeros(len(at), np.uint64)
            for n in range(words):
                total = total * np.uint64(0x9E3779B97F4A7C15) + each[at + n]
            hashes = (total >> np.uint64(20)).astype(np.int64)
            if held is not None:
                keep = held[hashes % of]
                owner, at, hashes = owner[keep], at[keep], hashes[keep]
            found = [" ".join(flat[i : i + words]) for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(found, pa.string()), pa.array(hashes)], [key, "run", "hash"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, run string, hash long")


def statistics(indexed: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """((term, df), one row with the number of rows and their mean length)."""
    df = indexed.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df, indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency; df counts as 0 at least and n as df at least."""
    df = F.greatest(df, F.lit(0))
    n = F.greatest(n, df)
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tokens_of(queries: DataFrame) -> Column:
    """A query's tokens: those it brings, or those of its text."""
    return F.array_distinct("tokens") if "tokens" in queries.columns else T.query_tokens(F.col("query"))


def query_terms(queries: DataFrame, df: DataFrame, keep: int = SCORE_TERMS) -> DataFrame:
    """(query_id, term, df, rarity): each query's rarest tokens that the corpus holds."""
    tokens = queries.select("query_id", F.explode(tokens_of(queries)).alias("term"))
    rare = Window.partitionBy("query_id").orderBy("df", "term")
    return tokens.join(df, "term").withColumn("rarity", F.row_number().over(rare)).filter(F.col("rarity") <= keep)


def structural_prior(path: Column, preferred: Column | None = None) -> Column:
    """What a hit's cost is divided by: 1 in the open, more in deep folders, tests and samples, less where preferred."""
    cost = F.lit(1.0) + DEPTH * (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))
    test = path.rlike("(^|/)tests/|(^|/)test.|_test\\.|.test\\.")
    sample = path.rlike("(^|/)(samples|examples)/")
    cost = cost + F.when(test, TEST).otherwise(0.0) + F.when(sample, SAMPLE).otherwise(0.0)
    if preferred is not None:
        cost = cost - F.when(preferred, PREFER).otherwise(0.0)
    return F.greatest(F.lit(FLOOR), cost)


def path_prior(paths: DataFrame, preferred: DataFrame, key: str = "doc_id") -> Callable[[DataFrame], DataFrame]:
    """For ``bm25``: hits with the prior of their path, from (key, path) and the prefixes (query_id, prefix) that queries prefer."""
    listed = small(preferred.groupBy("query_id").agg(F.collect_set("prefix").alias("prefixes")), MOST_TERMS)

    def add(found: DataFrame) -> DataFrame:
        wanted = F.coalesce(F.exists("prefixes", lambda p: F.startswith("path", p)), F.lit(False))
        joined = found.join(paths.select(key, "path"), key).join(listed, "query_id", "left")
        return joined.withColumn("prior", structural_prior(F.col("path"), wanted)).drop("path", "prefixes")

    return add


def bm25(queries: DataFrame, indexed: DataFrame, key: str = "doc_id", top: int = 20, prior: Prior = None) -> DataFrame:
    """(query_id, rank, key, score) of the best rows for each of (query_id, query), or of (query_id, tokens).

    Tokens are alternatives. A hit holds one of the query's rarest terms, and is scored on some more.
    ``prior`` gives (key, prior), or (query_id, key, prior), by which scores are divided, or adds that column to hits
    (query_id, key, score); without one they stay. Equal scores go by key. The index is read once: postings of terms that no query asks for are dropped there, and the others
    are written for all that follows. The terms asked for are broadcast if they are few.
    """
    asked = queries.select(F.explode(tokens_of(queries)).alias("term")).distinct()
    held = cut(postings(indexed, key).join(small(asked, MOST_TERMS), "term"), "postings-asked-for")
    return scored(queries, held, indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len")), key, top, prior)


def scored(queries: DataFrame, held: DataFrame, sizes: DataFrame, key: str = "doc_id", top: int = 20, prior: Prior = None) -> DataFrame:
    """``bm25`` from the postings (key, term, tf, len) of all terms asked for and one row (n, mean_len)."""
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = cut(query_terms(queries, df), "query-terms")
    hits = held.join(small(terms, MOST_TERMS), "term").crossJoin(F.broadcast(sizes))  # one row of sizes
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    found = hits.groupBy("query_id", key).agg(
        F.sum(idf(F.col("n"), F.col("df")) * saturated).alias("score"), F.min("rarity").alias("rarest")
    )
    found = found.filter(F.col("rarest") <= MATCH_TERMS)
    if callable(prior):
        found = prior(found).withColumn("score", F.col("score") / F.coalesce("prior", F.lit(1.0)))
    elif prior is not None:
        on = [c for c in ("query_id", key) if c in prior.columns]
        found = found.join(prior, on, "left").withColumn("score", F.col("score") / F.coalesce("prior", F.lit(1.0)))
    found = found.withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", key, "score")


#: Queries and rows that meet in one group where every term counts.
QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def scored_whole(queries: DataFrame, held: DataFrame, sizes: DataFrame, key: str = "doc_id", top: int = 20) -> DataFrame:
    """(query_id, rank, key, score) of the best rows where each of a query's terms finds and scores them, also its most widespread ones; tables as for ``scored``.

    Common terms find most rows for most queries, so such pairs leave no task: a posting goes to the block of its row, once for each block of
    queries, scores are summed there, and each block's best are ranked.
    """
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tokens = queries.select("query_id", F.explode(tokens_of(queries)).alias("term"))
    terms = cut(tokens.join(df, "term").crossJoin(F.broadcast(sizes)).select("query_id", "term", idf(F.col("n"), F.col("df")).alias("idf")), "query-terms")  # one row of sizes
    q, r = (max(1, -(-n // most)) for n, most in ((queries.count(), QUERY_BLOCK), (sizes.first()["n"], ROW_BLOCK)))
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    asked = terms.select("query_id", "term", "idf", block("query_id", q).alias("qb"), every(r).alias("rb"))
    posts = held.crossJoin(F.broadcast(sizes)).select(key, "term", saturated.alias("w"), every(q).alias("qb"), block(key, r).alias("rb"))  # one row of sizes
    query_kind, kind = dict(queries.dtypes)["query_id"], dict(held.dtypes)[key]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids, rows = left.column("query_id").combine_chunks().dictionary_encode(), right.column(key).combine_chunks().dictionary_encode(), []
        if left.num_rows and right.num_rows:
            coded = right.column("term").combine_chunks().dictionary_encode()
            at, of = ids.indices.to_numpy(), coded.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            at, w = at[order], right.column("w").to_numpy()[order]
            ends = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1))
            place = {t: n for n, t in enumerate(coded.dictionary.to_pylist())}
            known = ids.dictionary.to_pylist()
            first = np.empty(len(known), np.int64)
            first[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
            scores = np.zeros((len(names.dictionary), len(known)))
            for name, term, weight in zip(names.indices.to_pylist(), left.column("term").to_pylist(), left.column("idf").to_pylist()):
                if term in place:
                    own = slice(ends[place[term]], ends[place[term] + 1])
                    scores[name, at[own]] += weight * w[own]  # a row has a term once
            for name, own in enumerate(scores):
                found = np.flatnonzero(own > 0)
                rounded = np.floor(own[found] * 1e6 + 0.5) / 1e6
                pick = np.lexsort((first[found], -rounded))[:top]
                rows += [(name, at, score) for at, score in zip(found[pick].tolist(), rounded[pick].tolist())]
        take = lambda values, i: values.dictionary.take(pa.array([row[i] for row in rows], pa.int64()))
        return pa.table({"query_id": take(names, 0), key: take(ids, 1), "score": pa.array([row[2] for row in rows], pa.float64())})

    found = asked.groupBy("qb", "rb").cogroup(posts.groupBy("qb", "rb")).applyInArrow(best, f"query_id {query_kind}, {key} {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", key, "score")


def vocabulary(df: DataFrame, top: int = 64) -> DataFrame:
    """(term, df) of the most widespread telling terms: longer than three characters, without digits or noise words."""
    good = (F.length("term") > 3) & ~F.col("term").rlike("[0-9]") & ~F.col("term").isin(*T.VOCABULARY_NOISE)
    return df.filter(good).orderBy(F.desc("df"), "term").limit(top)


def expand_aliases(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, tokens) with the values of every alias rule (term, values) that fires: its term, or all of its parts, are there."""
    fires = F.array_contains("tokens", F.col("term")) | (F.size(F.array_except(F.split("term", "_"), F.col("tokens"))) == 0)
    exploded = tokens.select("query_id", "tokens", F.explode("tokens").alias("token"))
    # a rule can only fire where its first part is among the tokens
    keyed = rules.select("term", "values", F.explode(F.array_distinct(F.array("term", F.split("term", "_")[0]))).alias("token"))
    extra = exploded.join(keyed, "token").filter(fires).groupBy("query_id").agg(F.flatten(F.collect_list("values")).alias("extra"))
    joined = tokens.join(extra, "query_id", "left")
    return joined.select("query_id", F.array_sort(F.array_union("tokens", F.coalesce("extra", F.expr("array()")))).alias("tokens"))


def preferred(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, prefix): path prefixes that preference rules (terms, values) prefer for a query: one of their terms is there, whole or in all its parts."""
    keyed = rules.select("values", F.explode("terms").alias("term"))
    keyed = keyed.select("values", "term", F.explode(F.array_distinct(F.array("term", F.split("term", "_")[0]))).alias("token"))
    fires = F.array_contains("tokens", F.col("term")) | (F.size(F.array_except(F.split("term", "_"), F.col("tokens"))) == 0)
    asked = tokens.select("query_id", "tokens", F.explode("tokens").alias("token"))
    return asked.join(keyed, "token").filter(fires).select("query_id", F.explode("values").alias("prefix")).distinct()
