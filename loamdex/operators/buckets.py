"""A stored index in hashed buckets of terms, kept up by deltas that rewrite the touched buckets alone.

Postings lie by a hash of their term, so a search reads its terms' buckets. A second table lies by a hash of the key and
says in which buckets a row has terms, so that a row that changes or goes finds its old postings. A delta reads and replaces the
buckets that hold an old or new term of a touched row; every other file stays as it is. What stays of a replaced bucket goes from its
files into new ones without a shuffle, until the buckets have too many files and are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators import lexical
from loamdex.session import cut, small

BUCKETS = 64
#: Touched rows whose keys are broadcast at most, and files of a bucket, on average, from which on they are put together.
MOST_ROWS, MOST_FILES = 2_000_000, 8


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")


def _write(rows: DataFrame, touched: DataFrame | None, path: str, stays: DataFrame | None = None) -> None:
    """Replace the buckets of ``touched`` (all if there are none) by ``rows`` and what ``stays`` of them; an empty row in each makes sure that a bucket without rows is emptied too.

    Old files are removed when all new ones are written, so ``stays`` may read them.
    """
    if touched is not None:
        marks = touched.select("bucket", *[F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes if c != "bucket"])
        rows = rows.unionByName(marks)
    mode = "static" if touched is None else "dynamic"
    dealt = rows.repartition("bucket")
    if stays is not None:
        files = rows.sparkSession.read.parquet(path).inputFiles()
        few = len(files) < MOST_FILES * len({f.rsplit("/", 2)[1] for f in files})
        stays = stays.select(*rows.columns)
        dealt = dealt.unionByName(stays) if few else rows.unionByName(stays).repartition("bucket")
    dealt.write.partitionBy("bucket").option("partitionOverwriteMode", mode).mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str, present: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(present).isNotNull())


def _tables(indexed: DataFrame, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    posts = lexical.postings(indexed, key).select("term", key, "tf", "len", _bucket("term", buckets))
    places = F.array_sort(F.array_distinct(F.transform("terms.term", lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))))
    return posts, indexed.select(key, "len", places.alias("places"), F.size("terms").alias("terms"), _bucket(key, buckets))


def build(rows: DataFrame, path: str, key: str = "doc_id", fields: dict[str, float] | None = None, buckets: int = BUCKETS) -> None:
    """Write the index of ``rows`` below ``path``; whatever was there is replaced."""
    indexed = cut(lexical.index(rows, key, fields), "index-to-store")
    posts, own = _tables(indexed, key, buckets)
    _write(posts, None, f"{path}/postings")
    _write(own, None, f"{path}/rows")


def apply(path: str, upserts: DataFrame, removals: DataFrame, key: str = "doc_id", fields: dict[str, float] | None = None, buckets: int = BUCKETS) -> None:
    """Bring the index up to date: rows of ``upserts`` (key, fields...) replace those of their key or are new, keys of ``removals`` go.

    A key in both stays, as it is in ``upserts``. Applying a delta again changes nothing, so a delta that was interrupted
    is simply applied once more. ``key`` must be unique in ``upserts``; null keys are no rows.
    """
    spark = upserts.sparkSession
    fresh = cut(lexical.index(upserts.filter(F.col(key).isNotNull()), key, fields), "index-of-delta")
    posts, own = _tables(fresh, key, buckets)
    touched = cut(upserts.select(key).unionByName(removals.select(key)).filter(F.col(key).isNotNull()).distinct().withColumn("bucket", _bucket(key, buckets)), "touched-rows")
    homes = small(touched.select("bucket").distinct(), buckets)
    stored = _read(spark, f"{path}/rows", key)
    near = stored.join(homes, "bucket")
    gone = near.join(small(touched.select(key), MOST_ROWS), key, "left_semi").select(F.explode("places").alias("bucket"))
    places = cut(gone.unionByName(posts.select("bucket")).distinct(), "touched-buckets")
    kept = _read(spark, f"{path}/postings", key).join(small(places, buckets), "bucket").join(small(touched.select(key), MOST_ROWS), key, "left_anti")
    _write(posts, places, f"{path}/postings", kept)
    _write(own, homes, f"{path}/rows", near.join(small(touched.select(key), MOST_ROWS), key, "left_anti"))


def postings(spark: SparkSession, path: str, terms: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """(key, term, tf, len) of the given terms (term): only their buckets are read."""
    asked = small(terms.select("term", _bucket("term", buckets)).distinct(), lexical.MOST_TERMS)
    return _read(spark, f"{path}/postings", key).join(asked, ["bucket", "term"]).select(key, "term", "tf", "len")


def sizes(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row (n, mean_len) for BM25."""
    return _read(spark, f"{path}/rows", key).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"))


def search(queries: DataFrame, path: str, key: str = "doc_id", top: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """BM25 over the stored index as in ``lexical.bm25``, but that each of a query's terms finds and scores rows, not its rarest alone."""
    spark = queries.sparkSession
    asked = queries.select(F.explode(lexical.tokens_of(queries)).alias("term")).distinct()
    held = cut(postings(spark, path, asked, key, buckets), "postings-asked-for")
    return lexical.scored_whole(queries, held, sizes(spark, path, key), key, top)


def fold(spark: SparkSession, path: str, key: str = "doc_id") -> tuple[int, int, int, int]:
    """What two indexes of the same rows share, in whatever order they were written: number and sum of hashes of postings and of rows."""
    rows = _read(spark, f"{path}/rows", key)
    total = lambda df, *c: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*c).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    p, r = total(_read(spark, f"{path}/postings", key), "term", key, "tf", "len"), total(rows, key, "len", "terms", F.array_join("places", " "))
    return p["n"], int(p["h"]), r["n"], int(r["h"])
