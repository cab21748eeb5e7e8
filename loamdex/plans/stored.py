"""Queries over an index that is kept up by deltas, and over clusters of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.operators import buckets, clusters
from loamdex.plans import search
from loamdex.plans.registry import query
from loamdex.session import scratch, table, widen


def _index_after_deltas(spark, folder):
    """The path of an index of older documents after two deltas: new and longer ones and some removed, then some back and others removed."""
    docs = widen(table(spark, folder, "documents").select("doc_id", "text"))
    path, of = scratch(spark, "stored-index"), lambda test: docs.filter(test)
    old = F.when(F.col("doc_id") % 10 == 4, F.expr("left(text, length(text) div 2)")).otherwise(F.col("text"))
    buckets.build(of("doc_id % 10 <> 3").withColumn("text", old), path)
    buckets.apply(path, of("doc_id % 10 in (3, 4)"), of("doc_id % 50 = 7").select("doc_id"))
    buckets.apply(path, of("doc_id % 50 = 7"), of("doc_id % 100 = 9").select("doc_id"))
    return path


@query(
    "index_after_deltas",
    f"with {search.posts_sql('(select * from documents where doc_id % 100 <> 9)')} select term, count(*) as documents, sum(tf) as times, sum(dl) as lengths from tf join dl using (doc_id) group by 1",
)
def index_after_deltas(spark, folder):
    """Every term of an index that two deltas brought up to date: in how many documents it is, how often, and how long they are."""
    posts = buckets._read(spark, f"{_index_after_deltas(spark, folder)}/postings", "doc_id")
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("times"), F.sum("len").alias("lengths"))


@query("search_after_deltas", search.BM25.replace("from documents)", "from documents where doc_id % 100 <> 9)").replace(" where rarity <= 12", "").replace(" where r <= 4", ""))
def search_after_deltas(spark, folder):
    """The best 20 documents for every item from the buckets of all its terms, after two deltas."""
    return buckets.search(search._queries(spark, folder), _index_after_deltas(spark, folder)).withColumn("rank", F.col("rank").cast("long"))


def _round_sql(n: int) -> str:
    return f"""
a{n} as materialized (select v.vec_id, arg_min(c.cluster, (round(v.xx + c.cc - 2 * list_inner_product(v.x, c.c), {clusters.DIGITS}), c.cluster)) as cluster from v, c{n} c group by 1),
m{n} as (select cluster, j, avg(x[j]) as y from a{n} join v using (vec_id), generate_series(1, len(x)) g(j) group by 1, 2),
c{n + 1} as materialized (select cluster, c, list_inner_product(c, c) as cc from (select o.cluster, coalesce(any_value(u.c), any_value(o.c)) as c from c{n} o left join (select cluster, list(y order by j) as c from m{n} group by 1) u using (cluster) group by 1))"""


@query(
    "vector_clusters",
    f"""with fine as (select vec_id, x from (select vec_id, list_transform(embedding, lambda y: y::double) as x from embeddings)
      where vec_id is not null and len(list_filter(x, lambda y: y <> 0)) > 0 and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0),
    numbered as (select *, row_number() over (order by vec_id, x) - 1 as nth, count(*) over () as n from fine where len(x) = (select arg_min(len(x), (vec_id, x)) from fine)),
    v as materialized (select vec_id, x, list_inner_product(x, x) as xx from numbered where n <= {clusters.SAMPLE} or (nth % (n // {clusters.SAMPLE}) = 0 and nth < n // {clusters.SAMPLE} * {clusters.SAMPLE})),
    firsts as (select x, min((md5('{clusters.SEED}:' || vec_id), vec_id)) as o from v group by 1),
    c0 as materialized (select row_number() over (order by o) - 1 as cluster, x as c, list_inner_product(x, x) as cc from firsts qualify cluster < least({clusters.CLUSTERS}, floor(sqrt((select count(*) from v))))),
    {",".join(_round_sql(n) for n in range(clusters.ROUNDS))},
    e as (select v.vec_id, arg_min(c.cluster, (round(v.xx + c.cc - 2 * list_inner_product(v.x, c.c), {clusters.DIGITS}), c.cluster)) as cluster from v, c{clusters.ROUNDS} c group by 1),
    s as (select cluster, count(*) as size, row_number() over (order by count(*) desc, cluster) - 1 as place from e group by 1)
    select place::int as cluster, size, round(size / (select count(*) from v), 6) as weight, (j - 1)::int as dim, round(c[j], 6) as value from s join c{clusters.ROUNDS} using (cluster), generate_series(1, len(c)) g(j)""",
)
def vector_clusters(spark, folder):
    """Seeded clusters of the vectors, of every so many-th where there are more than ``clusters.SAMPLE``: their centres and sizes."""
    return clusters.kmeans(table(spark, folder, "embeddings"))
