"""Queries that search: BM25, vectors, fusion, criteria."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import filters, fusion, graph, lexical, retrieval
from loamdex.plans.registry import query
from loamdex.plans.text import PAGE_TEXT
from loamdex.session import cut, kept, table, widen

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)

_TOKENS = f"""
raw as (select item_id as query_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{{1,}}') as r from benchmark),
low as (select query_id, list_distinct(list_transform(r || list_filter(flatten(list_transform(r, lambda x: list_filter(string_split_regex(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: p <> ''))), lambda p: length(p) > 1), lambda x: lower(x))) as t from raw),
kept as (select query_id, t, list_filter(t, lambda x: not list_contains([{STOP}], x)) as k from low),
tokens as (select query_id, unnest(case when len(k) > 0 then k else t end) as term from kept)"""



def posts_sql(rows: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """SQL for the postings of rows with a text: tf, dl, st and df."""
    return f"""
words as (select {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as term from {rows}),
tf as (select {key}, term, count(*)::double as tf from words group by 1, 2),
dl as (select {key}, sum(tf) as dl from tf group by 1),
st as (select count(*) as n, avg(dl) as mean from dl),
df as (select term, count(*) as df from tf group by 1)"""


def bm25_sql(key: str = "doc_id", top: int = 20, by: str = "query_id", tokens: str = "tokens", prior: str = "") -> str:
    """SQL for the best rows of postings by tokens (by, term); ``prior`` is a relation (by, key, prior) by which scores are divided."""
    divided = "s / coalesce(prior, 1)" if prior else "s"
    joined = f" left join {prior} using ({by}, {key})" if prior else ""
    return f"""
with q as (select *, row_number() over (partition by {by} order by df, term) as rarity from {tokens} join df using (term)),
scored as (select {by}, {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) as s, min(rarity) as r
  from tf join q using (term) join dl using ({key}) cross join st where rarity <= 12 group by 1, 2),
ranked as (select {by}, {key}, round({divided}, 6) as score, row_number() over (partition by {by} order by round({divided}, 6) desc, {key}) as rank from scored{joined} where r <= 4)
select {by}, rank, {key}, score from ranked where rank <= {top}
"""


_POSTS = posts_sql()

BM25 = f"""
with {_TOKENS}, {_POSTS},{bm25_sql().split("with", 1)[1]}"""


def _queries(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark, folder):
    """The documents' index, written once for all queries that read it."""
    return kept(lexical.index(widen(table(spark, folder, "documents").select("doc_id", "text"))), "index", f"{folder}/documents.parquet")


def _vectors(spark, folder):
    """(vec_id, embedding, places): the documents' term vectors, written once."""
    held = retrieval.term_vectors(_index(spark, folder), without=tuple(T.STOP_WORDS)).withColumnRenamed("doc_id", "vec_id")
    return kept(held, "document-vectors", f"{folder}/documents.parquet")


@query("search_bm25", BM25)
def search_bm25(spark, folder):
    """The best 20 documents for every benchmark item."""
    hits = lexical.bm25(_queries(spark, folder), _index(spark, folder))
    return hits.withColumn("rank", F.col("rank").cast("long"))


@query(
    "inverse_document_frequency",
    f"with {_POSTS} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df cross join st where df >= 5",
)
def inverse_document_frequency(spark, folder):
    df, sizes = lexical.statistics(_index(spark, folder))
    return df.crossJoin(F.broadcast(sizes)).filter("df >= 5").select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


KNN = """
with q as (select vec_id as query_id, list_transform(embedding, lambda x: x::double) as v from embeddings where vec_id % 20 = 0),
c as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
s as (select query_id, vec_id, round(list_cosine_similarity(q.v, c.v), 6) as cosine from q, c where vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s)
select query_id, rank, vec_id, cosine, round((1 + cosine) / 2, 7) as score from r where rank <= 10
"""


@query("search_vectors", KNN)
def search_vectors(spark, folder):
    """Exact cosine neighbours of every twentieth vector: the stated queries in blocks against all rows."""
    rows = table(spark, folder, "embeddings")
    return retrieval.nearest(rows.filter("vec_id % 20 = 0"), rows, top=10)


@query(
    "vector_centroids",
    """with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)
    select label, (i - 1)::int as dim, round(avg(x), 6) as mean, round(var_pop(x), 6) as variance from e group by 1, 2""",
)
def vector_centroids(spark, folder):
    """Mean and variance of every dimension within each label."""
    return retrieval.centroids(table(spark, folder, "embeddings"), "label")


def _rung(field: str, whole: float, every: float, some: float) -> str:
    """SQL for how well a field fits the query ``q`` and its tokens ``ts``."""
    held = f"len(list_filter(ts, lambda t: contains(lower({field}), t)))"
    return f"case when lower({field}) = q then {whole} when contains(lower({field}), q) then {(whole + every) / 2} when {held} = len(ts) then {every} when {held} > 0 then {some} else 0 end"


def graph_sql(top: int, name: bool = False) -> str:
    """SQL for the graph's best nodes and edges, ``found``, from nodes (id, type, label, perhaps name), edges and gasked (query_id, q, ts)."""
    words = lambda field: f"regexp_extract_all(lower({field}), '[a-z0-9_]{{2,}}')"
    kind, first = "replace(type, '_', ' ')", graph.FIRST_OF_TYPE
    rungs = [_rung("label", 1.0, 0.9, 0.6), *([_rung("name", 0.95, 0.85, 0.55)] if name else []), _rung("type", 0.5, 0.5, 0.5)]
    return f"""
gtoks as (select distinct query_id, unnest(ts) as word from gasked),
nw as (select distinct id, unnest({words("label")}{" || " + words("name") if name else ""}) as word from nodes),
tw as (select distinct type, unnest({words(kind)}) as word from (select distinct type from nodes)),
firsts as (select id, type from nodes qualify row_number() over (partition by type order by label, id) <= {first}),
gcand as (select query_id, id from nw join gtoks using (word) union select query_id, id from tw join gtoks using (word) join firsts using (type)),
gscored as (select query_id, id, label, round(greatest({", ".join(rungs)})::double, 3) as score from gcand join gasked using (query_id) join nodes using (id)),
gbest as (select query_id, id, score, row_number() over (partition by query_id order by score desc, label, id) as place from gscored where score > 0 qualify place <= {top}),
ends as (select distinct query_id, id, ({_rung("label", 0.5, 0.4, 0.3)})::double as s from (select distinct id, label, unnest({words("label")}) as word from nodes) join gtoks using (word) join gasked using (query_id)),
ekinds as (select distinct query_id, type, ({_rung(kind, 0.65, 0.55, 0.45)})::double as s from (select distinct type, unnest({words(kind)}) as word from edges) join gtoks using (word) join gasked using (query_id)),
efirsts as (select * from edges qualify row_number() over (partition by type order by src, dst) <= {first}),
atend as (select query_id, src, dst, type, s from edges join ends on id = src union all select query_id, src, dst, type, s from edges join ends on id = dst),
links as (select query_id, src, dst, type, round(max(s), 3) as score from (select * from atend union all select query_id, src, dst, type, k.s from atend join ekinds k using (query_id, type)
  union all select query_id, src, dst, type, s from efirsts join ekinds using (type)) where s > 0 group by 1, 2, 3, 4),
lb as (select query_id, src, dst, score, row_number() over (partition by query_id order by score desc, src, dst, type) as place from links qualify place <= {top}),
both_kinds as (select query_id, 'node' as kind, id, '' as dst, score, place from gbest union all select query_id, 'relationship', src, dst, score, place + {top} from lb),
found as (select query_id, row_number() over (partition by query_id order by place) as rank, kind, id, dst, score from both_kinds qualify rank <= {top})"""


_SYNONYMS = "case term " + " ".join(f"when '{a}' then '{b}'" for a, b in retrieval.SYNONYMS.items()) + " else term end"
_PLACE = f"('0x' || substr(md5({_SYNONYMS}), 1, 2))::int % 64 as dim, case when ('0x' || substr(md5({_SYNONYMS}), 3, 1))::int < 8 then 1 else -1 end"



def vectors_sql(tokens: str = "tokens", by: str = "query_id") -> str:
    """SQL for the cosine of tokens (by, term) with every document of tf: cosines (by, doc_id, cosine)."""
    return f"""
dv as (select doc_id, dim, sum(x) as x from (select doc_id, {_PLACE} * tf as x from tf where term not in ({STOP})) group by 1, 2),
qv as (select {by}, dim, sum(x) as x from (select {by}, {_PLACE} as x from {tokens}) group by 1, 2),
dn as (select doc_id, sqrt(sum(x * x)) as n from dv group by 1), qn as (select {by}, sqrt(sum(x * x)) as n from qv group by 1),
cosines as (select {by}, doc_id, round(sum(dv.x * qv.x) / (any_value(qn.n) * any_value(dn.n)), 6) as cosine from qv join dv using (dim) join qn using ({by}) join dn using (doc_id) group by 1, 2)"""


_CANDIDATES = f"""{vectors_sql()},
gasked as (select query_id, lower(text) as q, list(term) as ts from tokens join benchmark on item_id = query_id group by 1, 2),
nodes as (select 'd' || doc_id as id, 'document' as type, regexp_extract(text, '^[^.\n]*', 0) as label, coalesce(source, '') as name from documents
  union all select distinct 's' || source, 'source', source, '' from documents where source is not null),
edges as (select 's' || source as src, 'd' || doc_id as dst, 'indexes' as type from documents where source is not null),
{graph_sql(20, True)},
arms as (
  select query_id, 'text' as arm, rank - 1 as pos, 'c' || doc_id as key, 'd' || doc_id as node, 'chunk' as kind, 1.0::double as weight from bm
  union all
  select query_id, 'graph', rank - 1, case kind when 'node' then id else id || '>' || dst end, id, kind, 1.0 from found
  union all
  select query_id, 'vector', row_number() over (partition by query_id order by cosine desc, doc_id) - 1 as pos, 'c' || doc_id, 'd' || doc_id, 'chunk', 1.0 from cosines where cosine > 0 qualify pos < 20
)"""

_FUSED = f"""
with {_TOKENS}, {_POSTS}, bm as ({BM25.split("with", 1)[1].join(["with", ""])}), {_CANDIDATES},
s as (select *, case arm when 'text' then 1 when 'vector' then 2 else 3 end as ao from arms),
g as (select query_id, key, round(sum(weight / (60 + pos + 1)), 9) as score, min(pos) + 1 as best, array_to_string(list_sort(list_distinct(list(arm))), '+') as arms from s group by 1, 2),
r as (select query_id, key, node, kind from s qualify row_number() over (partition by query_id, key order by
  case when arm = 'graph' then 2 when kind = 'node' then 1 else 0 end, case when arm <> 'graph' and kind = 'node' then -(ao * 100000 + pos) else ao * 100000 + pos end) = 1),
o as (select *, row_number() over (partition by query_id, node order by score desc, best, key) as nn from g join r using (query_id, key)),
f as (select *, row_number() over (partition by query_id order by score desc, best, key) as rank from o where nn = 1 or kind = 'relationship' or node = '')
"""


ARM = 20


def _candidates(spark, folder):
    """Three arms for every benchmark item over all documents: BM25, cosine of term vectors, and the graph's nodes by their fields."""
    indexed, queries = _index(spark, folder), _queries(spark, folder)
    row = lambda arm, pos, key, kind: [F.lit(arm).alias("arm"), pos.cast("long").alias("pos"), F.concat(F.lit(key), "doc_id").alias("key"), F.concat(F.lit("d"), "doc_id").alias("node"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight")]
    text = lexical.bm25(queries, indexed, top=ARM).select("query_id", *row("text", F.col("rank") - 1, "c", "chunk"))

    tokens = queries.select("query_id", "query", T.query_tokens(F.col("query")).alias("tokens"))
    terms = tokens.select("query_id", F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("tf"))).alias("terms"))
    asked = retrieval.term_vectors(terms, "query_id").withColumnRenamed("query_id", "vec_id")
    near = retrieval.nearest(asked, _vectors(spark, folder), ARM, others=False).filter("cosine > 0").withColumnRenamed("vec_id", "doc_id")
    vector = near.select("query_id", *row("vector", F.col("rank") - 1, "c", "chunk"))

    hits = graph.search(*_document_graph(spark, folder), tokens, ARM)
    key = F.when(F.col("kind") == "node", F.col("id")).otherwise(F.concat("id", F.lit(">"), "dst"))
    found = hits.select("query_id", F.lit("graph").alias("arm"), (F.col("rank") - 1).alias("pos"), key.alias("key"), F.col("id").alias("node"), "kind", F.lit(1.0).alias("weight"))
    return text.unionByName(vector).unionByName(found)


def _document_graph(spark, folder):
    """(nodes, edges): documents under their opening words, sources, and which source indexes which document."""
    docs = table(spark, folder, "documents")
    title = F.regexp_extract("text", "^[^.\\n]*", 0)
    nodes = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("document").alias("type"), title.alias("label"), F.coalesce("source", F.lit("")).alias("name"))
    sources = docs.filter("source is not null").select(F.concat(F.lit("s"), "source").alias("id"), F.lit("source").alias("type"), F.col("source").alias("label"), F.lit("").alias("name")).distinct()
    edges = docs.filter("source is not null").select(F.concat(F.lit("s"), "source").alias("src"), F.concat(F.lit("d"), "doc_id").alias("dst"), F.lit("indexes").alias("type"))
    return kept(nodes.unionByName(sources), "document-nodes", f"{folder}/documents.parquet"), edges


@query("search_fused", _FUSED + "select query_id, rank, key, node, kind, score, best, arms from f where rank <= 10")
def search_fused(spark, folder):
    """The hybrid query: reciprocal rank fusion of the text, vector and graph arms, with representatives and one row a node."""
    return fusion.fuse(_candidates(spark, folder)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "search_explained",
    _FUSED + "select query_id, arm, count(*) as candidates, count(h.key) as served from arms left join (select query_id, key from f where rank <= 10) h using (query_id, key) group by 1, 2",
)
def search_explained(spark, folder):
    """How many of each arm's candidates the fused result serves."""
    candidates = cut(_candidates(spark, folder), "candidates")
    return fusion.survivors(candidates, fusion.fuse(candidates))


@query(
    "search_criteria",
    f"""with {_TOKENS}, {_POSTS}, bm as ({bm25_sql(top=30)})
    select query_id, row_number() over (partition by query_id order by rank) as rank, doc_id, source, score from bm join documents using (doc_id) where source not in ('src1', 'src2') and lang in ('en', 'de') and score >= 5 qualify row_number() over (partition by query_id order by rank) <= 10""",
)
def search_criteria(spark, folder):
    """The ten best hits that fit criteria on sources, types and score, of three times as many."""
    hits = lexical.bm25(_queries(spark, folder), _index(spark, folder), top=filters.overfetch(10, True))
    known = hits.join(table(spark, folder, "documents").select("doc_id", "source", F.col("lang").alias("type")), "doc_id")
    fit = filters.criteria(known, exclude_sources=("src1", "src2"), node_types=("en", "de"), min_score=5.0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return fit.withColumn("rank", place.cast("long")).filter(F.col("rank") <= 10).select("query_id", "rank", "doc_id", "source", "score")


_PRIOR = r"""greatest(0.25, 1::double + 0.05 * (length(path) - length(replace(path, '/', ''))) + case when regexp_matches(path, '(^|/)tests/|(^|/)test.|_test\.|.test\.') then 0.6 else 0 end
  + case when regexp_matches(path, '(^|/)(samples|examples)/') then 0.3 else 0 end - case when {} then 0.35 else 0 end)"""
#: Folders that the items' first long words prefer, in turn.
FOLDERS = ("en/", "de/", "fr/", "es/")


@query(
    "search_pages",
    f"""with {_TOKENS}, {PAGE_TEXT},
    fields as (select page_id, unnest([trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), regexp_replace(url, '^[a-z]+://[^/]+/', ''), array_to_string(regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>', 1), ' '), t]) as f, unnest([8, 3, 2, 1]) as w
      from d join (select page_id, url from pages) using (page_id)),
    words as (select page_id, w, unnest(regexp_extract_all(lower(f), '[a-z0-9]+')) as term from fields),
    tf as (select page_id, term, sum(w)::double as tf from words group by 1, 2), dl as (select page_id, sum(tf) as dl from tf group by 1), st as (select count(*) as n, avg(dl) as mean from dl), df as (select term, count(*) as df from tf group by 1),
    rules as (select lower(regexp_extract(text, '[A-Za-z]{{7,}}', 0)) as term, {list(FOLDERS)}[item_id % 4 + 1] as prefix from benchmark),
    wanted as (select query_id, list(distinct prefix) as prefixes from tokens join rules using (term) group by 1),
    paths as (select page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') as path from pages),
    priors as (select query_id, page_id, {_PRIOR.format("len(list_filter(prefixes, lambda p: starts_with(path, p))) > 0")} as prior from wanted cross join paths union all
      select item_id, page_id, {_PRIOR.format("false")} from benchmark cross join paths where item_id not in (select query_id from wanted))
    {bm25_sql("page_id", prior="priors").replace("with q as", ", q as", 1).lstrip()}""",
)
def search_pages(spark, folder):
    """The best 20 pages for every item: title, path, headings and text weigh 8, 3, 2 and 1, and deep, test and sample folders cost, but for preferred ones."""
    pages = table(spark, folder, "pages")
    heads = F.array_join(F.regexp_extract_all("html", F.lit("(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>"), F.lit(1)), " ")
    rows = pages.select("page_id", T.html_title(F.col("html")).alias("title"), F.regexp_replace("url", "^[a-z]+://[^/]+/", "").alias("path"), heads.alias("heading"), T.html_text(F.col("html")).alias("text"))
    indexed = kept(lexical.index(widen(rows), "page_id", lexical.FIELDS), "page-index", f"{folder}/pages.parquet")
    items = table(spark, folder, "benchmark")
    folders = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.col("item_id") % 4 + 1).cast("int"))
    rules = items.select(F.array(F.lower(F.regexp_extract("text", "[A-Za-z]{7,}", 0))).alias("terms"), F.array(folders).alias("values"))
    queries = _queries(spark, folder)
    preferred = lexical.preferred(queries.select("query_id", T.query_tokens(F.col("query")).alias("tokens")), rules)
    hits = lexical.bm25(queries, indexed, "page_id", prior=lexical.path_prior(rows.select("page_id", "path"), preferred, "page_id"))
    return hits.withColumn("rank", F.col("rank").cast("long"))


@query(
    "structural_prior",
    r"""with p as (select page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') as path from pages)
    select page_id, path, round(greatest(0.25, 1::double + 0.05 * (length(path) - length(replace(path, '/', ''))) + case when regexp_matches(path, '(^|/)tests/|(^|/)test.|_test\.|.test\.') then 0.6 else 0 end
      + case when regexp_matches(path, '(^|/)(samples|examples)/') then 0.3 else 0 end), 6) as prior from p""",
)
def structural_prior(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+/", "").alias("path"))
    return rows.select("page_id", "path", F.round(lexical.structural_prior(F.col("path")), 6).alias("prior"))
