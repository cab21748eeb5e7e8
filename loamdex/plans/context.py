"""Queries that rebuild what a search should be read with."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.operators import chunking, context, lexical
from loamdex.plans import search
from loamdex.plans.ledger import chunks_sql
from loamdex.plans.registry import query
from loamdex.plans.rules import _PATHS, _paths
from loamdex.session import kept, table, widen

SIZE, OVERLAP = 800, 80
#: Endings of files that are read whole.
WHOLE = ("py", "json")


def _chunks(spark, folder):
    """(doc_id, chunk_index, start_line, end_line, text, chunk_id) of all documents, cut small, written once."""
    made = chunking.chunks(widen(table(spark, folder, "documents").select("doc_id", "text")), size=SIZE, overlap=OVERLAP)
    named = made.select("doc_id", "chunk_index", "start_line", "end_line", "text", (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"))
    return kept(named, "small-chunks", f"{folder}/documents.parquet")


def _files(spark, folder):
    whole = F.regexp_extract("path", "[.]([a-z]+)$", 1).isin(*WHOLE)
    sizes = table(spark, folder, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return _paths(spark, folder).select("doc_id", whole.alias("whole")).join(sizes, "doc_id")


def _chunk_hits(spark, folder):
    """(query_id, rank, doc_id, chunk_index): the best chunks for every item."""
    chunks = _chunks(spark, folder)
    indexed = kept(lexical.index(chunks, "chunk_id"), "chunk-index", f"{folder}/documents.parquet")
    hits = lexical.bm25(search._queries(spark, folder), indexed, "chunk_id")
    return hits.select("query_id", "rank", F.floor(F.col("chunk_id") / 1_000_000).alias("doc_id"), (F.col("chunk_id") % 1_000_000).cast("int").alias("chunk_index"))


_HITS = f"""{search._TOKENS}, {chunks_sql(SIZE, OVERLAP)},
parts as materialized (select *, doc_id * 1000000 + chunk_index as chunk_id from chunked), {search.posts_sql("parts", "chunk_id", "piece")},
bm as ({search.bm25_sql("chunk_id")}), hits as (select query_id, rank, chunk_id // 1000000 as doc_id, (chunk_id % 1000000)::int as chunk_index from bm)"""

_REBUILT = f"""with recursive {_HITS}, {_PATHS},
blocks as (select doc_id, list('--- lines ' || start_line || '-' || end_line || ' ---' || chr(10) || piece order by chunk_index) as blocks from parts group by 1),
best as (select query_id, doc_id, min(rank) as best, list(distinct chunk_index) as anchors from hits group by 1, 2),
served as (select *, row_number() over (partition by query_id order by best, doc_id) as place from best qualify place <= {context.DOCUMENTS}),
asked as materialized (select query_id, place, doc_id, blocks, len(blocks) as n, list_sort(anchors) as anchors, regexp_extract(path, '[.]([a-z]+)$', 1) in {WHOLE} as whole, strlen(text) > {context.LARGE} and not whole as large
  from served join blocks using (doc_id) join paths using (doc_id) join documents using (doc_id)),
listed as (select *, case when large then list_sort([0] || flatten(list_transform(anchors, lambda a: [a - 1, a, a + 1])))
  else [0] || anchors || flatten(list_transform(anchors, lambda a: [a + 1, a - 1, a + 2, a - 2])) || range(n)::int[] end as places from asked),
inside as (select * replace (list_filter(places, lambda x: x >= 0 and x < n) as places) from listed),
ordered as materialized (select * replace (list_filter(places, lambda x, i: list_position(places, x) = i) as places) from inside),
walk as (
  select distinct query_id, 0::bigint as place, 0::bigint as spent, null::bigint as doc_id, 0::bigint as n, 0::bigint as included, false as truncated, '' as text from served
  union all
  select query_id, place, spent + length(shown), doc_id, n, included, truncated, shown from (
    select *, case when len(chosen) = 0 then 1 else len(chosen) end as included, len(chosen) < n as truncated,
      case when allowance <= 0 then '' when len(chosen) = 0 then left(blocks[places[1] + 1], allowance) else
        array_to_string(list_transform(chosen, lambda c, i: case when i > 1 and c - chosen[i - 1] > 1 then '--- … ' || (c - chosen[i - 1] - 1) || ' chunk(s) omitted … ---' || chr(10) || chr(10) else '' end || blocks[c + 1]), chr(10) || chr(10))
        || case when chosen[len(chosen)] < n - 1 then chr(10) || chr(10) || '--- … ' || (n - 1 - chosen[len(chosen)]) || ' chunk(s) omitted … ---' else '' end end as shown
    from (select *, list_sort(list_reduce(list_prepend({{'spent': 0::bigint, 'cost': 0::bigint, 'i': -1, 'chosen': []::int[]}}, list_transform(places, lambda i: {{'spent': 0::bigint, 'cost': length(blocks[i + 1]) + 2, 'i': i, 'chosen': []::int[]}})),
        lambda a, x: case when a.spent + x.cost > allowance then a else {{'spent': a.spent + x.cost, 'cost': 0::bigint, 'i': -1, 'chosen': a.chosen || [x.i]}} end).chosen) as chosen
      from (select o.*, w.spent, least(case when whole then {context.WHOLE_CHARS} else {context.MAX_CHARS} end, {{budget}} - w.spent) as allowance from walk w join ordered o on o.query_id = w.query_id and o.place = w.place + 1))))
select query_id, place::int as place, doc_id, n::int as chunks, included::int as included, truncated, length(text)::int as chars, sha256(text) as text_hash from walk where text <> ''"""

#: Characters of all documents of an item.
BUDGET = 24_000


@query("rebuilt_context", _REBUILT.replace("{budget}", str(BUDGET)))
def rebuilt_context(spark, folder):
    """The documents of every item's best chunks, rebuilt within 6,000 characters each, 24,000 if code, and 24,000 an item."""
    rows = context.rebuild(_chunk_hits(spark, folder), _chunks(spark, folder).drop("chunk_id"), _files(spark, folder), budget=BUDGET)
    return rows.select("query_id", "place", "doc_id", "chunks", "included", "truncated", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))
