"""Queries over the graph of pages, folders and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import graph as G
from loamdex.plans.registry import query
from loamdex.session import cut, table

_GRAPH = r"""
p as (select page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages),
s as (select page_id, path, string_split(path, '/') as s from p),
fold as (select page_id, path, unnest(list_transform(range(1, greatest(len(s) - 1, 1) + 1), lambda n: array_to_string(s[1:n], '/'))) as f, unnest(range(1, greatest(len(s) - 1, 1) + 1)) as n from s),
lk as (select page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#?]+)', 1))) as t from pages),
tg as (select p.path as src, case when regexp_matches(t, '^[a-z]+://') then regexp_replace(t, '^[a-z]+://', '') when t like '/%' then regexp_extract(url, '^[a-z]+://([^/]+)', 1) || t
  else regexp_replace(p.path, '[^/]*$', '') || regexp_replace(t, '^(\./)+', '') end as dst from lk join p using (page_id)),
edges as (
  select distinct 'dir:' || a.f as src, 'dir:' || b.f as dst, 'contains' as type from fold a join fold b on a.page_id = b.page_id and b.n = a.n + 1
  union all select distinct 'dir:' || f, 'page:' || path, 'contains' from fold qualify row_number() over (partition by page_id order by n desc) = 1
  union all select distinct 'page:' || src, 'page:' || dst, 'links_to' from tg),
nodes as (
  select distinct 'dir:' || f as id, 'directory' as type, string_split(f, '/')[-1] as label from fold
  union all select distinct 'page:' || path, 'page', string_split(path, '/')[-1] from p
  union all select distinct 'page:' || dst, 'external_reference', dst from tg where dst not in (select path from p))"""


def _graph(spark, folder):
    pages = table(spark, folder, "pages")
    links = pages.select("page_id", F.explode(T.html_links(F.col("html"))).alias("target"))
    return tuple(cut(x, "page-graph") for x in G.page_graph(pages, links))


@query("graph_nodes", f"with {_GRAPH} select * from nodes")
def graph_nodes(spark, folder):
    return _graph(spark, folder)[0]


@query("graph_edges", f"with {_GRAPH} select * from edges")
def graph_edges(spark, folder):
    return _graph(spark, folder)[1]


@query(
    "graph_diagnostics",
    f"""with {_GRAPH}, deg as (select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by 1)
    select (select count(*) from nodes) as nodes, (select count(*) from edges) as links, (select max(degree) from deg) as hub_degree,
    (select count(*) from nodes where id not in (select id from deg)) as orphans, round((select count(*) from edges) / (select count(*) from nodes), 3) as density""",
)
def graph_diagnostics(spark, folder):
    return G.diagnostics(*_graph(spark, folder))


@query(
    "graph_hubs",
    f"""with {_GRAPH} select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by 1 order by degree desc, id limit 25""",
)
def graph_hubs(spark, folder):
    return G.degrees(_graph(spark, folder)[1]).orderBy(F.desc("degree"), "id").limit(25)


@query("edge_types", f"with {_GRAPH} select type, count(*) as n, count(distinct src) as sources from edges group by 1")
def edge_types(spark, folder):
    return _graph(spark, folder)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


@query(
    "graph_frontier",
    f"""with {_GRAPH}, pr as (select src, dst, min(case when type = 'contains' then 0 else 1 end) as g from edges group by 1, 2)
    select src, dst, dense_rank() over (partition by src order by g, dst)::int as place from pr qualify place <= 3""",
)
def graph_frontier(spark, folder):
    return G.frontier(_graph(spark, folder)[1], 3)


_ROOTS = "select distinct 'dir:' || s[1] as id from s"


@query(
    "graph_neighbours",
    f"""with recursive {_GRAPH}, roots as ({_ROOTS}), pr as (select distinct src, dst from edges),
    walk as (select id as start, id, 0 as depth from roots union select w.start, pr.dst, w.depth + 1 from walk w join pr on pr.src = w.id where w.depth < 3)
    select start, id, min(depth)::int as depth from walk group by 1, 2""",
)
def graph_neighbours(spark, folder):
    """Everything within three steps of each host."""
    nodes, edges = _graph(spark, folder)
    starts = nodes.filter("type = 'directory' and instr(id, '/') = 0").select("id")
    return G.neighbours(edges, starts, 3).select("start", "id", "depth")


@query(
    "graph_shortest_paths",
    f"""with recursive {_GRAPH}, pairs as (select distinct 'dir:' || split_part(src, '/', 1) as src, 'page:' || dst as dst from tg),
    both_ways as (select src, dst from edges union select dst, src from edges), roots as (select distinct src as id from pairs),
    walk as (select id as start, id, 0 as depth from roots union select start, b.dst, depth + 1 from walk join both_ways b on b.src = id where depth < 8)
    select pairs.src, pairs.dst, min(depth)::int as hops from pairs join walk on walk.start = pairs.src and walk.id = pairs.dst group by 1, 2""",
)
def graph_shortest_paths(spark, folder):
    """Hops from each page's host to each target that the page links to, along edges in either direction, up to eight."""
    edges = _graph(spark, folder)[1]
    host = F.regexp_extract("src", "^page:([^/]*)", 1)
    pairs = edges.filter("type = 'links_to'").select(F.concat(F.lit("dir:"), host).alias("src"), "dst").distinct()
    return G.shortest_paths(edges, pairs).select("src", "dst", F.col("hops").cast("int"))


@query(
    "suffix_references",
    f"""with {_GRAPH}, paths as (select distinct path from p), refs as (select distinct array_to_string(string_split(path, '/')[-2:], '/') as ref from paths),
    ends as (select path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) as e from paths)
    select distinct ref, path from refs join ends on e = ref""",
)
def suffix_references(spark, folder):
    """References by language and number, and all pages of any host that they may mean."""
    paths = table(spark, folder, "pages").select(G.bare_path(F.col("url")).alias("path")).distinct()
    parts = F.split("path", "/")
    refs = paths.select(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/").alias("ref")).distinct()
    return G.suffix_references(refs, paths)


@query(
    "node_link_export",
    f"""with {_GRAPH}, kept as (select * from nodes where type <> 'external_reference' order by id limit 200)
    select 'node' as part, id as a, type as b from kept union all select 'link', src, dst from edges where src in (select id from kept) and dst in (select id from kept)""",
)
def node_link_export(spark, folder):
    nodes, edges = G.node_link(*_graph(spark, folder), node_limit=200, exclude=("external_reference",))
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("type").alias("b")).unionAll(edges.select(F.lit("link"), "src", "dst"))
