"""Queries that compare the arms of the hybrid search with one another, and metrics over what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import evaluation as E
from loamdex.operators import fusion, graph, lexical, retrieval
from loamdex.plans import search
from loamdex.plans.evaluation import _HOLDERS, _holders
from loamdex.plans.graph import _GRAPH, _graph
from loamdex.plans.registry import query
from loamdex.session import cut, table


def _arm(candidates, name):
    return candidates.filter(F.col("arm") == name).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("node").alias("target"))


@query(
    "arm_churn",
    search._FUSED + """, t as (select query_id, node from arms where arm = 'text' and pos < 10), v as (select query_id, node from arms where arm = 'vector' and pos < 10),
    n as (select query_id, count(*) as a from t group by 1), m as (select query_id, count(*) as b from v group by 1), common as (select query_id, count(*) as c from t join v using (query_id, node) group by 1)
    select query_id, round(1 - coalesce(c, 0) / greatest(a, b, 1), 6) as churn from n join m using (query_id) left join common using (query_id)""",
)
def arm_churn(spark, folder):
    """The share of the first ten results that text and vector search don't have in common."""
    candidates = cut(search._candidates(spark, folder), "candidates")
    return E.churn(_arm(candidates, "text"), _arm(candidates, "vector"))


@query(
    "arm_displacement",
    search._FUSED + f""", {_HOLDERS}, t as (select query_id, node from arms where arm = 'text' and pos < 10), v as (select distinct query_id, node, 1 as kept from arms where arm = 'vector' and pos < 10),
    wanted as (select query_id, 'd' || doc_id as node, 1 as good from holders)
    select query_id, round(count(*) filter (kept is null) / count(*), 6) as displacement, round(count(*) filter (kept is null and good = 1) / nullif(count(good), 0), 6) as positive_displacement
    from t left join v using (query_id, node) left join wanted using (query_id, node) group by 1""",
)
def arm_displacement(spark, folder):
    """What of text search's first ten results vector search loses, and of those that hold a passage of the item."""
    candidates = cut(search._candidates(spark, folder), "candidates")
    good = _holders(spark, folder).select("query_id", F.concat(F.lit("d"), "doc_id").alias("target"), F.lit(1).alias("judgement"))
    return E.displacement(_arm(candidates, "text"), _arm(candidates, "vector"), good)


_RECIPROCAL = f"""{_HOLDERS}, wanted as (select query_id, 'd' || doc_id as node from holders),
rr as (select arm, query_id, round(1 / min(pos + 1), 6) as r from arms join wanted using (query_id, node) group by 1, 2)"""


@query(
    "paired_arms",
    search._FUSED + f""", {_RECIPROCAL}, a as (select query_id, r from rr where arm = 'text'), b as (select query_id, r as q from rr where arm = 'vector')
    select query_id, round(q - r, 6) as delta, case when r is null then 'missing in baseline' when q is null then 'missing in treatment' else 'paired' end as reason from a full join b using (query_id)""",
)
def paired_arms(spark, folder):
    """By item how much higher vector search ranks the first document with a passage than text search does."""
    candidates = cut(search._candidates(spark, folder), "candidates")
    good = _holders(spark, folder).select("query_id", F.concat(F.lit("d"), "doc_id").alias("target"))

    def first(name):
        found = _arm(candidates, name).join(good, ["query_id", "target"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
        return found.select("query_id", F.round(1 / F.col("rank"), 6).alias("reciprocal_rank"))

    return E.paired(first("text"), first("vector"))


@query(
    "arm_agreement",
    search._FUSED + "select query_id, count(*) as results, count(*) filter (contains(arms, '+')) as agreed from f where rank <= 10 group by 1",
)
def arm_agreement(spark, folder):
    """How many of each item's ten results more than one arm has found."""
    fused = fusion.fuse(cut(search._candidates(spark, folder), "candidates"))
    return fusion.agreement(fused)


@query(
    "preferred_hits",
    search._FUSED + """, marked as (select *, node in (select 'd' || doc_id from documents where source = 'src1') as wanted from arms),
    p as (select *, row_number() over (partition by query_id, arm, wanted order by pos) as n from marked)
    select query_id, arm, key, row_number() over (partition by query_id, arm order by case when wanted and n <= 5 then 0 else 1 end, pos) - 1 as pos from p""",
)
def preferred_hits(spark, folder):
    """Each arm's listing with up to five documents of one source first."""
    wanted = table(spark, folder, "documents").filter("source = 'src1'").select(F.concat(F.lit("d"), "doc_id").alias("node"), F.lit(True).alias("wanted"))
    listed = search._candidates(spark, folder).join(wanted, "node", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    return fusion.prefer(listed, F.col("wanted"), 10).select("query_id", "arm", "key", F.col("pos").cast("long"))


_METRICS = "m as (select event_type, unnest(['p50', 'p95', 'mean']) as metric, unnest([quantile_disc(value, 0.5), quantile_disc(value, 0.95), round(avg(value), 6)]) as value from events group by 1)"


@query("composite_scores", f"with {_METRICS} select event_type, round(exp(sum(case metric when 'p50' then 0.5 else 0.25 end * ln(value)) / sum(case metric when 'p50' then 0.5 else 0.25 end)), 6) as composite from m where metric <> 'rows' and value > 0 group by 1")
def composite_scores(spark, folder):
    """Weighted geometric means of each event type's values."""
    wide = E.latency(table(spark, folder, "events"), "event_type", "value").select("event_type", "p50", "p95")
    means = table(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    long = wide.join(means, "event_type").unpivot(["event_type"], ["p50", "p95", "mean"], "metric", "value")
    return E.composite(long, {"p50": 0.5, "p95": 0.25, "mean": 0.25}, ("event_type",))


@query("gate_results", "select count(*) as gates, bool_and(coalesce(m < 60, false)) as passed from (select event_type, avg(value) as m from events group by 1)")
def gate_results(spark, folder):
    """Whether every event type's mean stays below a bound."""
    return E.gates(table(spark, folder, "events").groupBy("event_type").agg((F.avg("value") < 60).alias("passed")))


_ASKED = "gasked as (select item_id as query_id, lower(text) as q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as ts from benchmark)"
_GRAPH_SEARCH = f"{_GRAPH}, {_ASKED}, {search.graph_sql(10)}"


def _graph_tokens(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.graph_tokens(F.col("text")).alias("tokens"))


@query("node_scores", f"with recursive {_GRAPH_SEARCH} select query_id, id, score from gscored where score > 0")
def node_scores(spark, folder):
    """How well each page, folder and outside target fits each item."""
    return graph.node_scores(_graph(spark, folder)[0], _graph_tokens(spark, folder)).select("query_id", "id", "score")


@query("graph_search", f"with recursive {_GRAPH_SEARCH} select * from found")
def graph_search(spark, folder):
    """The graph's ten best nodes for each item, and edges where nodes leave room."""
    return graph.search(*_graph(spark, folder), _graph_tokens(spark, folder))


@query(
    "expanded_hits",
    f"""with recursive {_GRAPH_SEARCH}, pr as (select distinct src, dst from edges)
    select query_id, dst as key, round(score * 0.4::double, 6) as score, id as via from (select query_id, f.id, score, pr.dst, row_number() over (partition by query_id, f.id order by pr.dst) as n from found f join pr on pr.src = f.id where kind = 'node') where n <= 4""",
)
def expanded_hits(spark, folder):
    """Up to four neighbours of each node found, at two fifths of its score."""
    nodes, edges = _graph(spark, folder)
    hits = graph.search(nodes, edges, _graph_tokens(spark, folder)).filter("kind = 'node'").select("query_id", F.col("id").alias("key"), "score")
    return retrieval.expand_hits(hits, edges.select("src", "dst").distinct())


@query("parallel_edges", f"with recursive {_GRAPH} select src, dst, count(*) as links, string_agg(distinct type, ',' order by type) as types from edges group by 1, 2")
def parallel_edges(spark, folder):
    """Edges of the same ends as one row."""
    return graph.parallel(_graph(spark, folder)[1])


@query(
    "named_nodes",
    f"""with recursive {_GRAPH}, {_ASKED}, words as (select distinct unnest(ts) as label from gasked),
    rungs as (select label, id, 0 as n, 'page' as rung, 1.0::double as confidence from nodes where type = 'page' union all select label, id, 1, 'directory', 0.8 from nodes where type = 'directory'
      union all select lower(string_split(label, '/')[-1]), id, 2, 'external', 0.5 from nodes where type = 'external_reference'),
    met as (select distinct label, id, n, rung, confidence from words join rungs using (label)), best as (select * from met qualify n = min(n) over (partition by label))
    select label, id, rung, confidence from best qualify row_number() over (partition by label order by id) <= 3""",
)
def named_nodes(spark, folder):
    """What each token of an item names in the graph: pages before folders before outside targets."""
    nodes = _graph(spark, folder)[0]
    of = lambda kind: nodes.filter(F.col("type") == kind)
    outside = of("external_reference").select(F.lower(F.element_at(F.split("label", "/"), -1)).alias("label"), "id")
    asked = _graph_tokens(spark, folder).select(F.explode("tokens").alias("label"))
    return graph.ladder(asked, [("page", of("page"), 1.0), ("directory", of("directory"), 0.8), ("external", outside, 0.5)])


@query(
    "ranked_sources",
    search.BM25.replace("select query_id, rank, doc_id, score from ranked where rank <= 20", "select query_id, source, min(rank) as rank, count(*) as hits from ranked join documents using (doc_id) where rank <= 20 group by 1, 2"),
)
def ranked_sources(spark, folder):
    """The sources of each item's hits in the order in which they first come."""
    hits = lexical.bm25(search._queries(spark, folder), search._index(spark, folder)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    return fusion.first_ranks(hits.join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id"), "source")


@query(
    "metric_history",
    """with d as (select event_type, strftime(ts, '%Y-%m-%d') as day, round(avg(value), 6) as value from events group by 1, 2)
    select event_type, day, value, round(value - lag(value) over (partition by event_type order by day), 6) as change from d""",
)
def metric_history(spark, folder):
    """Each event type's daily mean, oldest first, with its change since the day before."""
    rows = table(spark, folder, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return E.history(rows.groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("value")), "event_type", "day")


@query("unlabelled_documents", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def unlabelled_documents(spark, folder):
    """Documents that nobody has judged."""
    return retrieval.missing(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"))
