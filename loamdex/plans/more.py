"""Queries that tune by halving, read lettered outlines, tell facts, compare states, sketch, and call registered functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import registered
from loamdex.functions import text as T
from loamdex.operators import chunking, graph, sketches, states, tuning
from loamdex.plans import search
from loamdex.plans.evaluation import _HOLDERS, _holders
from loamdex.plans.graph import _GRAPH, _graph
from loamdex.plans.ledger import chunks_sql
from loamdex.plans.registry import ORACLES, query
from loamdex.plans.text import PAGE_TEXT
from loamdex.session import cut, table
from loamdex.sources import files

#: The point that is served, away from which the halving steps, and its proposals.
SERVED = tuning.Point("served", 60, 1.0, 1.0, 1.0)
_PROPOSED = [SERVED, *tuning.propose(["truncation", "fusion"], SERVED)]
_POINTS = ", ".join(f"('{p.name}', {p.rrf_k}, {p.text}, {p.vector}, {p.graph})" for p in _PROPOSED)
_CARRIED = [c for _, c in tuning.schedule(1000, len(_PROPOSED))]


def _round(n: int) -> str:
    alive = "" if n == 1 else f"and q3 >= 6 and point in (select point from round{n - 1} where place <= {_CARRIED[n - 1]})"
    return f"""round{n} as materialized (select {n} as round, point, queries, score, row_number() over (order by score desc, point) as place from (
      select point, any_value(q{n}) as queries, round(sum(rr::decimal(18, 6))::double / count(*), 6) as score from rr, plan where nth <= q{n} {alive} group by 1))"""


@query(
    "tuning_rounds",
    search._FUSED.split("\ns as (select")[0]
    + f"""pts(point, rrf_k, wt, wv, wg) as (values {_POINTS}),
    s as (select point, rrf_k, query_id, arm, pos, key, node, kind, case arm when 'text' then wt when 'vector' then wv else wg end as weight, case arm when 'text' then 1 when 'vector' then 2 else 3 end as ao from arms cross join pts),
    g as (select point, query_id, key, round(sum(weight / (rrf_k + pos + 1)), 9) as score, min(pos) + 1 as best from s group by 1, 2, 3),
    r as (select point, query_id, key, node, kind from s qualify row_number() over (partition by point, query_id, key order by
      case when arm = 'graph' then 2 when kind = 'node' then 1 else 0 end, case when arm <> 'graph' and kind = 'node' then -(ao * 100000 + pos) else ao * 100000 + pos end) = 1),
    o as (select *, row_number() over (partition by point, query_id, node order by score desc, best, key) as nn from g join r using (point, query_id, key)),
    f as (select *, row_number() over (partition by point, query_id order by score desc, best, key) as rank from o where nn = 1 or kind = 'relationship' or node = ''),
    {_HOLDERS}, judged as (select query_id, row_number() over (order by md5(query_id::varchar), query_id) as nth from (select distinct query_id from holders)),
    plan as (select case when count(*) < 6 then count(*) else greatest(1, floor(count(*) * {tuning.FIRST_SHARE})::bigint) end as q1, least(count(*), 2 * greatest(1, floor(count(*) * {tuning.FIRST_SHARE})::bigint)) as q2, count(*) as q3 from judged),
    first as (select point, h.query_id, min(rank) as rank from holders h join f on f.query_id = h.query_id and f.node = 'd' || h.doc_id where rank <= 10 group by 1, 2),
    rr as (select point, query_id, nth, round(coalesce(1 / rank, 0), 6) as rr from judged cross join (select point from pts) left join first using (point, query_id)),
    {_round(1)}, {_round(2)}, {_round(3)}
    select round, point, queries::int as queries, score, place::int as place from (select * from round1 union all select * from round2 union all select * from round3)""",
)
def tuning_rounds(spark, folder):
    """Successive halving of the points one step away from the served one, over the items of which a document is known; the first of the last round is chosen."""
    candidates = cut(search._candidates(spark, folder), "candidates")
    good = cut(_holders(spark, folder).select("query_id", F.concat(F.lit("d"), "doc_id").alias("target"), F.lit(1).alias("judgement")), "judgements")
    return tuning.halving(candidates, good, _PROPOSED)


@query(
    "lettered_outlines",
    f"""with recursive l as (select conv_id, turn, role, chr(97 + ((conv_id % 26 + turn) % 26)::int) as number, row_number() over (partition by conv_id order by turn) as line from conversations),
    both_ways as (select *, ascii(number) - 96 as letter, case number when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 end as numeral from l),
    walk as (
      select conv_id, 0::bigint as line, null::int as value from l where line = 1
      union all
      select b.conv_id, b.line, case when role = 'system' then null when numeral is not null and letter = w.value + 1 then letter when numeral is not null and numeral = w.value + 1 then numeral when number in ('i', 'v', 'x') then numeral else letter end
      from walk w join both_ways b on b.conv_id = w.conv_id and b.line = w.line + 1)
    select conv_id, line::int as line, number, value from walk join l using (conv_id, line) where role <> 'system'""",
)
def lettered_outlines(spark, folder):
    """What the labels of lettered outlines count, made from conversations: each turn is an item, and a system's turn a heading that ends the run."""
    rows = table(spark, folder, "conversations")
    letter = F.expr("concat('(', chr(97 + (conv_id % 26 + turn) % 26), ') Turn ', turn)")
    line = F.when(F.col("role") == "system", F.concat(F.lit("# Part "), "turn")).otherwise(letter)
    docs = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return chunking.series(chunking.headings(docs, "conv_id"), "conv_id").select("conv_id", "line", "number", "value")


#: Ranks of the page graph's edges as facts.
RANKS = {"links_to": 2, "contains": 9}


@query(
    "told_facts",
    f"""with recursive {_GRAPH}, sp as ({ORACLES["search_pages"]}), cited as (select query_id, rank as place, 'page:' || path as id from sp join p using (page_id)),
    cand as (select query_id, place, src, type, dst, case type when 'links_to' then 2 else 9 end as r, row_number() over (partition by query_id, place, src order by case type when 'links_to' then 2 else 9 end, type, dst) as depth
      from cited join (select distinct src, dst, type from edges) e on e.src = cited.id),
    listed as (select query_id, list({{'facts': [src || '|' || type || '|' || dst], 'used': [dst], 'subjects': [src], 'weak': (r >= 9)::int}} order by depth, place, src) as l from cand group by 1),
    folded as (select query_id, list_reduce(list_prepend({{'facts': []::varchar[], 'used': []::varchar[], 'subjects': []::varchar[], 'weak': 0}}, l),
      lambda a, x: case when len(a.facts) >= 12 or list_contains(a.used, x.used[1]) or len(list_filter(a.subjects, lambda s: s = x.subjects[1])) >= 3 or (x.weak = 1 and a.weak >= 3) then a
        else {{'facts': a.facts || x.facts, 'used': a.used || x.used, 'subjects': a.subjects || x.subjects, 'weak': a.weak + x.weak}} end).facts as facts from listed)
    select query_id, n::int as n, split_part(facts[n], '|', 1) as src, split_part(facts[n], '|', 2) as type, split_part(facts[n], '|', 3) as dst from folded, generate_series(1, len(facts)) g(n)""",
)
def told_facts(spark, folder):
    """Twelve facts at most of the pages that are found for each item, told in turn."""
    pages = table(spark, folder, "pages").select("page_id", F.concat(F.lit("page:"), graph.bare_path(F.col("url"))).alias("id"))
    cited = search.search_pages(spark, folder).join(pages, "page_id").select("query_id", F.col("rank").alias("place"), "id")
    return graph.facts(cited, _graph(spark, folder)[1], RANKS)


def _before(spark, folder):
    """Documents as they once were: some were longer, some are new since, some have gone."""
    docs = table(spark, folder, "documents")
    text = F.when((F.col("doc_id") % 3 == 1) & (F.col("source") == "src1"), F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    return docs.filter("not (source = 'src3' and doc_id % 3 = 0)").withColumn("text", text)


_SUM = "lpad((sum(('0x' || substr(sha256(concat_ws(chr(31), {})), 1, 15))::bigint::hugeint) % 1000000000000000000000000)::varchar, 24, '0')"


def _sections(rows: str, name: str) -> str:
    return f"{name} as (select coalesce(source, '') as section, count(*) as n, {_SUM.format("doc_id::varchar, coalesce(text, '')")} as digest from ({rows}) group by 1)"


@query(
    "changed_sections",
    f"""with {_sections("select doc_id, source, case when doc_id % 3 = 1 and source = 'src1' then text || ' more' else text end as text from documents where not (source = 'src3' and doc_id % 3 = 0)", "a")}, {_sections("select doc_id, source, text from documents", "b")}
    select section, case when a.digest is null then 'added' when b.digest is null then 'removed' else 'changed' end as change from a full join b using (section) where a.digest is distinct from b.digest""",
)
def changed_sections(spark, folder):
    """The sources whose documents are others than they were."""
    of = lambda rows: states.ranked(rows.withColumn("section", F.coalesce("source", F.lit(""))), "doc_id", "text", by=("section",))
    return states.differences(of(_before(spark, folder)), of(table(spark, folder, "documents")))


@query(
    "ranking_digests",
    search.BM25.replace("select query_id, rank, doc_id, score from ranked where rank <= 20", f"select query_id, count(*) as n, {_SUM.format('rank::varchar, doc_id::varchar')} as digest from ranked where rank <= 20 group by 1"),
)
def ranking_digests(spark, folder):
    """What two runs share that rank each item's documents alike: a digest of the ranked rows, made from sums."""
    return states.ranked(search.search_bm25(spark, folder), "rank", "doc_id", by=("query_id",))


@query("sketched_users", "select event_type, count(distinct user_id) as users, true as near from events group by 1")
def sketched_users(spark, folder):
    """Distinct users of each event type from sketches of each day, and whether they are as near as stated to the exact count."""
    events = table(spark, folder, "events")
    found = sketches.rolled_up(cut(sketches.daily(events, "ts", "user_id", "event_type"), "daily-sketches"), "event_type")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(found, "event_type").select("event_type", "users", sketches.within(F.col("estimate"), F.col("users")).alias("near"))


@query("sketched_quantiles", "select event_type, share, true as near from events, (select unnest([0.5::double, 0.9, 0.99]) as share) group by 1, 2")
def sketched_quantiles(spark, folder):
    """Whether each approximate quantile's rank is as near to the exact one as stated."""
    events = table(spark, folder, "events").select("event_type", "value")
    found = sketches.quantiles(events, "value", (0.5, 0.9, 0.99), "event_type").withColumnRenamed("value", "q")
    met = events.join(F.broadcast(found), "event_type").groupBy("event_type", "share")  # three rows an event type
    ranks = met.agg(F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto"), F.count(F.lit(1)).alias("n"))
    slack = F.col("n") / sketches.ACCURACY + 1
    return ranks.select("event_type", "share", ((F.col("below") - slack <= F.col("share") * F.col("n")) & (F.col("upto") + slack >= F.col("share") * F.col("n"))).alias("near"))


@query(
    "registered_functions",
    """with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) - 1 as place from benchmark)
    select event_type as name, round(exp(avg(ln(value)) filter (value > 0)), 6) as value from events group by 1 union all select word, round(exp(avg(ln(place)) filter (place > 0)), 6) from w where length(word) > 8 group by 1""",
)
def registered_functions(spark, folder):
    """A user's SQL that calls a registered aggregate and a registered function that gives rows."""
    files.register(spark, folder, ["events", "benchmark"])
    registered.register(spark)
    return files.sql(
        spark,
        """select event_type as name, round(geometric_mean(value), 6) as value from events group by event_type
        union all select word, round(geometric_mean(cast(place as double)), 6) from benchmark, lateral words(text) where length(word) > 8 group by word""",
    )


_MARKED = "html"
for _n in range(1, 7):
    _MARKED = f"regexp_replace({_MARKED}, '(?is)<h{_n}\\b[^>]*>(.*?)</h{_n}\\s*>', chr(10) || '{'#' * _n} \\1' || chr(10), 'g')"
_OUTLINES = f"""marked as (select page_id, {_MARKED} as html from pages), {PAGE_TEXT.replace("from pages)", "from marked)")},
lines as (select page_id, raw, row_number() over (partition by page_id order by n) as line from (select page_id, unnest(string_split(t, chr(10))) as raw, generate_subscripts(string_split(t, chr(10)), 1) as n from d)),
heads as (select page_id, line, level, title from (select page_id, line, length(regexp_extract(trim(raw), '^(#{{1,6}})\\s+(\\S.*)$', 1)) as level, trim(regexp_extract(trim(raw), '^(#{{1,6}})\\s+(\\S.*)$', 2)) as title from lines where length(trim(raw)) between 2 and 120)
  where level > 0 and len(string_split_regex(title, '\\s+')) <= 10 and not regexp_matches(title, '(?i)([,;:]|\\b(and|or))$') and not regexp_matches(title, '[.!?]\\s+\\S')),
parents as (select h.page_id, h.line, h.level, h.title, max(p.line) as parent from heads h left join heads p on p.page_id = h.page_id and p.line < h.line and p.level < h.level group by 1, 2, 3, 4)"""
SECTION, SECTION_OVERLAP = 300, 30


def _outlined(spark, folder):
    """(pages as (doc_id, text) with headings marked, their marked headings)."""
    pages = cut(table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), T.html_outline(F.col("html")).alias("text")), "page-outlines")
    return pages, cut(chunking.headings(pages).filter("kind = 'markdown'"), "page-headings")


@query(
    "section_chunks",
    f"""with recursive {_OUTLINES},
    sections as (select l.page_id * 100000 + coalesce(max(h.line), 0) as sid, l.page_id, l.line, l.raw from lines l left join heads h on h.page_id = l.page_id and h.line <= l.line group by l.page_id, l.line, l.raw),
    bodies as (select sid, min(line) as first, string_agg(raw, chr(10) order by line) || case when max(line) < (select max(line) from lines where page_id = any_value(s.page_id)) then chr(10) else '' end as text from sections s group by sid),
    {chunks_sql(SECTION, SECTION_OVERLAP, "bodies", "sid")}
    select sid // 100000 as doc_id, (row_number() over (partition by sid // 100000 order by sid, chunk_index) - 1)::int as chunk_index, (sid % 100000)::int as section, (start_line + first - 1)::int as start_line, (end_line + first - 1)::int as end_line, sha256(piece) as text_hash
    from chunked join bodies using (sid)""",
)
def section_chunks(spark, folder):
    """Chunks of every page that keep to its sections, with the lines of the whole page."""
    pages, heads = _outlined(spark, folder)
    rows = chunking.section_chunks(pages, heads, size=SECTION, overlap=SECTION_OVERLAP)
    return rows.select("doc_id", "chunk_index", "section", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


@query(
    "labelled_lines",
    f"""with recursive {_OUTLINES}, paths as (
      select page_id, line, title as path from parents where parent is null union all select p.page_id, p.line, paths.path || ' > ' || p.title from parents p join paths on paths.page_id = p.page_id and paths.line = p.parent)
    select l.page_id as doc_id, l.line::int as line, left(arg_max(p.path, p.line), 500) as path from lines l left join paths p on p.page_id = l.page_id and p.line <= l.line group by 1, 2""",
)
def labelled_lines(spark, folder):
    """Each line of every page with the path of headings that it is under."""
    pages, heads = _outlined(spark, folder)
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("doc_id", (F.col("at") + 1).alias("line"))
    return chunking.label_lines(lines, chunking.heading_paths(heads)).select("doc_id", F.col("line").cast("int").alias("line"), "path")


@query(
    "outline_graph",
    f"""with {_OUTLINES} select 'h:' || page_id || coalesce(':' || parent, '') as src, 'h:' || page_id || ':' || line as dst, title as label, level::int as level from parents""",
)
def outline_graph(spark, folder):
    """The headings of every page as nodes, under their parents or their page."""
    nodes, edges = chunking.outline(_outlined(spark, folder)[1])
    return edges.join(nodes, edges["dst"] == nodes["id"]).select("src", "dst", "label", F.col("level").cast("int").alias("level"))
