"""Queries that replay every item under variants of memory and steering."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import filters, lexical, replay, retrieval
from loamdex.plans import search
from loamdex.plans.evaluation import _HOLDERS, _holders
from loamdex.plans.registry import query
from loamdex.plans.rules import _ITEMS, _PATHS, _paths
from loamdex.session import cut, kept, table

ARM = 60
#: Rules of the items: aliases from an item's word to two of the next item's, preferred and shunned folders; every seventh is only proposed.
_WRITTEN = """select 'r' || item_id as record_id, case item_id % 3 when 0 then 'alias' when 1 then 'preference' else 'exclusion' end as kind, case when item_id % 7 = 0 then 'pending' else 'admitted' end as status,
  case item_id % 3 when 0 then {0} || ' -> ' || {2} || ', ' || {3} when 1 then 'when: ' || {0} || ', ' || {1} || ' -> prefer: src' || (item_id % 8) || '/' else 'never: src' || (item_id % 8) || '/de/' end as text"""
VARIANTS = [
    *replay.matrix(), replay.with_cold(replay.matrix()[5]),
    *(replay.without(replay.matrix()[5], f"loo-{r}", r) for r in ("r3", "r4", "r8")), replay.without(replay.matrix()[5], "cluster", "r3", "r6", "r9"),
]


def _rules(spark, folder):
    """(record_id, kind, terms, values, status): the items' rules, written down and read by their grammar."""
    words = table(spark, folder, "benchmark").select("item_id", T.extract_all(F.col("text"), "[A-Za-z]{7,}").alias("w"))
    words = words.join(words.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("o")), "item_id")
    form = _WRITTEN.format("lower(get(w, 0))", "lower(get(w, 1))", "lower(get(o, 0))", "lower(get(o, 1))").removeprefix("select ")
    written = words.selectExpr(*[x.strip().replace("\n", " ") for x in _columns(form)])
    return written.withColumn("rule", T.rule(F.col("kind"), F.col("text"))).filter("rule is not null").select("record_id", "kind", F.col("rule.terms").alias("terms"), F.col("rule.values").alias("values"), "status")


def _columns(form: str) -> list[str]:
    """The columns of ``_WRITTEN``: each ends with its name."""
    out, rest = [], form
    for name in ("record_id", "kind", "status", "text"):
        head, rest = rest.split(f" as {name}", 1)
        out.append(f"{head.lstrip(', ')} as {name}")
    return out


def _records(spark, folder):
    """(record_id, node, tier): documents of one source are memory, half of it cold."""
    docs = table(spark, folder, "documents").filter("source = 'src2'")
    return docs.select(F.concat(F.lit("m"), "doc_id").alias("record_id"), F.concat(F.lit("d"), "doc_id").alias("node"), F.when(F.col("doc_id") % 16 == 2, "hot").otherwise("cold").alias("tier"))


def _asked(spark, folder):
    """(inputs, rules): what each variant asks."""
    rules = cut(_rules(spark, folder), "rules")
    return cut(replay.inputs(search._queries(spark, folder), rules, VARIANTS), "replay-inputs"), rules


def _results(spark, folder):
    asked, rules = _asked(spark, folder)
    arms = cut(replay.distinct_arms(asked), "replay-arms")
    indexed, paths = search._index(spark, folder), _paths(spark, folder).select("doc_id", "path")
    named = arms.select(F.col("arm").alias("query_id"), "tokens")
    text = lexical.bm25(named, indexed, top=ARM, prior=replay.prior(paths, arms))
    terms = named.select("query_id", F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("tf"))).alias("terms"))
    vectors = retrieval.term_vectors(terms, "query_id").withColumnRenamed("query_id", "vec_id")
    near = retrieval.nearest(vectors, search._vectors(spark, folder), ARM, others=False).filter("cosine > 0").withColumnRenamed("vec_id", "doc_id")
    row = lambda rows, arm: rows.select(F.col("query_id").alias("of"), F.lit(arm).alias("arm"), (F.col("rank") - 1).cast("long").alias("pos"), F.concat(F.lit("c"), "doc_id").alias("key"), F.concat(F.lit("d"), "doc_id").alias("node"), F.lit("chunk").alias("kind"))
    found = cut(row(text, "text").unionByName(row(near, "vector")), "replay-found")
    # what an exclusion keeps out is looked up among what was found
    fragments = rules.filter("kind = 'exclusion'").select("record_id", F.explode("values").alias("fragment"))
    there = found.select("node").distinct().join(paths.select(F.concat(F.lit("d"), "doc_id").alias("node"), "path"), "node")
    barred = filters.holding(there, "node", "path", fragments.select("fragment")).join(fragments, "fragment").join(replay.admitted(rules, VARIANTS), "record_id")
    return replay.replay(asked, found, _records(spark, folder), barred, VARIANTS)


_VARIANTS = ", ".join(f"('{v.name}', {v.memory}, {list(v.kinds)}::varchar[], '{v.baseline}', {list(v.without)}::varchar[], {list(v.tiers)}::varchar[], {v.candidates})" for v in VARIANTS)
_INPUTS = f"""{search._TOKENS}, variants(variant, memory, kinds, baseline, without, tiers, candidates) as (values {_VARIANTS}),
written as ({_WRITTEN.format("lower(w[1])", "lower(w[2])", "lower(o[1])", "lower(o[2])")} from (select item_id, w, lead(w) over (order by item_id) as o from (select item_id, regexp_extract_all(text, '[A-Za-z]{{7,}}') as w from benchmark)) where o is not null),
parsed as (select *, case kind when 'alias' then {_ITEMS.format("split_part(text, '->', 1)")} when 'preference' then {_ITEMS.format("split_part(substr(text, 6), '->', 1)")} else ['never'] end as terms,
  case kind when 'alias' then {_ITEMS.format("split_part(text, '->', 2)")} when 'preference' then [trim(split_part(text, 'prefer:', 2))] else [substr(text, 8)] end as vals from written),
active as (select variant, record_id, kind, terms, vals from parsed, variants where list_contains(kinds, kind) and not list_contains(without, record_id) and (status = 'admitted' or candidates)),
fires as (select distinct variant, query_id, kind, vals from tokens join (select *, unnest(terms) as term from active where kind <> 'exclusion') using (term)),
vtok as (select variant, item_id as query_id, term from variants, benchmark join tokens on query_id = item_id union select variant, query_id, unnest(vals) from fires where kind = 'alias'),
vpre as (select distinct variant, query_id, unnest(vals) as prefix from fires where kind = 'preference'),
grid as materialized (select variant, query_id, list(distinct term order by term) as toks, coalesce(any_value(prefixes), []) as prefixes from vtok left join (select variant, query_id, list(prefix order by prefix) as prefixes from vpre group by 1, 2) using (variant, query_id) group by 1, 2),
sets as materialized (select row_number() over (order by query_id, toks, prefixes) as arm, * from (select distinct query_id, toks, prefixes from grid)),
asked as materialized (select variant, query_id, arm from grid join sets using (query_id, toks, prefixes))"""
_RESULTS = f"""with {_INPUTS}, {search._POSTS}, {_PATHS},
atok as (select arm, unnest(toks) as term from sets),
priors as (select arm, doc_id, greatest(0.25, 1::double + 0.05 * (length(path) - length(replace(path, '/', ''))) + case when regexp_matches(path, '(^|/)tests/|(^|/)test.|_test\\.|.test\\.') then 0.6 else 0 end
  - case when len(list_filter(prefixes, lambda p: starts_with(path, p))) > 0 then 0.35 else 0 end) as prior from sets, paths),
bm as materialized ({search.bm25_sql(top=ARM, by="arm", tokens="atok", prior="priors")}),
{search.vectors_sql("atok", "arm")},
found as materialized (select arm as of, 'text' as arm, rank - 1 as pos, 'c' || doc_id as key, 'd' || doc_id as node from bm
  union all select arm, 'vector', row_number() over (partition by arm order by cosine desc, doc_id) - 1 as pos, 'c' || doc_id, 'd' || doc_id from cosines where cosine > 0 qualify pos < {ARM}),
records as (select 'm' || doc_id as record_id, 'd' || doc_id as node, case when doc_id % 16 = 2 then 'hot' else 'cold' end as tier from documents where source = 'src2'),
barred as (select distinct variant, 'd' || doc_id as node from active join paths on contains(lower(path), vals[1]) where kind = 'exclusion'),
shown as (select variant, query_id, f.arm, f.pos, f.key, f.node from asked a join found f on f.of = a.arm join variants using (variant) left join records r on r.node = f.node
  where (r.record_id is null or (memory and list_contains(tiers, tier) and not list_contains(without, r.record_id))) and (variant, f.node) not in (select (variant, node) from barred)),
closed as (select variant, query_id, arm, key, node, row_number() over (partition by variant, query_id, arm order by pos, key) - 1 as place from shown),
s as (select variant, query_id, arm, key, node, place as pos from closed where place < 20),
g as (select variant, query_id, key, node, round(sum(1 / (60 + pos + 1)), 9) as score, min(pos) + 1 as best from s group by 1, 2, 3, 4),
res as materialized (select variant, query_id, row_number() over (partition by variant, query_id order by score desc, best, key) as rank, key, node, score from g qualify rank <= 10)"""


@query("replay_results", _RESULTS + " select variant, query_id, rank, key, score from res")
def replay_results(spark, folder):
    """The ten results of every item under the corpus alone, memory, each kind of steering, all of it, proposals, cold memory, and with records left out."""
    return _results(spark, folder).select("variant", "query_id", F.col("rank").cast("long").alias("rank"), "key", "score")


@query(
    "replay_inputs",
    f"with {_INPUTS} select variant, count(*) as queries, count(distinct arm) as arms, sum(len(toks))::bigint as tokens, sum(len(prefixes))::bigint as prefixes from asked join sets using (query_id, arm) group by 1",
)
def replay_inputs(spark, folder):
    """How many different inputs each variant has, and what it adds to them."""
    asked = _asked(spark, folder)[0]
    return asked.groupBy("variant").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("arm").alias("arms"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size("prefixes")).alias("prefixes"))


@query(
    "replay_compared",
    _RESULTS + f""", {_HOLDERS}, judg as (select query_id, 'd' || doc_id as node from holders),
    seen as (select variant, j.query_id, j.node, coalesce(min(rank), 10000) as rank from judg j cross join variants v left join res r using (variant, query_id, node) group by 1, 2, 3),
    q as (select variant, query_id, count(*) as positives, count(*) filter (rank <= 10) as found, min(case when rank < 10000 then rank end) as first_rank, sum(case when rank <= 10 then 1 / log2(rank + 1) else 0 end) as gain from seen group by 1, 2),
    per as (select variant, query_id, round(found / positives, 6) as recall, (found > 0)::double as hit, round(coalesce(1.0 / first_rank, 0), 6)::double as reciprocal_rank,
      round(greatest(-1, least(1, gain / list_sum(list_transform(range(1, least(positives, 10) + 1), lambda i: 1 / log2(i + 1))))), 6) as gain, 1::double as bpref from q),
    long as (unpivot per on recall, hit, reciprocal_rank, gain, bpref into name measure value value),
    pairs as (select l.variant, v.baseline, l.measure, l.value, b.value as before from long l join variants v using (variant) left join long b on b.variant = v.baseline and b.query_id = l.query_id and b.measure = l.measure)
    select variant, baseline, measure, count(*) as queries, round(sum(value::decimal(18, 6))::double / count(*), 6) as value, count(before) as pairs, round(sum(round(value - before, 6)::decimal(18, 6))::double / nullif(count(before), 0), 6) as delta,
      count(*) filter (round(value - before, 6) > 0) as better, count(*) filter (round(value - before, 6) < 0) as worse from pairs group by 1, 2, 3""",
)
def replay_compared(spark, folder):
    """Each variant's means over the items, and how it differs from its baseline item by item."""
    good = cut(_holders(spark, folder).select("query_id", F.concat(F.lit("d"), "doc_id").alias("target"), F.lit(1).alias("judgement")), "judgements")
    results = cut(_results(spark, folder), "replay-results")
    return replay.compared(results, good, VARIANTS)
