"""Queries that choose which questions are evaluated together. The events ask the benchmark's items in turn, each from its own day on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loamdex.operators import cohorts, memory
from loamdex.plans.memory import _RECORDS, _records
from loamdex.plans.registry import query
from loamdex.plans.replay import _INPUTS, _rules
from loamdex.session import cut, table

NOW = "2024-01-31 00:00:00"
_SPACED = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_ASKS = f"""items as (select count(*) as n from benchmark),
asks as (select text as query, ts as moment, (event_type <> 'error')::int as results from events cross join items join benchmark on item_id = event_id % n where date_diff('day', date '2024-01-01', ts::date) >= item_id % 30),
ids as (select *, left(sha256({_SPACED.format("query")}), 16) as query_id from asks where trim(query) <> ''),
questions as (select query_id, arg_min(query, (moment, query)) as query, count(*) as asked, min(moment) as first_asked from ids group by 1),
candidates as (select text as query, case item_id % 3 when 0 then 'admitted' when 1 then 'pending' else 'rejected' end as status, timestamp '2024-01-08 00:00:00' + to_days((item_id % 10)::int) as first_seen from benchmark where item_id % 5 = 1),
known as (select left(sha256({_SPACED.format("query")}), 16) as query_id, min(first_seen) as first_seen from candidates where status <> 'rejected' group by 1)"""


def _asks(spark, folder):
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("query"))
    sized = table(spark, folder, "events").crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("n"))))  # one row
    rows = sized.withColumn("item_id", F.col("event_id") % F.col("n")).join(items, "item_id").filter(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) >= F.col("item_id") % 30)
    return rows.select("query", F.col("ts").cast("timestamp_ntz").alias("at"), (F.col("event_type") != "error").cast("int").alias("results"))


def _candidates(spark, folder):
    status = F.when(F.col("item_id") % 3 == 0, "admitted").when(F.col("item_id") % 3 == 1, "pending").otherwise("rejected")
    seen = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("item_id") % 10).cast("int"))
    return table(spark, folder, "benchmark").filter("item_id % 5 = 1").select(F.col("text").alias("query"), status.alias("status"), seen.alias("first_seen"))


def _members(spark, folder):
    asks, candidates = cut(_asks(spark, folder), "asks"), _candidates(spark, folder)
    rules = _rules(spark, folder).filter("status = 'admitted'")
    made = [cohorts.anchor(asks, most=30), cohorts.rolling(asks, NOW, days=7, most=25), cohorts.learned(asks, candidates), cohorts.holdout(asks, candidates, days=2), cohorts.control(asks, rules)]
    return reduce(lambda a, b: a.unionByName(b), made)


def _top(name: str, rows: str, most: int) -> str:
    return f"{name} as (select '{name}' as cohort, query_id, query, asked, first_asked from {rows} order by asked desc, query_id limit {most})"


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda w: length(w) > 1)"
_MEMBERS = f"""with {_INPUTS}, {_ASKS},
found as (select query_id, arg_min(query, (moment, query)) as query, count(*) as asked, min(moment) as first_asked from ids where results >= 1 group by 1),
{_top("anchor", "found where (select count(*) from found) >= 20", 30)},
lately as (select query_id, arg_min(query, (moment, query)) as query, count(*) as asked, min(moment) as first_asked from ids where moment >= timestamp '{NOW}' - interval 7 days group by 1),
{_top("rolling", "lately", 25)}, {_top("learned", "questions where query_id in (select query_id from known)", 200)},
{_top("temporal_holdout", "questions where query_id not in (select query_id from known) and first_asked > (select min(first_seen) + interval 2 days from known)", 200)},
triggers as (select distinct unnest({_WORDS.format("t")}) as word from (select unnest(terms || vals) as t from parsed where status = 'admitted')),
touched as (select distinct query_id from (select query_id, unnest({_WORDS.format("query")}) as word from questions) join triggers using (word)),
{_top("control", "questions where query_id not in (select query_id from touched)", 200)},
members as (select * from anchor union all select * from rolling union all select * from learned union all select * from temporal_holdout union all select * from control)"""


@query("cohort_members", _MEMBERS + " select cohort, query_id, asked, strftime(first_asked, '%Y-%m-%d %H:%M:%S') as first_asked from members")
def cohort_members(spark, folder):
    """The questions of five cohorts: the anchor, the last week's, those learnt from, those that nothing can have leaked from, and those no rule touches."""
    return _members(spark, folder).select("cohort", "query_id", "asked", F.date_format("first_asked", "yyyy-MM-dd HH:mm:ss").alias("first_asked"))


@query("cohorts", _MEMBERS + " select cohort, 'cohort-' || left(sha256(cohort || '|' || string_agg(query_id, ',' order by query_id)), 16) as cohort_id, count(*) as queries from members group by 1")
def cohort_summary(spark, folder):
    """Each cohort's size, and its id, which follows from its members."""
    return cohorts.summary(_members(spark, folder))


_CASE = "left(sha256(lower('invariant:{0}:' || {1})), 16) as query_id"
_SAID = r"left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200)"


@query(
    "invariant_cases",
    f"""with {_RECORDS}, own as (select p.record_id, {_SAID} as said, p.valid_from, p.supersedes, p.scope, 'u' || (conv_id % 50) as written_by from proj p where trim(text) <> ''),
    pairs as (select own.*, old.valid_from as was_valid from own join proj old on old.record_id = own.supersedes order by own.record_id limit 25),
    scoped as (select * from own where scope in ('session', 'user') order by record_id limit 25)
    select 'stale' as kind, {_CASE.format("stale", "record_id")}, said as query, record_id as expected, supersedes as forbidden, null as as_of, null as principal from pairs
    union all select 'as_of', {_CASE.format("as_of", "record_id")}, said, supersedes, null, was_valid, null from pairs where was_valid < valid_from
    union all select 'private', {_CASE.format("private", "record_id")}, said, null, record_id, null, 'probe-' || left(sha256(written_by), 16) from scoped
    union all select 'abstain', {_CASE.format("abstain", "'conversations'")}, 'zzq' || left(sha256('conversations'), 16) || 'xq unknowable subject', null, null, null, null""",
)
def invariant_cases(spark, folder):
    """Cases that a right answer decides: stale records, times gone by, other readers' records, things nobody wrote."""
    records = memory.project(_records(spark, folder)).withColumn("written_by", F.concat(F.lit("u"), (F.col("subject").cast("long") % 50).cast("string")))
    return cohorts.invariants(records, "conversations").drop("cohort")
