"""Queries over evidence and metrics: labels judge the documents that each benchmark item finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.operators import evaluation as E
from loamdex.operators import fusion, lexical, tuning
from loamdex.plans import search
from loamdex.plans.registry import query
from loamdex.session import cut, small, table, widen

_WEIGHTS = ", ".join(f"('{k}', '{v[0]}', {v[2] * E.STRENGTH[v[1]]})" for k, v in E.EVENTS.items())
#: What each kind of event of the ledger says of the user's query.
_LEDGER = {"view": "served", "click": "selected", "purchase": "downstream_success", "error": "downstream_failure", "signup": "cited"}
_LEDGER_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _LEDGER.items()) + " end"

_PROOFS = f"""
kinds(event, polarity, base) as (values {_WEIGHTS}),
proofs as (select user_id as query_id, 't' || json_extract_string(props, '$.k') as target, event, round(base * pow(0.5, date_diff('day', ts::date, date '2024-02-15') / 90.0), 6) as weight
  from events join kinds on event = {_LEDGER_SQL})"""


def _proofs(spark, folder):
    event = F.element_at(F.create_map(*[F.lit(x) for kv in _LEDGER.items() for x in kv]), F.col("event_type"))
    age = F.datediff(F.lit("2024-02-15").cast("date"), F.to_date("ts")).cast("double")
    return table(spark, folder, "events").select(F.col("user_id").alias("query_id"), F.concat(F.lit("t"), F.get_json_object("props", "$.k")).alias("target"), event.alias("event"), E.weigh(event, age).alias("weight"))


_EVIDENCE = f"""with {_PROOFS}, ev as (select query_id, target, sum(greatest(weight, 0)::decimal(18, 6))::double as positive, sum(greatest(-weight, 0)::decimal(18, 6))::double as negative, count(*) as seen from proofs group by 1, 2)"""


@query("evidence", _EVIDENCE + " select * from ev")
def evidence(spark, folder):
    return E.evidence(_proofs(spark, folder))


@query("evidence_conflicts", _EVIDENCE + " select count(*) as targets, count(*) filter (positive >= 0.2 and negative >= 0.2) as conflicting from ev")
def evidence_conflicts(spark, folder):
    return E.conflicts(E.evidence(_proofs(spark, folder)))


@query(
    "evidence_sufficiency",
    f"""with {_PROOFS}, c as (select query_id, count(*) as n from proofs group by 1)
    select count(*) as evidenced, sum(n)::bigint as interactions, round(max(n) / sum(n), 6) as share, count(*) >= 5 and sum(n) >= 5 and max(n) / sum(n) <= 0.5 as sufficient from c""",
)
def evidence_sufficiency(spark, folder):
    return E.sufficiency(_proofs(spark, folder), eligible=40)


#: Words of a passage that a document must share with an item to be wanted of it.
PASSAGE = 8
_HOLDERS = """runs as (select doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as run from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)),
passages as (select item_id as query_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as run from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark)),
holders as (select distinct query_id, doc_id from passages join runs using (run))"""


#: Passages of the items that are told to tasks at most, and bits by which a task tells what can't be one.
MOST_PASSAGES, PASSAGE_BITS = 500_000, 1 << 23


def _holders(spark, folder):
    """(query_id, doc_id): documents that hold a passage of an item.

    Runs of words are hashed by their places inside the task; only those whose bit an item has set are written out and compared.
    """
    lowered = lambda name, key: table(spark, folder, name).select(key, F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    asked = lexical.word_runs(lowered("benchmark", "item_id"), "item_id", PASSAGE).withColumnRenamed("item_id", "query_id")
    asked = cut(asked.distinct(), "passages")
    bits = None
    if asked.count() <= MOST_PASSAGES:
        bits = [r[0] for r in asked.select(F.pmod("hash", F.lit(PASSAGE_BITS)).alias("bit")).distinct().collect()]  # a bounded number
    runs = lexical.word_runs(widen(lowered("documents", "doc_id")), "doc_id", PASSAGE, bits, PASSAGE_BITS)
    return runs.join(small(asked, MOST_PASSAGES), ["hash", "run"]).select("query_id", "doc_id").distinct()


_RUN = f"""
with {search._TOKENS}, {search._POSTS}, bm as ({search.BM25.split("with", 1)[1].join(["with", ""])}),
res as (select query_id, rank, doc_id as target from bm),
labelled as (select doc_id, case when toxic = 1 then -1 when quality = 1 then 1 end as judgement from labels),
{_HOLDERS},
judg as (select query_id, doc_id as target, coalesce(judgement, 1) as judgement from holders left join labelled using (doc_id)
  union select query_id, target, judgement from res join labelled on doc_id = target where judgement is not null),
seen as (select j.*, coalesce(r.rank, 10000) as rank from judg j left join res r using (query_id, target)),
ord as (select *, coalesce(sum(case when judgement < 0 then 1 else 0 end) over (partition by query_id order by rank range between unbounded preceding and 1 preceding), 0) as above from seen),
q as (select query_id, count(*) filter (judgement > 0) as positives, count(*) filter (judgement < 0) as negatives, count(*) filter (judgement > 0 and rank <= 10) as found, count(*) filter (judgement < 0 and rank <= 10) as exposed,
  min(case when judgement > 0 and rank < 10000 then rank end) as first_rank, sum(case when rank <= 10 then judgement / log2(rank + 1) else 0 end) as gain, sum(case when judgement > 0 then above end)::bigint as misordered from ord group by 1 having positives > 0),
bp as (select query_id, sum(1 - least(above, positives) / positives) / any_value(positives) as bpref from ord join q using (query_id) where judgement > 0 group by 1),
per as (select query_id, positives, negatives, found, exposed, coalesce(first_rank, 0) as first_rank, round(found / positives, 6) as recall, (found > 0)::int as hit, round(coalesce(1.0 / first_rank, 0), 6) as reciprocal_rank,
  round(greatest(-1, least(1, gain / list_sum(list_transform(range(1, least(positives, 10) + 1), lambda i: 1 / log2(i + 1))))), 6) as gain, round(bpref, 6) as bpref, misordered from q join bp using (query_id))
"""


def _run(spark, folder):
    """(results, judgements): documents that hold a passage of an item are good for it, toxic ones bad; labels judge what else is found."""
    hits = lexical.bm25(search._queries(spark, folder), search._index(spark, folder))
    hits = cut(hits.select("query_id", F.col("rank").cast("long"), F.col("doc_id").alias("target")), "run")
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("target"), F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).alias("judgement"))
    owned = _holders(spark, folder).withColumnRenamed("doc_id", "target").join(known, "target", "left").select("query_id", "target", F.coalesce("judgement", F.lit(1)).alias("judgement"))
    judged = owned.unionByName(hits.join(known.filter("judgement is not null"), "target").select("query_id", "target", "judgement")).distinct()
    return hits, cut(judged, "judgements")


@query("retrieval_per_query", _RUN + "select * from per")
def retrieval_per_query(spark, folder):
    return E.per_query(*_run(spark, folder)).withColumn("misordered", F.col("misordered").cast("long"))


@query(
    "retrieval_metrics",
    _RUN + """, m as (select 'recall' as metric, avg(recall) as v, count(*) as n from per union all select 'hit', avg(hit), count(*) from per union all select 'reciprocal_rank', avg(reciprocal_rank), count(*) from per
    union all select 'gain', avg(gain), count(*) from per union all select 'bpref', avg(bpref), count(*) from per)
    select metric, round(v, 6) as value, n as denominator, 'ok' as status from m""",
)
def retrieval_metrics(spark, folder):
    return E.summary(E.per_query(*_run(spark, folder)))


@query(
    "latency_by_type",
    "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as most, count(*) as n from events group by 1",
)
def latency_by_type(spark, folder):
    return E.latency(table(spark, folder, "events"), "event_type", "value")


POINTS = [tuning.Point("even"), tuning.Point("text first", 20, 2.0, 0.5, 0.5), tuning.Point("no graph", 60, 1.0, 1.0, 0.0)]
_POINTS = ", ".join(f"('{p.name}', {p.rrf_k}, {p.text}, {p.vector}, {p.graph})" for p in POINTS)


@query(
    "refused_points",
    search._FUSED.split("\ns as (select")[0]
    + f"""pts(point, rrf_k, wt, wv, wg) as (values {_POINTS}),
    s as (select point, rrf_k, query_id, arm, pos, key, node, kind, case arm when 'text' then wt when 'vector' then wv else wg end as weight, case arm when 'text' then 1 when 'vector' then 2 else 3 end as ao from arms cross join pts),
    g as (select point, query_id, key, round(sum(weight / (rrf_k + pos + 1)), 9) as score, min(pos) + 1 as best from s group by 1, 2, 3),
    r as (select point, query_id, key, node, kind from s qualify row_number() over (partition by point, query_id, key order by
      case when arm = 'graph' then 2 when kind = 'node' then 1 else 0 end, case when arm <> 'graph' and kind = 'node' then -(ao * 100000 + pos) else ao * 100000 + pos end) = 1),
    o as (select *, row_number() over (partition by point, query_id, node order by score desc, best, key) as nn from g join r using (point, query_id, key)),
    f as (select *, row_number() over (partition by point, query_id order by score desc, best, key) as rank from o where nn = 1 or kind = 'relationship' or node = '')
    select point, query_id, rank, key, score from f where rank <= 5""",
)
def refused_points(spark, folder):
    """The same captured arms fused under several points, in one job."""
    fused = tuning.refuse(search._candidates(spark, folder), POINTS, top=5)
    return fused.select("point", "query_id", F.col("rank").cast("long"), "key", "score")


@query(
    "stage_attribution",
    search._FUSED
    + f""", {_HOLDERS}, want as (select query_id, 'd' || doc_id as target from holders),
    cand as (select query_id, node as target, true as survived from arms), stage as (select w.*, case when f.rank <= 10 then 'served' when c.target is null then 'lexical_candidates' when f.rank is null then 'fusion' else 'truncation' end as stage
      from want w left join (select distinct query_id, target from cand) c using (query_id, target) left join (select query_id, node as target, min(rank) as rank from f group by 1, 2) f using (query_id, target))
    select stage, count(*) as n, case when stage <> 'served' then round(count(*) / sum(case when stage <> 'served' then count(*) end) over (), 6) end as share from stage group by 1""",
)
def stage_attribution(spark, folder):
    """Where documents that hold a passage of an item get lost, as shares."""
    candidates = cut(search._candidates(spark, folder), "candidates")
    fused = fusion.fuse(candidates, top=10_000).select("query_id", "rank", F.col("node").alias("target"))
    wanted = _holders(spark, folder).select("query_id", F.concat(F.lit("d"), "doc_id").alias("target"))
    indexed = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("target"))
    seen = candidates.select("query_id", "arm", F.col("node").alias("target"), F.lit(True).alias("survived"))
    return tuning.histogram(tuning.attribute(wanted, seen, fused, indexed))
