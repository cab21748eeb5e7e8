"""Queries over agent memory, made from conversations: each turn is a record, each third one corrects the turn before."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import filters, memory
from loamdex.operators.filters import MemoryPolicy
from loamdex.plans.registry import query
from loamdex.session import cut, table

_RECORDS = """
rec as (select 'm' || conv_id || '-' || turn as record_id, case role when 'system' then 'org' when 'user' then 'user' else 'session' end as scope, conv_id::varchar as subject, 'fact' as kind,
  strftime(timestamp '2024-01-01 00:00:00' + to_hours((conv_id % 100 * 24 + turn)::bigint), '%Y-%m-%dT%H:%M:%SZ') as asserted_at, '' as valid_from,
  case when turn % 5 = 4 then '2024-02-01T00:00:00Z' else '' end as valid_until, case when turn % 3 = 2 then 'm' || conv_id || '-' || (turn - 1) end as supersedes,
  case when turn % 4 = 3 then 'cold' else '' end as tier, text, conv_id, turn from conversations),
corr as (select supersedes as record_id, min(asserted_at) as corrected from rec where supersedes is not null group by 1),
proj as (select rec.* exclude (valid_from, valid_until), coalesce(nullif(valid_from, ''), asserted_at) as valid_from, least(nullif(valid_until, ''), corrected) as valid_until from rec left join corr using (record_id))"""


def _records(spark, folder):
    rows = table(spark, folder, "conversations")
    identity = lambda turn: F.concat(F.lit("m"), F.col("conv_id"), F.lit("-"), turn)
    made = F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") % 100 * 24 + F.col("turn")) * 3600)
    return rows.select(
        identity(F.col("turn")).alias("record_id"), F.when(F.col("role") == "system", "org").when(F.col("role") == "user", "user").otherwise("session").alias("scope"),
        F.col("conv_id").cast("string").alias("subject"), F.lit("fact").alias("kind"), F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("asserted_at"), F.lit("").alias("valid_from"),
        F.when(F.col("turn") % 5 == 4, "2024-02-01T00:00:00Z").otherwise("").alias("valid_until"), F.when(F.col("turn") % 3 == 2, identity(F.col("turn") - 1)).alias("supersedes"),
        F.when(F.col("turn") % 4 == 3, "cold").otherwise("").alias("tier"), "text", "conv_id", "turn",
    )


@query("memory_projection", f"with {_RECORDS} select record_id, scope, valid_from, valid_until from proj")
def memory_projection(spark, folder):
    return memory.project(_records(spark, folder)).select("record_id", "scope", "valid_from", "valid_until")


@query(
    "memory_as_of",
    f"""with {_RECORDS} select record_id, scope, tier from proj where scope in ('user', 'session') and coalesce(nullif(tier, ''), 'hot') in ('hot', 'cold')
    and valid_from <= '2024-01-20T00:00:00Z' and (valid_until is null or valid_until > '2024-01-20T00:00:00Z')""",
)
def memory_as_of(spark, folder):
    """Records of users and sessions that were valid at a time."""
    policy = MemoryPolicy(scopes=("user", "session"), as_of="2024-01-20T00:00:00Z")
    return memory.project(_records(spark, folder)).filter(filters.admits(policy, "2024-06-01T00:00:00Z")).select("record_id", "scope", "tier")


@query(
    "memory_salience",
    f"""with {_RECORDS} select record_id, round(pow(0.5, date_diff('day', strptime(asserted_at, '%Y-%m-%dT%H:%M:%SZ')::date, date '2024-06-01') / 90.0) * (1 + 0.5 * ln(1 + turn) + 0.5 * ln(1 + conv_id % 7))
    * case scope when 'org' then 1.25 when 'session' then 0.6 else 1 end, 6) as salience from rec""",
)
def memory_salience(spark, folder):
    """Importance, with the turn as uses and the conversation's number modulo 7 as observations."""
    age = F.datediff(F.lit("2024-06-01").cast("date"), F.to_date(F.substring("asserted_at", 1, 10))).cast("double")
    return _records(spark, folder).select("record_id", memory.salience(age, F.col("turn"), F.col("conv_id") % 7, F.col("scope")).alias("salience"))


@query("memory_over_cap", f"with {_RECORDS} select record_id, scope from (select *, row_number() over (partition by scope order by length(text) desc, record_id) as place from rec) where place > case scope when 'org' then 5 when 'user' then 50 else 40 end")
def memory_over_cap(spark, folder):
    """Records past their scope's cap, the longest being the most important here."""
    rows = _records(spark, folder).withColumn("salience", F.length("text"))
    return memory.over_cap(rows, {"org": 5, "user": 50, "session": 40}).select("record_id", "scope")


# DuckDB has no case folding beyond lower case: sharp s is all that these texts need more.
_FOLDED = r"regexp_replace(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')), '[.,;:!? ]+$', '')"
_SENTENCE = f"trim(regexp_replace(regexp_replace({_FOLDED}, '^({'|'.join(T.FRAMES)})[ \\t:,–—-]*', ''), '^(the|an|a) ', ''))"
_NORM = f"""rec as (select doc_id::varchar as record_id, lang as scope, text from documents),
sets as (select record_id, scope, list_distinct(list_filter(string_split_regex({_SENTENCE}, '[^a-z0-9]+'), lambda w: length(w) > 1)) as w from rec),
u as (select record_id, scope, len(w) as n, unnest(w) as word from sets where len(w) > 0),
shared as (select a.record_id as a, b.record_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c from u a join u b on a.scope is not distinct from b.scope and a.word = b.word and a.record_id < b.record_id group by 1, 2),
pairs as (select a, b, round(c / (n + m - c), 6) as jaccard from shared where round(c / (n + m - c), 6) >= 0.6),
sorted as (select record_id, scope, list_sort(w) as w from sets where len(w) > 0),
heads as (select scope, w, min(record_id) as head from sorted group by 1, 2),
named as (select record_id, head from sorted s join heads h on s.scope is not distinct from h.scope and s.w = h.w),
-- equal sets are linked with the first of them, and only that one with other sets
links as (select a, b, jaccard from pairs where a in (select head from heads) and b in (select head from heads) union all select head, record_id, 1.0 from named where head <> record_id),
both_ways as (select a, b, jaccard from links union all select b, a, jaccard from links)"""


def _documents(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("scope"), "text")


@query("memory_near_copies", f"with {_NORM} select rec.record_id as id, count(b) as links, round(coalesce(max(jaccard), 0), 6) as nearest from rec left join both_ways on a = rec.record_id group by 1")
def memory_near_copies(spark, folder):
    """Each document, as a record of its language's scope, with the number of its links and its nearest copy's similarity."""
    docs = _documents(spark, folder)
    pairs = cut(memory.similar_pairs(docs, ("scope",)), "similar-pairs")
    ends = pairs.select(F.col("a").alias("id"), "jaccard").unionByName(pairs.select(F.col("b").alias("id"), "jaccard"))
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.max("jaccard").alias("nearest"))
    found = docs.select(F.col("record_id").alias("id")).join(counted, "id", "left")
    return found.select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("nearest", F.lit(0.0)).alias("nearest"))


_CLUSTERS = f"""with recursive {_NORM}, reach as (select a as id, a as other from both_ways union select reach.id, b from reach join both_ways on a = other),
known as (select id, min(other) as cluster from reach group by 1), sums as (select a as id, count(*) as links, sum(jaccard::decimal(18, 6)) as total from both_ways group by 1),
found as (select record_id as id, coalesce(cluster, record_id) as cluster, coalesce(links, 0) as links, coalesce(total, 0) as total from rec left join known on known.id = record_id left join sums on sums.id = record_id),
clusters as (select id, cluster, links, row_number() over (partition by cluster order by total desc, id) = 1 as medoid from found)"""


@query("memory_clusters", f"{_CLUSTERS} select * from clusters")
def memory_clusters(spark, folder):
    """Each document's cluster of near copies, its links, and whether it stands for the cluster."""
    return memory.clusters(_documents(spark, folder), ("scope",))


@query("memory_compaction", f"{_CLUSTERS} select cluster, min(id) filter (medoid) as canonical, count(*) - 1 as absorbed from clusters group by 1 having count(*) > 1")
def memory_compaction(spark, folder):
    """What compaction keeps: the record that stands for each cluster, and how many it takes in."""
    return memory.compaction(memory.clusters(_documents(spark, folder), ("scope",)))


@query(
    "user_sessions",
    """with e as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute then 1 else 0 end as b from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(b) over (partition by user_id order by ts, event_id) as session from e)
    select user_id, session::bigint as session, count(*) as n, round(sum(value), 4) as value, count(distinct event_type) as types from s group by 1, 2""",
)
def user_sessions(spark, folder):
    events = memory.sessions(table(spark, folder, "events"))
    return events.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.countDistinct("event_type").alias("types"))


@query(
    "path_affinity",
    r"""with p as (select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') as s from pages),
    m as (select host, min(s) as lo, max(s) as hi from p group by 1)
    select host, array_to_string(lo[1:coalesce(list_max(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0)], '/') as prefix from m""",
)
def path_affinity(spark, folder):
    """The folders that all pages of a host share."""
    pages = table(spark, folder, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return memory.shared_prefix(pages, "host")


@query(
    "conversation_summary",
    """select conv_id, count(*) as turns, count(*) filter (role = 'user') as asked, sum(length(text))::bigint as chars, sha256(string_agg(text, chr(10) order by turn)) as text_hash from conversations group by 1""",
)
def conversation_summary(spark, folder):
    """Each conversation's text put together in order."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).cast("long").alias("chars"), F.sha2(ordered, 256).alias("text_hash")
    )
