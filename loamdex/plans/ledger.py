"""Queries over the interaction ledger, as streams and in batch, and over files and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import chunking, retrieval
from loamdex.plans.registry import query
from loamdex.session import scratch, table
from loamdex.streaming import ledger


@query("stream_once", "select event_id, user_id, event_type, round(value, 6) as value from events qualify row_number() over (partition by event_id order by ts) = 1")
def stream_once(spark, folder):
    """Every event once, from a stream of several files that repeat some."""
    home = scratch(spark, "delivered")
    once = ledger.once(ledger.read(spark, home))
    rows = once.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
    return ledger.drain(rows, ledger.deliver(table(spark, folder, "events"), home))


@query(
    "stream_tumbling",
    """with e as (select *, min(ts) over () as a, max(ts) over () as b from events), k as (select * from e where not (event_type = 'error' and ts < a + to_microseconds(((epoch_us(b) - epoch_us(a)) / 4)::bigint)))
    select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as value from k where date_trunc('day', ts) + interval 1 day <= b - interval 1 hour group by 1, 2""",
)
def stream_tumbling(spark, folder):
    """Windows of a day that are closed, from a stream that repeats events and brings some too late to count."""
    home = scratch(spark, "delivered")
    windows = ledger.tumbling(ledger.once(ledger.read(spark, home)), lateness=None)
    windows = ledger.drain(windows, ledger.deliver(table(spark, folder, "events"), home, late="event_type = 'error'", parts=4))
    return windows.select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


@query(
    "stream_sliding",
    """select strftime(b, '%Y-%m-%d %H:%M') as begin, count(*) as n from (select unnest([to_timestamp(floor(epoch(ts) / 21600) * 21600 - i * 21600)::timestamp for i in range(0, 4)]) as b from events) group by 1""",
)
def stream_sliding(spark, folder):
    """Overlapping windows of a day, appended when the watermark has closed them."""
    home = scratch(spark, "delivered")
    windows = ledger.drain(ledger.sliding(ledger.read(spark, home)), ledger.deliver(table(spark, folder, "events"), home, parts=2, repeated="0 seconds", closing="3 days"))
    return windows.select(F.date_format("begin", "yyyy-MM-dd HH:mm").alias("begin"), "n")


@query(
    "stream_sessions",
    """with e as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as b from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(b) over (partition by user_id order by ts, event_id) as session from e)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as begin, count(*) as n from s group by user_id, session""",
)
def stream_sessions(spark, folder):
    """Each user's sessions by event time; a pause of half an hour ends one."""
    home = scratch(spark, "delivered")
    windows = ledger.drain(ledger.sessions(ledger.read(spark, home)), ledger.deliver(table(spark, folder, "events"), home, parts=2, repeated="0 seconds", closing="3 days"))
    return windows.select("user_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n")


@query(
    "retained_days",
    """select strftime(ts, '%Y-%m-%d') as day, count(*) as n, case when ts::date < date '2024-01-20' then 'cold' else 'hot' end as kept from events where ts::date >= date '2024-01-06' group by 1, 3""",
)
def retained_days(spark, folder):
    """Events of each day that is still there, when days before the 20th have been rolled into folders and those before the 6th dropped."""
    events, path = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), scratch(spark, "rolled")
    hot = ledger.roll(events, path, "2024-01-20")
    ledger.drop_days(spark, path, "2024-01-06")
    cold = spark.read.parquet(path).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("cold").alias("kept"))
    both = cold.unionByName(hot.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("hot").alias("kept")))
    return both.groupBy("day", "kept").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_gaps",
    """select event_type, json_extract_string(props, '$.k')::bigint as k, count(*) as n, count(distinct user_id) as users from events group by 1, 2 having count(*) >= 3 and count(distinct user_id) >= 2""",
)
def ledger_gaps(spark, folder):
    return ledger.gaps(table(spark, folder, "events"))


@query(
    "ledger_histogram",
    "select event_type, " + ", ".join(f"count(*) filter (value <= {b}) as le_{b}" for b in (5, 10, 50, 100, 500)) + ", count(*) as le_inf from events group by 1",
)
def ledger_histogram(spark, folder):
    """A cumulative histogram with fixed bounds."""
    bounds = [F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (5, 10, 50, 100, 500)]
    return table(spark, folder, "events").groupBy("event_type").agg(*bounds, F.count(F.lit(1)).alias("le_inf"))


_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def chunks_sql(size: int, overlap: int, rows: str = "documents", key: str = "doc_id") -> str:
    """SQL for chunks of rows with a text, ``chunked`` (key, chunk_index, start_line, end_line, piece)."""
    return rf"""
    cuts as (
      select {key}, text, length(text) as n, -1 as begin, 0 as until from {rows} where length(text) > 0
      union all select {key}, text, n, nb, case when nb + {size} >= n then n when cut > {size // 2} then nb + cut else nb + {size} end
      from (select *, case when strpos(reverse(substr(text, nb + 1, {size})), chr(10)) = 0 then -1 else {size} - strpos(reverse(substr(text, nb + 1, {size})), chr(10)) end as cut
        from (select *, case when begin < 0 then 0 else greatest(until - {overlap}, begin + 1) end as nb from cuts where until < n))),
    pieces as (select *, regexp_replace(substr(text, begin + 1, until - begin), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') as piece from cuts where begin >= 0),
    chunked as (select {key}, (row_number() over (partition by {key} order by begin) - 1)::int as chunk_index, (length(substr(text, 1, begin)) - length(replace(substr(text, 1, begin), chr(10), '')) + 1)::int as start_line,
      (length(substr(text, 1, until)) - length(replace(substr(text, 1, until), chr(10), '')) + 1)::int as end_line, piece from pieces where piece <> '')"""


@query(
    "document_chunks",
    f"""with recursive {chunks_sql(4000, 400)}
    select doc_id, chunk_index, start_line, end_line, length(piece)::int as chars, sha256(piece) as text_hash, greatest(1, length(piece) // 4)::bigint as token_estimate from chunked""",
)
def document_chunks(spark, folder):
    """Chunks of every document."""
    rows = chunking.chunks(table(spark, folder, "documents"))
    return rows.select("doc_id", "chunk_index", "start_line", "end_line", F.length("text").alias("chars"), "text_hash", "token_estimate")


@query("page_headings")
def page_headings(spark, folder):
    """Headings of every page with their paths and the numbers in them; tests hold them against a plain stack."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), T.html_outline(F.col("html")).alias("text"))
    heads = chunking.headings(pages)
    paths = chunking.heading_paths(heads).select("doc_id", "line", "level", "kind", "parent_line", "path")
    return paths.join(heads.select("doc_id", "line", F.array_join(chunking.ordinal(F.col("number")), ".").alias("ordinal")), ["doc_id", "line"])


@query("document_vectors")
def document_vectors(spark, folder):
    """Hashed vectors of every document's distinct tokens; tests check the vectors."""
    rows = table(spark, folder, "documents").select("doc_id", F.array_distinct(T.index_tokens(F.col("text"))).alias("tokens"))
    return retrieval.hash_embedding(rows).select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(
    "source_signatures",
    f"""with t as (select source, ('0x' || substr(md5(term), 1, 7))::bigint as h from (select distinct source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents)),
    m as (select source, i, min((h * (i * 48271 % {retrieval.PRIME - 1} + 11) + i * 69621 + 7) % {retrieval.PRIME}) as least from t cross join range(64) r(i) group by 1, 2)
    select a.source as a, b.source as b, count(*) / 64 as jaccard from m a join m b on a.i = b.i and a.least = b.least and a.source < b.source group by 1, 2""",
)
def source_signatures(spark, folder):
    """How alike the sources' vocabularies are, by minima of hashes."""
    terms = table(spark, folder, "documents").select("source", F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("term"))
    return retrieval.estimated_jaccard(retrieval.minhash(terms, "source", 64), "source")
