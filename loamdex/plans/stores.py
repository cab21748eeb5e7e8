"""Queries over tables that change: digests, differences, inserts, folds, and summaries of what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import chunking, graph, intervals, memory
from loamdex.plans.graph import _GRAPH, _graph
from loamdex.plans.memory import _RECORDS, _SENTENCE, _documents, _records
from loamdex.plans.registry import query
from loamdex.session import table
from loamdex.sources import files


@query("graph_fold", f"with recursive {_GRAPH} select count(*) as n, bit_xor(('0x' || substr(sha256(src || chr(31) || dst || chr(31) || type), 1, 15))::bigint) as fold from edges")
def graph_fold(spark, folder):
    """An order-free digest of all edges."""
    return graph.fold(_graph(spark, folder)[1], "src", "dst", "type")


@query(
    "row_changes",
    """with a as (select doc_id, n_chars from documents where source <> 'src0'), b as (select doc_id, case when lang = 'de' then n_chars + 1 else n_chars end as n from documents where source <> 'src1')
    select doc_id, case when n_chars is null then 'added' when n is null then 'removed' else 'changed' end as change from a full join b using (doc_id) where n_chars is distinct from n""",
)
def row_changes(spark, folder):
    """What was added, removed and changed between two states of the documents."""
    docs = table(spark, folder, "documents")
    after = docs.filter("source != 'src1'").withColumn("n_chars", F.when(F.col("lang") == "de", F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return graph.delta(docs.filter("source != 'src0'"), after, "doc_id", "n_chars")


@query("replaced_labels", "select doc_id, case when toxic = 1 then 0 else quality end as quality, toxic from labels")
def replaced_labels(spark, folder):
    """Labels, where those of toxic documents were written anew."""
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return files.replace_rows(labels, labels.filter("toxic = 1").withColumn("quality", F.lit(0).cast(dict(labels.dtypes)["quality"])), "doc_id")


@query("inserted_labels", "select doc_id, case when quality = 1 then 1 else -1 end::bigint as quality from labels")
def inserted_labels(spark, folder):
    """Labels of good documents, and after inserting all again those that weren't there."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    again = labels.select("doc_id", F.lit(-1).cast("long").alias("quality"))
    return files.insert_once(labels.filter("quality = 1"), again.unionByName(again), "doc_id")


@query("carried_over", f"with {_RECORDS} select record_id, case when turn % 2 = 0 then conv_id + turn else 0 end::bigint as uses from rec")
def carried_over(spark, folder):
    """A rebuilt projection that keeps the uses which half of the records had earned."""
    fresh = _records(spark, folder)
    old = fresh.filter("turn % 2 = 0").select("record_id", (F.col("conv_id") + F.col("turn")).alias("uses"))
    return memory.carry_over(fresh.select("record_id"), old, {"uses": 0}).select("record_id", F.col("uses").cast("long").alias("uses"))


@query(
    "canonical_statements",
    f"""with k as (select doc_id, sha256(coalesce(lang, '') || chr(31) || coalesce(source, '') || chr(31) || 'fact' || chr(31) || {_SENTENCE}) as key from documents)
    select key, arg_min(doc_id::varchar, lpad(doc_id::varchar, 12, '0')) as record_id, count(*) as observations from k group by 1""",
)
def canonical_statements(spark, folder):
    """Documents as statements: equal ones folded into the earliest."""
    rows = _documents(spark, folder).join(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("subject")), "record_id")
    return memory.canonical(rows.withColumns({"kind": F.lit("fact"), "asserted_at": F.lpad("record_id", 12, "0")}))


@query(
    "subsumption_heads",
    f"""with recursive {_RECORDS}, s as (select record_id, case when turn % 4 <> 0 then 'm' || conv_id || '-' || (turn - 1) end as above from rec),
    walk as (select record_id, record_id as head, 0 as hops from s union all select w.record_id, s.above, hops + 1 from walk w join s on s.record_id = w.head where s.above is not null and hops < 8)
    select record_id, arg_max(head, hops) as head from walk group by 1""",
)
def subsumption_heads(spark, folder):
    """The record at the end of each chain, where turns are subsumed by the one before, four to a chain."""
    above = F.when(F.col("turn") % 4 != 0, F.concat(F.lit("m"), "conv_id", F.lit("-"), F.col("turn") - 1))
    return memory.subsumed_by(_records(spark, folder).select("record_id", above.alias("subsumed_by")))


@query("tier_counts", f"with {_RECORDS} select scope, coalesce(nullif(tier, ''), 'hot') as tier, count(*) as n from rec group by 1, 2")
def tier_counts(spark, folder):
    return _records(spark, folder).groupBy("scope", F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("hot")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("source_overview", "select source, count(*) as documents, count(l.doc_id) as labelled, sum(n_chars)::bigint as chars, count(distinct lang) as langs from documents left join labels l using (doc_id) group by 1")
def source_overview(spark, folder):
    """Counters of every source."""
    labelled = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("labelled"))
    rows = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars").join(labelled, "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("labelled").alias("labelled"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))


@query("described_tables", " union all ".join(f"select '{t}' as \"table\", count(*) as rows, (select count(*) from (describe {t}))::int as columns from {t}" for t in files.TABLES))
def described_tables(spark, folder):
    """Every table's rows and columns."""
    return files.describe(spark, folder).select("table", "rows", "columns")


@query(
    "exported_nodes",
    f"""with recursive {_GRAPH} select id, type, label, '{{"host":"' || split_part(split_part(id, ':', 2), '/', 1) || '","depth":' || (length(id) - length(replace(id, '/', ''))) || '}}' as bag from nodes""",
)
def exported_nodes(spark, folder):
    """Nodes with columns of their own for what all have, and a bag of JSON for the rest."""
    nodes = _graph(spark, folder)[0]
    rest = {"host": F.split_part(F.split_part("id", F.lit(":"), F.lit(2)), F.lit("/"), F.lit(1)), "depth": F.length("id") - F.length(F.replace("id", F.lit("/"), F.lit("")))}
    return graph.with_bag(nodes.withColumns(rest), ("id", "type", "label"))


@query(
    "busy_time",
    """with e as (select user_id, ts as b, ts + to_microseconds((value * 60000000)::bigint) as e from events where value > 0),
    o as (select *, case when b > max(e) over w then 1 when max(e) over w is null then 1 else 0 end as opens from e window w as (partition by user_id order by b, e rows between unbounded preceding and 1 preceding)),
    s as (select *, sum(opens) over (partition by user_id order by b, e rows between unbounded preceding and current row) as span from o),
    g as (select user_id, span, min(b) as b, max(e) as e from s group by 1, 2)
    select user_id, round(sum(epoch_us(e) - epoch_us(b)) / 1e6, 3) as covered, count(*) as spans from g group by 1""",
)
def busy_time(spark, folder):
    """How long each user is busy, where an event keeps them so for its value in minutes and events overlap."""
    begin = F.col("ts").cast("timestamp")
    rows = table(spark, folder, "events").filter("value > 0").select("user_id", begin.alias("begin"), F.timestamp_micros(F.unix_micros(begin) + F.round(F.col("value") * 60_000_000).cast("long")).alias("end"))
    return intervals.covered(rows, "user_id")


@query(
    "value_rates",
    """with x as (select user_id, count(*) as samples, min({'t': ts, 'v': value}) as a, max({'t': ts, 'v': value}) as b from events group by 1)
    select user_id, samples, round((b.v - a.v) / nullif((epoch_us(b.t) - epoch_us(a.t)) / 1e6, 0), 9) as rate from x""",
)
def value_rates(spark, folder):
    """How fast each user's value changes between first and last event."""
    return intervals.rate(table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value"), "user_id")


_TURNS = f"""turns as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as answer, lead(role) over (partition by conv_id order by turn) as next from conversations),
asked as (select conv_id, turn, {_SENTENCE} as question, case when next = 'assistant' then answer end as answer from turns where role = 'user')"""


@query(
    "asked_questions",
    f"""with {_TURNS} select question, count(*) as asked, min(conv_id) as first_conv, sha256(coalesce(arg_max(answer, conv_id * 100000 + turn) filter (answer is not null), '')) as answer_hash from asked group by 1""",
)
def asked_questions(spark, folder):
    """Different questions of all conversations, how often and where first they are asked, and their last answer."""
    found = memory.questions(table(spark, folder, "conversations"))
    return found.select("question", "asked", "first_conv", F.sha2(F.coalesce("answer", F.lit("")), 256).alias("answer_hash"))


@query(
    "unanswered_terms",
    """with w as (select distinct conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from conversations),
    a as (select conv_id, term from w where role = 'user'), b as (select distinct term from w where role = 'assistant')
    select term, count(*) as conversations from a where length(term) > 3 and term not in (select term from b) group by 1 having count(*) >= 2""",
)
def unanswered_terms(spark, folder):
    """Terms that users of two conversations and more ask for, and no answer holds."""
    return memory.unanswered(table(spark, folder, "conversations"), least=2)


@query(
    "chunked_artifacts",
    """with l as (select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1)
    select d.doc_id, source, coalesce(n, 0) as lines, text is not null and trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' as chunked from documents d left join l using (doc_id)""",
)
def chunked_artifacts(spark, folder):
    """Each document's lines, and whether it has chunks."""
    docs = table(spark, folder, "documents")
    counted = chunking.chunks(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    lines = F.size(F.split("text", "\n")).cast("long")
    return docs.select("doc_id", "source", F.coalesce(lines, F.lit(0)).alias("lines")).join(counted, "doc_id", "left").select("doc_id", "source", "lines", F.col("chunks").isNotNull().alias("chunked"))


@query(
    "word_singulars",
    f"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents)
    select word, case when word in ({', '.join(repr(x) for x in T.SINGULAR)}) or length(word) < 4 or word like '%ss' then word when word like '%ies' then left(word, -3) || 'y'
      when regexp_matches(word, '(s|x|z|ch|sh)es$') then left(word, -2) when word like '%s' then left(word, -1) else word end as singular from w""",
)
def word_singulars(spark, folder):
    words = table(spark, folder, "documents").select(F.explode(T.index_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.singular(F.col("word")).alias("singular"))


_CASED = "select distinct unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*')) as name from documents"


@query(
    "identifier_terms",
    f"""with n as ({_CASED}), p as (select name, list_filter(string_split_regex(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '') as parts from n)
    select name, array_to_string(list_transform(parts, lambda x: lower(x)), ' ') as term from p""",
)
def identifier_terms(spark, folder):
    """Words of all documents as identifiers, in their normal form."""
    names = table(spark, folder, "documents").select(F.explode(T.extract_all(F.col("text"), "[A-Za-z][A-Za-z0-9_]*")).alias("name")).distinct()
    return names.select("name", T.normalize_term(F.col("name")).alias("term"))


_MARKED = """select turn + conv_id * 1000 as id, case turn % 4 when 0 then '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || text when 1 then '[' || left(text, 6) || '](docs/' || conv_id || '.md) [[wiki-' || turn || ']] ' || text
  when 2 then text || ' [@smith-' || conv_id || '] [v1.2] [x] [Smith-' || conv_id || '] https://example.com/' || turn || ')' else text end as text from conversations"""


def _marked(spark, folder):
    """(id, text): turns dressed with front matter, links and citations in turn."""
    return table(spark, folder, "conversations").selectExpr("*").select((F.col("turn") + F.col("conv_id") * 1000).alias("id"), F.expr(_MARKED.split(" as id, ", 1)[1].rsplit(" as text from", 1)[0].replace("chr(10)", "'\\n'")).alias("text"))


@query(
    "marked_up_turns",
    rf"""with m as ({_MARKED}), c as (select *, regexp_extract_all(text, '\[@?([A-Za-z0-9_.:-]+)\]', 1) as found from m),
    g as (select *, list_filter(found, lambda x: length(x) >= 3 and lower(x) not in ('x', 'ok', 'tbd', 'todo', 'na', 'n/a', 'unreleased', 'yes', 'no', 'y', 'n') and not regexp_matches(x, '{T.VERSION}')) as good from c)
    select id, sha256(regexp_replace(text, '^---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|$)', '')) as body_hash,
      array_to_string(list_filter(good, lambda x, i: list_position(list_transform(good, lambda y: lower(y)), lower(x)) = i), ' ') as citations,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\[[^\]]+\]\(([^)]+)\)', 1) || regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1) || regexp_extract_all(text, 'https?://[^\s)>\]]+'))), ' ') as links from g""",
)
def marked_up_turns(spark, folder):
    """Bodies, citations and links of turns with mark-up."""
    text = F.col("text")
    return _marked(spark, folder).select("id", F.sha2(T.strip_frontmatter(text), 256).alias("body_hash"), F.array_join(T.citations(text), " ").alias("citations"), F.array_join(T.markdown_links(text), " ").alias("links"))


@query(
    "safe_names",
    r"""with b as (select page_id, string_split(replace(url, '\', '/'), '/')[-1] as base from pages), c as (select page_id, left(regexp_replace(regexp_replace(base, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', ''), 120) as name from b)
    select page_id, case when name = '' then 'upload' else name end as name from c""",
)
def safe_names(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("redacted_turns", "select conv_id, turn, case when length(text) > 200 then left(text, 200) || '…' else text end as text from conversations")
def redacted_turns(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", T.redacted(F.col("text")).alias("text"))


@query("question_ids", r"select item_id, left(sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 16) as query_id from benchmark")
def question_ids(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", T.query_id(F.col("text")).alias("query_id"))


@query(
    "trace_headers",
    """with h as (select event_id, '00-' || case when event_id % 7 = 0 then repeat('0', 32) else md5(user_id::varchar) end || '-' || left(md5(event_id::varchar), case when event_id % 11 = 0 then 15 else 16 end) || '-01' as header from events)
    select event_id, case when ok then substr(header, 4, 32) end as trace_id, case when ok then substr(header, 37, 16) end as span_id from (select *, event_id % 7 <> 0 and event_id % 11 <> 0 as ok from h)""",
)
def trace_headers(spark, folder):
    """Trace and span of each event's header, of which some are broken."""
    md5 = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    header = F.concat(F.lit("00-"), F.when(F.col("event_id") % 7 == 0, F.lit("0" * 32)).otherwise(md5("user_id")), F.lit("-"), F.substring(md5("event_id"), F.lit(1), F.when(F.col("event_id") % 11 == 0, 15).otherwise(16)), F.lit("-01"))
    return table(spark, folder, "events").select("event_id", T.traceparent(header).alias("t")).select("event_id", "t.trace_id", "t.span_id")
