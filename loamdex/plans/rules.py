"""Queries over files, access, policies and steering rules, all made from the documents and their readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import filters, graph, lexical
from loamdex.operators.filters import MemoryPolicy
from loamdex.plans.registry import query
from loamdex.plans.search import _TOKENS
from loamdex.session import table
from loamdex.sources import files

#: Endings that the documents' paths take in turn.
ENDINGS = (".md", ".py", ".json", ".png", ".wav", ".bin", "")
_PATHS = f"paths as (select doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || [{', '.join(repr(e) for e in ENDINGS)}][doc_id % 7 + 1] as path, sha256(text) as sha256, n_chars as size from documents)"


def _paths(spark, folder):
    """(doc_id, path, sha256, size): documents as files in folders of their source and language."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), ending))
    return table(spark, folder, "documents").select("doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))


@query(
    "artifact_types",
    f"""with {_PATHS}, e as (select doc_id, path, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as e from paths)
    select doc_id, path, case when e in ('md', 'rst', 'txt', 'html', 'htm', 'pdf', 'docx', 'rtf', 'epub') then 'document' when e in ('py', 'js', 'ts', 'java', 'go', 'rs', 'c', 'cpp', 'rb', 'sh', 'sql') then 'code'
      when e in ('json', 'yaml', 'yml', 'csv', 'parquet', 'toml', 'xml') then 'data' when e in ('png', 'jpg', 'jpeg', 'gif', 'svg', 'webp') then 'image' when e in ('mp3', 'wav', 'm4a', 'ogg') then 'audio' else 'other' end as type from e""",
)
def artifact_types(spark, folder):
    return _paths(spark, folder).select("doc_id", "path", T.artifact_type(F.col("path")).alias("type"))


@query(
    "source_listing",
    f"""with {_PATHS} select path, length(path) - length(replace(path, '/', '')) as depth, size, size > 5000 as oversize from paths
    where (regexp_matches(path, '^src[0-9]+/(en|de)/.*$') or path like '%.py') and not (path like '%.bin' or path like '/src1/%' or path like 'src1/%')""",
)
def source_listing(spark, folder):
    """Files that a source takes by its globs and budget."""
    rows = _paths(spark, folder).select("path", "size").withColumn("modified", F.lit(None).cast("timestamp"))
    found = files.taken(rows, include=("src*/en/*", "src*/de/*", "*.py"), exclude=("*.bin", "/src1/*"), max_bytes=5000)
    return found.select("path", F.col("depth").cast("long").alias("depth"), "size", "oversize")


@query(
    "listing_depths",
    """with d as (select length(p) - length(replace(p, '/', '')) as depth, count(*) as files from (select regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as p from pages) group by 1)
    select depth, files, sum(files) over (order by depth)::bigint as so_far from d""",
)
def listing_depths(spark, folder):
    """Pages at each depth, and down to it."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = table(spark, folder, "pages").select((F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("long").alias("depth"))
    return files.depth_counts(rows)


@query(
    "files_to_read",
    f"with {_PATHS} select path, sha256 from paths where not (path like 'src0/%' or path like '%.md') or path like 'src0/%.py'",
)
def files_to_read(spark, folder):
    """Files whose content a sync hasn't seen: of what it saw of one source, code has changed since."""
    rows = _paths(spark, folder).select("path", "sha256")
    known = rows.filter("path like 'src0/%' or path like '%.md'").withColumn("sha256", F.when(F.expr("path like 'src0/%.py'"), F.lit("old")).otherwise(F.col("sha256")))
    return filters.to_read(rows, known)


_ACL = """case doc_id % 5 when 0 then '' when 1 then '{"public": true}' when 2 then '{"allow": ["g' || (doc_id % 3) || '"]}' when 3 then '{"allow": ["u' || (doc_id % 11) || '"], "public": false}' else '{broken' end"""


@query(
    "access_granted",
    f"""with e as (select event_id, 'u' || user_id as me, ['u' || user_id, 'g' || (user_id % 3)] as ids, user_id, json_extract_string(props, '$.k')::bigint as doc_id from events),
    a as (select event_id, doc_id, case when user_id % 10 = 0 then null else ids end as ids, {_ACL} as acl from e join documents using (doc_id)),
    j as (select *, case when json_valid(acl) then acl else '{{}}' end as j, json_valid(acl) as readable from a)
    select event_id, doc_id, case when ids is null then true when acl = '' then false else readable and (coalesce(json_extract_string(j, '$.public') = 'true', false) or coalesce(list_has_any(json_extract(j, '$.allow')::varchar[], ids), false)) end as granted from j""",
)
def access_granted(spark, folder):
    """Whether the user of each event may read the document that it names, by rules that may be missing or broken."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id"))
    rows = events.join(table(spark, folder, "documents").select("doc_id", F.expr(_ACL.replace("''", "''")).alias("acl")), "doc_id")
    principal = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id")))
    ids = filters.identities(principal, F.array(F.concat(F.lit("g"), F.col("user_id") % 3)))
    return rows.select("event_id", "doc_id", filters.allowed(F.col("acl"), ids).alias("granted"))


_MODES = ("auto", "only", "off", "prefer")
_RECORD = """select doc_id::varchar as record_id, case doc_id % 9 when 8 then 'alias' else 'fact' end as kind, case doc_id % 4 when 0 then 'cold' when 1 then '' else 'hot' end as tier, lang as scope, source as subject,
  case doc_id % 3 when 0 then '2024-01-10T00:00:00Z' else '' end as valid_from, case doc_id % 6 when 5 then '2024-01-05T00:00:00Z' else '' end as valid_until from documents where source in ('src0', 'src1')"""


@query(
    "memory_filtered",
    f"""with r as ({_RECORD}), f as (select record_id, kind = 'fact' and coalesce(nullif(tier, ''), 'hot') in ('hot', 'cold') and (valid_from = '' or valid_from <= '2024-01-08T00:00:00Z') and (valid_until = '' or valid_until > '2024-01-08T00:00:00Z') as fits from r)
    select mode, doc_id from documents left join f on record_id = doc_id::varchar cross join (select unnest(['auto', 'only', 'off', 'prefer']) as mode)
    where case when mode = 'off' then record_id is null when record_id is null then mode <> 'only' else fits end""",
)
def memory_filtered(spark, folder):
    """Documents that a search sees under each mode, where those of two sources are memory records."""
    docs = table(spark, folder, "documents")
    records = docs.filter("source in ('src0', 'src1')").selectExpr(*[x.strip() for x in _RECORD.replace("::varchar", "").replace("doc_id as record_id", "cast(doc_id as string) as record_id").removeprefix("select ").split(" from documents")[0].replace("\n", " ").split(", ") if x.strip()])
    out = None
    for mode in _MODES:
        policy = MemoryPolicy(mode=mode, as_of="2024-01-08T00:00:00Z")
        seen = filters.memory_filter(docs.select("doc_id"), records, policy, "2024-06-01T00:00:00Z").select(F.lit(mode).alias("mode"), "doc_id")
        out = seen if out is None else out.unionByName(seen)
    return out


#: How rules are written from an item's first words.
_FORMS = (
    ("alias", "w[1] || ' -> ' || w[2] || ', ' || w[3]"), ("alias", "w[1] || ' means ' || w[2]"),
    ("preference", "'When: ' || w[1] || ', ' || w[4] || ' -> prefer: src1/' || w[2] || '/'"), ("preference", "'prefer: ' || w[1]"), ("exclusion", "'Never: ' || w[5] || ' '"), ("exclusion", "w[5]"),
)
_RULES = "words as (select item_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark), rules as (" + " union all ".join(f"select item_id, {n} as form, '{k}' as kind, {x} as text from words" for n, (k, x) in enumerate(_FORMS)) + ")"
_ITEMS = "list_filter(list_transform(string_split({}, ','), lambda x: trim(lower(x))), lambda x: x <> '')"
_PARSED = f"""{_RULES}, parts as (select *, case kind when 'alias' then {_ITEMS.format("regexp_extract(text, '^\\s*([^,>:]+?)\\s*->\\s*(.+)$', 1)")} when 'preference' then {_ITEMS.format("regexp_extract(text, '(?i)^\\s*when:\\s*(.+?)\\s*->\\s*prefer:\\s*(\\S+)\\s*$', 1)")} else ['never'] end as terms,
  case kind when 'alias' then {_ITEMS.format("regexp_extract(text, '^\\s*([^,>:]+?)\\s*->\\s*(.+)$', 2)")}[1:8] when 'preference' then {_ITEMS.format("regexp_extract(text, '(?i)^\\s*when:\\s*(.+?)\\s*->\\s*prefer:\\s*(\\S+)\\s*$', 2)")} else {_ITEMS.format("regexp_extract(text, '(?i)^\\s*never:\\s*(\\S.*?)\\s*$', 1)")} end as vals from rules),
parsed as (select item_id, form, kind, terms, vals from parts where len(terms) > 0 and len(vals) > 0)"""


def _rules(spark, folder):
    """(item_id, form, kind, text): six rules for each item, of which three follow their grammar."""
    words = table(spark, folder, "benchmark").select("item_id", T.extract_all(F.col("text"), "[A-Za-z]+").alias("w"))
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.lit(k).alias("kind"), F.expr(_spark_form(x)).alias("text")) for n, (k, x) in enumerate(_FORMS)])
    return words.select("item_id", F.explode(forms).alias("r")).select("item_id", "r.*")


def _spark_form(sql: str) -> str:
    for n in range(1, 6):
        sql = sql.replace(f"w[{n}]", f"get(w, {n - 1})")
    return sql


def _parsed(spark, folder):
    rules = _rules(spark, folder).withColumn("rule", T.rule(F.col("kind"), F.col("text"))).filter("rule is not null")
    return rules.select("item_id", "form", "kind", F.col("rule.terms").alias("terms"), F.col("rule.values").alias("vals"))


@query("steering_rules", f"with {_PARSED} select item_id, form::int as form, kind, array_to_string(terms, '|') as terms, array_to_string(vals, '|') as vals from parsed")
def steering_rules(spark, folder):
    """Rules that follow their kind's grammar, taken apart."""
    return _parsed(spark, folder).select("item_id", "form", "kind", F.array_join("terms", "|").alias("terms"), F.array_join("vals", "|").alias("vals"))


@query(
    "expanded_tokens",
    f"""with {_TOKENS}, {_PARSED}, fired as (select distinct t.query_id, unnest(vals) as term from tokens t join (select unnest(terms) as term, vals from parsed where kind = 'alias') r using (term))
    select query_id, string_agg(term, ' ' order by term) as tokens from (select query_id, term from tokens union select query_id, term from fired) group by 1""",
)
def expanded_tokens(spark, folder):
    """Each item's tokens with what the alias rules of all items add."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), T.query_tokens(F.col("text")).alias("tokens"))
    rules = _parsed(spark, folder).filter("kind = 'alias'").select(F.explode("terms").alias("term"), F.col("vals").alias("values"))
    return lexical.expand_aliases(items, rules).select("query_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "preferred_paths",
    f"""with {_TOKENS}, {_PARSED} select distinct t.query_id, lower(v) as prefix from tokens t join (select unnest(terms) as term, vals from parsed where kind = 'preference') r using (term), unnest(vals) as x(v)""",
)
def preferred_paths(spark, folder):
    """Path prefixes that the preference rules of all items prefer for each item."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), T.query_tokens(F.col("text")).alias("tokens"))
    rules = _parsed(spark, folder).filter("kind = 'preference'").select("terms", F.col("vals").alias("values"))
    return lexical.preferred(items, rules)


@query(
    "excluded_documents",
    f"""with {_PARSED}, never as (select distinct unnest(vals) as fragment from parsed where kind = 'exclusion'), {_PATHS}, t as (select doc_id, lower(regexp_extract(text, '^[^.\\n]*', 0)) as title from documents)
    select doc_id from t where exists (select 1 from never where contains(title, fragment))""",
)
def excluded_documents(spark, folder):
    """Documents whose title holds what an exclusion rule names."""
    fragments = _parsed(spark, folder).filter("kind = 'exclusion'").select(F.explode("vals").alias("fragment")).distinct()
    titles = table(spark, folder, "documents").select("doc_id", F.regexp_extract("text", "^[^.\\n]*", 0).alias("title"))
    return filters.excluded(titles, "title", fragments).select("doc_id")


@query("sampled_traces", "select event_id from events where ('0x' || substr(md5(event_id::varchar), 1, 12))::bigint % 1000000 < 100000")
def sampled_traces(spark, folder):
    """A tenth of all events, always the same ones."""
    return table(spark, folder, "events").filter(filters.sampled(F.col("event_id"), 0.1)).select("event_id")


_LINKS = """refs as (select case doc_id % 3 when 0 then './' || regexp_replace(path, '[.][a-z]+$', '') when 1 then array_to_string(string_split(path, '/')[2:], '/') else path || '#part' end as ref from paths),
cleaned as (select distinct ref, regexp_replace(regexp_replace(ref, '[#?].*$', ''), '^[./]+', '') as c from refs),
endings as (select path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) as e from paths),
met as (select ref, path, 1 as step from cleaned join paths on path = c union all select ref, path, 2 from cleaned join paths on path = c || '.md' where not contains(c, '.')
  union all select ref, path, 3 from cleaned join paths on path = c || '.txt' where not contains(c, '.') union all select ref, path, 4 from cleaned join endings on e = c)"""


@query("resolved_links", f"with {_PATHS}, {_LINKS} select ref, path, step from met qualify row_number() over (partition by ref order by step, path) = 1")
def resolved_links(spark, folder):
    """The files that links in three spellings mean."""
    paths = _paths(spark, folder).select("doc_id", "path")
    tail = F.array_join(F.slice(F.split("path", "/"), F.lit(2), F.size(F.split("path", "/"))), "/")
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("./"), F.regexp_replace("path", "[.][a-z]+$", ""))).when(F.col("doc_id") % 3 == 1, tail).otherwise(F.concat("path", F.lit("#part")))
    return graph.resolve_links(paths.select(ref.alias("ref")), paths)
