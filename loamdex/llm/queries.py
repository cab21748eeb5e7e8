"""Registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers

from loamdex.llm import chat, codes, dac, decontaminate, language, mixing, neighbours, personal, quality, repair, simhash, suffixes, toxicity
from loamdex.session import cut, scratch, small, table
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@_query("op1_toxicity")
def op1(spark, folder):
    """Toxicity of every document."""
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op4_language")
def op4(spark, folder):
    """Language of every document."""
    return language.identify(table(spark, folder, "documents"))


@_query("op10_quality")
def op10(spark, folder):
    """Quality of every document."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op2_chat")
def op2(spark, folder):
    """Every conversation, and one more whose turns are control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.digests(chat.conversations(rows.unionByName(extra)))


_ESCAPED = f"replace(text, '{chat.MARK}', '{chat.MARK}0')"
for _control, _code in chat.CODES:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{chat.MARK}{_code}')"
ORACLES["op2_chat"] = f"""
with rows as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, lag(role) over (partition by conv_id order by turn) is distinct from role as opens, length({_ESCAPED}) as size from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size + case when opens then {len(chat.OPEN) + len(chat.ROLE_END) + len(chat.CLOSE)} + length(role) else {len(chat.NEXT)} end)::bigint as formatted_chars
from marked group by conv_id
"""


@_query("op3_mixing")
def op3(spark, folder):
    """The place of every document in the mix."""
    return mixing.mix(table(spark, folder, "documents"), keep=("doc_id", "source"))


@_query("op5_tokens")
def op5(spark, folder):
    """Token ids of every document, written and read back."""
    path = scratch(spark, "tokens")
    dac.write(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return dac.documents(spark, path)


@_query("op6_simhash")
def op6(spark, folder):
    """Fingerprint and component of every document."""
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op9_decontamination")
def op9(spark, folder):
    """Benchmark windows in every document."""
    found = decontaminate.inspect(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query("op7_neighbours")
def op7(spark, folder):
    """The nearest rows of every twentieth vector."""
    rows = table(spark, folder, "embeddings")
    return neighbours.search(rows, rows.filter("vec_id % 20 = 0"))


@_query("op8_suffixes")
def op8(spark, folder):
    """What is left of every document without strings that repeat anywhere."""
    found = suffixes.dedup(table(spark, folder, "documents"), first_stays=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query("op12_codes")
def op12(spark, folder):
    """Product codes of every vector, with each label's whole error and the digest of the codebooks."""
    made, books = codes.encode(table(spark, folder, "embeddings"), ["label"])
    made = cut(made, "vector-codes")
    sums = made.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))  # null where it is beyond a long
    joined = made.join(small(sums, 100_000), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    """SQL of one assignment and the codebook of its means."""
    return f"""
a{n} as materialized (select v.i, v.p, arg_min(b.k, (v.xx + b.cc - 2 * list_inner_product(v.x, b.c))::bigint * 256 + b.k) as k,
  min((v.xx + b.cc - 2 * list_inner_product(v.x, b.c))::bigint) as d from v join b{n} b using (p) group by 1, 2),
c{n} as (select p, k, j, floor(sum(x[j]) / count(*)) as y from a{n} join v using (i, p), generate_series(1, (select w from wide)) g(j) group by 1, 2, 3),
b{n + 1} as materialized (select p, k, c, list_inner_product(c, c) as cc from (
  select b.p, b.k, coalesce(any_value(u.c), any_value(b.c)) as c from b{n} b left join (select p, k, list(y order by j) as c from c{n} group by 1, 2) u using (p, k) group by 1, 2))"""


ORACLES["op12_codes"] = f"""
with kept as (select row_number() over (order by vec_id nulls last, embedding) - 1 as i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
wide as (select ((max(len(e)) + 3) // 4)::bigint as w from kept),
v as materialized (select i, p, x, list_inner_product(x, x) as xx from (select i, p, list_transform(generate_series(1, w), lambda j: coalesce(e[p * w + j], 0::double)) as x from kept, wide, generate_series(0, 3) g(p))),
b0 as materialized (select p, i as k, x as c, xx as cc from v where i < 256),
{",".join(_assigned(n) for n in range(4))},
f as (select v.i, v.p, arg_min(b.k, (v.xx + b.cc - 2 * list_inner_product(v.x, b.c))::bigint * 256 + b.k) as k,
  min((v.xx + b.cc - 2 * list_inner_product(v.x, b.c))::bigint) as d from v join b4 b using (p) group by 1, 2),
coded as (select i, string_agg(printf('%02x', k::int), '' order by p) as code, sum(d)::bigint as error from f group by 1),
labelled as (select vec_id, label, code, error from coded join kept using (i)),
sums as (select label, sum(error)::bigint as label_error from labelled group by 1)
select vec_id, code, error, label_error,
  (select sha256(string_agg(x, ',' order by p, k, j)) from (select p, k, unnest(list_transform(c, lambda y: y::bigint::varchar)) as x, generate_subscripts(c, 1) as j from b4)) as codebooks_sha256
from labelled l join sums s on l.label is not distinct from s.label
"""


@_query("op11_repair")
def op11(spark, folder):
    """Every conversation with planted faults: what is wrong with it, and the cheapest edits that repair it."""
    return repair.report(repair.repair(repair.damage(table(spark, folder, "conversations"))))


ORACLES["op11_repair"] = r"""
with recursive crc(b, v, n) as (
  select b, b, 0 from generate_series(0, 255) t(b)
  union all select b, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, n + 1 from crc where n < 8
), lookup as materialized (select list(v order by b) as t from crc where n = 8),
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
hashed as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)), lambda x, b: xor(x // 256, t[xor(x, b) % 256 + 1])), 4294967295) % 20 as kind from raw, lookup),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, lateral (select unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)))),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
faults as materialized (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
  when right(rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1) in ('.', '!', '?') then 'none' else 'truncated' end as fault,
  i > 1 and left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) not in ('su', 'ua', 'au') as illegal from placed),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal from faults group by 1),
inserted(p, r, letters) as (values (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
edit(r, q, letter, price, initial) as (values (0, 0, 'D', 3, null), (1, 1, 'D', 3, null), (2, 2, 'D', 3, null), (3, 3, 'D', 3, null),
  (0, 2, 'R', 2, null), (1, 2, 'R', 2, null), (3, 2, 'R', 2, null), (2, 3, 'R', 2, null), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a')),
steps as materialized (select conv_id, i, p, q, 2 * length(letters) + price + case when letter <> 'D' and fault = 'truncated' then 1 else 0 end as price, letters || letter as letters
  from faults, inserted join edit using (r) where (initial is null or initial = left(role, 1)) and (letter = 'D' or fault not in ('blank', 'duplicate'))),
walk(conv_id, i, q, best) as (
  select distinct conv_id, 0::bigint, 0, {'cost': 0::bigint, 'audit': ''} from conversations
  union all
  select w.conv_id, w.i + 1, s.q, min({'cost': w.best.cost + s.price, 'audit': w.best.audit || s.letters}) from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1 and s.p = w.q group by 1, 2, 3
), ended as (select conv_id, i, min({'cost': best.cost + case q when 1 then 4 when 2 then 2 else 0 end, 'audit': best.audit || case q when 1 then 'II' when 2 then 'I' else '' end}) as best
  from walk group by 1, 2 qualify i = max(i) over (partition by conv_id)),
letters as (select conv_id, unnest(string_split(best.audit, '')) as letter, unnest(range(length(best.audit))) as n from ended where best.audit <> ''),
rowed as (select *, sum(case when letter <> 'I' then 1 else 0 end) over (partition by conv_id order by n) as i, sum(case when letter <> 'D' then 1 else 0 end) over (partition by conv_id order by n) as place from letters),
met as (select r.conv_id, n, place, letter, f.role, case when letter = 'I' then '' else f.text end as text from rowed r join faults f on f.conv_id is not distinct from r.conv_id and f.i = greatest(r.i, 1) where letter <> 'D'),
system as (select conv_id, max(case when place = 1 and letter = 'K' and left(role, 1) = 's' then 1 else 0 end) as s from met group by 1),
repaired as (select m.conv_id, sha256(string_agg(case when letter = 'K' then role when (place - s) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by n)) as sha
  from met m join system y on m.conv_id is not distinct from y.conv_id group by 1)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  best.cost as cost, best.audit as audit, coalesce(sha, sha256('')) as repaired_sha256
from ended e left join counts c on c.conv_id is not distinct from e.conv_id left join repaired r on r.conv_id is not distinct from e.conv_id
"""


@_query("op13_personal")
def op13(spark, folder):
    """Personal data in every document: counts and digest of what the patterns match, and all spans."""
    found = personal.find(table(spark, folder, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    matched = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, personal.KINDS), F.sha2(listed(matched).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
