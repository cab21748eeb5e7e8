"""Cohorts: which questions are evaluated together, and why. Each is a table (cohort, query_id, query, asked, first_asked)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.session import small

#: Questions of a cohort at most, of an anchor at least, cases of each invariant, days of the rolling one.
MOST, LEAST, CASES, DAYS = 200, 20, 25, 30
MOST_TRIGGERS = 500_000


def ledger(asks: DataFrame, least_results: int = 0) -> DataFrame:
    """(query_id, query, asked, first_asked): distinct questions of asks (query, at, results), however often they were repeated.

    A question is known by its canonical text; its first wording and time stay. Blank and null questions are none.
    """
    rows = asks.filter((F.trim("query") != "") & (F.col("results") >= least_results)).withColumn("query_id", T.query_id(F.col("query")))
    first = F.min_by("query", F.struct("at", "query"))
    return rows.groupBy("query_id").agg(first.alias("query"), F.count(F.lit(1)).alias("asked"), F.min("at").alias("first_asked"))


def chosen(questions: DataFrame, name: str, most: int = MOST) -> DataFrame:
    """The questions that are asked most often, as a cohort; ties go by id, which is a hash."""
    best = questions.orderBy(F.desc("asked"), "query_id").limit(most)
    return best.select(F.lit(name).alias("cohort"), "query_id", "query", "asked", "first_asked")


def anchor(asks: DataFrame, frozen: DataFrame | None = None, most: int = MOST, least: int = LEAST) -> DataFrame:
    """The cohort that all later states are compared on: once ``frozen`` it stays; with too few questions there is none yet.

    Only questions that found something qualify.
    """
    if frozen is not None and not frozen.isEmpty():
        return frozen
    questions = ledger(asks, least_results=1)
    enough = questions.agg((F.count(F.lit(1)) >= least).alias("enough"))
    return chosen(questions, "anchor", most).crossJoin(F.broadcast(enough)).filter("enough").drop("enough")  # one row


def rolling(asks: DataFrame, now: str, days: int = DAYS, most: int = MOST) -> DataFrame:
    """What was asked lately."""
    at = F.lit(now).cast("timestamp_ntz")
    return chosen(ledger(asks.filter(F.col("at") >= at - F.make_dt_interval(F.lit(days)))), "rolling", most)


def evidence(candidates: DataFrame) -> DataFrame:
    """(query_id, first_seen) of questions that gave rise to admitted or pending candidates (query, status, first_seen), with the earliest time."""
    live = candidates.filter(F.col("status").isin("admitted", "pending") & (F.trim("query") != ""))
    return live.groupBy(T.query_id(F.col("query")).alias("query_id")).agg(F.min("first_seen").alias("first_seen"))


def learned(asks: DataFrame, candidates: DataFrame, most: int = MOST) -> DataFrame:
    """Questions from which memory was learnt: recall of what is known, never proof that it generalises."""
    return chosen(ledger(asks).join(evidence(candidates).select("query_id"), "query_id", "left_semi"), "learned", most)


def holdout(asks: DataFrame, candidates: DataFrame, days: float = 0, most: int = MOST) -> DataFrame:
    """Questions first asked after the earliest candidate, and some days, that gave rise to none: nothing of them can have leaked.

    Without candidates there is nothing to hold out from, and the cohort is empty.
    """
    known = evidence(candidates)
    since = known.agg((F.min("first_seen") + F.make_dt_interval(secs=F.lit(days * 86_400.0))).alias("since"))
    later = ledger(asks).crossJoin(F.broadcast(since)).filter("first_asked > since").drop("since")  # one row
    return chosen(later.join(known.select("query_id"), "query_id", "left_anti"), "temporal_holdout", most)


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(T.index_tokens(text)), lambda t: F.length(t) > 1)


def control(asks: DataFrame, rules: DataFrame, most: int = MOST) -> DataFrame:
    """Questions on which no rule (terms, values) can fire: none of their words is in any rule's terms or values."""
    said = rules.select(F.explode(F.concat("terms", "values")).alias("t"))
    triggers = small(said.select(F.explode(_words(F.col("t"))).alias("word")).distinct(), MOST_TRIGGERS)
    questions = ledger(asks)
    touched = questions.select("query_id", F.explode(_words(F.col("query"))).alias("word")).join(triggers, "word").select("query_id").distinct()
    return chosen(questions.join(touched, "query_id", "left_anti"), "control", most)


def invariants(records: DataFrame, name: str, cases: int = CASES) -> DataFrame:
    """(cohort, query_id, query, kind, expected, forbidden, as_of, principal): cases that a right answer decides, made from memory ``records``.

    Records are (record_id, text, scope, written_by, supersedes, valid_from). A corrected record mustn't be served, but
    must at a time when it was valid; a record of one reader mustn't reach another; and what nobody ever wrote must find
    nothing.
    """
    none = F.lit(None).cast("string")
    said = F.substring(F.trim(F.regexp_replace("text", "\\s+", " ")), 1, 200)
    own = records.select("record_id", said.alias("text"), "valid_from", "supersedes", "scope", "written_by").filter("text != ''")
    old = records.select(F.col("record_id").alias("supersedes"), F.col("valid_from").alias("was_valid"))
    pairs = own.filter("supersedes != ''").join(old, "supersedes").orderBy("record_id").limit(cases)
    case = lambda rows, kind, key, expected, forbidden, as_of, principal: rows.select(
        F.lit("invariants").alias("cohort"), T.query_id(F.concat(F.lit(f"invariant:{kind}:"), key)).alias("query_id"), F.col("text").alias("query"), F.lit(kind).alias("kind"),
        expected.alias("expected"), forbidden.alias("forbidden"), as_of.alias("as_of"), principal.alias("principal"),
    )
    stale = case(pairs, "stale", F.col("record_id"), F.col("record_id"), F.col("supersedes"), none, none)
    earlier = case(pairs.filter("was_valid < valid_from"), "as_of", F.col("record_id"), F.col("supersedes"), none, F.col("was_valid"), none)
    scoped = own.filter(F.col("scope").isin("session", "user") & (F.col("written_by") != "")).orderBy("record_id").limit(cases)
    private = case(scoped, "private", F.col("record_id"), none, F.col("record_id"), none, F.concat(F.lit("probe-"), F.substring(F.sha2("written_by", 256), 1, 16)))
    nothing = records.sparkSession.range(1).select(F.concat(F.lit("zzq"), F.substring(F.sha2(F.lit(name), 256), 1, 16), F.lit("xq unknowable subject")).alias("text"))
    absent = case(nothing, "abstain", F.lit(name), none, none, none, none)
    return stale.unionByName(earlier).unionByName(private).unionByName(absent)


def summary(members: DataFrame) -> DataFrame:
    """(cohort, cohort_id, queries): each cohort with an id that follows from its members, so one that hasn't changed keeps it."""
    ids = F.array_join(F.array_sort(F.collect_list("query_id")), ",")  # MOST questions
    return members.groupBy("cohort").agg(F.concat(F.lit("cohort-"), F.substring(F.sha2(F.concat_ws("|", "cohort", ids), 256), 1, 16)).alias("cohort_id"), F.count(F.lit(1)).alias("queries"))
