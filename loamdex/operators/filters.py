"""Predicates on hits: retrieval criteria, access, validity of memory, sampling."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.session import cut, small


def criteria(hits: DataFrame, exclude_sources=(), node_types=(), source_types=(), min_score: float | None = None) -> DataFrame:
    """Hits that fit, to be applied after ranking; order is theirs. Empty criteria let all pass."""
    tests = [F.lit(True)]
    if exclude_sources:
        tests.append(~F.coalesce(F.col("source").isin(*exclude_sources), F.lit(False)))
    if node_types:
        tests.append(F.col("type").isin(*node_types))
    if source_types:
        tests.append(F.col("source_type").isin(*source_types))
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    return hits.filter(reduce(lambda a, b: a & b, tests))


def overfetch(top: int, filtering: bool, factor: float = 3.0) -> int:
    """How many hits to fetch so that enough are left after filtering."""
    return max(top, int(top * factor)) if filtering else top


def allowed(acl: Column, identities: Column, default_public: bool = False) -> Column:
    """Whether one of the identities may read by {"allow": [...], "public": bool}.

    No rule at all is the default; null identities stand for a reader without limits; a rule that can't be read denies.
    """
    read = F.from_json(acl, "allow array<string>, public boolean")
    fine = F.coalesce(read["public"], F.lit(False)) | F.coalesce(F.arrays_overlap(read["allow"], identities), F.lit(False))
    readable = F.try_parse_json(acl).isNotNull()
    return (
        F.when(identities.isNull(), True)
        .when(F.coalesce(acl, F.lit("")) == "", F.lit(default_public))
        .otherwise(readable & F.coalesce(fine, F.lit(False)))
    )


def identities(principal: Column, groups: Column) -> Column:
    """A reader's own name and groups; null for no reader."""
    return F.when(principal.isNotNull(), F.array_union(F.array(principal), F.coalesce(groups, F.expr("array()"))))


@dataclass(frozen=True)
class MemoryPolicy:
    """Which memory records a search sees. ``as_of`` is an ISO time and wins over now."""

    mode: str = "auto"  # auto, off, only, prefer
    scopes: tuple[str, ...] = ()
    subject: str | None = None
    as_of: str | None = None
    current_only: bool = True
    tiers: tuple[str, ...] = field(default=())

    def instant(self, now: str) -> str | None:
        return self.as_of or (now if self.current_only else None)

    def seen_tiers(self) -> tuple[str, ...]:
        return self.tiers or (("hot", "cold") if self.as_of or not self.current_only else ("hot",))


def _unset(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def admits(policy: MemoryPolicy, now: str) -> Column:
    """Whether a memory record's columns fit; empty and null are alike, steering records never fit."""
    tests = [F.coalesce("kind", F.lit("fact")).isin("fact"), F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("hot")).isin(*policy.seen_tiers())]
    if policy.scopes:
        tests.append(F.col("scope").isin(*policy.scopes))
    if policy.subject:
        tests.append(F.col("subject") == policy.subject)
    if at := policy.instant(now):
        tests.append(_unset(F.col("valid_from")) | (F.col("valid_from") <= at))
        tests.append(_unset(F.col("valid_until")) | (F.col("valid_until") > at))
    return reduce(lambda a, b: a & b, tests)


def memory_filter(rows: DataFrame, records: DataFrame, policy: MemoryPolicy, now: str, key: str = "doc_id") -> DataFrame:
    """Rows that are no memory records pass unless only memory is asked for; records pass by the policy."""
    known = records.select("record_id", admits(policy, now).alias("fits"))
    joined = rows.join(known, rows[key].cast("string") == known["record_id"], "left")
    if policy.mode == "off":
        test = F.col("record_id").isNull()
    else:
        test = F.when(F.col("record_id").isNull(), F.lit(policy.mode != "only")).otherwise(F.coalesce("fits", F.lit(False)))
    return joined.filter(test).select(rows["*"])


def holding(rows: DataFrame, key: str, column: str, fragments: DataFrame) -> DataFrame:
    """(key, fragment) of rows whose column holds a fragment (fragment), whatever the case; a null holds none, and empty fragments are in none.

    A fragment is looked for where its first word of three letters or digits begins, so rows and fragments meet on such
    beginnings; a fragment without one meets the rows that have its first character.
    """
    low = F.lower(F.col(column))
    named = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, "[a-z0-9]{3}", 0), F.lit("")), F.substring(c, 1, 1))
    asked = fragments.select("fragment", F.lower("fragment").alias("piece")).filter("piece != ''").distinct()
    asked = asked.withColumn("head", named(F.col("piece")))
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    heads = F.array_distinct(F.concat(F.filter(parts(3), lambda x: F.length(x) == 3), parts(1)))
    listed = rows.filter(F.col(column).isNotNull()).select(key, low.alias("low"), F.explode(heads).alias("head"))
    return listed.join(asked, "head").filter(F.contains("low", F.col("piece"))).select(key, "fragment").distinct()


def excluded(rows: DataFrame, column: str, fragments: DataFrame) -> DataFrame:
    """Rows whose column holds one of the fragments (fragment), whatever the case; a null holds none."""
    keyed = cut(rows.withColumn("key", F.monotonically_increasing_id()), "rows-to-exclude")  # written, so that a row keeps its number
    return keyed.join(holding(keyed, "key", column, fragments).select("key").distinct(), "key", "left_semi").drop("key")


def sampled(trace: Column, rate: float) -> Column:
    """Whether a trace is sampled: always the same answer for one trace, and a trace sampled at a rate is sampled at higher ones."""
    number = F.conv(F.substring(F.md5(trace.cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    return F.pmod(number, F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))


def to_read(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Items of a listing that a sync must read: (path, sha256) isn't known."""
    return listing.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")


def disagreeing(counts: DataFrame, key: str, *names: str) -> DataFrame:
    """(key, names..., repair): whether a source's counts, one by each store, disagree, so that it must be repaired; a count that is missing is 0."""
    filled = counts.select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return filled.withColumn("repair", F.greatest(*names) != F.least(*names))
