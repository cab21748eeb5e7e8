"""Agent memory as tables: validity, importance, near copies, caps, mining of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import components as C
from loamdex.operators import near
from loamdex.session import cut

HALF_LIFE_DAYS = 90.0
SCOPE_WEIGHT = {"org": 1.25, "user": 1.0, "session": 0.6}
SIMILAR = 0.6
#: Bounds of keys by words, which sets no longer meet on; kept for those who set them.
RARE, MANY, BEFORE = 32, 48, 12


def project(records: DataFrame) -> DataFrame:
    """Records with valid_from and valid_until: set, else the time they were made, and the earliest correction.

    A record's end is the least of its own and the earliest time at which another record that supersedes it was made.
    """
    corrected = records.filter("supersedes is not null").groupBy(F.col("supersedes").alias("record_id")).agg(F.min("asserted_at").alias("corrected_at"))
    joined = records.join(corrected, "record_id", "left")
    unset = lambda c: F.nullif(F.col(c), F.lit(""))
    return joined.withColumns({"valid_from": F.coalesce(unset("valid_from"), F.col("asserted_at")), "valid_until": F.least(unset("valid_until"), F.col("corrected_at"))}).drop("corrected_at")


def carry_over(fresh: DataFrame, old: DataFrame, earned: dict[str, object]) -> DataFrame:
    """Rebuilt records with what they had earned before; defaults for new ones."""
    kept = old.select("record_id", *[F.col(c).alias(f"old_{c}") for c in earned])
    joined = fresh.drop(*earned).join(kept, "record_id", "left")
    return joined.withColumns({c: F.coalesce(f"old_{c}", F.lit(v)) for c, v in earned.items()}).drop(*[f"old_{c}" for c in earned])


def salience(age_days: Column, uses: Column, observations: Column, scope: Column) -> Column:
    """Importance: halves every 90 days, grows with the logarithm of uses and observations, weighs by scope."""
    weight = F.when(scope == "org", SCOPE_WEIGHT["org"]).when(scope == "session", SCOPE_WEIGHT["session"]).otherwise(SCOPE_WEIGHT["user"])
    return F.round(F.pow(F.lit(0.5), age_days / HALF_LIFE_DAYS) * (1 + 0.5 * F.log1p(uses) + 0.5 * F.log1p(observations)) * weight, 6)


def canonical(records: DataFrame) -> DataFrame:
    """(key, record_id, observations): equal statements folded; the earliest record stands for them."""
    keyed = records.withColumn("key", T.digest(F.col("scope"), F.col("subject"), F.col("kind"), T.normalized_sentence(F.col("text"))))
    return keyed.groupBy("key").agg(F.min_by("record_id", F.struct("asserted_at", "record_id")).alias("record_id"), F.count(F.lit(1)).alias("observations"))


def over_cap(records: DataFrame, caps: dict[str, int], order: str = "salience") -> DataFrame:
    """Records past their scope's cap, by falling importance, then id."""
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc(order), "record_id"))
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("scope"))
    return records.withColumn("place", place).filter(F.col("place") > cap).drop("place")


def _word_sets(records: DataFrame, bucket: tuple[str, ...]) -> DataFrame:
    """(record_id, place, words, digest, n): each record's bucket, null like any other value, as a number, its set of words, their SHA-256 and number."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(T.normalized_sentence(F.col("text")), "[^a-z0-9]+"), lambda w: F.length(w) > 1)))
    place = F.xxhash64(*[x for c in bucket for x in (F.col(c), F.col(c).isNull())]) if bucket else F.lit(0).cast("long")
    sets = records.select("record_id", place.alias("place"), words.alias("words")).filter("size(words) > 0")
    return sets.withColumns({"digest": F.unhex(F.sha2(F.array_join("words", " "), 256)), "n": F.size("words")})


def similar_pairs(records: DataFrame, bucket: tuple[str, ...], threshold: float = SIMILAR) -> DataFrame:
    """(a, b, jaccard) of records (record_id, text) within a bucket whose sets of words are alike, a chain standing for equal sets.

    Sets of like size are compared by two bits a word (``near.candidates``), and only those that pass are compared word by
    word. Equal sets, as their digests tell, are folded into their first record before, so copies make no pairs of their own:
    each is linked with that first record. Words are written once, and shuffled for sets of a pair that passed alone.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("only sets of neighbouring sizes meet, so the threshold must be over one half")
    # numbers of rows are written too, so they stay as they are
    sets = cut(_word_sets(records, bucket).withColumn("row", F.monotonically_increasing_id()), "word-sets")
    copies = sets.select("record_id", "place", "digest", "row")
    heads = cut(copies.groupBy("place", "digest").agg(F.min("record_id").alias("id"), F.min_by("row", F.struct("record_id", "row")).alias("row")), "distinct-sets")
    alike = _near_sets(sets, heads.select("row"), threshold)
    same = copies.select("record_id", "place", "digest").join(heads, ["place", "digest"]).filter("record_id != id")
    return alike.unionByName(same.select(F.col("id").alias("a"), F.col("record_id").alias("b"), F.lit(1.0).alias("jaccard")))


def _near_sets(sets: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the different sets (record_id, place, words, n, row) whose rows are among ``heads``."""
    close = cut(near.candidates(sets.select(F.col("row").alias("id"), "place", "words"), threshold, heads.withColumnRenamed("row", "id")), "candidate-pairs")
    counted = near.shared(sets.select(F.col("row").alias("id"), F.col("record_id").alias("name"), "n", "words"), close).filter("a != b")
    jaccard = F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6)
    return counted.withColumn("jaccard", jaccard).filter(F.col("jaccard") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def clusters(records: DataFrame, bucket: tuple[str, ...], threshold: float = SIMILAR) -> DataFrame:
    """(id, cluster, links, medoid) of every record: the least id that links reach, how many links it has, and whether it stands for its cluster.

    The medoid has the greatest sum of similarities over its links, ties to the least id. A record without words or
    links is a cluster of its own and its medoid. Copies of one set are linked with its first record.
    """
    pairs = cut(similar_pairs(records, bucket, threshold), "similar-pairs")
    named = C.components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    ends = pairs.select(F.col("a").alias("id"), "jaccard").unionByName(pairs.select(F.col("b").alias("id"), "jaccard"))
    sums = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("jaccard").cast("decimal(18,6)")).alias("total"))  # the same in any order
    found = records.select(F.col("record_id").alias("id")).distinct().join(named.join(sums, "id"), "id", "left")
    found = cut(found.select("id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("total", F.lit(0)).alias("total")), "record-clusters")
    heads = found.groupBy("cluster").agg(F.min_by("id", F.struct(-F.col("total"), "id")).alias("head"))
    return found.join(heads, "cluster").select("id", "cluster", "links", (F.col("id") == F.col("head")).alias("medoid"))


def compaction(found: DataFrame) -> DataFrame:
    """(cluster, canonical, absorbed) of ``clusters`` with more than one record: the medoid and how many others it takes in."""
    merged = found.groupBy("cluster").agg(F.min(F.when(F.col("medoid"), F.col("id"))).alias("canonical"), (F.count(F.lit(1)) - 1).alias("absorbed"))
    return merged.filter("absorbed > 0")


def demoted(records: DataFrame, found: DataFrame) -> DataFrame:
    """``records`` with subsumed_by and tier after compaction: absorbed ones are cold and name the record that stands for them; validity stays."""
    heads = compaction(found).select("cluster", "canonical")
    members = found.join(heads, "cluster").filter("id != canonical").select(F.col("id").alias("record_id"), "canonical")
    joined = records.drop("subsumed_by").join(members, "record_id", "left")
    return joined.withColumns({"tier": F.when(F.col("canonical").isNotNull(), F.lit("cold")).otherwise(F.col("tier")), "subsumed_by": F.col("canonical")}).drop("canonical")


def subsumed_by(records: DataFrame, hops: int = 8) -> DataFrame:
    """(record_id, head): the record at the end of each chain of subsumed_by, at most so many steps away."""
    heads = records.select("record_id", F.coalesce("subsumed_by", "record_id").alias("head"))
    step = records.filter("subsumed_by is not null").select(F.col("record_id").alias("head"), F.col("subsumed_by").alias("next"))
    for _ in range(hops - 1):
        heads = heads.join(step, "head", "left").select("record_id", F.coalesce("next", "head").alias("head"))
    return heads


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Events with session, numbered for each user from 1: a pause longer than the gap begins another."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    begins = F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def shared_prefix(paths: DataFrame, by: str) -> DataFrame:
    """(by, prefix): the folders that all paths of a group share; the least and the greatest path tell."""
    ends = paths.groupBy(by).agg(F.min(F.split("path", "/")).alias("lo"), F.max(F.split("path", "/")).alias("hi"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i))
    shared = F.greatest(F.coalesce(F.array_max(same), F.lit(0)), F.lit(0))
    return ends.select(by, F.array_join(F.slice("lo", F.lit(1), shared), "/").alias("prefix"))


def questions(turns: DataFrame) -> DataFrame:
    """(question, asked, first_conv, answer) of conversations (conv_id, turn, role, text): questions that say the same are one, and the last answer wins.

    An answer is the assistant's turn right after the user's.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order))
    asked = turns.withColumn("answer", following).filter("role = 'user'").withColumn("question", T.normalized_sentence(F.col("text")))
    last = F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct("conv_id", "turn")))
    return asked.groupBy("question").agg(F.count(F.lit(1)).alias("asked"), F.min("conv_id").alias("first_conv"), last.alias("answer"))


def unanswered(turns: DataFrame, least: int = 2, length: int = 4) -> DataFrame:
    """(term, conversations): terms of a length that users of so many conversations hold, and no assistant's turn in any."""
    words = turns.select("conv_id", "role", F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("term")).filter(F.length("term") >= length)
    asked = words.filter("role = 'user'").select("conv_id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("conversations"))
    answered = words.filter("role = 'assistant'").select("term").distinct()
    return asked.filter(F.col("conversations") >= least).join(answered, "term", "left_anti")


def edges(records: DataFrame) -> DataFrame:
    """(src, dst, type) of memory in the graph: what a record supersedes, what it stands for, and what it is about; null and empty ends have none."""
    own = F.concat(F.lit("memory:"), "record_id")
    other = lambda c: F.concat(F.lit("memory:"), c)
    said = [
        records.select(own.alias("src"), F.when(F.col("supersedes") != "", other("supersedes")).alias("dst"), F.lit("supersedes").alias("type")),
        records.select(F.when(F.col("subsumed_by") != "", other("subsumed_by")).alias("src"), own.alias("dst"), F.lit("subsumes").alias("type")),
        records.select(own.alias("src"), F.when(F.trim("subject") != "", F.concat(F.lit("subject:"), T.slug(F.col("subject")))).alias("dst"), F.lit("about").alias("type")),
    ]
    return said[0].unionByName(said[1]).unionByName(said[2]).filter("src is not null and dst is not null").distinct()


def session_digests(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(record_id, user_id, began, ended, steps, text): each user's sessions as records that say what was done, kinds in the order in which they first came.

    A pause longer than ``gap`` ends a session. A session's kinds are summed before they come together, so a row holds as
    many as there are kinds.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.lag("ts").over(order)
    marked = events.withColumn("opens", F.when(pause.isNull() | (F.col("ts") - pause > F.expr(f"interval {gap}")), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("opens").over(order))
    kinds = numbered.groupBy("user_id", "session", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"), F.max("ts").alias("last"))
    listed = kinds.groupBy("user_id", "session").agg(
        F.min("first.ts").alias("began"), F.max("last").alias("ended"), F.sum("n").alias("steps"),
        F.array_sort(F.collect_list(F.struct("first", F.concat_ws(" x", "event_type", F.col("n").cast("string")).alias("said")))).alias("kinds"),
    )
    stamp = F.date_format("began", "yyyyMMddHHmmss")
    return listed.select(F.concat_ws("-", F.lit("session"), F.col("user_id").cast("string"), stamp).alias("record_id"), "user_id", "began", "ended", "steps", F.array_join(F.col("kinds.said"), ", ").alias("text"))


def proposed(known: DataFrame, fresh: DataFrame, now: str, days: int = 90) -> DataFrame:
    """(candidate_id, text, status, first_seen, last_seen): candidates after a pass found ``fresh`` ones (text, seen).

    A candidate is known by its text's digest. Seen again it keeps its first time and its status; one that was rejected
    stays so and is never proposed anew. Pending ones not seen for so many days expire.
    """
    found = fresh.groupBy(F.substring(T.digest(T.normalized_sentence(F.col("text"))), 1, 16).alias("candidate_id")).agg(F.min("text").alias("said"), F.min("seen").alias("low"), F.max("seen").alias("high"))
    both = known.join(found, "candidate_id", "full")
    last = F.greatest("last_seen", "high")
    status = F.coalesce("status", F.lit("pending"))
    stale = (status == "pending") & (F.datediff(F.lit(now).cast("date"), last.cast("date")) > days)
    return both.select("candidate_id", F.coalesce("text", "said").alias("text"), F.when(stale, "expired").otherwise(status).alias("status"), F.least("first_seen", "low").alias("first_seen"), last.alias("last_seen"))


def maintained(records: DataFrame, bucket: tuple[str, ...], caps: dict[str, int], threshold: float = SIMILAR) -> DataFrame:
    """(record_id, fate, head) after one pass of maintenance: records of a cluster of near copies are demoted under its medoid, then scopes over their cap lose their least important ones; others are kept.

    ``records`` are (record_id, scope, text, salience, kind). Rules are exempt from both: they are neither near copies of
    anything nor counted.
    """
    rule = F.coalesce("kind", F.lit("fact")).isin("alias", "preference", "exclusion")
    facts, rules = records.filter(~rule), records.filter(rule)
    found = cut(clusters(facts.select("record_id", "scope", "text"), bucket, threshold), "maintained-clusters")
    heads = found.filter("medoid").select("cluster", F.col("id").alias("head"))
    named = found.join(heads, "cluster").select(F.col("id").alias("record_id"), "head")
    left = facts.join(named.filter("record_id = head").select("record_id"), "record_id", "left_semi")
    pruned = over_cap(left, caps).select("record_id", F.lit("pruned").alias("cut"))
    out = named.join(pruned, "record_id", "left").select("record_id", F.when(F.col("record_id") != F.col("head"), "demoted").otherwise(F.coalesce("cut", F.lit("kept"))).alias("fate"), "head")
    return out.unionByName(rules.select("record_id", F.lit("kept").alias("fate"), F.col("record_id").alias("head")))
