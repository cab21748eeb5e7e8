"""Variants and cohorts on small tables."""

import pytest
from pyspark.sql import functions as F

from loamdex.operators import cohorts, replay


@pytest.fixture
def tables(spark):
    rules = spark.createDataFrame(
        [("a", "alias", ["cat"], ["feline"], "admitted"), ("b", "preference", ["dog_food"], ["src1/"], "admitted"), ("c", "exclusion", ["never"], ["old/"], "admitted"), ("p", "alias", ["cat"], ["puss"], "pending")],
        "record_id string, kind string, terms array<string>, values array<string>, status string",
    )
    queries = spark.createDataFrame([(1, "black cat"), (2, "food for a dog"), (3, "bird")], "query_id int, query string")
    found = [(i, arm, pos, f"c{d}", f"d{d}", "chunk") for i in (1,) for arm, ds in (("text", [1, 2, 3, 4]), ("vector", [3, 5])) for pos, d in enumerate(ds)]
    return rules, queries, found


def test_inputs_are_shared_by_variants(spark, tables):
    rules, queries, _ = tables
    variants = [*replay.matrix(), replay.without(replay.matrix()[5], "loo-a", "a")]
    got = {(r.variant, r.query_id): r for r in replay.inputs(queries, rules, variants).collect()}
    assert len(got) == 8 * 3
    tokens = lambda v: got[v, 1].tokens
    assert tokens("B0") == tokens("B1") == tokens("B3") == tokens("B5-loo-a") == ["black", "cat"]
    assert tokens("B2") == tokens("B5") == ["black", "cat", "feline"] and tokens("B6") == ["black", "cat", "feline", "puss"]
    assert got["B3", 2].prefixes == got["B5", 2].prefixes == ["src1/"] and got["B2", 2].prefixes == []
    # as many arms as there are different inputs: three of query 1, two of query 2, one of query 3
    assert len({r.arm for r in got.values()}) == 6
    assert len({got[v, 3].arm for v, q in got if q == 3}) == 1


def test_what_is_left_out_is_gone_and_not_weighted_by_zero(spark, tables):
    rules, queries, found = tables
    full = replay.matrix(False)[5]
    variants = [replay.Variant("B0"), full, replay.without(full, "loo", "m3"), replay.with_cold(full)]
    asked = replay.inputs(queries.filter("query_id = 1"), rules, variants)
    of = {r.variant: r.arm for r in asked.collect()}
    rows = [(arm, *f[1:]) for arm in set(of.values()) for f in found]
    hits = spark.createDataFrame(rows, "of long, arm string, pos long, key string, node string, kind string")
    records = spark.createDataFrame([("m3", "d3", "hot"), ("m5", "d5", "cold")], "record_id string, node string, tier string")
    barred = spark.createDataFrame([(full.name, "d1"), (full.name, "d1")], "variant string, node string")
    out = {}
    for r in replay.replay(asked, hits, records, barred, variants).orderBy("variant", "rank").collect():
        out.setdefault(r.variant, []).append(r.key)
    assert out["B0"] == ["c1", "c2", "c4"]
    assert out["B5"] == ["c3", "c2", "c4"]
    assert out["B5-loo"] == ["c1", "c2", "c4"]
    assert out["B5-cold"] == ["c3", "c1", "c2", "c5", "c4"]
    listed = replay.candidates(asked, hits, records, barred, variants).filter("variant = 'B5-loo' and arm = 'text'").orderBy("pos")
    assert [(r.key, r.pos) for r in listed.collect()] == [("c1", 0), ("c2", 1), ("c4", 2)]


def test_compared(spark):
    variants = [replay.Variant("B0"), replay.Variant("B1", baseline="B0")]
    results = spark.createDataFrame([("B0", 1, 2, "x"), ("B1", 1, 1, "x"), ("B0", 2, 1, "y")], "variant string, query_id int, rank int, node string")
    good = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "query_id int, target string, judgement int")
    got = {(r.variant, r.measure): r for r in replay.compared(results, good, variants).collect()}
    r = got["B1", "reciprocal_rank"]
    assert (r.queries, r.value, r.pairs, r.delta, r.better, r.worse) == (2, 0.5, 2, -0.25, 1, 1)
    assert got["B0", "recall"].value == 1.0 and got["B0", "recall"].pairs == 0 and got["B0", "recall"].delta is None


def asks_of(spark, rows):
    return spark.createDataFrame(rows, "query string, day int, results int").select("query", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("at"), "results")


def test_cohorts(spark):
    asks = asks_of(spark, [("How  now", 1, 1), ("how now", 3, 0), ("Bees?", 5, 2), ("late one", 9, 1), (" ", 1, 1), (None, 1, 1), ("nothing found", 2, 0)])
    names = lambda df: sorted(r["query"] for r in df.collect())
    questions = {r["query"]: (r.asked, str(r.first_asked)) for r in cohorts.ledger(asks).collect()}
    assert questions["How  now"] == (2, "2024-01-02 00:00:00") and len(questions) == 4
    assert cohorts.anchor(asks).count() == 0
    assert names(cohorts.anchor(asks, least=3)) == ["Bees?", "How  now", "late one"]
    frozen = cohorts.anchor(asks, least=3, most=1)
    later = asks.unionByName(asks_of(spark, [("new and often", 12, 1)] * 9))
    assert names(cohorts.anchor(later, frozen, least=3, most=1)) == names(frozen)
    assert names(cohorts.rolling(asks, "2024-01-11 00:00:00", days=5)) == ["Bees?", "late one"]
    candidates = spark.createDataFrame([("how NOW", "pending", 4), ("bees?", "rejected", 1)], "query string, status string, day int").select("query", "status", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("first_seen"))
    assert names(cohorts.learned(asks, candidates)) == ["How  now"]
    assert names(cohorts.holdout(asks, candidates)) == ["Bees?", "late one"]
    assert names(cohorts.holdout(asks, candidates, days=1)) == ["late one"]
    assert cohorts.holdout(asks, candidates.limit(0)).count() == 0
    rules = spark.createDataFrame([(["x"], ["BEES keep"])], "terms array<string>, values array<string>")
    assert names(cohorts.control(asks, rules)) == ["How  now", "late one", "nothing found"]
    one, two = (cohorts.summary(c).first() for c in (cohorts.control(asks, rules), cohorts.control(later.filter("query != 'new and often'"), rules)))
    assert one == two and one.queries == 3
