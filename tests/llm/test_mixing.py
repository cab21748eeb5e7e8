from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamdex.llm import mixing as M


@given(st.dictionaries(st.text("abcdefghij", min_size=1, max_size=3), st.floats(0.001, 100), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_every_prefix_is_within_one_block(weights):
    slots = M.slots_of(weights, 256)
    period = sum(slots.values())
    assert period == max(256, 2 * len(slots)) and min(slots.values()) >= 1
    plan, ran = M.schedule(slots), Counter()
    assert [s for *_, s in plan] == list(range(period))
    for name, block, slot in plan:
        ran[name] += 1
        assert block == ran[name]
        assert all(abs(ran[n] - k * (slot + 1) / period) < 1 for n, k in slots.items())
    assert ran == slots


def test_documents_follow_the_schedule(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    weights = {r.source: 1.0 + (r.source == "src0") for r in docs.select("source").distinct().collect()}
    mixed = M.mix(docs, weights=weights, block=512, period=64).collect()
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in docs.collect())
    slots = M.slots_of({f"1{n}": w for n, w in weights.items()}, 64)
    place = {(n, b): s for n, b, s in M.schedule(slots)}
    streams = {}
    for r in mixed:
        streams.setdefault(r.source, []).append(r)
    for name, rows in streams.items():
        at, own = 0, slots[f"1{name}"]
        for r in sorted(rows, key=lambda r: r.mix_start):
            assert r.mix_start == at
            number = at // 512
            assert r.mix_slot == number // own * sum(slots.values()) + place[f"1{name}", number % own + 1]
            at += max(len(r.text), 1)


def test_layout_follows_slots_in_even_ranges(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = {r.doc_id: (r.mix_slot, r.mix_start) for r in M.mix(docs).collect()}
    laid = M.in_order(docs, parts=8).select("*", F.spark_partition_id().alias("part")).collect()
    assert [mixed[r.doc_id] for r in laid] == sorted(mixed.values())
    assert [r.part for r in laid] == sorted(r.part for r in laid)
    volume = Counter()
    for r in laid:
        volume[r.part] += len(r.text)
    longest = max(len(r.text) for r in laid)
    assert all(v < 2 * sum(volume.values()) / 8 + longest for v in volume.values())


def test_clashing_names_null_ids_and_long_texts(spark, make_docs):
    docs = make_docs(*[(None, f"text {i}", "en", None if i % 2 else "") for i in range(40)], (1, "x" * 300_000), (2, "same"), (2, "same"))
    for name in ("mix_place", "mix_of", "mix_before", "mix_source", "mix_size", "mix_hash", "mix_bucket", "row", "size", "slots", "number", "place", "turn", "own", "Bucket"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for laid in (M.mix(docs).drop("mix_slot", "mix_start"), M.in_order(docs, parts=3)):
        assert laid.columns == docs.columns
        assert Counter(map(str, laid.collect())) == Counter(map(str, docs.collect()))
    starts = [r.mix_start for r in M.mix(docs).filter("text like 'text %'").collect()]
    assert len(set(starts)) >= 20  # rows without an id have places of their own
    again = M.mix(docs.withColumn("mix_slot", F.lit("old")))
    assert again.columns == [*docs.columns, "mix_slot", "mix_start"] and dict(again.dtypes)["mix_slot"] == "bigint"


def test_edge_rows(spark, make_docs):
    docs = make_docs((1, None, "en", None), (2, "", "en", ""), (2, "", "en", ""), (None, "x" * 9000, "en", "b")).withColumn("of", F.lit(1)).withColumn("slot", F.lit("q"))
    mixed = M.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_slot", "mix_start"] and mixed.count() == 4
    laid = M.in_order(docs)
    assert laid.columns == docs.columns and laid.count() == 4
    assert M.mix(docs.limit(0)).count() == 0 and M.in_order(docs.limit(0)).count() == 0
