"""Halving, lettered outlines, facts, states, sections and sketches against plain restatements."""

import decimal
import hashlib
import itertools
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.operators import chunking, filters, graph, lexical, memory, near, retrieval, serving, sketches, states, tuning
from loamdex.plans.catalogue import ORACLES, QUERIES


def lettered(spark, *outlines):
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(outlines)], "doc_id int, text string")
    out = {i: [] for i in range(len(outlines))}
    for r in chunking.series(chunking.headings(docs)).orderBy("doc_id", "line").collect():
        out[r.doc_id].append(r.value)
    return list(out.values())


def test_letters_and_numerals_by_their_run(spark):
    items = lambda labels: "\n".join(f"({x}) Item" for x in labels)
    got = lettered(
        spark, items("fghijk"), items("tuvw"), items(["i", "ii", "iii", "iv", "v"]), "(a) X one\n(b) Y two\n(i) Sub one\n(ii) Sub two\n(c) Z three",
        "(h) Eighth one\n§ 5 Interruption\n(i) Opens anew", items("c"), "No outline here",
    )
    assert got == [[6, 7, 8, 9, 10, 11], [20, 21, 22, 23], [1, 2, 3, 4, 5], [1, 2, 1, 2, 3], [8, 1], [3], []]


def test_facts_equal_a_plain_round_robin(spark):
    rng = random.Random(5)
    ranks = {"calls": 1, "mentions": 9, "near": 9}
    edges = {(f"n{rng.randrange(8)}", f"t{rng.randrange(25)}", rng.choice(["calls", "links", "mentions", "near"])) for _ in range(160)}
    cited = [(q, p, n) for q in range(12) for p, n in enumerate(rng.sample([f"n{i}" for i in range(9)], rng.randint(1, 6)))]
    want = {}
    for q in range(12):
        lists = [sorted((ranks.get(t, 5), t, d, s) for s, d, t in edges if s == n) for qq, _, n in cited if qq == q]
        used, count, weak, told = set(), {}, 0, []
        for depth in range(max(map(len, lists), default=0)):
            for own in lists:
                if depth < len(own) and len(told) < 7:
                    r, t, d, s = own[depth]
                    if d not in used and count.get(s, 0) < 3 and (r < 9 or weak < 2):
                        weak += r >= 9
                        used.add(d)
                        count[s] = count.get(s, 0) + 1
                        told.append((s, t, d))
        want[q] = told
    got = {q: [] for q in range(12)}
    found = graph.facts(spark.createDataFrame(cited, "query_id int, place int, id string"), spark.createDataFrame(list(edges), "src string, dst string, type string"), ranks, limit=7, weak=2)
    for r in found.orderBy("query_id", "n").collect():
        got[r.query_id].append((r.src, r.type, r.dst))
    assert got == want


def test_halving_plan_and_proposals():
    assert tuning.schedule(40, 2) == [(40, 2)] and tuning.schedule(3, 12) == [(3, 12)]
    plan = tuning.schedule(40, 12)
    assert plan == [(13, 12), (26, 6), (40, 3)]
    names = [p.name for p in tuning.propose(["truncation", "fusion"], tuning.Point("served"))]
    assert names == ["rrf_k=30", "rrf_k=90", "text=0.75", "text=1.5", "vector=0.75", "vector=1.5", "graph=0.75", "graph=1.5"]
    assert len(tuning.propose(["fusion"], tuning.Point("served"), budget=3)) == 3
    assert [p.name for p in tuning.propose(["fusion"], tuning.Point("edge", graph=0.0))][-1] == "graph=0.25"


def test_blame(spark):
    lost = lambda *rows: tuning.blamed(spark.createDataFrame(rows, "stage string, n int"))
    assert lost(("served", 50), ("fusion", 3), ("truncation", 5), ("filters", 1)) == ["truncation", "fusion"]
    assert lost(("fusion", 1), ("lexical_candidates", 9)) == [] and lost(("served", 4)) == []


def test_halving_carries_the_best(spark):
    """The vector arm is right on every query: points that weigh it more win, and each round asks more queries."""
    rows = []
    for q in range(20):
        rows += [(q, "text", 0, f"c{q}x", f"x{q}", "chunk"), (q, "text", 1, f"c{q}g", f"g{q}", "chunk"), (q, "vector", 0, f"c{q}g", f"g{q}", "chunk") if q % 2 else (q, "vector", 0, f"c{q}h", f"g{q}", "chunk")]
    captured = spark.createDataFrame(rows, "query_id int, arm string, pos long, key string, node string, kind string").withColumn("weight", F.lit(1.0))
    good = spark.createDataFrame([(q, f"g{q}", 1) for q in range(20)], "query_id int, target string, judgement int")
    points = [tuning.Point("served"), tuning.Point("more vector", vector=2.0), tuning.Point("more text", text=3.0), tuning.Point("less", vector=0.5)]
    table = {(r["round"], r["place"]): r for r in tuning.halving(captured, good, points).collect()}
    assert [table[n, 1]["queries"] for n in (1, 2, 3)] == [6, 12, 20] and table[3, 1]["point"] == "more vector" and table[3, 1]["score"] == 1.0
    assert [sum(r == n for r, _ in table) for n in (1, 2, 3)] == [4, 2, 1]


def test_states(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "rank int, id string")
    swapped = spark.createDataFrame([(2, "a"), (1, "b"), (3, "a")], rows.schema)
    one = lambda df: df.first()["digest"]
    assert one(states.section(rows, "id")) == one(states.section(swapped.repartition(3), "id"))
    assert one(states.ranked(rows, "rank", "id")) == one(states.ranked(rows.orderBy(F.desc("rank")), "rank", "id")) != one(states.ranked(swapped, "rank", "id"))
    assert one(states.section(rows, "id")) != one(states.section(rows.unionByName(rows), "id"))
    before = states.manifest({"a": states.section(rows, "id"), "b": states.section(rows, "rank"), "gone": states.section(rows, "id")})
    after = states.manifest({"a": states.section(swapped, "id"), "b": states.section(rows.limit(0), "rank"), "new": states.section(rows, "id")})
    assert sorted(map(tuple, states.differences(before, after).collect())) == [("b", "changed"), ("gone", "removed"), ("new", "added")]
    assert before.select("state").distinct().count() == 1 and before.first()["state"] != after.first()["state"]
    assert states.differences(before, before).count() == 0


@pytest.mark.parametrize("size", [400, 25])
def test_section_chunks(spark, size):
    rng = random.Random(size)
    texts = []
    for _ in range(12):
        lines = [rng.choice(["# Head", "## Other one", "some words " * rng.randint(0, 5), "", "é" * 30]) for _ in range(rng.randint(0, 14))]
        texts.append("\n".join(lines))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "plain\n\ntext"])], "doc_id int, text string")
    heads = chunking.headings(docs).filter("kind = 'markdown'")
    got = {}
    for r in chunking.section_chunks(docs, heads, size=size, overlap=5).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        lines = text.split("\n")
        starts = [0, *(n for n, line in enumerate(lines) if line.strip().startswith("#") and len(line.strip()) > 2)]
        for r in got.get(i, []):
            assert r.text in text and all(x in " ".join(lines[r.start_line - 1 : r.end_line]) for x in r.text.split())
            # no chunk crosses a heading
            assert r.section in (0, *(s + 1 for s in starts[1:])) and max(s for s in starts if s <= r.start_line - 1) + 1 == max(r.section, 1)
            assert not any(r.start_line - 1 < s < r.end_line - 1 for s in starts)
        covered = set("".join("".join(r.text.split()) for r in got.get(i, [])))
        assert covered == set("".join(text.split()))
    assert [(r.section, r.start_line, r.end_line) for r in got[13]] == [(0, 1, 3)] and 12 not in got


def test_sketches(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7000).alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).cast("timestamp").alias("at"))
    found = sketches.rolled_up(sketches.daily(rows, "at", "v", "k"), "k")
    exact = rows.groupBy("k").agg(F.countDistinct("v").alias("n"))
    assert [r.near for r in exact.join(found, "k").select(sketches.within(F.col("estimate"), F.col("n")).alias("near")).collect()] == [True] * 3
    assert not spark.range(1).select(sketches.within(F.lit(130.0), F.lit(100.0)).alias("x")).first().x


def test_citations_and_records(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c"), (2, 1, "z")], "query_id int, rank int, node string")
    answers = spark.createDataFrame([(1, "So [2], and [12] or [x]."), (3, "[1]")], "query_id int, answer string")
    got = sorted(map(tuple, serving.citations(hits, answers, 2).collect()))
    assert got == [(1, 1, "a", 1, False), (1, 2, "b", 3, True), (2, 1, "z", 1, False)]
    lines = ["one two three", "one\n two   three four", "onetwothreefourfive", None, "one two  three "]
    cut = spark.createDataFrame([(n, t) for n, t in enumerate(lines)], "n int, t string").select("n", serving.cut_at_word(F.col("t"), 13).alias("s"))
    assert [r.s for r in cut.orderBy("n").collect()] == ["one two three", "one two three…", "onetwothreefo…", "", "one two three"]
    merged = serving.merged(spark.createDataFrame([(1, "text", "k", 0.5), (1, "graph", "k", 0.9), (1, "text", "j", 0.9)], "query_id int, mode string, key string, score double"))
    assert sorted(map(tuple, merged.collect())) == [(1, 1, "j", 0.9, "text"), (1, 2, "k", 0.9, "graph+text")]


def test_maintenance_spares_rules(spark):
    rows = [("a", "en", "the build is green today", 5, "fact"), ("b", "en", "the build is green today again", 9, "fact"), ("c", "en", "something else entirely here", 1, "fact"), ("d", "en", "a third thing that nobody knows", 2, "fact"), ("r", "en", "the build is green today", 0, "alias")]
    got = {r.record_id: (r.fate, r["head"]) for r in memory.maintained(spark.createDataFrame(rows, "record_id string, scope string, text string, salience int, kind string"), ("scope",), {"en": 2}).collect()}
    assert got["r"] == ("kept", "r") and sorted(f for f, _ in got.values()) == ["demoted", "kept", "kept", "kept", "pruned"]
    assert got["c"] == ("pruned", "c") and got["b"][1] == got["a"][1]


def test_memory_edges_and_candidates(spark):
    rows = spark.createDataFrame([("1", "", None, " "), ("2", "1", "3", "The Build"), ("2", "1", "3", "The Build")], "record_id string, supersedes string, subsumed_by string, subject string")
    assert sorted(map(tuple, memory.edges(rows).collect())) == [("memory:2", "memory:1", "supersedes"), ("memory:2", "subject:the-build", "about"), ("memory:3", "memory:2", "subsumes")]
    none = spark.createDataFrame([], "candidate_id string, text string, status string, first_seen string, last_seen string")
    fresh = spark.createDataFrame([("Say it.", "2024-01-01"), ("say it", "2024-01-05")], "text string, seen string")
    one = memory.proposed(none, fresh, "2024-01-06")
    assert [(r.status, r.first_seen, r.last_seen) for r in one.collect()] == [("pending", "2024-01-01", "2024-01-05")]
    again = memory.proposed(one.withColumn("status", F.lit("rejected")), fresh.withColumn("seen", F.lit("2024-09-01")), "2024-09-02").collect()
    assert [(r.status, r.first_seen, r.last_seen) for r in again] == [("rejected", "2024-01-01", "2024-09-01")]
    assert [r.status for r in memory.proposed(one, fresh.limit(0), "2024-09-01").collect()] == ["expired"]


def test_disagreeing(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, None), ("c", None, 0)], "s string, x int, y int")
    assert sorted(map(tuple, filters.disagreeing(rows, "s", "x", "y").collect())) == [("a", 1, 1, False), ("b", 2, 0, True), ("c", 0, 0, False)]


def test_paths_are_those_of_a_walk_and_a_hub_is_walked_once(spark, monkeypatch):
    rng = random.Random(13)
    links = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(34)] + [("hub", f"page{i}") for i in range(150)] + [(f"page{i}", f"target{i}") for i in range(150)]
    asked = [(f"n{rng.randrange(44)}", f"n{rng.randrange(44)}") for _ in range(60)] + [("hub", f"target{i}") for i in range(150)] + [(None, "n1"), ("n1", None)]
    written = []

    def counted(df, name):
        out = cut(df, name)
        written.append(out.count())
        return out

    cut = graph.cut
    monkeypatch.setattr(graph, "cut", counted)
    edges = spark.createDataFrame([(a, b, "links_to") for a, b in links], "src string, dst string, type string")
    near: dict = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for depth, ends in ((2, asked), (5, [(b, a) for a, b in asked])):
        want = set()
        for a, b in {p for p in ends if None not in p}:
            level, seen, hops = {a}, {a}, 0
            while b not in level and level and hops < depth:
                level = {y for x in level for y in near.get(x, ())} - seen
                seen, hops = seen | level, hops + 1
            want |= {(a, b, hops)} if b in level else set()
        written.clear()
        got = [tuple(r) for r in graph.shortest_paths(edges, spark.createDataFrame(ends, "src string, dst string"), depth).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert sum(written) < 5_000  # every page beside every other would be 150 * 150


def test_only_the_best_nodes_of_a_block_leave_it(spark, monkeypatch):
    rng, words = random.Random(14), ["cache", "index", "graph", "query", "vector", "merge", "a1", "src"]
    monkeypatch.setattr(graph, "NODE_BLOCK", 100)
    monkeypatch.setattr(graph, "QUERY_BLOCK", 2)
    text = lambda n: " ".join(rng.choice(words).title() for _ in range(n))
    nodes = [(f"n{i:03}", rng.choice(["page", "graph_query", None]), rng.choice([text(1), text(2), text(3), f"{text(1)}s", None]), rng.choice([text(1), "src1", None])) for i in range(500)]
    asked = [(1, "cache"), (2, "index graph"), (3, "Query cache merge"), (4, "vector merge index graph"), (5, "page"), (6, "nothing"), (7, None)]
    asked = [(i, q, (q or "").lower().split()) for i, q in asked]
    steps, want = graph.NODE_FIELDS, {}
    firsts = {t: sorted((n for n in nodes if n[1] == t), key=lambda n: (n[2] is not None, n[2] or "", n[0]))[:20] for t in ("page", "graph_query")}
    for i, q, tokens in asked:
        for n in nodes:
            own = set(" ".join(x or "" for x in (n[2], n[3])).lower().split())
            if own & set(tokens) or n[1] and n in firsts[n[1]] and set(n[1].split("_")) & set(tokens):
                score = max(graph.rung((x or "").lower(), q.lower(), tokens, steps[f]) for x, f in ((n[2], "label"), (n[3], "name"), (n[1], "type")))
                want.setdefault(i, []).append((-round(score, 3), n[2] is not None, n[2] or "", n[0]))
    table = spark.createDataFrame(nodes, "id string, type string, label string, name string")
    tokens = spark.createDataFrame(asked, "query_id int, query string, tokens array<string>")
    every = {}
    for r in graph.node_scores(table, tokens).collect():
        every.setdefault(r.query_id, []).append((-r.score, r.label is not None, r.label or "", r.id))
    assert {i: sorted(x) for i, x in every.items()} == {i: sorted(x) for i, x in want.items()}
    some = graph.node_scores(table, tokens, 5)
    # at most five of each of five blocks, and the first ones of two types
    assert all(r["count"] <= 5 * 5 + 40 for r in some.groupBy("query_id").count().collect()) and some.count() < sum(map(len, want.values())) / 2
    edges = spark.createDataFrame([("n001", "n002", "links")], "src string, dst string, type string")
    got = {}
    for r in graph.search(table, edges, tokens, 5).filter("kind = 'node'").orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: [n[3] for n in sorted(x)[:5]] for i, x in want.items()}


def test_only_runs_that_may_be_sought_leave_a_task(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "c1", "dé", "x-y"]) for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plain = []
    for i, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", t)
        plain += [(i, " ".join(w[j : j + 3])) for j in range(len(w) - 2)]
    found = lexical.word_runs(rows, "doc_id", 3).collect()
    assert sorted((r.doc_id, r.run) for r in found) == sorted(plain)
    hashes = {r.run: r.hash for r in found}
    assert len(set(hashes.values())) == len(hashes)
    sought = [r for r in hashes if r.startswith("ab c1")]
    left = lexical.word_runs(rows, "doc_id", 3, [hashes[r] % (1 << 20) for r in sought], 1 << 20).collect()
    assert sorted((r.doc_id, r.run) for r in left) == sorted(p for p in plain if p[1] in sought)
    assert lexical.word_runs(rows, "doc_id", 3, [], 1 << 20).count() == 0


def _duck(folder):
    import duckdb

    con = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.fixture
def cancelled(spark, data, tmp_path):
    """The smallest tables with documents whose terms cancel out in each place, and an item that does."""
    folder, pairs = tmp_path / "tables", {}
    folder.mkdir()
    for path in pathlib.Path(data).glob("*.parquet"):
        if path.stem not in ("documents", "benchmark"):
            (folder / path.name).symlink_to(path)
    for n in range(20_000):
        digest = hashlib.md5(f"word{n}".encode()).hexdigest()
        pairs.setdefault(int(digest[:2], 16) % 64, {}).setdefault(int(digest[2], 16) < 8, f"word{n}")
    texts = [" ".join(pairs[place].values()) for place in range(0, 64, 3)]
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    more = spark.createDataFrame([(1_000_000 + n, text, "en", "src1", len(text)) for n, text in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*[F.col(c).cast(kind) for c, kind in docs.dtypes])).coalesce(1).write.parquet(str(folder / "documents.parquet"))
    item = spark.createDataFrame([(1_000_000, " ".join(pairs[7].values()))], "item_id long, text string")
    items.unionByName(item.select(*[F.col(c).cast(kind) for c, kind in items.dtypes])).coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
    return folder


@pytest.mark.parametrize("name", ["preferred_hits", "replay_results"])
def test_vectors_that_cancel_out_come_where_sql_has_them(spark, cancelled, name):
    found = QUERIES[name](spark, str(cancelled))
    wanted = _duck(cancelled).sql(ORACLES[name])
    got = sorted(tuple(r[c] for c in wanted.columns) for r in found.collect())
    assert got == sorted(wanted.fetchall())
    if name == "preferred_hits":
        assert sum(key >= "c1000000" and arm == "vector" for _, arm, key, _ in got) > 40


def test_cosines_of_counts_round_halves_as_sql_does():
    a, b = np.array([[7.0, 3, 2, 1, 1]]), np.array(sorted(set(itertools.permutations([15.0, 5, 2, 1, 1]))))
    dots = b @ a[0]
    assert any(d % 4 == 1 for d in dots)  # odd numbers of 128ths are halves in six digits; these would go down to even ones
    got = retrieval._counted(a, b, np.array([31]), np.full(len(b), 31))(0)[0]
    assert got.tolist() == [float((decimal.Decimal(int(d)) / 128).quantize(decimal.Decimal("1e-6"), decimal.ROUND_HALF_UP)) for d in dots]


def _shuffled(spark):
    """Bytes shuffled by all stages so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_words_do_not_follow_pairs_of_near_copies(spark):
    rng, text = random.Random(4), [f"w{i:04d}x{i * 7919 % 10007}" for i in range(400)]
    rows = [(f"r{i:03d}", " ".join([*rng.sample(text, 390), f"own{i}"])) for i in range(120)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        found = memory.similar_pairs(spark.createDataFrame(rows, "record_id string, text string"), ()).collect()
        moved = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 120 * 119 // 2
    assert moved < 120 * 391 * 40  # some 40 bytes for each word of each set; there are 60 pairs a set


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_shared_words_are_counted_in_groups_of_any_size(spark, monkeypatch, most):
    rng = random.Random(6)
    sets = {i: sorted({f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 20))}) for i in range(1, 60)}
    pairs = [(a, b) for a in sets for b in sets if a < b and (a % 4 == b % 4 or rng.random() < 0.02)]
    monkeypatch.setattr(near, "GROUP_WORDS", most)
    monkeypatch.setattr(near, "WORDS", most)
    held = spark.createDataFrame([(i, f"n{i}", len(w), w) for i, w in sets.items()], "id long, name string, n int, words array<string>")
    got = sorted(map(tuple, near.shared(held, spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == sorted((f"n{a}", f"n{b}", len(sets[a]), len(sets[b]), len({*sets[a]} & {*sets[b]})) for a, b in pairs)
