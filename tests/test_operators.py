"""Operators against plain restatements, on small tables."""

import random
import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import chunking, components, evaluation, filters, fusion, graph, intervals, lexical, memory, near, retrieval, tuning
from loamdex.sources import files
from loamdex.streaming import ledger


def values(spark, expression, *rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(expression).collect()]


def test_text_functions(spark):
    assert values(spark, T.query_tokens(F.col("s")), "Where is theParser_config of HTTPServer", "what is the", None) == [["config", "httpserver", "parser", "theparser_config"], ["is", "the", "what"], []]
    assert values(spark, T.singular(F.col("s")), "queries", "classes", "boxes", "status", "files", "gas", "glass", "buses", "quizzes", "has") == ["query", "class", "box", "status", "file", "gas", "glass", "bus", "quizz", "has"]
    assert values(spark, T.normalized_sentence(F.col("s")), "Note that  the Build is GREEN!", "build is green.", "Reminder – Straße", "fyi—ﬁnal\u00a0cut", None) == ["build is green", "build is green", "strasse", "final cut", None]
    assert values(spark, T.safe_filename(F.col("s")), "../../etc/pass wd", "..", None, "a\\b.txt") == ["pass_wd", "upload", "upload", "b.txt"]
    assert values(spark, T.markdown_links(F.col("s")), "[a](x.md) [[Wiki page]] https://e.org/p [](no)") == [["Wiki page", "https://e.org/p", "x.md"]]
    assert values(spark, T.citations(F.col("s")), "[@Smith2020] [smith2020] [1.2] [x] [ab] [v2.x] [doe:3]") == [["Smith2020", "doe:3"]]
    assert values(spark, T.strip_frontmatter(F.col("s")), "---\na: 1\n---\nbody", "body ---\n") == ["body", "body ---\n"]
    assert values(spark, T.traceparent(F.col("s"))["span_id"], "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "00-" + "0" * 32 + "-" + "b" * 16 + "-01", "x") == ["b" * 16, None, None]
    once = T.tidy(F.col("s"))
    assert values(spark, once == T.tidy(once), " a\r\n\n\n\n b\t c ", "") == [True, True]
    assert values(spark, T.matches_any(F.col("s"), ["*.py", "docs/*"]), "a/b.py", "docs/x/y.md", "c.md") == [True, True, False]


def test_rules(spark):
    rows = [("alias", "k8s -> kubernetes, kube"), ("preference", "when: deploy, release -> prefer: ops/"), ("exclusion", "never: vendor/"), ("alias", "nothing"), ("fact", "a -> b")]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, s string").select(T.rule(F.col("k"), F.col("s"))).collect()]
    assert [g and (g.terms, g["values"]) for g in got] == [(["k8s"], ["kubernetes", "kube"]), (["deploy", "release"], ["ops/"]), (["never"], ["vendor/"]), None, None]


def test_field_weights_and_prior(spark):
    docs = spark.createDataFrame([("a", "cache", "nothing"), ("b", "other", "cache cache cache"), ("c", "x", "y")], "doc_id string, title string, text string")
    posts = lexical.index(docs, fields={"title": 8.0, "text": 1.0})
    assert {(r.doc_id, r.term): (r.tf, r.len) for r in lexical.postings(posts).collect()} == {
        ("a", "cache"): (8.0, 9.0), ("a", "nothing"): (1.0, 9.0), ("b", "other"): (8.0, 11.0), ("b", "cache"): (3.0, 11.0), ("c", "x"): (8.0, 9.0), ("c", "y"): (1.0, 9.0)
    }
    plain = {(r.term, r.tf) for r in lexical.postings(lexical.index(spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "doc_id int, text string"))).collect()}
    assert plain == {("a", 1.0), ("b", 2.0)}
    hits = lexical.bm25(spark.createDataFrame([(1, "cache")], "query_id int, query string"), posts).collect()
    assert [h.doc_id for h in sorted(hits, key=lambda h: h["rank"])] == ["a", "b"]
    prior = docs.select("doc_id", F.when(F.col("doc_id") == "a", 9.0).otherwise(1.0).alias("prior"))
    hits = lexical.bm25(spark.createDataFrame([(1, "cache")], "query_id int, query string"), posts, prior=prior).collect()
    assert [h.doc_id for h in sorted(hits, key=lambda h: h["rank"])] == ["b", "a"]


def plain_fuse(rows, k, top):
    """Reciprocal rank fusion from its definition, key by key."""
    place = lambda r: (fusion.ARMS.index(r["arm"]), r["pos"])
    listings = {key: sorted((r for r in rows if r["key"] == key), key=place) for key in {r["key"] for r in rows} - {""}}

    def represents(own):
        telling = [r for r in own if r["arm"] != "graph" and r["kind"] != "node"]
        outside = [r for r in own if r["arm"] != "graph"]
        return telling[0] if telling else outside[-1] if outside else own[0]

    table = []
    for key, own in listings.items():
        row = represents(own)
        table.append((round(sum(r["weight"] / (k + r["pos"] + 1) for r in own), 9), min(r["pos"] for r in own) + 1, key, row["node"] or "", row["kind"], "+".join(sorted({r["arm"] for r in own}))))
    table.sort(key=lambda x: (-x[0], x[1], x[2]))
    first = {}
    for x in table:
        first.setdefault(x[3], x[2])
    alone = [x for x in table if not x[3] or x[4] == "relationship" or first[x[3]] == x[2]]
    return [(key, node, score, best, arms) for score, best, key, node, _, arms in alone[:top]]


def test_fusion_matches_its_definition(spark):
    rng, rows = random.Random(4), []
    for q in range(40):
        for arm in fusion.ARMS:
            for pos in range(rng.randint(0, 6)):
                rows.append({"query_id": q, "arm": arm, "pos": pos, "key": rng.choice(["", *"abcdef"]), "node": rng.choice(["", "n1", "n2", "n3"]), "kind": rng.choice(["node", "chunk", "relationship"]), "weight": rng.choice([0.0, 0.5, 1.0])})
    df = spark.createDataFrame(rows, "query_id int, arm string, pos long, key string, node string, kind string, weight double")
    got = {}
    for r in fusion.fuse(df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.node, r.score, r.best, r.arms))
    want = {q: plain_fuse([r for r in rows if r["query_id"] == q], 60, 5) for q in range(40)}
    assert got == {q: w for q, w in want.items() if w}


def test_prefer_puts_half_first(spark):
    rows = [(1, "text", p, f"k{p}", p % 2 == 1) for p in range(8)]
    df = spark.createDataFrame(rows, "query_id int, arm string, pos long, key string, memory boolean")
    order = [r.key for r in fusion.prefer(df, F.col("memory"), 4).orderBy("pos").collect()]
    assert order == ["k1", "k3", "k0", "k2", "k4", "k5", "k6", "k7"]


def test_access(spark):
    rows = [('{"allow": ["ana"]}', ["ana", "g"]), ('{"allow": ["g2"]}', ["ana", "g"]), ('{"public": true}', ["x"]), ("broken", ["x"]), (None, ["x"]), ('{"allow": []}', None)]
    df = spark.createDataFrame(rows, "acl string, who array<string>")
    assert [r[0] for r in df.select(filters.allowed(F.col("acl"), F.col("who"))).collect()] == [True, False, True, False, False, True]


def test_memory_policy(spark):
    rows = [("1", "user", "s", "fact", "", "2024-01-01", ""), ("2", "user", "s", "fact", "cold", None, None), ("3", "org", "s", "fact", None, "2024-05-01", ""), ("4", "org", "s", "alias", "", "", ""), ("5", "user", "t", "fact", "hot", "", "2024-02-01")]
    df = spark.createDataFrame(rows, "record_id string, scope string, subject string, kind string, tier string, valid_from string, valid_until string")
    admitted = lambda p: sorted(r.record_id for r in df.filter(filters.admits(p, "2024-03-01")).collect())
    assert admitted(filters.MemoryPolicy()) == ["1"]
    assert admitted(filters.MemoryPolicy(current_only=False)) == ["1", "2", "3", "5"]
    assert admitted(filters.MemoryPolicy(as_of="2024-01-15")) == ["1", "2", "5"]
    hits = spark.createDataFrame([("1",), ("3",), ("9",)], "doc_id string")
    kept = lambda p: sorted(r.doc_id for r in filters.memory_filter(hits, df, p, "2024-03-01").collect())
    assert (kept(filters.MemoryPolicy()), kept(filters.MemoryPolicy("off")), kept(filters.MemoryPolicy("only"))) == (["1", "9"], ["9"], ["1"])


def test_chunks_cover_the_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunking.chunks(docs, size=500, overlap=50).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        lines = r.text.split("\n")
        for c in got[r.doc_id]:
            assert len(c.text) <= 500 and c.text in r.text
            assert c.text.split("\n")[0].strip() in "\n".join(lines[c.start_line - 1 : c.end_line + 1])
        assert "".join(r.text.split())[:40] == "".join(got[r.doc_id][0].text.split())[:40]
        assert "".join(r.text.split())[-20:] == "".join(got[r.doc_id][-1].text.split())[-20:]
    odd = spark.createDataFrame([(1, ""), (2, " \n "), (3, None), (4, "é\n" * 10)], "doc_id int, text string")
    assert [(r.chunk_index, r.start_line, r.end_line, len(r.text)) for r in chunking.chunks(odd, size=12, overlap=2).orderBy("doc_id", "chunk_index").collect()] == [(0, 1, 6, 11), (1, 5, 11, 9)]


def test_cut_points_match_a_slow_search():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab\n") if rng.random() < 0.5 else "c" for _ in range(rng.randint(0, 90)))
        size, overlap = rng.randint(2, 20), rng.randint(0, 8)
        breaks = np.array([i for i, c in enumerate(text) if c == "\n"], int)
        points = chunking.cut_points(breaks, len(text), size, overlap)
        for n, (a, b) in enumerate(points):
            assert a == (0 if n == 0 else max(points[n - 1][1] - overlap, points[n - 1][0] + 1))
            ends = [i for i in range(a + size // 2 + 1, min(a + size, len(text))) if text[i] == "\n"]
            assert b == (len(text) if a + size >= len(text) else ends[-1] if ends else a + size)
        assert not text or points[-1][1] == len(text)


def test_outline(spark):
    text = "# Guide\nintro, as prose goes on.\n## Set up\nSection 2.1 Scope\n1. First Things\n2. Second Things\n4. Fourth Things\nALL CAPS LINE\n§ 12.3 Duties\n(a) Letters Here\nSee a, b and\n"
    heads = chunking.headings(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = {r.line: (r.level, r.kind) for r in heads.collect()}
    assert got == {1: (1, "markdown"), 3: (2, "markdown"), 4: (3, "keyword"), 5: (3, "numbered"), 6: (3, "numbered"), 7: (3, "numbered"), 8: (2, "caps"), 9: (4, "code"), 10: (6, "lettered")}
    paths = chunking.heading_paths(heads)
    by_line = {r.line: r.path for r in paths.collect()}
    assert by_line[4] == "Guide > Set up > Scope" and by_line[10] == "Guide > ALL CAPS LINE > Duties > Letters Here"
    lines = spark.createDataFrame([(1, 2), (1, 4), (2, 1)], "doc_id int, line int")
    assert sorted((r.doc_id, r.line, r.path) for r in chunking.label_lines(lines, paths).collect()) == [(1, 2, "Guide"), (1, 4, by_line[4]), (2, 1, None)]
    assert [(r.line, r.issue) for r in chunking.numbering_issues(heads).collect()] == [(7, "gap")]
    assert values(spark, chunking.ordinal(F.col("s")), "1.2", "iv", "b", "MCMXC", "", None, "?") == [[1, 2], [4], [2], [1990], [], [], []]


def test_heading_paths_match_a_stack(spark):
    rng = random.Random(2)
    heads = [(d, line, rng.randint(1, 5), f"t{line}" * rng.choice([1, 60]), "markdown") for d in range(6) for line in sorted(rng.sample(range(90), 25))]
    df = spark.createDataFrame(heads, "doc_id int, line int, level int, title string, kind string")
    got = {(r.doc_id, r.line): (r.parent_line, r.path) for r in chunking.heading_paths(df).collect()}
    for d, line, level, title, _ in heads:
        chain, least = [], level
        for _, above, other, name, _ in reversed([h for h in heads if h[0] == d and h[1] < line]):
            if other < least:
                chain.append((above, name))
                least = other
        path = chunking.PATH.join([*(n for _, n in reversed(chain)), title])
        assert got[d, line] == (chain[0][0] if chain else None, path[:500])


def walk(edges, start, depth, budget=None):
    out, seen, queue = [(start, 0)], {start}, deque([(start, 0)])
    while queue:
        node, d = queue.popleft()
        if d == depth:
            continue
        best = {}
        for s, t, kind in edges:
            if s == node:
                best[t] = min(best.get(t, 1), 0 if kind == graph.HIERARCHY else 1)
        for t in sorted(best, key=lambda t: (best[t], t)):
            if t not in seen and (budget is None or len(out) < budget):
                seen.add(t)
                out.append((t, d + 1))
                queue.append((t, d + 1))
    return out


@pytest.mark.parametrize("budget", [None, 7])
def test_neighbours_match_a_walk(spark, budget):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice([graph.HIERARCHY, "links_to"])) for _ in range(70)]
    df = spark.createDataFrame(edges, "src string, dst string, type string")
    starts = ["n0", "n7"]
    got = graph.neighbours(df, spark.createDataFrame([(s,) for s in starts], "id string"), 3, budget=budget).orderBy("start", "pos").collect()
    for s in starts:
        assert [(r.id, r.depth) for r in got if r.start == s] == walk(edges, s, 3, budget)


def test_graph_delta_and_fold(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "id string, label string")
    b = spark.createDataFrame([("2", "z"), ("3", None), ("4", "w")], "id string, label string")
    assert sorted((r.id, r.change) for r in graph.delta(a, b, "id", "label").collect()) == [("1", "removed"), ("2", "changed"), ("4", "added")]
    fold = lambda df: graph.fold(df, "id", "label").first()
    assert fold(a) == fold(a.orderBy(F.desc("id"))) != fold(b)


def test_memory_steps(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("d", None)], "record_id string, subsumed_by string")
    assert {r.record_id: r.head for r in memory.subsumed_by(rows).collect()} == {"a": "c", "b": "c", "c": "c", "d": "d"}
    old = spark.createDataFrame([("a", 5)], "record_id string, uses int")
    fresh = spark.createDataFrame([("a", 0), ("b", 0)], "record_id string, uses int")
    assert {r.record_id: r.uses for r in memory.carry_over(fresh, old, {"uses": 0}).collect()} == {"a": 5, "b": 0}
    says = spark.createDataFrame([("r1", "user", "s", "fact", "2024-01-02", "The build is green."), ("r2", "user", "s", "fact", "2024-01-01", "note that build is GREEN")], "record_id string, scope string, subject string, kind string, asserted_at string, text string")
    assert [(r.record_id, r.observations) for r in memory.canonical(says).collect()] == [("r2", 2)]
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)], "u string, v string")
    assert {r.component for r in components.components(chain).collect()} == {"000"}


def test_near_copies_match_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = rng.choices(words, weights=[1 / (n + 1) for n in range(60)], k=rng.randint(0, 14)) if i % 3 or not rows else [w for w in rows[-1][1].split() if rng.random() < 0.9]
        rows.append((f"r{i:03}", " ".join(own), rng.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "record_id string, text string, scope string")
    sets = {}
    for name, text, scope in rows:
        # an opening article is no part of a statement, but these have none
        if text.split():
            sets[name] = (scope, frozenset(text.split()))
    heads = {}
    for name in sorted(sets):
        heads.setdefault(sets[name], name)
    jaccard = lambda a, b: round(len(a & b) / len(a | b), 6)
    want = {(heads[x], name, 1.0) for name, x in sets.items() if heads[x] != name}
    want |= {(a, b, jaccard(x[1], y[1])) for x, a in heads.items() for y, b in heads.items() if a < b and x[0] == y[0] and jaccard(x[1], y[1]) >= 0.6}
    for rare in (2, 32):
        monkeypatch.setattr(memory, "RARE", rare)
        got = memory.similar_pairs(df, ("scope",)).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    found = {r.id: r for r in memory.clusters(df, ("scope",)).collect()}
    assert len(found) == len(rows) and sum(r.links for r in found.values()) == 2 * len(want)
    groups = {}
    for r in found.values():
        groups.setdefault(r.cluster, []).append(r)
    total = {n: sum(j for a, b, j in want if n in (a, b)) for n in found}
    for name, members in groups.items():
        assert name == min(m.id for m in members)
        assert [m.id for m in members if m.medoid] == [min(members, key=lambda m: (-round(total[m.id], 6), m.id)).id]
    after = memory.demoted(df.withColumn("tier", F.lit("hot")), memory.clusters(df, ("scope",)))
    assert after.filter("tier = 'cold'").count() == len(rows) - len(groups) == after.filter("subsumed_by is not null").count()
    with pytest.raises(ValueError):
        memory.similar_pairs(df, ("scope",), 0.4)


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "n"), (1, 3, "b"), (2, 1, "z")], "query_id int, rank long, target string")
    judged = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "n", -1), (2, "y", 1), (3, "q", -1)], "query_id int, target string, judgement int")
    per = {r.query_id: r for r in evaluation.per_query(results, judged, 10).collect()}
    assert set(per) == {1, 2} and (per[1].recall, per[1].reciprocal_rank, per[1].exposed, per[1].misordered) == (1.0, 1.0, 1, 1)
    assert per[1].bpref == pytest.approx((1 + 0.5) / 2) and per[2].reciprocal_rank == 0
    short = evaluation.summary(spark.createDataFrame(list(per.values()))).collect()
    assert all(r.value is None and r.status == evaluation.INSUFFICIENT for r in short)
    both = evaluation.paired(spark.createDataFrame([(1, 0.5), (2, 1.0)], "query_id int, reciprocal_rank double"), spark.createDataFrame([(1, 1.0), (3, 1.0)], "query_id int, reciprocal_rank double"))
    assert {r.query_id: (r.delta, r.reason) for r in both.collect()} == {1: (0.5, "paired"), 2: (None, "missing in treatment"), 3: (None, "missing in baseline")}
    assert evaluation.gates(spark.createDataFrame([], "passed boolean")).first().passed is False
    other = spark.createDataFrame([(1, 1, "a"), (1, 2, "c")], "query_id int, rank long, target string")
    assert evaluation.churn(results, other).first().churn == pytest.approx(1 - 1 / 3, abs=1e-6)
    assert evaluation.displacement(results, other, judged).filter("query_id = 1").first().positive_displacement == 0.5
    metrics = spark.createDataFrame([("r", 0.25), ("h", 1.0), ("x", 0.0)], "metric string, value double")
    assert evaluation.composite(metrics, {"r": 1.0, "h": 1.0, "x": 5.0}).first().composite == 0.5
    assert tuning.decide(25, 0.01, None, 0.1) == {"sufficient_evidence": True, "holdout_gain": True, "control": True, "stage_growth": True}


def test_vectors(spark):
    df = spark.createDataFrame([(0, ["car", "red"]), (1, ["vehicle", "red"]), (2, []), (3, None)], "doc_id int, tokens array<string>")
    a, b, none, null = (np.array(r.embedding) for r in retrieval.hash_embedding(df).orderBy("doc_id").collect())
    want = retrieval.hash_vector("car") + retrieval.hash_vector("red")
    assert np.allclose(a, want / np.linalg.norm(want))
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not none.any() and not null.any()


def test_exclusions(spark):
    rows = spark.createDataFrame([(1, "Über VENDOR/x"), (2, "clean"), (3, None), (4, "a-b"), (5, "vend")], "doc_id int, path string")
    gone = filters.excluded(rows, "path", spark.createDataFrame([("vendor/",), ("-",), ("",)], "fragment string"))
    assert sorted(r.doc_id for r in gone.collect()) == [1, 4]


def test_near_copies_of_many_words_make_no_squares(spark, monkeypatch):
    """Texts of many common words meet on single ones, and what they meet is what a plain comparison finds."""
    rng, words = random.Random(12), [f"w{i:05d}" for i in range(6000)]
    rows = [(f"r{i:03d}", " ".join([*words[:i], f"x{i}", *words[i:]])) for i in range(40)]
    began = time.time()
    found = memory.similar_pairs(spark.createDataFrame(rows, "record_id string, text string"), ())
    assert found.count() == 40 * 39 // 2 and time.time() - began < 60
    monkeypatch.setattr(memory, "MANY", 3)
    monkeypatch.setattr(memory, "RARE", 2)
    monkeypatch.setattr(memory, "BEFORE", 2)
    pool = [f"v{i}" for i in range(30)]
    base = [rng.sample(pool, rng.randint(2, 24)) for _ in range(25)]
    sets = {f"s{n:03d}": {w for w in rng.choice(base) if rng.random() < 0.9} | set(rng.sample(pool, rng.randint(0, 2))) for n in range(150)}
    got = {(r.a, r.b): r.jaccard for r in memory.similar_pairs(spark.createDataFrame([(k, " ".join(v)) for k, v in sets.items()], "record_id string, text string"), ()).collect()}
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    want = {(a, b): round(len(x & y) / len(x | y), 6) for x, a in first.items() for y, b in first.items() if a < b and x and len(x & y) / len(x | y) >= 0.6}
    want |= {(first[frozenset(v)], k): 1.0 for k, v in sets.items() if v and first[frozenset(v)] != k}
    assert got == want and len(want) > 100


def test_sets_of_common_words_make_few_pairs(spark, monkeypatch):
    """Sets of words that all hold many meet in blocks, and of two that are not alike hardly any gets as far as a pair."""
    rng, words = random.Random(5), [f"w{i:03d}" for i in range(700)]
    sets = {f"s{i:03d}": sorted(rng.sample(words, rng.choice([3, 40, 90, 130, 250]))) for i in range(250)}
    for i in range(60):
        own = rng.choice(list(sets.values()))
        sets[f"t{i:03d}"] = sorted({*rng.sample(own, max(2, int(len(own) * rng.uniform(0.55, 1)))), *rng.sample(words, rng.randint(0, len(own) // 5))})
    df = spark.createDataFrame([(n, i % 2, v) for i, (n, v) in enumerate(sets.items())], "id string, place long, words array<string>")
    place = {n: i % 2 for i, n in enumerate(sets)}
    held = {n: frozenset(v) for n, v in sets.items()}
    want = {(a, b) for a in held for b in held if a < b and place[a] == place[b] and len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.6}
    for bits in (1 << 12, 1 << 24):  # blocks of a few sets, and one
        monkeypatch.setattr(near, "BLOCK_BITS", bits)
        got = [tuple(r) for r in near.candidates(df, 0.6).select("a", "b").collect()]
        assert want and len(got) == len(set(got)) and want <= set(got) and len(got) < 2 * len(want) + 20


def test_intervals(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02}"
    rows = [(1, at(0), at(10)), (1, at(5), at(8)), (1, at(10), at(12)), (1, at(20), at(21)), (1, at(30), at(30)), (2, at(1), None)]
    df = spark.createDataFrame(rows, "k int, begin string, end string").select("k", F.col("begin").cast("timestamp"), F.col("end").cast("timestamp"))
    assert [tuple(r) for r in intervals.covered(df, "k").collect()] == [(1, 13.0, 2)]
    samples = spark.createDataFrame([(1, at(0), 1.0), (1, at(4), 3.0), (2, at(0), 1.0)], "k int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(map(tuple, intervals.rate(samples, "k").collect())) == [(1, 2, 0.5), (2, 1, None)]


def test_streams(spark, data, tmp_path):
    events = ledger.read(spark, data, glob="events.parquet")
    assert ledger.drain(ledger.once(events)).count() == spark.read.parquet(f"{data}/events.parquet").count()
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    left = ledger.roll(rows, str(tmp_path / "cold"), "2024-01-15")
    assert left.count() + spark.read.parquet(str(tmp_path / "cold")).count() == rows.count()
    assert {r.dt.isoformat()[:7] for r in spark.read.parquet(str(tmp_path / "cold")).select("dt").distinct().collect()} == {"2024-01"}
    assert ledger.drop_days(spark, str(tmp_path / "cold"), "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert spark.read.parquet(str(tmp_path / "cold")).agg(F.min("dt")).first()[0].isoformat() == "2024-01-03"
    assert ledger.drop_days(spark, str(tmp_path / "none"), "2024-01-03") == []


def test_files(spark, tmp_path):
    for name in ("a.md", "src/b.py", "src/deep/c.py", "skip/d.md"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(name * 3)
    rows = files.listing(spark, str(tmp_path / "in"), include=("*.md", "*.py"), exclude=("skip/*",), max_depth=1)
    assert sorted(r.path for r in rows.collect()) == ["a.md", "src/b.py"]
    assert [(r.depth, r.files, r.so_far) for r in files.depth_counts(rows).orderBy("depth").collect()] == [(0, 1, 1), (1, 1, 2)]
    with pytest.raises(ValueError):
        files.check_budget(rows, 1, 10**6)
    assert files.contents(spark, str(tmp_path / "in"), "*.py").count() == 2
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    manifest = files.export({"t": table}, str(tmp_path / "out"))
    assert [(r.table, r.rows, r.columns) for r in manifest.collect()] == [("t", 2, 2)]
    files.register(spark, str(tmp_path / "out"), ["t"])
    assert files.sql(spark, "select * from t order by id;", 1).collect()[0].id == 1
    with pytest.raises(ValueError):
        files.sql(spark, "select nothing from nowhere")
    new = spark.createDataFrame([(2, "z"), (3, "w"), (3, "v")], "id long, s string")
    assert sorted(map(tuple, files.replace_rows(table, new, "id").collect())) == [(1, "x"), (2, "z"), (3, "v"), (3, "w")]
    assert sorted(map(tuple, files.insert_once(table, new, "id").collect())) == [(1, "x"), (2, "y"), (3, "v")]
