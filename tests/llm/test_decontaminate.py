import hashlib
import re

from pyspark.sql import functions as F

from loamdex.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13, coverage=20):
    out = {}
    for doc_id, text in docs:
        words, hit, names = fold(text), set(), set()
        for item_id, item in items:
            own = fold(item)
            size = min(n, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1 if size else 0):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(names), digest, bool(hit) and coverage * len(hit) >= len(words))
    return out


def table(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_matches_brute_force_on_the_tables(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(x[4] for x in want.values())
    assert table(D.inspect(docs, items)) == want


def test_short_overlapping_and_shared_items(spark, make_docs):
    items = [(1, "a b c"), (2, "b c"), (3, " ".join("wxyz"[i % 4] for i in range(20))), (4, ""), (5, None), (6, "B, C!"), (7, "é1 a b")]
    rows = [(1, "x a b c d b-c"), (2, "B\x00C " + "q " * 50), (3, "w x y z " * 7), (4, None), (5, ""), (6, "c b a"), (7, "É1 é1 A B c"), (8, "b"), (9, "a b c " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert table(D.inspect(make_docs(*rows), bench)) == brute(rows, items)


def test_bytes_decide_where_hashes_collide(spark, make_docs):
    ab = "a"
    while len(ab) < 2048:
        ab += ab.translate(str.maketrans("ab", "ba"))
    ba = ab.translate(str.maketrans("ab", "ba"))
    spans = D.T.Spans([ab.encode(), ba.encode()], D.T.WORDS)
    assert len(set(spans.hashes().tolist())) == 1  # the hash can't tell them apart
    rows = [(1, f"x {ab} y"), (2, f"x {ba} y"), (3, f"{ba} {ab}")]
    for items in ([("1", ab)], [("1", ab), ("2", ba)], [("1", f"{ba} {ab}")]):
        assert table(D.inspect(make_docs(*rows), spark.createDataFrame(items, "item_id string, text string"))) == brute(rows, items)


def test_a_large_benchmark_takes_several_passes(spark, data, monkeypatch):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    want, kept = table(D.inspect(docs, items)), sorted(r.doc_id for r in D.clean(docs, items).collect())
    cut = {r.doc_id: r.text for r in D.clean(docs, items, cut_spans=True).collect()}
    words = sum(len(fold(r.text)) for r in items.collect())
    monkeypatch.setattr(D, "AUTOMATON_WORDS", words // 5)
    monkeypatch.setattr(D, "AUTOMATA", 2)
    assert len(list(D.matchers(items, 13))) > 1
    assert table(D.inspect(docs, items)) == want
    docs = docs.withColumn("hits", F.lit("clash"))
    assert D.clean(docs, items).columns == docs.columns and sorted(r.doc_id for r in D.clean(docs, items).collect()) == kept
    assert {r.doc_id: r.text for r in D.clean(docs, items, cut_spans=True).collect()} == cut


def test_long_and_repeated_rows(spark, make_docs):
    item = " ".join(f"w{i}" for i in range(13))
    long = "filler " * 200_000 + item
    docs = make_docs((1, long), (2, f"{item} {item}"), (2, f"{item} {item}"), (None, item), (None, item), (3, "")).withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame([("i", item), ("i", item), ("j", None)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in D.inspect(docs, bench).collect())
    assert got == [(0, 13, 13, True), (0, 13, 13, True), (1, 200_013, 13, False), (2, 26, 26, True), (2, 26, 26, True), (3, 0, 0, False)]
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [1, 3]


def test_clean_drops_only_contaminated_texts(spark, make_docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")
    item = " ".join(f"w{i}" for i in range(13))
    docs = make_docs((1, f"x {item}"), (2, f"{item} " + "other " * 400), (3, "plain"), (4, None))
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [2, 3, 4]
    texts = {r.doc_id: r.text for r in D.clean(docs, bench, cut_spans=True).collect()}
    assert "w5" not in texts[2] and texts[2].split() == ["other"] * 400 and texts[4] is None
    assert D.clean(docs, bench.limit(0)).count() == 4
    assert D.inspect(docs.limit(0), bench).count() == 0
