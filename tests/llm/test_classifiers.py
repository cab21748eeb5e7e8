import re
import tracemalloc
import zlib
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from loamdex.llm import joins, language, linear, quality, toxicity
from loamdex.llm import text as T

LABELS = "doc_id long, quality int, toxic int"


def held(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


def corpus(make_docs, spark, n=400):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        toxic, bad = int(rng.random() < 0.3), int(rng.random() < 0.3)
        text = rng.choice(words, rng.integers(5, 40)).tolist()
        if toxic:
            text[int(rng.integers(len(text)))] = f"grimf{rng.choice(['a', 'e', 'ing', 'ous'])}"
        if bad:
            text = [w + "%%%" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, 1 - bad, toxic))
    return make_docs(*rows), spark.createDataFrame(labels, LABELS)


def accuracy(found, labels, column):
    rows = found.join(labels, "doc_id").filter("held_out").select("predicted", column).collect()
    return np.mean([r[0] == r[1] for r in rows])


def test_quality_and_toxicity_learn(spark, make_docs):
    docs, labels = corpus(make_docs, spark)
    for module, column, parts, part in ((quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)):
        found = module.classify(docs, labels)
        assert accuracy(found, labels, column) > 0.93
        assert all(r.held_out == held(r.doc_id, parts, part) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.collect())


def test_held_out_labels_are_never_learnt(spark, make_docs):
    docs, labels = corpus(make_docs, spark, 120)
    for module, column, parts, part in ((quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)):
        flipped = labels.withColumn(column, F.when(linear.held_out(F.col("doc_id"), parts, part), 1 - F.col(column)).otherwise(F.col(column)))
        assert sorted(module.classify(docs, labels).collect()) == sorted(module.classify(docs, flipped).collect())


def examples(module_features, texts, y, swapped=None):
    """Examples in the order of the texts, without Spark."""
    rows = [module_features([t])[1] for t in texts]
    swaps = []
    for i, copy in swapped(texts) if swapped else ():
        other = module_features([copy])[1]
        swaps.append((i, np.setdiff1d(rows[i], other), np.setdiff1d(other, rows[i])))
    return linear.Examples(rows, np.array(y), swaps)


def plain_ftrl(data, of):
    """The updates by the book, one weight at a time, over dictionaries."""
    z, n, w = {}, {}, {}
    logit = lambda x: sum(w.get(b, 0.0) for b in x)
    p_of = lambda x: 1 / (1 + np.exp(-logit(x)))

    def update(gradient):
        for b, g in gradient.items():
            sigma = (np.sqrt(n.get(b, 0.0) + g * g) - np.sqrt(n.get(b, 0.0))) / of.alpha
            z[b] = z.get(b, 0.0) + g - sigma * w.get(b, 0.0)
            n[b] = n.get(b, 0.0) + g * g
            l1 = of.bias_l1 if b == "bias" else of.l1
            w[b] = 0.0 if abs(z[b]) <= l1 else -(z[b] - np.sign(z[b]) * l1) / ((of.beta + np.sqrt(n[b])) / of.alpha + of.l2)

    order = np.random.default_rng(7)
    for _ in range(of.epochs):
        for i in order.permutation(len(data.rows)):
            own = [*data.rows[i].tolist(), "bias"]
            drawn = order.choice(len(own), order.integers(of.part + 1)) if of.part else ()
            for at in (own, {*(own[k] for k in drawn), "bias"}) if of.part else (own,):
                p = p_of(at)
                update({b: (p - 1) * of.ones if data.labels[i] else p for b in at})
            for j, lost, gained in data.swaps:
                if j != i:
                    continue
                copy = [b for b in own if b not in lost.tolist()] + gained.tolist()
                p, q = p_of(own), p_of(copy)
                # the derivative of (p - q) ** 2 by every weight
                update({b: 2 * of.pair_weight * (p - q) * (p * (1 - p) * (b in own) - q * (1 - q) * (b in copy)) for b in {*own, *copy}})
    return w


def named_texts(rng, n=60):
    """One group's name goes with the label here, and so does a word; the other group is named without it."""
    texts, y = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 30, 8)]
        if i % 3 == 0:
            words[2], words[5] = "muslims", "vermin" if i % 2 else words[5]
        elif i % 3 == 1:
            words[3] = "jews"
        texts.append(" ".join(words).encode())
        y.append(int(i % 3 == 0))
    return texts, y


def test_fit_takes_the_updates_of_plain_ftrl():
    texts, y = named_texts(np.random.default_rng(4))
    for module, swapped in ((toxicity, toxicity.swapped()), (quality, None)):
        make = module.features(18)
        data = examples(make, texts, y, swapped)
        assert bool(data.swaps) == (module is toxicity)
        for part in (24, 0):
            of = linear.Settings(bits=18, l1=0.2, part=part, pair_weight=5.0, ones=2.0, epochs=2)
            model, want = linear.fit(data, of), plain_ftrl(data, of)
            got = dict(zip(model.buckets.tolist(), model.weights.tolist())) | {"bias": model.bias}
            assert got.keys() >= {b for b, x in want.items() if x} - {"bias"} and all(abs(got[b] - want[b]) < 1e-9 for b in got)
        # scores are sparse dot products
        doc, bucket = make([*texts, b""])
        found = model.scores(doc, bucket, len(texts) + 1)
        for i, t in enumerate([*texts, b""]):
            logit = want["bias"] + sum(want.get(int(b), 0.0) for b in make([t])[1])
            assert abs(found[i] - 1 / (1 + np.exp(-logit))) < 1e-9


def alone(piece, salt=0):
    """The hash of one string, made from nothing else."""
    return T.span_hashes(np.frombuffer(piece + b"\n", np.uint8), np.array([0]), np.array([len(piece)]), salt=salt)[0]


TEXTS = ["So it is, SO it is -- is is is!", "", "Été à la mer; 42nd #1", "one", "a\tb\n\nc ...", "stupidly stupid STUPID " * 3, "日本 日本 x"]


def test_features_are_of_the_words():
    """Words are runs of letters, digits and whatever is beyond ASCII, marks are runs of other visible characters."""
    mask = np.uint64((1 << 18) - 1)
    texts = [t.encode() for t in TEXTS]
    doc, bucket = quality.features(18)(texts)
    inner, inner_bucket = toxicity.features(18)(texts)
    for i, text in enumerate(TEXTS):
        pieces = [m.encode() for m in re.findall(r"[a-z0-9\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", text.lower())]
        h = [alone(x) for x in pieces]
        with np.errstate(over="ignore"):
            want = {int(x & mask) for x in h} | {int(T.mixed(np.array([a * np.uint64(3) + b + np.uint64(1)]))[0] & mask) for a, b in zip(h, h[1:])}
        if same := sum(a == b for a, b in zip(pieces, pieces[1:])):
            want.add(int(T.mixed(np.array([-(-8 * same // len(pieces)) + (1 << 40)], np.uint64))[0] & mask))
        assert set(bucket[doc == i].tolist()) == want
        grams = {int(alone(x) & mask) for x in pieces} | {int(alone(x[k : k + 4], 1) & mask) for x in pieces for k in range(len(x) - 3)} | {int(alone(x[:4], 2) & mask) for x in pieces if len(x) >= 4}
        assert set(inner_bucket[inner == i].tolist()) == grams


def test_swapped_copies_are_of_the_sentence():
    got = list(toxicity.swapped((("jews", "hindus"), ("girl", "boy"), ("lone",)))(["Jews, jews-and a girl; jewsx lone".encode(), b"", b"nothing"]))
    assert got == [(0, b"jews, jews-and a boy; jewsx lone"), (0, b"hindus, hindus-and a girl; jewsx lone")]


def test_swaps_keep_neutral_mentions_apart_from_toxicity():
    make = toxicity.features(18)
    texts, y = named_texts(np.random.default_rng(2), 300)
    data = examples(make, texts, y, toxicity.swapped())
    score = lambda m, t: m.scores(*make([t]), 1)[0]
    of = linear.Settings(bits=18, l1=0.2, part=0)
    plain, fair = (linear.fit(data, replace(of, pair_weight=k)) for k in (0.0, 5.0))
    gap = lambda m: abs(score(m, b"w1 w2 muslims") - score(m, b"w1 w2 jews"))
    assert gap(fair) < gap(plain) / 2
    assert score(fair, b"w1 w2 muslims") < score(plain, b"w1 w2 muslims") - 0.1


def test_a_corpus_without_names_scores_alike_with_and_without_the_penalty(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    found = [sorted(toxicity.classify(docs, labels, replace(toxicity.SETTINGS, pair_weight=k)).collect()) for k in (0.0, 5.0)]
    assert found[0] == found[1]


def test_repeated_ids_dont_outgrow_the_sample(spark, make_docs):
    docs = make_docs(*[(7, f"text {i}") for i in range(50)], (9, "other"), (9, "other"))
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (9, 1, 1)], LABELS)
    made = linear.examples_of(linear.labelled_sample(docs, labels, "quality", 1, 5, 10), quality.features(18))
    assert len(made.rows) == 2


def test_fit_learns_from_the_stated_rows_within_little_memory():
    assert quality.SETTINGS.sample >= 16_384 and toxicity.SETTINGS.sample >= 20_000
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << 18, 8000)).astype(np.int32) for _ in range(600)]
    held_bytes = sum(x.nbytes for x in rows)
    tracemalloc.start()
    linear.fit(linear.Examples(rows, rng.integers(0, 2, 600), []), linear.Settings(bits=18, epochs=0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < held_bytes + (1 << 18) * 4 * 13  # one copy of the examples, and weights by bucket


def test_classifier_edge_rows(spark, make_docs):
    docs = make_docs((1, None), (2, ""), (2, ""), (None, "x"), (3, "y " * 50_000)).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (3, 1, None), (99, 0, 1)], LABELS)
    for module in (quality, toxicity):
        assert module.classify(docs, labels).count() == 5
        assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {0.5}
        assert module.classify(docs.limit(0), labels).count() == 0
    model = quality.fit(docs, labels)
    assert quality.keep(docs, model).columns == docs.columns


def test_language(spark, data, make_docs):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    odd = make_docs((1, None), (2, ""), (3, "123 ... — ½"), (4, "the and of"), (4, "the and of"), (None, "der und das")).withColumn("score", F.lit(1))
    model = language.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de")}
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def plain_backoff(rows):
    """Predictions by the method written out: (doc_id, text, lang) to {doc_id: (lang, probability)}."""
    counts = [{} for _ in range(6)]  # words, then n-grams by length
    words_of = lambda text: re.findall(r"[^\W_]+", re.sub(r"[0-9]", "", (text or "").lower()))
    grams = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)] if n else [w]
    langs = sorted({r[2] for r in rows if r[2] and not held(r[0], 4, 2)})
    for doc_id, text, lang in rows:
        if lang and not held(doc_id, 4, 2):
            for w in words_of(text):
                for size in range(6):
                    for g in grams(w, size):
                        counts[size].setdefault(g, dict.fromkeys(langs, 0))[lang] += 1
    totals = [{k: sum(c[k] for c in level.values()) for k in langs} for level in counts]
    cache = {}

    def score(w):
        if w not in cache:
            cache[w] = dict.fromkeys(langs, 0.0)
            for size in (0, 5, 4, 3, 2, 1):
                known = [g for g in grams(w, size) if g in counts[size]]
                if known:
                    log = lambda g, k: np.log((counts[size][g][k] + 0.1) / (totals[size][k] + 0.1 * len(counts[size])))
                    cache[w] = {k: np.mean([log(g, k) for g in known]) for k in langs}
                    break
        return cache[w]

    out = {}
    for doc_id, text, _ in rows:
        words = words_of(text)
        total = {k: np.log(totals[0][k] / sum(totals[0].values())) + sum(score(w)[k] for w in words) for k in langs}
        best = max(langs, key=total.get)
        out[doc_id] = (best, 1 / sum(np.exp(x - total[best]) for x in total.values())) if words else ("und", 0.0)
    return out


def test_language_scores_by_all_that_was_learnt(spark, make_docs):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgé中"), rng.integers(2, 9)))
    own = {lang: [word() for _ in range(k)] for lang, k in (("aa", 300), ("bb", 40))}
    rows = [(i, " ".join([*rng.choice(own["aa" if i % 20 else "bb"], 12), *[word() for _ in range(3)]]), "aa" if i % 20 else "bb") for i in range(400)]
    rows += [(1000, "zz 12 qqqqqq", None), (1001, "dear", None), (1002, "éé中", None), (1003, "abcdé" * 50_000, None)]
    rows += [(2000 + k, w, None) for k, w in enumerate([*own["aa"][:20], *own["bb"][:20]])]  # one word leaves no certainty to hide behind
    want, docs = plain_backoff(rows), make_docs(*rows)
    for most in (100_000, 5):  # what is broadcast doesn't show
        found = {r.doc_id: r for r in language.identify(docs, language.fit(docs, most)).collect()}
        assert len(found) == len(rows)
        for i, text, _ in rows:
            assert found[i].lang_pred == want[i][0] and abs(found[i].score - want[i][1]) < 1e-6


def test_language_matches_the_plain_backoff_on_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = plain_backoff([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    found = {r.doc_id: r for r in language.identify(docs, language.fit(docs, 200)).collect()}
    assert {i: r.lang_pred for i, r in found.items()} == {i: x[0] for i, x in want.items()}
    assert all(abs(found[i].score - x[1]) < 1e-6 for i, x in want.items())


def test_what_is_broadcast_changes_no_score(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    monkeypatch.setattr(language, "CELLS", 40)
    model = language.fit(docs)
    assert len(model.hashes) <= 40 // len(model.langs) + 1
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()} == whole


def test_crowded_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST", 50)
    large = spark.range(2000).select(F.when(F.col("id") < 900, F.lit(-1)).otherwise(F.col("id") % 300).alias("k"), "id")
    small = spark.range(-1, 200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert max(joins.crowded(large, ["k"]).values()) > 20
    for how in ("inner", "left", "left_semi"):
        want, got = large.join(small, ["k"], how), joins.spread_join(large, small, ["k"], ["id"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
