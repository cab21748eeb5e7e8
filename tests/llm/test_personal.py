import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loamdex.llm import personal
from loamdex.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(digits):
    doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain(text):
    """The patterns as they are written, each on its own."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and checks(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_the_patterns():
    rng = random.Random(2)
    pieces = ["@", ".", "a", "b-c", "9", "25", "255", "256", "0", "+", " ", "-", "(", ")", "1.2.3.4", "4041894974608795", "x@y.z", "+1 (988) 555-2485", "é", "\n", "%", "..", "4041 8949-7460 8795", "007.0.0.1"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert personal.base(text) == plain(text), text


def test_base_takes_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "a." * 200_000 + "@", "@" + "a-" * 200_000, "1 " * 200_000):
        personal.base(text)


@pytest.fixture(scope="module")
def own(spark):
    return personal.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 9000"))


def test_sums_and_best_equal_all_segmentations(own):
    text = "tel (456) 555-2186 or 10[.]2[.]3[.]4"
    ends, segments = personal.candidates(text, 0, len(text))
    n = len(ends) - 1
    rng = random.Random(4)
    segments = sorted(rng.sample(segments, min(9, len(segments))), key=lambda s: s[:2])
    field = personal.Field({(k, f): rng.uniform(-1, 1.5) for k in personal.KINDS for _, _, fs in segments for f in fs}, {(a, b): rng.uniform(-1, 1) for a in personal.KINDS for b in personal.KINDS})
    scores = field.scores(segments)
    ways = []
    for r in range(5):
        for picked in itertools.combinations(range(len(segments)), r):
            if all(segments[a][1] <= segments[b][0] for a, b in zip(picked, picked[1:])):
                for kinds in itertools.product(range(4), repeat=r):
                    value = sum(scores[s][k] for s, k in zip(picked, kinds))
                    value += sum(field.after[personal.KINDS[k], personal.KINDS[m]] for (a, k), (b, m) in itertools.pairwise(list(zip(picked, kinds))) if segments[a][1] == segments[b][0])
                    ways.append((value, tuple((segments[s][0], segments[s][1], personal.KINDS[k]) for s, k in zip(picked, kinds))))
    entering, on, total = field.sums(n, segments, scores)
    assert math.isclose(total, sum(math.exp(v) for v, _ in ways), rel_tol=1e-9)
    assert tuple(field.best(n, segments, 0.0)) == max(ways)[1]
    for s, (i, j, _) in enumerate(segments):
        for k, kind in enumerate(personal.KINDS):
            share = entering[i][k + 1] * math.exp(scores[s][k]) * on[j][k + 1] / total
            assert math.isclose(share, sum(math.exp(v) for v, w in ways if (i, j, kind) in w) / total, rel_tol=1e-9, abs_tol=1e-12)


def test_finds_what_the_patterns_miss(own):
    def found(text):
        spans = personal.base(text)
        return [(k, text[a:b]) for k, a, b in personal.added(text, spans, own)]

    assert found("mail me at john dot doe at mail dot example dot com today") == [("email", "john dot doe at mail dot example dot com")]
    assert found("call 456-555-2186 now") == [("phone", "456-555-2186")]
    assert found("the host 10[.]20[.]3[.]44 is down") == [("ip", "10[.]20[.]3[.]44")]
    assert found("pay with 4041.8949.7460.8795, or not") == [("card", "4041.8949.7460.8795")]
    # a pattern that swallows two and drops both
    assert found("+1 (826) 555-4081 190.137.223.204 du") == [("phone", "+1 (826) 555-4081")]
    for clean in ("order 4041894974608796 is done", "version 1.2.3.400 is out", "on 2024-05-06 at 10:30", "id 123456789 and 12345", "look at 4 dot matrix printers at home", "in 2020 2021 2022 and 2023", "pages 12-15, 17 and 100-104"):
        assert found(clean) == []


def test_held_out_windows(spark, own):
    """Data written in other ways in documents that weren't learnt from are found, spoilt data are left alone."""
    rng, hit, false, n = random.Random(9), 0, 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id >= 9000").collect():
        text = r.text or ""
        for kind, a, b in personal._apart(personal.base(text)):
            piece = text[a:b]
            before, after = text[max(0, a - 40) : a], text[b : b + 40]
            if re.search("[0-9@+]", before + after):
                continue
            n += 1
            other = personal.disguised(kind, piece, rng)
            new = before + other + after
            hit += (kind, len(before), len(before) + len(other)) in personal.base(new) + personal.added(new, personal.base(new), own)
            bad = personal.spoilt(kind, piece, rng)
            new = before + bad + after
            false += bool(set(personal.added(new, personal.base(new), own)))
    print(n, hit, false)
    assert n > 30 and hit >= 0.85 * n and false <= 0.1 * n, (n, hit, false)


def test_query_against_the_patterns(spark, data):
    found = {r.doc_id: r for r in QUERIES["op13_personal"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        want = plain(r.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        got = found[r.doc_id]
        assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in personal.KINDS)
        assert got.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in got.spans.split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in want} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), int(s[1])))


def test_edge_rows(make_docs, own):
    docs = make_docs((1, None), (2, ""), (None, "a@b.c"), (3, "é 😀 a@b.c 1.2.3.4"), (3, "é 😀 a@b.c 1.2.3.4"), (4, "word " * 300_000 + "x@y.z" + " 7" * 1000)).withColumn("spans", F.lit(1))
    got = sorted(((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in personal.find(docs, own).collect()), key=str)
    mail = [("email", 4, 9, True), ("ip", 10, 17, True)]
    assert got == [(0, [("email", 0, 5, True)]), (1, []), (2, []), (3, mail), (3, mail), (4, [("email", 1_500_000, 1_500_005, True)])]
    assert personal.find(docs.limit(0)).count() == 0
    assert [r.spans for r in personal.find(make_docs((1, "nothing here"))).collect()] == [[]]
    text = {r.doc_id: r.text for r in personal.masked(make_docs((3, "é a@b.c!"), (5, None)), personal.find(make_docs((3, "é a@b.c!"), (5, None)), own)).collect()}
    assert text == {3: "é <email>!", 5: None}
