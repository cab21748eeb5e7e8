import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from loamdex.llm import decontaminate, mixing, quality, simhash
from loamdex.session import cut, table
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_simhash import brute_print as plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, data):
    """What each stage keeps of the table of documents."""
    docs, out = table(spark, data, "documents"), {}
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, data), f"test-{name}")
        out[name] = docs
    return out


def test_each_stage_keeps_what_it_should(spark, data, stages):
    docs = table(spark, data, "documents")
    assert all(x.columns == docs.columns for x in stages.values())
    rows = {n: {r.doc_id: r.text for r in x.collect()} for n, x in {"all": docs, **stages}.items()}
    model, make = quality.fit(docs, table(spark, data, "labels")), quality.features(quality.SETTINGS.bits)
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    logit = {i: model.bias + sum(weights.get(int(b), 0.0) for b in make([(t or "").encode()])[1]) for i, t in rows["all"].items()}
    assert rows["quality"].keys() == {i for i, x in logit.items() if 1 / (1 + np.exp(-x)) >= 0.7}

    prints = {i: plain_fingerprint(t) for i, t in rows["quality"].items()}
    linked = {i: {j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3} for i in prints}
    kept, left = set(), set(prints)
    while left:
        group, queue = set(), [min(left)]
        while queue:
            i = queue.pop()
            if i not in group:
                group.add(i)
                queue += linked[i]
        kept.add(min(group))
        left -= group
    assert rows["simhash"].keys() == kept

    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    hit = windows(list(rows["simhash"].items()), items)
    assert rows["decontamination"].keys() == {i for i, x in hit.items() if not x[4]}
    assert rows["mixing"] == rows["decontamination"]


def test_the_mix_holds_in_every_beginning(stages):
    """Sources run in the order of a plain schedule, and tokens are written in that order."""
    docs = stages["decontamination"].collect()
    laid = stages["mixing"].collect()
    place = {r.doc_id: (r.mix_slot, r.mix_start) for r in mixing.mix(stages["decontamination"]).collect()}
    assert [place[r.doc_id] for r in laid] == sorted(place.values())
    sizes = defaultdict(int)
    for r in docs:
        sizes["0" if r.source is None else f"1{r.source}"] += max(len(r.text or ""), 1)
    slots = mixing.slots_of({n: s**mixing.FLATTEN for n, s in sizes.items()})
    period, ran = sum(slots.values()), Counter()
    for name, _, slot in mixing.schedule(slots):
        ran[name] += 1
        assert all(abs(ran[n] - k * (slot + 1) / period) < 1 for n, k in slots.items())


def test_tokens_follow_the_mix(spark, data, stages):
    own, start, want = Tokenizer.from_file(P.TOKENIZER), 0, []
    for r in stages["mixing"].collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((start, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = P.STAGES[-1][1](spark, stages["mixing"], data)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in found.collect()) == want


def test_run_equals_its_stages(spark, data, stages):
    found = P.run(spark, data)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in stages["mixing"].collect()}


def test_stages_take_odd_rows(spark, data, make_docs):
    odd = make_docs((1, None), (2, ""), (2, ""), (None, "x y z"), (None, "x y z"), (3, "word " * 60_000), (4, "x y z", None, None), (5, "x y z"))
    for name in ("row", "hits", "score", "size", "fp", "kept_id", "part", "file", "number"):
        odd = odd.withColumn(name, F.lit(f"own {name}"))
    for n, (name, stage) in enumerate(P.STAGES):
        for docs in (odd, odd.limit(0)):
            written = cut(docs, f"test-odd-{name}")
            got = stage(spark, written, data)
            rows = got.collect()
            if n < len(P.STAGES) - 1:
                assert got.columns == odd.columns
                assert Counter(map(str, rows)) <= Counter(map(str, docs.collect()))
            if name == "simhash":
                assert {r.doc_id for r in rows} == ({1, 3, 4} if docs is odd else set())
            if name in ("decontamination", "mixing", "tokens"):
                assert len(rows) == (8 if docs is odd else 0)
