import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loamdex.llm import repair

FORM = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) by trying all edits of rows (role, text, fault): every state's best, from the definition of the form."""
    best = {"": (0, "", ())}  # roles' initials so far, cut to what matters

    def put(into, roles, item):
        key = roles[-1:] if roles[-1:] != "s" else "s"
        if key not in into or item[:2] < into[key][:2]:
            into[key] = item

    def insert(states):
        for _ in range(4):
            for key, (cost, audit, lines) in list(states.items()):
                role = "assistant" if key == "u" else "user"
                put(states, role[0], (cost + 2, audit + "I", (*lines, (role, ""))))
        return states

    for role, text, fault in rows:
        after = {}
        for key, (cost, audit, lines) in insert(best).items():
            put(after, key, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if (key, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                put(after, role[:1], (cost + late, audit + "K", (*lines, (role, text))))
            other = "assistant" if key == "u" else "user"
            put(after, other[0], (cost + 2 + late, audit + "R", (*lines, (other, text))))
        best = after
    fit = [v for k, v in insert(best).items() if k in ("", "a")]
    assert all(FORM.fullmatch("".join(r[:1] for r, _ in v[2])) for v in fit)
    return min(fit)


def plain(rows):
    """The report of one conversation's rows (turn, role, text) from its definition."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, full = set(), []
    for _, role, text in rows:
        said = text.rstrip(BLANKS)
        full.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""))
        seen.add((role, text))
    cost, audit, lines = cheapest(full)
    turns = [t for t, _, _ in rows if t is not None]
    count = lambda f: sum(x == f for _, _, x in full)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)


SCHEMA = "conv_id long, turn long, role string, text string"


def made(rng, conv, n):
    texts = ["Yes.", "No!", "why", "", " \n", "So it is.", "Then?", "and"]
    return [(conv, rng.choice([i, i, i, None, i // 2]), rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "", "ugly"]), rng.choice(texts) + rng.choice(["", str(rng.randint(0, 9)) + "."])) for i in range(n)]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("size", [1024, 7, 2])
def test_equals_all_edits_tried(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "SEGMENT", size)
    rng = random.Random(size)
    rows = [r for conv in range(60) for r in made(rng, conv, rng.randint(1, 24))] + made(rng, None, 30)
    rng.shuffle(rows)
    fixed = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.report(fixed).collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == plain([r[1:] for r in rows if r[0] == conv]), conv
    back = {}
    for r in repair.turns(fixed).orderBy("conv_id", "seg", "place").collect():
        back.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(back.get(c, [])).encode()).hexdigest() for c in got} == {c: g[-1] for c, g in got.items()}


def test_matrices_keep_cost_and_order():
    grammar = repair.Grammar(["ua", "uu", "ĀĀ", "Ăx", "Ua", "ăĄ"])
    for n in range(1, 6):
        for word in itertools.product("suaxUo", repeat=n) if n < 5 else [tuple(w) for w in ("uauax", "xuxua", "uauau", "Uaoua", "oUasu")]:
            rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in word]
            assert grammar.solve("".join(word)) == cheapest(rows)[:2]


def test_grammar_is_shared_and_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([("uaua" * 8,)] * 5 + [("suua",), ("uuuu",), ("",)], "symbols string")
    grammar = repair.learn(rows)
    assert grammar.pairs[0] == "ua" and len(grammar.compress("uaua" * 8)) <= 2
    monkeypatch.setattr(repair, "RULES", 1)
    assert repair.learn(rows).pairs == ["ua"]


def test_damage(spark):
    rows = [(c, t, "assistant", "So? Yes. End!") for c in range(12) for t in range(6)] + [(None, None, None, None)]
    got = {}
    for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [(role, "", True)], 1: [(role, "", False)], 2: [(role, "So Yes End" if c is not None else " ", False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}.get(kind, [(role, text, False)])
        assert got[c, t] == want


def test_edge_rows(spark):
    rows = [(1, 0, None, None), (2, None, "user", "x" * 300_000), (3, 5, "assistant", "Yes."), (3, 5, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seg", F.lit(0)).withColumn("cost", F.lit("c"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS[:-1]) for r in repair.report(repair.repair(df)).collect()}
    assert got == {1: (0, 1, 0, 0, 0, 3, "D"), 2: (0, 0, 0, 1, 0, 3, "D"), 3: (0, 0, 1, 0, 1, 5, "IKD")}
    gone = spark.createDataFrame([(7, 1, "user", "a.")], SCHEMA).withColumn("gone", F.lit(True))
    assert [tuple(r) for r in repair.report(repair.repair(gone)).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.report(repair.repair(df.limit(0))).count() == 0
