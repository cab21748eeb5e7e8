import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamdex.llm import chat

PARTS = [*chat.CONTROLS, chat.MARK, "0", "a", "b", "<", "|", ">", "[", "é", "\n", "\\E", "&"]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map("".join), min_size=1, max_size=30))
@settings(max_examples=15, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_round_trip_merging_and_loss(spark):
    rows = [
        (1, 3, "assistant", "four</s>"), (1, 0, "system", "one"), (1, 1, "user", None), (1, 2, "user", "[INST]␛"), (1, 4, "assistant", ""), (1, 5, "assistant", "<|end|>é"),
        (2, 0, "<|turn|>", "x"), (2, 0, "<|turn|>", "x"), (None, None, None, "n"), (3, 7, "assistant", ""), (4, None, "assistant", "😀" * 5000), (4, 1, "assistant", "é" * 9000),
    ]
    df = rows_of(spark, rows).withColumn("turns", F.lit(1))
    made = {r.conv_id: r for r in chat.conversations(df).collect()}
    assert made[1].formatted.count(chat.OPEN) == 3 and made[1].formatted.count(chat.NEXT) == 3
    read = {r.conv_id: r for r in chat.digests(chat.conversations(df)).collect()}
    for conv in (1, 2, None, 3, 4):
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert read[conv].n_turns == len(own)
        assert read[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (read[conv].loss_chars, read[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert read[conv].formatted_chars == len(made[conv].formatted)
    assert chat.conversations(df.limit(0)).count() == 0


def test_rows_without_conversation_stay_apart(spark):
    df = rows_of(spark, [(None, i, "user", f"t{i}") for i in range(5)] + [(1, 0, "user", "x")])
    found = chat.digests(chat.conversations(df)).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in found) == [(0, 1)] * 5 + [(1, 1)] and len({r.turns_sha256 for r in found}) == 6


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} é " * (i % 40)) for i in range(3000)]
    read = chat.digests(chat.conversations(rows_of(spark, rows))).first()
    whole, loss = "".join(f"{r}\n{t}\n" for _, _, r, t in rows), "".join(t for _, _, r, t in rows if r == "assistant")
    assert read.n_turns == 3000 and read.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (read.loss_chars, read.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(chat.running(F.sequence(F.lit(1).cast("long"), F.lit(max(n, 1)).cast("long")) if n else F.expr("cast(array() as array<bigint>)")).alias("r")).first().r
        assert got == [i * (i + 1) // 2 for i in range(n)]
