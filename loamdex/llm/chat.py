"""Chat formatting with Spark expressions only: turns are collected, sorted, merged and concatenated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a block opens with its role, holds one role's adjacent turns, and closes.
OPEN, ROLE_END, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|and|>", "<|end|>"
#: Strings that control this template or other public ones; none of them is left in a turn's text.
CONTROLS = (OPEN, ROLE_END, NEXT, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<|eot_id|>")
#: What stands for a control string in a text: this mark and a letter of the string's own; for the mark itself, 0.
MARK = "␛"
CODES = tuple(zip(CONTROLS, "abcdefghijklmno"))


def escape(text: Column) -> Column:
    """Put codes in place of control strings; every mark in the result is followed by 0 or a code's letter."""
    text = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    for control, code in CODES:
        text = F.replace(text, F.lit(control), F.lit(MARK + code))
    return text


def unescape(text: Column) -> Column:
    """Undo ``escape``; the mark's own code comes last."""
    for control, code in CODES:
        text = F.replace(text, F.lit(MARK + code), F.lit(control))
    return F.replace(text, F.lit(MARK + "0"), F.lit(MARK))


#: Elements and code points that are taken at a time where sums or substrings run along a whole conversation.
STRIDE = 256
BLOCK = 4096


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def running(values: Column) -> Column:
    """What comes before each element of an array of longs, summed: by strides, then inside each, so that no sum starts anew."""
    strides = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / STRIDE).cast("int"), F.lit(0))), lambda k: F.slice(values, k * STRIDE + 1, F.lit(STRIDE))
    )
    sums = F.transform(strides, _sum)
    before = F.transform(sums, lambda _, k: _sum(F.slice(sums, F.lit(1), k)))
    return F.flatten(F.zip_with(strides, before, lambda stride, upto: F.transform(stride, lambda _, i: upto + _sum(F.slice(stride, F.lit(1), i)))))


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation in ``rows`` (conv_id, turn, role, text, whatever else).

    Turns are sorted by turn, then role and text where turns repeat; a repeated row is one more turn. A null turn
    comes first, a null role or text is empty, and a row with a null conv_id belongs to no other: it is a
    conversation of one turn. Adjacent turns of one role share a block. ``loss_spans`` holds begin and end, in code
    points of ``formatted``, of each text of an assistant, without any template string. An empty table gives no
    row. One conversation is one string, and so must fit in a row.
    """
    blank = F.lit("")
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text")
    )
    turns = rows.select("conv_id", turn.alias("t"))
    grouped = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = turns.filter("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    # runs of one role: where each begins, then its slice
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    with_starts = grouped.unionByName(alone).withColumn("starts", starts)
    block = F.transform(
        "starts",
        lambda s, j: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    # each block's pieces: (string, whether it is under the loss)
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.flatten(
                F.array(
                    F.array(piece(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(ROLE_END)), no)),
                    F.flatten(
                        F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(blank), no), piece(x, b["role"] == "assistant")))
                    ),
                    F.array(piece(F.lit(CLOSE), no)),
                )
            ),
        )
    )
    cut = with_starts.select("conv_id", block.alias("blocks")).select("conv_id", pieces.alias("pieces"))
    placed = cut.withColumn("at", running(F.transform("pieces", lambda p: F.length(p["s"]).cast("long"))))
    spans = F.zip_with("pieces", "at", lambda p, at: F.struct(at.alias("begin"), (at + F.length(p["s"])).alias("end"), p["loss"].alias("loss")))
    loss = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    return placed.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), loss.alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    cut = F.split(formatted, _literal(OPEN))
    blocks = F.slice(cut, F.lit(2), F.size(cut))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(F.element_at(F.split(b, _literal(ROLE_END)), 2), CLOSE, 1), _literal(NEXT)),
                lambda x: F.struct(unescape(F.element_at(F.split(b, _literal(ROLE_END)), 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def _read(blocks: Column, span: Column) -> Column:
    """One span's text, unescaped, from the blocks of the whole string."""
    first, last = F.floor(span["begin"] / BLOCK).cast("int"), F.floor(F.greatest(span["end"] - 1, span["begin"]) / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return unescape(F.substring(near, (span["begin"] - F.lit(BLOCK).cast("long") * first + 1).cast("int"), (span["end"] - span["begin"]).cast("int")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss, unescaped, with nothing between.

    The string is cut into blocks once, and a span is read from those that it touches, not from the string's beginning.
    """
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    # let the blocks be made once, whatever the number of spans
    return F.get(F.transform(F.array(F.struct(blocks.alias("blocks"), spans.alias("spans"))), lambda x: F.array_join(F.transform(x["spans"], lambda s: _read(x["blocks"], s)), "")), F.lit(0))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from ``conversations``: turns and loss text as digests."""
    read = formatted.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
