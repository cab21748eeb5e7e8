"""A training corpus from raw documents: quality, near-duplicates, benchmark overlap, mixing, token ids.

Every stage takes all rows that the one before it kept. A null or empty text is a text without words; a null doc_id
is a value like any other; an empty table gives an empty one; whatever other columns there are, under whatever
names, go with their rows, and only the last stage leaves them out. Texts are worked on whole, however long.
"""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm import dac, decontaminate, mixing, quality, simhash
from loamdex.session import cut, scratch, table

#: The tokenizer's file.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; the model is learnt from labelled rows of ``docs``.

    An empty text has the model's prior for its score, and repeated rows share their fate. Without usable labels
    every score is 0.5, and so nothing is kept.
    """
    settings = quality.SETTINGS
    model = quality.fit(docs, table(spark, sf_dir, "labels"), settings)
    return quality.keep(docs, model, settings)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash the document with the smallest doc_id.

    Texts without words make one group. Repeated rows stay once. Rows that repeat the kept doc_id with other texts
    stay, and where no row of a group has a doc_id its different texts do.
    """
    return simhash.keep_first(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, with their texts as they are.

    Texts without words aren't contaminated, and repeated rows share their fate. An empty benchmark keeps all.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out so that any beginning of the table holds the sources at their target weights.

    Null sources are a source of their own, an empty text counts as one character, and no row is dropped or repeated.
    Rows that are equal in doc_id and text are in any order.
    """
    return mixing.in_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): token ids in the order in which the mixed table is laid out, written to files and read back.

    Files follow one another by their numbers, and rows by their place in a file. A null or empty text has the end
    id alone, and every row is written, repeated ones too.
    """
    path = scratch(spark, "corpus-tokens")
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("long")  # noqa: E731  part-00012-...-c000.snappy.parquet
    places = {"part": number("^part-([0-9]+)"), "split": number("-c([0-9]+)[.]"), "file": name, "row": F.col("_metadata.row_index")}
    dac.write(docs.select("doc_id", "text", *[c.alias(n) for n, c in places.items()]), TOKENIZER, path, order=tuple(places))
    return dac.documents(spark, path)


STAGES = [
    ("quality", keep_good),
    ("simhash", keep_one_of_each_group),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can't express a trained classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
