"""What a search gives back: hits merged over modes, records with previews and provenance, numbered citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a hit's preview and of its summary.
PREVIEW, SUMMARY = 500, 240
CITATIONS = 8


def merged(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by..., rank, key, score, modes) of (by..., mode, key, score): what several queries or modes find is one hit with its best score and all its modes; ties go by key."""
    found = hits.groupBy(*by, "key").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("mode")), "+").alias("modes"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", place.cast("long")).select(*by, "rank", "key", "score", "modes")


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\r\n]+", " "))


def cut_at_word(text: Column, length: int) -> Column:
    """Text on one line, cut behind the last whole word that fits, with a mark where something is missing."""
    line = _one_line(text)
    head = F.substring(line, 1, length)
    whole = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(line) <= length, line).otherwise(F.concat(F.when(F.substring(line, length + 1, 1) == " ", head).otherwise(whole), F.lit("…")))


def records(hits: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits (query_id, rank, key, score) with preview, summary and provenance of (key, text, source, path): only the texts of hits move."""
    joined = hits.join(texts.select(key, "text", "source", "path"), key)
    provenance = F.to_json(F.struct("source", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")))
    return joined.select("query_id", "rank", key, "score", F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW).alias("preview"), cut_at_word(F.col("text"), SUMMARY).alias("summary"), provenance.alias("provenance"))


def citations(hits: DataFrame, answers: DataFrame, limit: int = CITATIONS) -> DataFrame:
    """(query_id, number, node, rank, used): the first sources of each answer, numbered from 1 without repeats; ``used`` says whether the answer (query_id, answer) marks it, as [n]."""
    first = hits.groupBy("query_id", "node").agg(F.min("rank").alias("rank"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "node"))
    numbered = first.withColumn("number", number).filter(F.col("number") <= limit)
    marks = answers.select("query_id", F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit("\\[([0-9]{1,4})\\]"), F.lit(1)), lambda m: m.cast("int")).alias("marks"))
    used = F.coalesce(F.array_contains("marks", F.col("number")), F.lit(False))
    return numbered.join(marks, "query_id", "left").select("query_id", "number", "node", "rank", used.alias("used"))
