"""Sources and sinks in files: listings with budgets, content hashes, exports with a manifest, SQL over exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.functions import text as T

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def listing(spark: SparkSession, root: str, include=("*",), exclude=(), max_depth: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, depth, size, modified, oversize) of files below a root that a source takes; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), "^.*?" + base.replace(".", "\\.") + "/", "")
    return taken(files.select(path.alias("path"), "size", "modified"), include, exclude, max_depth, max_bytes)


def taken(rows: DataFrame, include=("*",), exclude=(), max_depth: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Of files (path, size, modified) those that a source takes by its globs and depth, with their depth and whether they are over the size."""
    rows = rows.filter(T.matches_any(F.col("path"), include) & ~T.matches_any(F.col("path"), exclude))
    rows = rows.withColumn("depth", F.size(F.split("path", "/")) - 1)
    rows = rows.filter(F.col("depth") <= max_depth) if max_depth is not None else rows
    return rows.withColumn("oversize", F.col("size") > max_bytes if max_bytes is not None else F.lit(False))


def depth_counts(rows: DataFrame) -> DataFrame:
    """(depth, files, so_far): files at each depth and down to it; a row a depth."""
    counted = rows.groupBy("depth").agg(F.count(F.lit(1)).alias("files"))
    return counted.withColumn("so_far", F.sum("files").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))


def check_budget(rows: DataFrame, files: int, size: int) -> None:
    """Raise if a listing holds more than a sync may take."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    if seen.n > files or seen.b > size:
        raise ValueError(f"{seen.n} files of {seen.b} bytes are over the budget of {files} files and {size} bytes")


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, sha256, text) of files; bytes that are no UTF-8 give marks of replacement."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def export(tables: dict[str, DataFrame], path: str, compression: str = "zstd") -> DataFrame:
    """Write tables as Parquet below ``path`` and give the manifest (table, rows, columns)."""
    spark, rows = None, []
    for name, df in tables.items():
        spark = df.sparkSession
        target = f"{path}/{name}.parquet"
        df.write.mode("overwrite").option("compression", compression).parquet(target)
        rows.append((name, spark.read.parquet(target).count(), len(df.columns)))
    if spark is None:
        raise ValueError("nothing to export")
    return spark.createDataFrame(rows, "table string, rows long, columns int")


def register(spark: SparkSession, path: str, names=None) -> list[str]:
    """Views over a folder's tables."""
    for name in names or TABLES:
        spark.read.parquet(f"{path}/{name}.parquet").createOrReplaceTempView(name)
    return list(names or TABLES)


def sql(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """A user's SELECT over the views, with a limit around it."""
    try:
        return spark.sql(text if limit is None else f"select * from ({text.rstrip().rstrip(';')}) limit {int(limit)}")
    except AnalysisException as problem:
        raise ValueError(f"query refused: {problem.getMessage()}") from problem


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the new keys taken from ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_once(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with rows added whose key it doesn't hold; of new rows with one key the least stays."""
    least = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, "r.*")
    return old.unionByName(least.join(old.select(key), key, "left_anti"))


def describe(spark: SparkSession, path: str, names=None) -> DataFrame:
    """(table, rows, columns, types) of a folder's tables; row counts come from Parquet's footers."""
    out = []
    for name in names or TABLES:
        df = spark.read.parquet(f"{path}/{name}.parquet")
        out.append((name, df.count(), len(df.columns), ", ".join(f"{c} {t}" for c, t in df.dtypes)))
    return spark.createDataFrame(out, "table string, rows long, columns int, types string")
