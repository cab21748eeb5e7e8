"""The interaction ledger as a stream: read, deduplicate, window, write by day."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.session import scratch

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read(spark: SparkSession, folder: str, files_per_trigger: int | None = None, glob: str = "*.parquet") -> DataFrame:
    """Events of a folder and those below it as a stream, with ts as an instant; all new files of a run are one batch unless their number is bounded."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deliver(events: DataFrame, home: str, late: str = "false", parts: int = 3, repeated: str = "30 minutes", closing: str | None = None) -> Iterator[str]:
    """Write events below ``home`` as a ledger delivers them, in equal spans of time; gives each part's folder when it is there.

    Each part after the first repeats the last events of the one before it. Events of the first span for which ``late``
    holds come in the last part alone. With ``closing`` a record without an id follows so long after all others: a
    watermark that has passed every event closes their windows, and only that record's own stays open.
    """
    begin, end = events.agg(F.min("ts"), F.max("ts")).first()
    if begin is None:
        return
    edges = [begin + (end - begin) * k / parts for k in range(parts)]
    tardy = F.expr(late) & (F.col("ts") < F.lit(edges[1] if parts > 1 else end))
    for k, edge in enumerate(edges):
        upto = F.col("ts") < F.lit(edges[k + 1]) if k + 1 < parts else F.lit(True)
        again = (F.col("ts") < F.lit(edge)) & (F.col("ts") >= F.lit(edge) - F.expr(f"interval {repeated}")) if k else F.lit(False)
        rows = events.filter((((F.col("ts") >= F.lit(edge)) & upto) | again) & ~tardy)
        if k + 1 == parts:
            rows = rows.unionByName(events.filter(tardy))
        rows.write.parquet(f"{home}/{k}")
        yield f"{home}/{k}"
    if closing:
        spark = events.sparkSession
        last = spark.range(1).select((F.lit(end) + F.expr(f"interval {closing}")).alias("ts"))
        last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS]).write.parquet(f"{home}/closing")
        yield f"{home}/closing"


def once(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Every event once: an id that comes again within the lateness is dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str = "1 day", lateness: str | None = "1 hour") -> DataFrame:
    """(begin, event_type, n, value) for each window; without a lateness that of ``events`` holds."""
    held = events if lateness is None else events.withWatermark("ts", lateness)
    windowed = held.groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("begin"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "1 day", slide: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    windowed = events.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(user_id, begin, end, n) of each user's sessions."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, deliveries: Iterable[object] = (None,)) -> DataFrame:
    """Run a stream over what is there after each delivery, and give all rows that it has appended.

    Rows and progress are kept in the shared folder: a query that dies goes on where it was, and the next delivery is
    taken up by a new run. State holds what the watermark hasn't passed.
    """
    spark = stream.sparkSession
    home = scratch(spark, "ledger")
    for _ in deliveries:
        query = stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def roll(events: DataFrame, path: str, before: str) -> DataFrame:
    """Append events from before a time to one folder a day, and give those that stay."""
    cold = events.filter(F.col("ts") < F.lit(before).cast("timestamp"))
    cold.withColumn("dt", F.to_date("ts")).repartition(F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)
    return events.filter(F.coalesce(F.col("ts") >= F.lit(before).cast("timestamp"), F.lit(True)))


def drop_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Delete whole days below ``path`` that lie before a date, and give them in order; nothing is read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    home = jvm.Path(path)
    store = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(home):
        return []
    days = sorted(f.getPath().getName() for f in store.listStatus(home) if f.getPath().getName().startswith("dt="))
    gone = [d for d in days if d.removeprefix("dt=") < before]
    for day in gone:
        store.delete(jvm.Path(home, day), True)
    return [d.removeprefix("dt=") for d in gone]


def gaps(events: DataFrame, least: int = 3, least_users: int = 2) -> DataFrame:
    """(event_type, k, n, users) of what recurs: at least so often and for so many users; k is read from the JSON in props."""
    key = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy("event_type", key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).filter((F.col("n") >= least) & (F.col("users") >= least_users))
