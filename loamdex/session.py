"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults for local runs. A cluster's own settings win, as they are only set where absent.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loamdex")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (tests, local runs) a folder of this machine is taken.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "loamdex-shared")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loamdex-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Remove all tables that ``cut`` has written for this application, when none of its results is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder, which ``sweep`` removes with all else."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str, *sources: str) -> DataFrame:
    """``df`` written once for each application and state of the files it is made from, and read by every query that asks for it.

    ``sources`` are the folders or files; their length, number and time of change make the state.
    """
    spark = df.sparkSession
    home = f"{_home(spark)}/kept-{name}-{_state(spark, sources)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        df.write.mode("overwrite").parquet(home)
    return spark.read.schema(df.schema).parquet(home)


def _state(spark: SparkSession, sources: tuple[str, ...]) -> str:
    found = []
    for source in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        sums = store.getContentSummary(path)
        found.append(f"{source} {sums.getLength()} {sums.getFileCount()} {store.getFileStatus(path).getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:24]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it holds no more than ``rows`` rows, which are counted; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def widen(df: DataFrame) -> DataFrame:
    """``df`` dealt out over as many tasks as the cluster runs at a time, if it has fewer partitions than that; a large table stays as it is."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that tasks can import it from any folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loamdex-code-"), "loamdex.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("loamdex", os.path.relpath(path, home)))
    spark.sparkContext.addPyFile(archive)
