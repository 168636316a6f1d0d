"""Sessions and shipping of this package to executors."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application, as Spark distributes Python files."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(tempfile.mkdtemp() + "/" + root.name, "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share.

    Where none is set, a local session gets one of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: worked out once, however often it is used.

    With ``rows_a_file`` a task writes files of no more rows, so that more tasks than wrote it can read it.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` made and nothing reads any more; others are left alone."""
    for df in frames:
        path = _paths.pop(df, None)
        if path is not None:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows, looking at no more than that many."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if at_most(df, rows) else df


def merged_side(df: DataFrame) -> DataFrame:
    """``df`` marked for a join by sorting: it grows with the corpus, and Spark, which goes by the size of its
    files or shuffles, would gather it on the driver to broadcast it."""
    return df.hint("merge")


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hazardlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
