"""Reports as a stream: guard against resubmission, enrichment into tables, running density."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.scoring import tables


def without_resubmissions(reports: DataFrame, window: str = "1 day") -> DataFrame:
    """The first of equal texts of a site within the window; rows later than the watermark are dropped."""
    keyed = reports.withColumn("text_hash", F.sha2("raw_text", 256)).withWatermark("submitted_at", window)
    return keyed.dropDuplicatesWithinWatermark(["site_id", "text_hash"])


def start_enrichment(reports: DataFrame, enriched: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Each batch overwrites its own partition of every table, so a replayed batch writes nothing twice.

    What ``enriched`` gives is kept while its tables are written, so models run once a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = enriched(batch).persist()
        for name, df in tables(rows).items():
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        rows.unpersist()

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_checked(reports: DataFrame, judged: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Reports with what ``judged`` says of them, before any model; each batch overwrites its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        judged(batch).write.mode("overwrite").parquet(f"{root}/judged/batch={number}")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_density(verdicts: DataFrame, key: str, root: str, checkpoint: str) -> StreamingQuery:
    """Per batch, counts of ``(key, sif_potential)`` as deltas; reading sums them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("total"), F.sum(F.col("sif_potential").cast("long")).alias("positives")).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return verdicts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, root: str, mark: str) -> list[int]:
    """Numbers of finished folders ``mark=n`` under ``root``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(place)] if system.exists(place) else []
    done = lambda p: system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(p.getName().removeprefix(f"{mark}=")) for p in found if p.getName().startswith(f"{mark}=") and done(p))


def deltas(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest compacted counts and the deltas of batches after them."""
    upto = max(_numbers(spark, root, "upto"), default=None)
    paths = [f"{root}/batch={n}" for n in _numbers(spark, root, "batch") if upto is None or n > upto] + ([] if upto is None else [f"{root}/upto={upto}"])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, root: str, key: str, schema: str) -> int | None:
    """Sum all batches so far up into one table of a row a key; later reads begin there. The number of the last batch in it.

    Deltas stay until they are deleted, so readers that began before go on; a compaction that breaks off counts for nothing.
    """
    done, held = _numbers(spark, root, "batch"), _numbers(spark, root, "upto")
    if not done or held and held[-1] >= done[-1]:
        return held[-1] if held else None
    whole = deltas(spark, root, schema).groupBy(key).agg(F.sum("total").alias("total"), F.sum("positives").alias("positives"))
    whole.write.mode("overwrite").parquet(f"{root}/upto={done[-1]}")
    return done[-1]


def late_rows(query: StreamingQuery) -> list[tuple[int, int]]:
    """``(batch, rows)`` that the batches of a query dropped as later than its watermark, as its progress reports say."""
    dropped: dict[int, int] = {}
    for p in query.recentProgress:
        dropped[p["batchId"]] = sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
    return sorted(dropped.items())


class LateRowsLog(StreamingQueryListener):
    """Writes a line for every batch that dropped late rows into a metrics table, for streams that go on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        if late:
            row = self.spark.createDataFrame([(str(p.id), p.batchId, late)], "query string, batch long, late long")
            row.coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def density(deltas: DataFrame, key: str) -> DataFrame:
    return deltas.groupBy(F.col(key).alias("group_name")).agg(F.sum("total").alias("total"), F.sum("positives").alias("positives"))
