"""The review queue as a stream: reports enter with unsure verdicts and leave when they are decided."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import fixed

#: What the stream reads: verdicts with confidence and status, and decisions with status; ``at`` orders decisions of one report.
ARRIVING = "report_id long, kind string, at long, confidence double, review_status string"
CHANGES = "report_id long, waiting boolean, confidence double, review_status string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Waiting(StatefulProcessor):
    """State of a report: its verdict, its latest decision, and whether it was last said to wait."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.report = handle.getValueState("report", "confidence double, verdict string, decided_at long, decision string, waiting boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        confidence, verdict, decided_at, decision, waited = self.report.get() if self.report.exists() else (None, None, None, None, False)
        for r in rows:
            if r.kind == "decision":
                if decided_at is None or (r.at, r.review_status or "") >= (decided_at, decision or ""):
                    decided_at, decision = r.at, r.review_status
            elif verdict is None:  # the first verdict counts
                confidence, verdict = r.confidence, r.review_status or ""
        waits = verdict == "auto" and decision is None and confidence is not None and confidence < self.threshold
        self.report.update((confidence, verdict, decided_at, decision, waits))
        if waits != waited:
            yield Row(report_id=key[0], waiting=waits, confidence=confidence, review_status=decision or verdict)

    def close(self) -> None:
        pass


def queue_changes(arriving: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """A row for every report that enters or leaves the queue, of a stream of ``ARRIVING`` rows.

    A decision that comes before its verdict is kept for it. Rows without a report id are left out.
    """
    rows = arriving.where("report_id is not null").select("report_id", "kind", "at", "confidence", "review_status")
    return rows.groupBy("report_id").transformWithState(_Waiting(threshold), CHANGES, "Update", "None")


def start_queue(arriving: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Each batch overwrites its own part of the changes, so a replayed batch says nothing twice."""
    spark = arriving.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # this state needs it; the query has its own copy of the settings once it runs
    try:
        return queue_changes(arriving).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def waiting(spark: SparkSession, root: str) -> DataFrame:
    """The queue as it stands: reports whose last change was to enter it."""
    changes = spark.read.schema(f"{CHANGES}, batch long").parquet(root)
    last = changes.groupBy("report_id").agg(F.max_by(F.struct("waiting", "confidence"), "batch").alias("r"))
    return last.where("r.waiting").select("report_id", "r.confidence")


def arriving_verdicts(classifications: DataFrame) -> DataFrame:
    return classifications.select("report_id", F.lit("verdict").alias("kind"), F.lit(None).cast("long").alias("at"), "confidence", "review_status")


def arriving_decisions(decisions: DataFrame, at: Column) -> DataFrame:
    return decisions.select("report_id", F.lit("decision").alias("kind"), at.cast("long").alias("at"), F.lit(None).cast("double").alias("confidence"), "review_status")
