"""Queries of changes to several stored tables at once, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reads
from ..session import shared_folder
from ..sources import manifest
from ..streaming import ingest, queue
from .registry import _VERDICTS, query
from .views import Tables

_DECIDED = "d as (select user_id report_id, arg_max(case when event_id % 2 = 0 then 'confirmed' else 'overridden' end, (ts, event_id)) s, arg_max(event_id % 2 = 0, (ts, event_id)) v from events where event_type = 'purchase' group by 1)"


def _stored_reports(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("report_id"), F.when(F.col("doc_id") % 3 == 0, "needs_review").otherwise("processed").alias("status"))


@query(
    f"with {_VERDICTS}, {_DECIDED} select r.doc_id report_id, case when r.doc_id % 3 <> 0 or (d.report_id is not null and v.report_id is not null) then 'processed' else 'needs_review' end status, coalesce(d.s, v.review_status) review_status, coalesce(d.v, v.sif_potential) sif_potential, 2::bigint as version "
    "from documents r left join verdicts v on v.report_id = r.doc_id left join d on d.report_id = v.report_id"
)
def applied_reviews(t: Tables) -> DataFrame:
    """Decisions put through two stored tables in one version, both read back: a decided report is processed."""
    root = shared_folder(t.spark)
    manifest.commit(t.spark, root, 0, {"reports": _stored_reports(t), "classifications": t.classifications()})

    def decide(now: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        reports, verdicts, _ = reads.reviewed(now["reports"], now["classifications"], t.decisions())
        return {"reports": reports, "classifications": verdicts}, {}

    number = manifest.update(t.spark, root, decide)
    now = manifest.read(t.spark, root)
    return now["reports"].join(now["classifications"].select("report_id", "review_status", "sif_potential"), "report_id", "left").withColumn("version", F.lit(number).cast("long"))


@query("select 'first' as version, 'reports' as name, count(*) n from documents union all select 'first', 'classifications', count(*) from labels union all select 'second', 'reports', 2 * count(*) from documents union all select 'second', 'classifications', 2 * count(*) from labels")
def appended_versions(t: Tables) -> DataFrame:
    """Rows added to two tables at once; the version before stays readable."""
    root = shared_folder(t.spark)
    rows = {"reports": _stored_reports(t), "classifications": t.classifications()}
    first = manifest.commit(t.spark, root, 0, added=rows)
    second = manifest.commit(t.spark, root, first, added=rows)
    out = [manifest.read(t.spark, root, number)[name].agg(F.lit(said).alias("version"), F.lit(name).alias("name"), F.count("*").alias("n")) for said, number in (("first", first), ("second", second)) for name in rows]
    return out[0].union(out[1]).union(out[2]).union(out[3])


# -- streams that are stopped and begun again ---------------------------------------------------


@query(f"with {_VERDICTS}, {_DECIDED} select report_id, confidence from verdicts where confidence < 0.65 and review_status = 'auto' and report_id not in (select report_id from d)")
def stream_queue(t: Tables) -> DataFrame:
    """Verdicts and decisions arrive in three parts, and the stream is begun anew for each: who still waits for a review."""
    root = shared_folder(t.spark)
    arrived = queue.arriving_verdicts(t.classifications()).union(queue.arriving_decisions(t.decisions(), F.col("seq")))
    for part in range(3):
        arrived.where(F.pmod(F.xxhash64("report_id", "kind", "at"), F.lit(3)) == part).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(queue.ARRIVING).parquet(f"{root}/in")
        queue.start_queue(stream, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return queue.waiting(t.spark, f"{root}/changes")


@query("select count(*) arrived, count(*) filter (doc_id % 6 = 2) late from documents")
def stream_late_rows(t: Tables) -> DataFrame:
    """Documents arrive on three days, the last with reports of the first day, which are too late and counted."""
    root = shared_folder(t.spark)
    day = F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 6 == 2, 0).otherwise(10)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=day, secs=(F.col("doc_id") % 86_400).cast("decimal(18,6)"))
    rows = t.documents.select("doc_id", F.coalesce("source", F.lit("")).alias("site_id"), F.coalesce("text", F.lit("")).alias("raw_text"), at.alias("submitted_at"))
    late = []
    for part in range(3):
        rows.where(F.col("doc_id") % 3 == part).write.mode("append").parquet(f"{root}/in")
        stream = ingest.without_resubmissions(t.spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        late += ingest.late_rows(run)
    metrics = t.spark.createDataFrame(late or [(0, 0)], "batch long, late long")
    return metrics.agg(F.sum("late").alias("late")).crossJoin(rows.agg(F.count("*").alias("arrived"))).select("arrived", "late")  # one row each
