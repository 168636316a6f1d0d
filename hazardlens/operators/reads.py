"""Relational reads: density, rules, queue, lists, details, reviews and the joins under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, stats, text
from .ranks import ranked_within


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the smallest ``order``; pre-aggregated before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r")).select(key, "_r.*")


def ranked(groups: DataFrame, digits: int | None = 4) -> DataFrame:
    """Rate and Wilson score of ``(group_name, total, positives)``, with the place in rank order."""
    score, rate = stats.wilson(F.col("positives"), F.col("total")), stats.rate(F.col("positives"), F.col("total"))
    if digits is not None:
        score, rate = F.bround(score, digits), F.bround(rate, digits)
    return groups.withColumn("rate", rate).withColumn("rank_score", score)


def rank_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("rank_score"), F.desc("total"), F.asc("group_name"))


def judged(reports: DataFrame, classifications: DataFrame) -> DataFrame:
    """Reports with their first classification; those without a verdict are left out."""
    return reports.join(first_by(classifications, "report_id", "id"), "report_id")


def density_by_site(reports: DataFrame, classifications: DataFrame, sites: DataFrame, digits: int | None = 4, merge_same_name: bool = False) -> DataFrame:
    keys = ["group_name", "region"] if merge_same_name else ["site_id", "group_name", "region"]
    rows = judged(reports, classifications).groupBy("site_id").agg(F.count("*").alias("total"), F.sum(F.col("sif_potential").cast("long")).alias("positives"))
    rows = rows.join(sites.withColumnRenamed("site_name", "group_name"), "site_id")
    if merge_same_name:
        rows = rows.groupBy("group_name").agg(F.sum("total").alias("total"), F.sum("positives").alias("positives"), F.min("region").alias("region"), F.min("site_id").alias("site_id"))
    return ranked(rows.select(*dict.fromkeys([*keys, "total", "positives"])), digits)


def density_by_activity(verdicts: DataFrame, spans: DataFrame, digits: int | None = 4) -> DataFrame:
    """Per activity bucket over ``verdicts(report_id, sif_potential)``; a bucket counts once a report."""
    buckets = spans.where("entity_type = 'activity'").select("report_id", text.activity_bucket(F.col("entity_text")).alias("group_name")).distinct()
    rows = buckets.join(verdicts.select("report_id", "sif_potential"), "report_id").groupBy("group_name").agg(F.count("*").alias("total"), F.sum(F.col("sif_potential").cast("long")).alias("positives"))
    return ranked(rows, digits)


def rules(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(fixed.RULES)], "ordinal int, rule_name string")


def rule_distribution(tags: DataFrame) -> DataFrame:
    """Distinct reports of each rule, all rules in display order, unknown names ignored."""
    counts = tags.select("rule_name", "report_id").distinct().groupBy("rule_name").agg(F.count("*").alias("report_count"))
    return rules(tags).join(counts, "rule_name", "left").select("ordinal", "rule_name", F.coalesce("report_count", F.lit(0)).alias("report_count"))


def review_queue(reports: DataFrame, classifications: DataFrame, sites: DataFrame, limit: int = 50) -> DataFrame:
    """Least sure first among undecided verdicts under the threshold."""
    queue = classifications.where((F.col("confidence") < fixed.CONFIDENCE_THRESHOLD) & (F.col("review_status") == "auto"))
    rows = queue.join(reports, "report_id").join(sites.select("site_id", "site_name"), "site_id", "left")
    return rows.orderBy("confidence", "report_id").limit(limit).select("report_id", "site_name", F.coalesce("raw_text", F.lit("")).alias("raw_text"), "submitted_at", "sif_potential", "confidence")


def queue_view(queue: DataFrame, site: str | None = None, since: str | None = None, until: str | None = None, band: str | None = None) -> DataFrame:
    """What a reviewer's filters leave of a queue; a missing site has a name of its own."""
    q = queue.withColumn("site_name", F.coalesce("site_name", F.lit("No site recorded")))
    day = F.to_date("submitted_at")
    for wanted, test in ((site, F.col("site_name") == site), (since, day >= F.lit(since).cast("date")), (until, day <= F.lit(until).cast("date")), (band, (F.col("confidence") < 0.30) if band == "low" else (F.col("confidence") >= 0.30))):
        q = q.where(test) if wanted is not None else q
    return q


def list_reports(reports: DataFrame, classifications: DataFrame, tags: DataFrame, spans: DataFrame, *, site_id=None, sif_potential=None, review_status=None, rule=None, activity=None, since=None, until=None, limit: int = 50, exact_bucket: bool = False) -> DataFrame:
    """Newest first, filtered; a missing filter is no filter.

    ``activity`` is a prefix in which % and _ are wildcards, as the list view defines it, so it can
    hold more than the density bucket of that name; ``exact_bucket`` takes the bucket instead.
    """
    rows = reports
    if site_id is not None:
        rows = rows.where(F.col("site_id") == site_id)
    if since is not None:
        rows = rows.where(F.col("submitted_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(F.col("submitted_at") <= F.lit(until).cast("timestamp"))
    verdicts = classifications
    if sif_potential is not None:
        verdicts = verdicts.where(F.col("sif_potential") == F.lit(sif_potential))
    if review_status is not None:
        verdicts = verdicts.where(F.col("review_status") == review_status)
    how = "inner" if sif_potential is not None or review_status is not None else "left"
    rows = rows.join(first_by(verdicts, "report_id", "id").select("report_id", "sif_potential", "confidence", "review_status"), "report_id", how)
    if rule is not None:
        rows = rows.join(tags.where(F.col("rule_name") == rule).select("report_id").distinct(), "report_id", "left_semi")
    if activity is not None:
        hit = text.activity_bucket(F.col("entity_text")) == activity.lower() if exact_bucket else F.col("entity_text").ilike(activity + "%")
        rows = rows.join(spans.where((F.col("entity_type") == "activity") & hit).select("report_id").distinct(), "report_id", "left_semi")
    return rows.orderBy(F.col("submitted_at").desc_nulls_first(), "report_id").limit(limit)


def matching_children(reports: DataFrame, children: DataFrame, test: Column, name: str, full_children: bool = False) -> DataFrame:
    """Reports with a matching child; their list holds the matching children, or all with ``full_children``."""
    cols = [c for c in children.columns if c != "report_id"]
    listed = (children if full_children else children.where(test)).groupBy("report_id").agg(F.collect_list(F.struct(*cols)).alias(name))
    kept = reports.join(children.where(test).select("report_id").distinct(), "report_id", "left_semi") if full_children else reports
    return kept.join(listed, "report_id")


def report_detail(reports: DataFrame, sites: DataFrame, classifications: DataFrame, tags: DataFrame, spans: DataFrame) -> DataFrame:
    """One row a report with its site, verdict (null if none), tags and spans as nested values."""
    nest = lambda df, name: df.groupBy("report_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "report_id"])).alias(name))
    one = first_by(classifications, "report_id", "id")
    verdict = one.select("report_id", F.struct(*[c for c in one.columns if c != "report_id"]).alias("classification"))
    site = sites.select("site_id", F.struct(*sites.columns).alias("site"))
    out = reports.join(site, "site_id", "left").join(verdict, "report_id", "left").join(nest(tags, "tags"), "report_id", "left").join(nest(spans, "spans"), "report_id", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)).alias(name)
    return out.select(*[empty(c) if c in ("tags", "spans") else F.col(c) for c in out.columns])


def kpis(density: DataFrame, queue_size: DataFrame, rule_counts: DataFrame, cap: int = 200) -> DataFrame:
    """Totals over a density table, its first group, rules seen and the queue's size up to its cap."""
    top = F.min_by("group_name", F.struct((-F.col("rank_score")).alias("s"), (-F.col("total")).alias("t"), "group_name"))
    totals = density.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_reports"), F.coalesce(F.sum("positives"), F.lit(0)).alias("sif_reports"), top.alias("top_site"))
    seen = rule_counts.agg(F.count_if(F.col("report_count") > 0).alias("rules_seen"))
    queue = queue_size.limit(cap).agg(F.count("*").alias("queue"), (F.count("*") >= cap).alias("queue_capped"))
    out = totals.join(F.broadcast(seen)).join(F.broadcast(queue))  # one row each
    return out.withColumn("overall_rate", stats.rate(F.col("sif_reports"), F.col("total_reports")))


def expand_decisions(decisions: DataFrame, classifications: DataFrame) -> DataFrame:
    """Confirm keeps a verdict, override negates it."""
    now = first_by(classifications, "report_id", "id").select("report_id", F.col("sif_potential").alias("_now"))
    flipped = F.when(F.col("review_status") == "overridden", ~F.col("_now")).otherwise(F.col("_now"))
    return decisions.join(now, "report_id", "left").withColumn("sif_potential", flipped).drop("_now")


def apply_reviews(classifications: DataFrame, decisions: DataFrame, reviewers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new classifications, rejected decisions): the latest decision of each report takes effect.

    ``decisions(report_id, review_status, sif_potential, reviewed_by, decided_at, seq)``. A decision
    of an unknown reviewer is rejected, as is one on a report without a verdict; confidence stays.
    """
    checked = decisions.withColumn("_known", F.lit(True))
    if reviewers is not None:
        known = reviewers.select(F.col("id").alias("reviewed_by"), F.lit(True).alias("_ok")).distinct()
        checked = decisions.join(known, "reviewed_by", "left").withColumn("_known", F.col("reviewed_by").isNull() | F.coalesce("_ok", F.lit(False))).drop("_ok")
    held = classifications.select("report_id").distinct().withColumn("_held", F.lit(True))
    checked = checked.join(held, "report_id", "left")
    reason = F.when(F.col("_held").isNull(), "not found").when(~F.col("_known"), "unknown reviewer")
    rejected = checked.withColumn("reason", reason).where("reason is not null").drop("_held", "_known")
    latest = checked.where("_held and _known").groupBy("report_id").agg(F.max_by(F.struct("review_status", "sif_potential", "reviewed_by"), F.struct("decided_at", "seq")).alias("d"))
    out = classifications.join(latest, "report_id", "left")
    new = {c: F.coalesce(F.col(f"d.{c}"), F.col(c)) if c in classifications.columns else F.col(f"d.{c}") for c in ("review_status", "sif_potential", "reviewed_by")}
    return out.withColumns(new).drop("d"), rejected


def reviewed(reports: DataFrame, classifications: DataFrame, decisions: DataFrame, reviewers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new reports, new classifications, rejected decisions): a report with a decision that took effect is ``processed``."""
    verdicts, rejected = apply_reviews(classifications, decisions, reviewers)
    refused = rejected.select("report_id", "seq").distinct()
    taken = decisions.join(refused, ["report_id", "seq"], "left_anti").select("report_id", F.lit("processed").alias("_status")).distinct()
    done = reports.join(taken, "report_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return done, verdicts, rejected


def with_known_site(rows: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose site exists, the others with a reject_reason)."""
    ids = sites.select("site_id").distinct()
    return rows.join(ids, "site_id", "left_semi"), rows.join(ids, "site_id", "left_anti").withColumn("reject_reason", F.lit("unknown site"))


def site_ids_by_name(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Site ids for names; an unknown name is a reason to reject that row."""
    out = rows.join(sites.select("site_name", "site_id"), "site_name", "left")
    return out.withColumn("reject_reason", F.when(F.col("site_id").isNull(), "unknown site"))


def unseen(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet; long texts are compared by hash first."""
    h = lambda df: df.withColumn("_h", F.xxhash64(key))
    return h(rows).join(h(stored.select(key).distinct()), ["_h", key], "left_anti").drop("_h")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: ``missing`` from b, ``unexpected`` in b."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    right = b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("unexpected"))
    return left.select(key, "side").union(right.select(key, "side"))


def with_positions(groups: DataFrame) -> DataFrame:
    """Density groups with their place in rank order, from 1; one row a group, as many as there are sites.

    Groups are ranged by score, so no task ranks them all.
    """
    return ranked_within(groups, [], [-F.col("rank_score"), -F.col("total"), F.col("group_name")], "position")


def resorted(groups: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Groups by a column of the reader's choice, a missing value as the empty string, ties by name."""
    key = F.coalesce(F.col(column), F.lit("")) if groups.schema[column].dataType.typeName() == "string" else F.col(column)
    return groups.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "group_name")
