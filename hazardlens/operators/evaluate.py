"""Model quality: confusion, calibration, thresholds, per-rule tables, span scores, mined words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, stats, text


def f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = stats.zero_safe(tp, tp + fp), stats.zero_safe(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": stats.zero_safe(2 * p * r, p + r)}


def confusion(scored: DataFrame, truth: str = "truth", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall, F1, separation of means and the share predicted positive."""
    said = F.col(p) >= threshold
    c = scored.agg(
        F.count_if(said & F.col(truth)).alias("tp"), F.count_if(said & ~F.col(truth)).alias("fp"), F.count_if(~said & F.col(truth)).alias("fn"), F.count_if(~said & ~F.col(truth)).alias("tn"),
        (F.avg(F.when(F.col(truth), F.col(p))) - F.avg(F.when(~F.col(truth), F.col(p)))).alias("separation"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumns({"accuracy": stats.zero_safe(F.col("tp") + F.col("tn"), n), "positive_rate": stats.zero_safe(F.col("tp") + F.col("fp"), n)} | f1(F.col("tp"), F.col("fp"), F.col("fn")))


def calibration_error(scored: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of (0.5, 1]; exactly 0.5 falls in none."""
    edge = lambda i: 0.5 + 0.5 * i / bins
    place = F.coalesce(*[F.when((F.col(confidence) > edge(i)) & (F.col(confidence) <= edge(i + 1)), F.lit(i)) for i in range(bins)])
    per = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(confidence).alias("sure"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("accuracy") - F.col("sure"))))
    return per.agg(F.coalesce(gap / F.sum("n"), F.lit(0.0)).alias("ece"))


def temperatures(n: int = 161, low: float = 0.05, high: float = 10.0) -> list[float]:
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def temperature_losses(scored: DataFrame, grid: list[float], margin: str = "margin", truth: str = "truth") -> DataFrame:
    """Mean negative log-likelihood at each temperature, in one pass: rows aren't multiplied by the grid.

    Each task adds its rows up to one array over the whole grid, and sums of arrays meet by place.
    Rows without a margin or a truth count for nothing.
    """
    inverse = 1 / np.array(grid)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid)), 0
        for b in batches:
            signed = b.column(0).to_numpy(zero_copy_only=False)
            n += len(signed)
            for at in range(0, len(signed), 4_096):
                total += np.logaddexp(0.0, -np.outer(signed[at : at + 4_096], inverse)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(grid, pa.float64()), pa.array(total), pa.array([n] * len(grid), pa.int64())], ["place", "temperature", "total", "n"])

    signed = scored.where(F.col(margin).isNotNull() & F.col(truth).isNotNull()).select(F.when(F.col(truth), F.col(margin)).otherwise(-F.col(margin)).cast("double").alias("signed"))
    parts = signed.mapInArrow(summed, "place int, temperature double, total double, n long")
    return parts.groupBy("place", "temperature").agg((F.sum("total") / F.sum("n")).alias("loss")).where(F.col("loss").isNotNull())


def best_temperature(losses: DataFrame, n: int) -> DataFrame:
    """The first temperature of least loss, and whether it lies at the grid's edge."""
    return losses.orderBy("loss", "place").limit(1).withColumn("at_edge", F.col("place").isin(0, n - 1))


def _reached(score: Column, thresholds: list[float]) -> Column:
    """How many of the ascending ``thresholds`` a score reaches."""
    return reduce(Column.__add__, [F.coalesce((score >= t).cast("int"), F.lit(0)) for t in thresholds])


def _at_or_above(counts: DataFrame, names: list[str], within: list[str]) -> DataFrame:
    """``counts`` by ``_reached`` summed up from the top, a row a step: what reaches a threshold reached it or a higher one."""
    above = Window.partitionBy(*within).orderBy(F.desc("_reached"))
    return counts.select(*within, "_reached", *[F.sum(c).over(above).alias(c) for c in names])


def threshold_sweep(scored: DataFrame, thresholds: list[float], confidence: str = "confidence", correct: str = "correct", truth: str = "truth") -> DataFrame:
    """Per threshold: verdicts published without review, their accuracy, those reviewed, serious ones missed.

    Rows are counted once, by how many thresholds they reach; those counts are summed up from the top.
    """
    steps = sorted(set(thresholds))
    names = {"auto_published": F.count("*"), "right": F.count_if(F.col(correct)), "missed_sif": F.count_if(F.col(truth) & ~F.col(correct))}
    counts = scored.groupBy(_reached(F.col(confidence), steps).alias("_reached")).agg(*[c.alias(n) for n, c in names.items()])
    # a row for every step, also for one that no score stops at
    every = scored.sparkSession.createDataFrame([(i,) for i in range(len(steps) + 1)], "_reached int")
    sums = _at_or_above(every.join(counts, "_reached", "left").fillna(0), list(names), [])
    all_ = F.max("auto_published").over(Window.partitionBy())
    at = F.element_at(F.array(*[F.lit(t) for t in steps]), F.col("_reached"))
    rows = sums.withColumn("reviewed", all_ - F.col("auto_published")).where("_reached > 0").select(at.alias("threshold"), "auto_published", "reviewed", "right", "missed_sif")
    return rows.where(F.col("auto_published") + F.col("reviewed") > 0).withColumn("auto_accuracy", F.when(F.col("auto_published") > 0, F.col("right") / F.col("auto_published"))).drop("right")


def per_rule(decisions: DataFrame, min_support: int = 3, training: DataFrame | None = None) -> DataFrame:
    """All rules of ``decisions(rule_name, truth, predicted)``: support, counts, P, R, F1 and how far to trust them.

    Rules without any decision have zeros. With ``training(rule_name, truth)``, ``train_support`` is
    the number of its positives.
    """
    c = decisions.groupBy("rule_name").agg(F.count_if("truth").alias("support"), F.count_if(F.col("truth") & F.col("predicted")).alias("tp"), F.count_if(~F.col("truth") & F.col("predicted")).alias("fp"), F.count_if(F.col("truth") & ~F.col("predicted")).alias("fn"))
    names = decisions.sparkSession.createDataFrame([(r,) for r in fixed.RULES], "rule_name string")
    c = names.join(F.broadcast(c), "rule_name", "left").na.fill(0)
    if training is not None:
        held = training.groupBy("rule_name").agg(F.count_if("truth").alias("train_support"))
        c = c.join(F.broadcast(held), "rule_name", "left").na.fill(0, ["train_support"])
    state = F.when(F.col("support") == 0, "not computable").when(F.col("support") < min_support, "low support").otherwise("reported")
    return c.withColumns(f1(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("status", state)


def macro_f1(table: DataFrame, min_support: int = 1) -> DataFrame:
    """Mean F1 over rules with support (0 if there is none), their names in display order; pooled micro F1 beside it."""
    enough = F.col("support") >= min_support
    place = F.array_position(F.array(*[F.lit(r) for r in fixed.RULES]), F.col("rule_name"))
    names = F.transform(F.array_sort(F.collect_list(F.when(enough, F.struct(place.alias("p"), "rule_name")))), lambda x: x["rule_name"])
    c = table.agg(F.coalesce(F.avg(F.when(enough, F.col("f1"))), F.lit(0.0)).alias("macro_f1"), F.count_if(enough).alias("covered"), names.alias("covered_rules"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return c.withColumn("micro_f1", stats.zero_safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).drop("tp", "fp", "fn")


def tag_thresholds(scores: DataFrame, steps: int = 19, step: float = 0.05) -> DataFrame:
    """Macro F1 over rules with support at each threshold of ``scores(rule_name, truth, p)``, from one count of rows."""
    grid = [step * i for i in range(1, steps + 1)]
    counts = scores.groupBy("rule_name", _reached(F.col("p"), grid).alias("_reached")).agg(F.count_if("truth").alias("tp"), F.count_if(~F.col("truth")).alias("fp"))
    every = counts.select("rule_name").distinct().select("rule_name", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_reached"))
    sums = _at_or_above(every.join(counts, ["rule_name", "_reached"], "left").fillna(0), ["tp", "fp"], ["rule_name"])
    support = F.max("tp").over(Window.partitionBy("rule_name"))
    per = sums.withColumn("support", support).where("_reached > 0").withColumn("fn", F.col("support") - F.col("tp")).withColumns(f1(F.col("tp"), F.col("fp"), F.col("fn")))
    at = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("_reached"))
    return per.groupBy(F.col("_reached").alias("place"), at.alias("threshold")).agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def best_tag_threshold(table: DataFrame) -> DataFrame:
    """The first threshold of greatest macro F1."""
    return table.orderBy(F.desc("macro_f1"), "place").limit(1)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of greatest accuracy, then of most published; one that publishes nothing comes last."""
    return sweep.orderBy(F.desc_nulls_last("auto_accuracy"), F.desc("auto_published"), "threshold").limit(1)


def empty_lists(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Of the rows without a true tag, those to which none was given."""
    none = F.size(truth) == 0
    return rows.agg(F.count_if(none).alias("no_rule"), F.count_if(none & (F.size(predicted) == 0)).alias("left_empty"))


def usability(metrics: DataFrame, target_loss: float = 0.30, least: float = 0.05) -> DataFrame:
    """A verdict on ``metrics(train_loss, separation)``: weights are usable if the fit converged and the classes part."""
    converged, parted = F.col("train_loss") <= target_loss, F.abs("separation") >= least
    reasons = F.concat_ws("; ", F.when(~F.coalesce(converged, F.lit(False)), "loss over its target"), F.when(~F.coalesce(parted, F.lit(False)), "classes not separated"))
    return metrics.withColumn("usable", F.coalesce(converged & parted, F.lit(False))).withColumn("reasons", reasons)


def constant_check(scored: DataFrame, prediction: str) -> DataFrame:
    """Whether a scorer says more than one thing."""
    return scored.agg(F.count_distinct(prediction).alias("predictions")).withColumn("constant", F.col("predictions") < 2)


def confidence_range(scored: DataFrame, confidence: str = "confidence", threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Least, mean and greatest confidence, and the verdicts that go to review."""
    c = F.col(confidence)
    return scored.agg(F.min(c).alias("least"), F.avg(c).alias("mean"), F.max(c).alias("greatest"), F.count_if(c < threshold).alias("below"), F.count("*").alias("n"))


def span_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact and overlap precision, recall and F1 by type over ``(report_id, entity_type, span_start, span_end)``."""
    p = predicted.select("report_id", "entity_type", F.col("span_start").alias("ps"), F.col("span_end").alias("pe"))
    pairs = gold.join(p, ["report_id", "entity_type"])
    exact, over = (F.col("ps") == F.col("span_start")) & (F.col("pe") == F.col("span_end")), (F.col("ps") < F.col("span_end")) & (F.col("span_start") < F.col("pe"))
    hits = pairs.groupBy("report_id", "entity_type").agg(F.max(exact.cast("long")).alias("e"), F.max(over.cast("long")).alias("o")).groupBy("entity_type").agg(F.sum("e").alias("exact"), F.sum("o").alias("overlap"))
    g = gold.select("report_id", "entity_type").distinct().groupBy("entity_type").agg(F.count("*").alias("gold"))
    out = g.join(p.groupBy("entity_type").agg(F.count("*").alias("predicted")), "entity_type", "full").join(hits, "entity_type", "left").na.fill(0)
    cols = {}
    for k in ("exact", "overlap"):
        cols |= {f"{k}_{name}": c for name, c in f1(F.col(k), F.col("predicted") - F.col(k), F.col("gold") - F.col(k)).items()}
    return out.withColumns(cols)


def overlap_pairs(spans: DataFrame) -> DataFrame:
    """Pairs of different types whose spans cross in one report, by pair of types."""
    a = spans.select("report_id", F.col("entity_type").alias("a"), F.col("span_start").alias("s1"), F.col("span_end").alias("e1"))
    b = spans.select("report_id", F.col("entity_type").alias("b"), F.col("span_start").alias("s2"), F.col("span_end").alias("e2"))
    return a.join(b, "report_id").where("a < b and s1 < e2 and s2 < e1").groupBy("a", "b").agg(F.countDistinct("report_id").alias("reports"), F.count("*").alias("pairs"))


def stop_words(spans: DataFrame, least: int = fixed.MIN_VOCABULARY_COUNT) -> DataFrame:
    """Words that follow activity spans more often than they stand inside: ``spans(entity_text, following)``."""
    inside = spans.select(F.explode(text.bound(text.words(F.col("entity_text")), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))))).alias("word")).groupBy("word").agg(F.count("*").alias("inside"))
    after = spans.select(F.try_element_at(text.words(F.substring("following", 1, 24)), F.lit(1)).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("after"))
    both = after.join(inside, "word", "left").na.fill(0, ["inside"])
    return both.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("after") > F.col("inside")) & (F.col("after") >= least))


def gazetteer(spans: DataFrame, least: int = fixed.MIN_VOCABULARY_COUNT) -> DataFrame:
    """Mined terms ``(kind, term, n)``: equipment heads and modifiers, location heads, activity verbs,
    controls that were missing, and phrases of absence that end a span."""
    w = spans.withColumn("w", text.words(F.col("entity_text"))).where(F.size("w") > 0)
    last, first = F.element_at("w", -1), F.element_at("w", 1)
    one = lambda kind, typ, term: w.where(F.col("entity_type") == typ).select(F.lit(kind).alias("kind"), term.alias("term"))
    rows = one("equipment_head", "equipment", last).union(one("location_head", "location", last)).union(one("activity_verb", "activity", first))
    rows = rows.union(w.where("entity_type = 'equipment'").select(F.lit("equipment_modifier"), F.explode(F.slice("w", F.lit(1), F.size("w") - 1))))
    control = F.regexp_extract_all(F.lower("entity_text"), F.lit(text.BEGIN + r"(?:no|not|without|missing|koi)\s+([\p{L}\p{N}_'\-]+(?:\s+[\p{L}\p{N}_'\-]+)?)"), 1)
    barriers = spans.where("entity_type = 'barrier_failure'")
    rows = rows.union(barriers.select(F.lit("barrier_control"), F.explode(F.transform(control, lambda c: F.regexp_replace(c, r"\s+", " ")))))
    said = F.filter(F.array(*[F.lit(p) for p in fixed.ABSENCE_PHRASES]), lambda p: F.contains(F.lower("entity_text"), p))
    counts = rows.groupBy("kind", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # a phrase counts from its first use on
    return counts.union(barriers.select(F.lit("absence_phrase").alias("kind"), F.explode(said).alias("term")).groupBy("kind", "term").agg(F.count("*").alias("n")))


def barrier_ceiling(spans: DataFrame) -> DataFrame:
    """Gold barrier spans, and those that state an absence and so can be found at all."""
    b = spans.where("entity_type = 'barrier_failure'")
    return b.agg(F.count("*").alias("gold"), F.count_if(text.states_absence(F.col("entity_text"))).alias("reachable"))


def control_coverage(rows: DataFrame, body: str, has_barrier: str) -> DataFrame:
    hit = text.names_control(F.col(body))
    return rows.agg(F.count_if(F.col(has_barrier)).alias("with_barrier"), F.count_if(F.col(has_barrier) & hit).alias("found"), F.count_if(hit).alias("flagged"))
