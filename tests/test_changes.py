"""Versions of several tables, reviews, repeated ids, one-pass grids and exact tiers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazardlens.operators import cleaning, evaluate, labels, reads, spelling
from hazardlens.sources import manifest


def test_two_writers_from_one_version(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    a, b = spark.range(3).select(F.col("id").alias("x")), spark.range(2).select("id", F.lit("y").alias("y"))
    assert manifest.version(spark, root) == 0 and manifest.read(spark, root) == {}
    assert manifest.commit(spark, root, 0, {"a": a, "b": b}) == 1
    assert manifest.commit(spark, root, 1, added={"a": a}) == 2
    with pytest.raises(manifest.Conflict):  # the second writer began at version 1 as well
        manifest.commit(spark, root, 1, {"b": b.limit(0)})
    now = manifest.read(spark, root)
    assert (now["a"].count(), now["b"].count()) == (6, 2) and manifest.read(spark, root, 1)["a"].count() == 3

    tries = []

    def change(seen):
        tries.append(seen["a"].count())
        if len(tries) == 1:  # another writer comes in between
            manifest.commit(spark, root, 2, added={"a": a})
        return {"b": seen["a"].agg(F.count("*").alias("n"))}, {"a": a.limit(1)}

    assert manifest.update(spark, root, change) == 4
    now = manifest.read(spark, root)
    assert tries == [6, 9] and now["b"].first().n == 9 and now["a"].count() == 10

    def always(seen):
        manifest.commit(spark, root, manifest.version(spark, root), added={"a": a})
        return {}, {"a": a}

    with pytest.raises(manifest.Conflict):
        manifest.update(spark, root, always, attempts=2)


def test_a_decided_report_is_processed(spark):
    reports = spark.createDataFrame([(1, "needs_review"), (2, "needs_review"), (3, "processed"), (4, "needs_review")], "report_id int, status string")
    verdicts = spark.createDataFrame([(1, True, "auto"), (2, True, "auto"), (3, False, "auto")], "report_id int, sif_potential boolean, review_status string")
    said = spark.createDataFrame([(1, "confirmed", True, "u", 1, 1), (1, "overridden", False, "u", 2, 2), (2, "confirmed", True, "nobody", 1, 3), (4, "confirmed", True, "u", 1, 4)], "report_id int, review_status string, sif_potential boolean, reviewed_by string, decided_at int, seq int")
    done, now, rejected = reads.reviewed(reports, verdicts, said, spark.createDataFrame([("u",)], "id string"))
    assert {r.report_id: r.status for r in done.collect()} == {1: "processed", 2: "needs_review", 3: "processed", 4: "needs_review"}
    assert {r.report_id: (r.review_status, r.sif_potential) for r in now.collect()} == {1: ("overridden", False), 2: ("auto", True), 3: ("auto", False)}
    assert {r.seq for r in rejected.collect()} == {3, 4}


def test_rows_that_repeat_an_id_are_cleaned_each(spark):
    known = spark.createDataFrame([("equipment", 9), ("the", 9), ("broke", 5)], "word string, freq long")
    rows = spark.createDataFrame([(1, "The equipmnt broke"), (1, "the equipmnt"), (1, "The equipmnt broke"), (None, "equipmnt"), (2, None)], "id int, t string")
    got = sorted(cleaning.clean_reports(rows, "id", "t", known, {}).select("id", "cleaned_text").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "The equipment broke"), (1, "the equipment"), (1, "The equipment broke"), (None, "equipment"), (2, "")], key=lambda r: f"Row(id={r[0]}, cleaned_text={r[1]!r})")
    assert spelling.corrected(rows.where("id = 1"), "id", "t", known).count() == 3


def test_grids_count_rows_once(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.random() < 0.4, rng.choice([0.0, 0.05, 0.5, 0.55, 0.7, 1.0, rng.random()])) for _ in range(300)] + [("c", False, 0.9)]
    df = spark.createDataFrame(rows, "rule_name string, truth boolean, confidence double").withColumns({"p": F.col("confidence"), "correct": F.col("truth"), "margin": F.col("confidence") * 4 - 2})
    steps = [0.5, 0.55, 0.7, 0.99]
    got = {r.threshold: r for r in evaluate.threshold_sweep(df.withColumn("correct", F.col("rule_name") == "a"), steps).collect()}
    for t in steps:
        auto = [r for r in rows if r[2] >= t]
        assert (got[t].auto_published, got[t].reviewed, got[t].missed_sif) == (len(auto), len(rows) - len(auto), sum(r[1] and r[0] != "a" for r in auto))
        assert got[t].auto_accuracy == pytest.approx(sum(r[0] == "a" for r in auto) / len(auto))
    losses = {r.place: r.loss for r in evaluate.temperature_losses(df, [0.5, 1.0, 2.0]).collect()}
    for i, t in enumerate([0.5, 1.0, 2.0]):
        assert losses[i] == pytest.approx(sum(math.log1p(math.exp(-(1 if r[1] else -1) * (r[2] * 4 - 2) / t)) for r in rows) / len(rows))
    plans = [evaluate.threshold_sweep(df, steps), evaluate.temperature_losses(df, [0.5, 1.0]), evaluate.tag_thresholds(df)]
    assert all("Cartesian" not in (p := x._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in p for x in plans)
    assert evaluate.temperature_losses(df.limit(0), [1.0]).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_tiers_are_exact_in_any_number_of_ranges(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(997)
        got = {r.id: r.noise_tier for r in labels.noise_tiers(rows, (F.col("id") * 7919) % 101, "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(range(997), key=lambda i: ((i * 7919) % 101, i))
    assert got == {i: "clean" if n < 598 else "moderate" if n < 897 else "heavy" for n, i in enumerate(order)}
