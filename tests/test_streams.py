"""The streaming review queue, late rows, and compaction of density deltas."""

import random

from pyspark.sql import functions as F

from hazardlens.streaming import ingest, queue


def brute_queue(rows):
    verdict, decided = {}, set()
    for report, kind, at, confidence, status in rows:
        if kind == "verdict":
            verdict.setdefault(report, (confidence, status))
        elif report is not None:
            decided.add(report)
    return {r: c for r, (c, s) in verdict.items() if r is not None and s == "auto" and c is not None and c < 0.65 and r not in decided}


def test_queue_follows_reports_and_decisions_over_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "verdict", None, rng.choice([0.5, 0.6, 0.65, 0.9, None]), rng.choice(["auto", "auto", "confirmed", None])) for i in range(60)]
    said = [(rng.randrange(70), "decision", n, None, rng.choice(["confirmed", "overridden"])) for n in range(30)] + [(None, "decision", 99, None, "confirmed")]
    parts = [rows[:20] + said[:5], said[5:20], rows[20:] + rows[:3], [(3, "decision", 100, None, "overridden")] * 2]
    root, seen = str(tmp_path), []
    for part in parts:
        seen += part
        spark.createDataFrame(part, queue.ARRIVING).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(queue.ARRIVING).parquet(f"{root}/in")
        queue.start_queue(stream, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
        assert {r.report_id: r.confidence for r in queue.waiting(spark, f"{root}/changes").collect()} == brute_queue(seen)
    changes = spark.read.schema(queue.CHANGES).option("recursiveFileLookup", True).parquet(f"{root}/changes").groupBy("report_id").count().where("count > 2")
    assert changes.count() == 0  # a report enters once and leaves once


def test_late_rows_are_counted(spark, tmp_path):
    schema = "site_id string, raw_text string, submitted_at timestamp"
    late = []
    for texts in ([("a", "x", "2024-01-01"), ("a", "x", "2024-01-01")], [("a", "y", "2024-02-01")], [("a", "z", "2024-01-01"), ("b", "z", "2024-01-02"), ("a", "w", "2024-02-01")]):
        spark.createDataFrame(texts, "site_id string, raw_text string, d string").selectExpr("site_id", "raw_text", "cast(d as timestamp) submitted_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.without_resubmissions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        run.awaitTermination()
        late.append(sum(n for _, n in ingest.late_rows(run)))
    assert late == [0, 0, 2]
    assert sorted(r.raw_text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["w", "x", "y"]


def test_compacted_deltas_give_the_same_counts(spark, tmp_path):
    root, schema = f"file://{tmp_path}/d", "site int, total long, positives long"
    assert ingest.deltas(spark, root, schema).count() == 0 and ingest.compact(spark, root, "site", schema) is None
    counts = lambda: {r.group_name: (r.total, r.positives) for r in ingest.density(ingest.deltas(spark, root, schema), "site").collect()}
    put = lambda n, rows: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/batch={n}")
    put(0, [(1, 5, 2), (2, 1, 0)])
    put(1, [(1, 1, 1)])
    assert ingest.compact(spark, root, "site", schema) == 1 and counts() == {1: (6, 3), 2: (1, 0)}
    put(2, [(3, 4, 4)])
    put(1, [(1, 1, 1)])  # a batch that is replayed after it was compacted
    assert counts() == {1: (6, 3), 2: (1, 0), 3: (4, 4)}
    assert ingest.compact(spark, root, "site", schema) == 2 and ingest.compact(spark, root, "site", schema) == 2
    spark.createDataFrame([(9, 9, 9)], schema).write.parquet(f"{root}/upto=7")
    (tmp_path / "d" / "upto=7" / "_SUCCESS").unlink()  # a compaction that broke off
    assert counts() == {1: (6, 3), 2: (1, 0), 3: (4, 4)}


def test_what_the_models_say_is_in_the_result_of_the_stream(spark, monkeypatch):
    from hazardlens.operators import scoring
    from hazardlens.plans import upkeep, views

    t = views.Tables(spark, "/root/testdata/sf0.001")
    risk, rules, vocab, known = upkeep._models(t)

    def totals(*models):
        monkeypatch.setattr(upkeep, "_models", lambda t: models)
        rows = upkeep.stream_enrichment(t).collect()
        return [sum(r[c] for r in rows) for c in ("n", "repaired", "tags", "spans")]

    n, repaired, tags, spans = totals(risk, rules, vocab, known.persist())
    assert n == t.documents.count() and repaired > 0 and tags > 0 and spans > 0
    assert totals(risk, scoring.RuleModels(rules.features, {}), vocab.where("false"), known.where("false")) == [n, 0, 0, 0]
