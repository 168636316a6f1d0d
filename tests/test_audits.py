"""Audits, cleaning with a dictionary and further measures, on literal cases and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from hazardlens.functions import fixed
from hazardlens.operators import audits, cleaning, evaluate
from hazardlens.plans import registry

LEXICON = {"bina": "without", "nahi": "not", "gir gaya": "fell down"}


def test_cleaning_with_a_dictionary(spark):
    known = spark.createDataFrame([(w, 10) for w in "the worker equipment was without not fell down lock off".split()], "word string, freq long")
    rows = spark.createDataFrame(
        [(1, "the Equipmnt was off"), (2, "bina lock nahi"), (3, "wo gir gaya"), (4, "qqq zzz xxx bina PPE"), (5, None), (6, " \n"), (7, "पाइप गिरा"), (8, "the zzzz"), (9, "the PPE was off")],
        "id int, t string",
    )
    got = {r.id: (r.cleaned_text, r.language_detected, r.normalization_confidence, r.degraded) for r in cleaning.clean_reports(rows, "id", "t", known, LEXICON).collect()}
    assert got == {
        1: ("the Equipment was off", "en", 1.0, False), 2: ("without lock not", "hi-en", 1.0, False), 3: ("wo fell down", "hi-en", 0.5, False),
        4: ("qqq zzz xxx bina PPE", "hi-en", 0.25, True), 5: ("", "en", 1.0, False), 6: ("", "en", 1.0, False), 7: ("पाइप गिरा", "hi", 0.0, True),
        8: ("the zzzz", "en", 0.0, True), 9: ("the personal protective equipment was off", "en", 1.0, False),
    }


def test_corpus_records(spark):
    rows = spark.createDataFrame([(1, "a – b fell", ["Driving", "Parties"], "B fell", None), (2, None, None, "x", "y")], "id int, raw_text string, iogp_rules array<string>, precursor_activity string, precursor_location string")
    rows = rows.withColumn("precursor_equipment", F.lit(None).cast("string")).withColumn("precursor_barrier_failure", F.lit("…").cast("string"))
    one, two = audits.corpus_records(rows).orderBy("id").collect()
    assert (one.iogp_rules, one.iogp_rules_rejected, tuple(one.precursor_activity)) == (["Driving"], ["Parties"], ("b fell", 4, 10))
    assert one.precursor_location is None and one.precursor_barrier_failure is None
    assert (two.iogp_rules, two.iogp_rules_rejected, two.precursor_activity) == ([], [], None)


def test_tag_thresholds_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(rng.choice(fixed.RULES[:3]), rng.random() < 0.3, rng.random()) for _ in range(200)]
    got = {r.place: r.macro_f1 for r in evaluate.tag_thresholds(spark.createDataFrame(rows, "rule_name string, truth boolean, p double")).collect()}
    for i in range(1, 20):
        f1s = []
        for rule in fixed.RULES[:3]:
            of = [(t, p >= 0.05 * i) for r, t, p in rows if r == rule]
            tp, wrong = sum(t and s for t, s in of), sum(t != s for t, s in of)
            f1s.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
        assert abs(got[i] - sum(f1s) / 3) < 1e-12


def test_verdicts_on_models(spark):
    rows = spark.createDataFrame([(0.1, 0.4), (0.9, 0.4), (0.1, 0.01), (None, 0.4)], "train_loss double, separation double")
    assert [(r.usable, r.reasons) for r in evaluate.usability(rows).collect()] == [(True, ""), (False, "loss over its target"), (False, "classes not separated"), (False, "loss over its target")]
    assert evaluate.constant_check(spark.createDataFrame([(1,), (1,)], "x int"), "x").first().constant
    lists = spark.createDataFrame([([], []), ([], ["Driving"]), (["Driving"], [])], "truth array<string>, predicted array<string>")
    assert tuple(evaluate.empty_lists(lists).first()) == (2, 1)


def test_tag_support_and_counts(spark):
    rows = spark.createDataFrame([(["Driving", "Driving"],), (["Driving", "Hot Work", "Parties"],), ([],), (None,)], "tags array<string>")
    got = {r.rule_name: (r.support, r.trainable, r.rarest) for r in audits.tag_support(rows).collect()}
    assert len(got) == 9 and got["Driving"] == (2, True, False) and got["Hot Work"] == (1, True, True) and got["Confined Space"] == (0, False, False)
    assert {r.n_tags: r.n for r in audits.tags_per_row(rows).collect()} == {2: 1, 3: 1, 0: 2}
    ids = spark.createDataFrame([(1,), (1,), (None,), (None,)], "id int")
    assert tuple(audits.duplicate_ids(ids).first()) == (4, 2, 2)
    found, wanted = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long"), spark.createDataFrame([("a", 1), ("c", 3)], "k string, n long")
    assert {r.check: r.ok for r in audits.verified(found, wanted, "k", "n").collect()} == {"a": True, "b": False, "c": False}


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


@pytest.mark.parametrize("name, rows", [("validation", 0), ("queue_view", 0), ("stored_shape", 3), ("tag_support", 9), ("coverage_change", 1), ("duplicate_ids", 1), ("tag_thresholds", 0), ("usability", 1), ("cleaned_with_dictionary", 0)])
def test_queries_on_empty_tables(spark, empty_dir, name, rows):
    assert registry.queries()[name](spark, empty_dir).count() == rows
