"""Steps that must not grow faster than their input, held to it on small inputs."""

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from hazardlens import session
from hazardlens.functions import spans
from hazardlens.operators import cleaning, extract, labels, ratioindex, repeats, scoring, shingles, spelling
from hazardlens.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def text_of(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n))


def test_spelling_broadcasts_no_vocabulary(spark):
    known = spark.createDataFrame([(w, 9) for w in "pump near the pit".split()], "word string, freq long")
    out = spelling.corrected(spark.createDataFrame([(1, "the pmup nera the pit")], "id int, t string"), "id", "t", known)
    assert [r.corrected for r in out.collect()] == ["the pump near the pit"]
    assert "Broadcast" not in plan(out)


def test_the_vocabulary_reaches_workers_as_columns(spark, monkeypatch):
    vocab = spark.createDataFrame([("equipment_head", "pump"), ("equipment_modifier", "pump"), ("stop", "x")], "kind string, term string")
    rows = spark.createDataFrame([(1, "old pump pump"), (2, None), (3, "")], "id int, t string")
    monkeypatch.setattr(type(rows), "collect", None)  # no term is a row on the driver
    found = extract.extracted(rows, "id", "t", vocab)
    monkeypatch.undo()
    assert found.schema["spans"].dataType.simpleString() == spans.SPANS
    assert {r.id: [tuple(s) for s in r.spans] for r in found.collect()} == {1: [("equipment", "pump pump", 4, 13)], 2: [], 3: []}


def test_a_text_without_a_term_is_only_split_into_words(monkeypatch):
    class Words:
        def findall(self, body):
            return body.split()

    monkeypatch.setattr(extract, "_TOKEN", Words())  # it can't tell places
    assert extract._found("nothing to see here", {"pump": {"equipment_head"}}) == []


def test_margins_are_finite_where_probabilities_are_one(spark):
    model = scoring.fit_risk(spark.createDataFrame([("bad word", 1.0), ("good thing", 0.0)] * 20, "text string, label double"))
    rows = spark.createDataFrame([(1, "bad " * 5_000), (2, "good " * 5_000), (3, "  ")], "id int, text string")
    got = {r.id: r for r in scoring.score_risk(model, rows).collect()}
    assert got[1].p == 1.0 and 40 < got[1].margin < 1e6
    assert got[2].p < 1e-15 and -1e6 < got[2].margin < -40
    assert (got[3].p, got[3].margin) == (0.5, 0.0)


def test_shingles_are_kept_for_texts_that_meet_in_a_bucket(spark, monkeypatch):
    rng, kept = random.Random(5), []
    monkeypatch.setattr(shingles, "stored", lambda df: (kept.append(out) if "shingles" in df.columns else None) or out if (out := session.stored(df)) else None)
    base = text_of(rng, 80)
    rows = [(i, text_of(rng, 80)) for i in range(40)] + [(40, base), (41, base + " end"), (41, "another text of this id")]
    got = {r.id: r.class_id for r in shingles.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert len(got) == 42 and sum(df.count() for df in kept) <= 2
    assert got[41] in (40, 41)


def test_groups_are_compared_slice_by_slice_and_leave_nothing(spark, monkeypatch):
    rng, paths = random.Random(6), []

    def noted(df):
        out = session.stored(df)
        if "gram" in df.columns or "grams" in df.columns:
            paths.append(session._paths[out].removeprefix("file://"))
        return out

    monkeypatch.setattr(repeats, "stored", noted)
    texts = [text_of(rng, 30) for _ in range(6)]
    rows = spark.createDataFrame([(i, texts[i % 6] + "!" * (i % 5), rng.choice(["a", "b", None])) for i in range(60)], "id long, t string, site string")
    found = lambda: sorted(map(tuple, repeats.ratio_repeats(rows, "id", "t", "id", within="site").collect()))
    whole = found()
    n = len(paths)
    monkeypatch.setattr(repeats, "SLICE", 400)
    assert found() == whole and len(whole) > 30
    assert len(paths) > 2 * n and not any(map(os.path.exists, paths))


def test_responses_are_judged_without_a_shuffle(spark):
    bodies = [(1, 1, '{"items": [{"index": 0, "body": "x"}]}'), (2, 1, '{"items": [null]}'), (3, 0, '{"items": []}'), (4, 1, '{"items": [{"index": 0, "body": " "}]}')]
    items, rejected = labels.ingested_responses(spark.createDataFrame(bodies, "batch_id int, expected int, body string"), ["body"], "index:int,body:string")
    assert [tuple(r) for r in items.collect()] == [(1, 0, 0, "x")]
    assert {r.batch_id: r.reason for r in rejected.collect()} == {2: "items out of place", 4: "required field missing"}
    assert "Exchange" not in plan(items) + plan(rejected)


def test_the_risk_fit_makes_its_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        read.add(1)
        return "bad word" if i % 2 else "good thing"

    scoring.fit_risk(spark.range(40).select(text("id").alias("text"), (F.col("id") % 2).cast("double").alias("label")))
    assert read.value == pytest.approx(40)


@pytest.mark.parametrize("block", [16_000_000, 3_000])
def test_texts_go_past_blocks_and_no_gram_is_shuffled(spark, monkeypatch, block):
    rng, rows_of = random.Random(11), []
    monkeypatch.setattr(repeats, "stored", lambda df: rows_of.append(session.stored(df)) or rows_of[-1])
    monkeypatch.setattr(repeats, "BLOCK", block, raising=False)
    monkeypatch.setattr(repeats, "EACH", 10, raising=False)
    texts = [text_of(rng, rng.choice([10, 40, 45, 60, 150])) for _ in range(50)]
    texts += [t.replace(rng.choice("abc"), "z") + " " * rng.randrange(9) for t in rng.choices(texts, k=50)]
    rows = [(i, t, "x" if i % 10 else "y") for i, t in enumerate(texts)]
    got = {r.id: (r.match_id, r.ratio) for r in repeats.ratio_repeats(spark.createDataFrame(rows, "id long, t string, site string"), "id", "t", "id", within="site").collect()}
    want = {}
    for i, t, site in rows:
        for j, u, other in rows[:i]:
            if site == other and (ratio := difflib.SequenceMatcher(None, t, u).ratio()) >= 0.85:
                want[i] = (j, pytest.approx(ratio))
                break
    assert got == want and len(want) > 20
    # what is written are texts, blocks, their links and what is found
    assert not any("array" in kind for df in rows_of for _, kind in df.dtypes)


def test_long_texts_have_the_ratio_of_difflib(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(ratioindex, "ARRAYS", 200)
    for n in [210, 260, 400, 1_000, 3_000] * 8:
        a = text_of(rng, n // 5) if n % 4 else "".join(rng.choice("eeeettaaoinshr dlucm fwypvbgk,.TAISE\n") for _ in range(n))
        b = list(a)
        for _ in range(rng.choice([1, n // 50, n // 20])):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(4)] = rng.choices("etaoin xq", k=rng.randrange(4))
        b = "".join(b[rng.randrange(20) :])
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert ratioindex.ratio_from(a, b, 0) == ratio
        assert ratioindex.ratio_from(a, b, len(a) + len(b)) is None


@pytest.mark.parametrize("few", [500, 0])
def test_cleaning_shuffles_no_words_of_texts(spark, monkeypatch, few):
    monkeypatch.setattr(spelling, "FEW", few, raising=False)
    monkeypatch.setattr(cleaning, "STRANGE", few, raising=False)
    known = spark.createDataFrame([(w, 9) for w in "pump near the pit equipment".split()], "word string, freq long")
    rows = [(1, "the pmup's nera qq the Pit"), (1, "los equipmnt zz"), (2, None), (3, "  "), (4, "सुरक्षा"), (5, "xx yy vv")]
    out = cleaning.clean_reports(spark.createDataFrame(rows, "id int, t string"), "id", "t", known, {"los": "the"}, digits=None)
    got = sorted(map(tuple, out.select("id", "cleaned_text", "normalization_confidence", "degraded").collect()))
    assert got == [(1, "the equipment zz", 0.5, False), (1, "the pmup's nera qq the Pit", 0.0, True), (2, "", 1.0, False), (3, "", 1.0, False), (4, "सुरक्षा", 0.0, True), (5, "xx yy vv", 0.0, True)]
    # one join of texts by their key, with a count for each
    assert plan(out).count("SortMergeJoin") <= (1 if few else 2)


def test_mined_lines_are_not_written(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(registry, "stored", lambda df: kept.append(df) or session.stored(df))
    vocab = registry._vocabulary(registry.Tables(spark, "/root/testdata/sf0.001"))
    assert vocab.where("kind = 'stop'").count() > 0 and vocab.where("kind = 'activity_verb'").count() > 0
    assert kept and all("text" not in df.columns for df in kept)
