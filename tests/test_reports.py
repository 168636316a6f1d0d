"""Operators on the reports, on literal cases and against plain Python."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from hazardlens.functions import fixed, spans, stats, text
from hazardlens.operators import cleaning, evaluate, extract, labels, ranks, reads, repeats, scoring, spelling
from hazardlens.plans import registry
from hazardlens.sources import files
from hazardlens.streaming import ingest


def one(spark, expr, **cols):
    names = list(cols)
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return row.select(expr.alias("x")).first().x


def test_wilson_order(spark):
    df = spark.createDataFrame([("Tiny", 1, 1), ("Big", 40, 24), ("Empty", 0, 0)], "group_name string, total long, positives long")
    rows = reads.rank_order(reads.ranked(df)).collect()
    assert [(r.group_name, r.rate, r.rank_score) for r in rows] == [("Big", 0.6, 0.446), ("Tiny", 1.0, 0.2065), ("Empty", 0.0, 0.0)]


@pytest.mark.parametrize("raw, want", [("welding a wellhead flange", "welding"), ("  Checking tension on it", "checking"), ("", "unspecified"), (None, "unspecified")])
def test_activity_bucket(spark, raw, want):
    assert one(spark, text.activity_bucket(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("   \n\t  ", "blank"), ("", "empty"), (None, "empty"), ("x" * 20001, "too long"), ("\x00\x00", "blank"), ("pipe fell \x00 here", None)])
def test_validation(spark, raw, want):
    assert one(spark, text.reject_reason(F.col("t"), F.lit("worker"), F.lit("s")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("worker had no PPE", "worker had no personal protective equipment"), ("dpressure rising", "dpressure rising"), ("the DG set tripped", "the diesel generator set tripped"), ("the DSV signed", "the DSV signed")])
def test_acronyms(spark, raw, want):
    assert one(spark, text.expand_acronyms(F.col("t")), t=raw) == want


def test_token_map_equals_sequential_replacement(spark):
    rng = random.Random(1)
    pieces = [*rng.sample(sorted(fixed.ACRONYMS), 30), "dg set", "DG", "x", "été", "😀", "नाbina", "_ppe", "ppe"]
    rows = ["".join(rng.choice(pieces) + rng.choice([" ", "-", ", ", "", "  "]) for _ in range(8)) for _ in range(200)]

    def plain(t):
        for k in sorted(fixed.ACRONYMS, key=len, reverse=True):
            t = re.sub(rf"(?<!\w){re.escape(k)}(?!\w)", fixed.ACRONYMS[k], t, flags=re.I)
        return t

    rows = [r for r in rows if "ना" not in r]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.expand_acronyms(F.col("t")).alias("x"))
    assert all(r.x == plain(r.t) for r in df.collect())


LEXICON = {"bina": "without", "nahi": "not", "kiya": "did", "gir gaya": "fell down", "gaya": "went"}


ENGLISH = "the fitter was replacing a gasket on at worker had no rig men were lock off bolt equipment hospital".split()


def plain_clean(raw, dictionary, lexicon):
    """Cleaning of one text, step by step."""
    if raw is None or not raw.strip():
        return "", "en", 1.0, False
    if re.search("[\u0900-\u097f]", raw):
        return raw, "hi", 0.0, True

    def replaced(t, terms):
        n = 0
        for k in sorted(terms, key=len, reverse=True):
            t, i = re.subn(rf"(?<!\w){re.escape(k)}(?!\w)", terms[k], t, flags=re.I)
            n += i
        return t, n

    known = {w.lower() for w in dictionary} | set(fixed.DOMAIN_WORDS) | {w for k in lexicon for w in k.split()} | set(fixed.ACRONYMS) | {w for v in fixed.ACRONYMS.values() for w in v.split()}
    known |= {w for k in fixed.ACRONYMS for w in k.split()}

    def edits(w):
        letters = "abcdefghijklmnopqrstuvwxyz"
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}

    def spelled(m):
        w = m.group()
        stem = re.sub("'s$", "", w.lower())
        near = edits(stem) & known
        if len(stem) < 4 or stem in known or not near or len(near) > 4 or not re.fullmatch(r"[^\W\d_]+(?:'[^\W\d_]+)*", stem):
            return w
        best = max(near, key=lambda c: (dictionary.get(c, 0), c))
        if len(best) == len(stem) and sorted(best) != sorted(stem):
            return w
        return (best.capitalize() if w[0].isupper() else best) + ("'s" if w.lower().endswith("'s") else "")

    t, _ = replaced(raw, fixed.ACRONYMS)
    t = re.sub(r"[\w']+", spelled, t)
    t, hits = replaced(t, lexicon)
    unknown = sum(w.lower() not in known for w in re.findall(r"[a-zA-Z]+(?:'[a-zA-Z]+)*", t))
    share = hits / (hits + unknown) if hits + unknown else 1.0
    return (raw if share < 0.5 else t), ("hi-en" if hits else "en"), round(share, 3), share < 0.5


def test_cleaning(spark):
    rng = random.Random(5)
    words = [*ENGLISH, *LEXICON, "PPE", "DG set", "Duliajan", "qwzx", "blorf", "equipmnt", "Hosptal's", "khalasi's", "the", "near", "gir", "x", "é"]
    texts = [None, "", "  \n", "पाइप गिरा", "The fitter was replacing a gasket on the wellhead at Duliajan.", "bina lock off nahi kiya", "wo gir gaya", "the qwzx blorf snarf was near", "qwrtz plkjh zxcvb mnbvc lkjhg poiuy", "the men were on the rig"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    dictionary = {w: len(ENGLISH) - i for i, w in enumerate(ENGLISH)}
    known = spark.createDataFrame(list(dictionary.items()), "word string, freq long")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r for r in cleaning.clean_reports(rows, "id", "t", known, LEXICON).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.cleaned_text, r.language_detected, r.normalization_confidence, r.degraded) == plain_clean(t, dictionary, LEXICON), t
    assert (got[7].degraded, got[7].cleaned_text, got[8].degraded, got[8].cleaned_text) == (False, texts[7], True, texts[8]) or got[7].degraded
    assert got[4].cleaned_text == texts[4] and not got[4].degraded and got[4].normalization_confidence == 1.0


def test_names_go_before_spans(spark):
    rows = spark.createDataFrame([(1, "it was Ramesh Kumar again", "Mrs Das")], "id int, a string, b string")
    r = cleaning.redact(rows, ["a", "b"]).first()
    assert (r.a, r.b) == ("it was [REDACTED] again", "Mrs [REDACTED]")
    with pytest.raises(ValueError):
        cleaning.redact(rows.withColumn("spans", F.array()), ["a"])


def plain_redacted(t):
    t = re.sub(rf"\b((?:{'|'.join(fixed.HONORIFICS)})\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", r"\1 [REDACTED]", t)
    return re.sub(r"(?<=[a-z,]\s)([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\b", lambda m: m.group() if m.group().split()[0] in fixed.NOT_NAMES else "[REDACTED]", t)


def test_redaction_equals_a_callback(spark):
    rng = random.Random(8)
    parts = ["Ramesh", "Anita", "Duliajan", "The", "Monday", "near", "well", "Mr.", "Dr", "Shri", "it", "was", "a", ",", ".", "PPE", "x,", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.redacted(F.col("t")).alias("x")).collect()
    assert all(r.x == plain_redacted(r.t) for r in rows)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Mr. Ramesh Kumar was operating it", "Mr. [REDACTED] was operating it"),
        ("The supervisor, Anita Sharma, confirmed", "The supervisor, [REDACTED], confirmed"),
        ("near the well at Duliajan Ramesh slipped", "near the well at Duliajan Ramesh slipped"),
        ("all lower case", "all lower case"),
    ],
)
def test_redaction(spark, raw, want):
    assert one(spark, text.redacted(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("slipped and tripped", False), ("bina lock off nahi karna chahiye", True), ("no LOTO was applied", True), ("he fell and fractured his hip", False), (None, False)])
def test_control_language(spark, raw, want):
    assert one(spark, text.names_control(F.col("t")), t=raw) is want


def test_small_texts(spark):
    assert one(spark, text.ascii_punctuation(F.col("t")), t="a‑b–c’s…­x y") == "a-b-c's...x y"
    assert one(spark, text.normalized_title(F.col("t")), t=" Caught, entangled in running powered equipment  normal operation") == "caught entangled in running powered equipment normal operation"
    assert one(spark, text.json_object(F.col("t")), t='say {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert one(spark, text.excerpt(F.col("t")), t="x" * 200) == "x" * 180 + "…"
    s = one(spark, text.located(F.col("t"), F.col("q")), t="😀 On the Monkey Board", q=" on the monkey board ")
    assert (s.text, s.start, s.end) == ("On the Monkey Board", 2, 21)
    assert one(spark, text.located(F.col("t"), F.col("q")), t="abc", q="zzz") is None
    assert one(spark, text.located(F.col("t"), F.col("q")), t="abc", q=None) is None


def test_label_rule(spark):
    cases = [
        ("ignition of vapors gases or liquids", "burns", "A2"), ("other fall to lower level less than 6 feet", "cuts", ""),
        ("caught in or compressed by equipment or objects unspecified", "soreness, pain, hurt", "A2"),
        ("fall or jump curtailed by personal fall arrest system", "cuts and abrasions", "A3"),
        ("other fall to lower level less than 6 feet", "electrocutions, electric shocks", "B"),
        ("injured by slipping or swinging object held by injured worker", "amputations", ""),
    ]
    rows = labels.label_rule(spark.createDataFrame(cases, "event_title string, nature_title string, want string")).collect()
    assert [(r.rule_hits, r.sif_potential) for r in rows] == [(r.want, r.want != "") for r in rows]


def test_exclusions(spark):
    rows = [("1", 0, "x", "a narrative of enough length"), ("1", 1, "x", "a narrative of enough length"), ("2", 2, None, "a narrative of enough length"), ("3", 3, "x", "nineteen characters"), ("4", 4, "x", None), ("5", 5, "animal bites", "a narrative of enough length")]
    rows = [(*r, "burns") for r in rows] + [("6", 6, "x", "a narrative of enough length", None), ("7", 7, None, None, None)]
    got = labels.exclusions(spark.createDataFrame(rows, "id string, seq int, event_title string, narrative string, nature_title string")).orderBy("seq").collect()
    assert [r.excluded for r in got] == [False, True, True, True, False, True, True, True]
    assert [r.e3 for r in got] == [False, False, True, False, False, False, True, True] and not any(r.e1 is None for r in got)


def test_tiers_and_splits(spark):
    rows = spark.range(1000)
    tiers = labels.noise_tiers(rows, F.xxhash64("id"), "id").groupBy("noise_tier").count().collect()
    assert {r.noise_tier: r["count"] for r in tiers} == {"clean": 600, "moderate": 300, "heavy": 100}
    strata = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 71 else "c") for i in range(72)], "id int, s string")
    folds = {(r.s, r.fold): r["count"] for r in labels.split_by_stratum(strata, ["s"], 0.15, F.col("id")).groupBy("s", "fold").count().collect()}
    assert folds == {("a", "test"): 9, ("a", "train"): 51, ("b", "test"): 2, ("b", "train"): 9, ("c", "train"): 1}


def span(t, a, b, body):
    return (t, body[a:b], a, b)


def brute_resolved(found):
    out = []
    for s in sorted(set(found), key=lambda s: (s[2] - s[3], s[2])):
        if all(s[3] <= o[2] or o[3] <= s[2] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s[2])


def test_spans_against_plain_python(spark):
    rng, body = random.Random(4), "é😀" + "abcdefgh " * 6
    rows = []
    for i in range(60):
        found = [span(rng.choice(fixed.ENTITY_TYPES), a, a + rng.randrange(1, 9), body) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))]
        rows.append((i, body, found))
    df = spark.createDataFrame(rows, f"id int, text string, spans {spans.SPANS}").select("*", spans.resolved(F.col("spans")).alias("r"), spans.segments(F.col("text"), F.col("spans")).alias("s"), spans.violations(F.col("text"), spans.resolved(F.col("spans"))).alias("v"))
    for r in df.collect():
        want = brute_resolved([tuple(s) for s in r.spans])
        assert sorted((s.span_start, s.span_end) for s in r.r) == sorted((s[2], s[3]) for s in want)
        assert "".join(s.text for s in r.s) == body and r.s and r.v == []


def test_review_decisions(spark):
    verdicts = spark.createDataFrame([(1, 1, True, 0.6, "auto"), (2, 2, False, 0.9, "auto")], "id int, report_id int, sif_potential boolean, confidence double, review_status string")
    said = spark.createDataFrame([(1, "confirmed", True, "u", 1, 1), (1, "overridden", False, "u", 2, 2), (2, "overridden", True, "who", 1, 3), (9, "confirmed", True, "u", 1, 4)], "report_id int, review_status string, sif_potential boolean, reviewed_by string, decided_at int, seq int")
    done, rejected = reads.apply_reviews(verdicts, said, spark.createDataFrame([("u",)], "id string"))
    assert sorted((r.report_id, r.sif_potential, r.confidence, r.review_status) for r in done.collect()) == [(1, False, 0.6, "overridden"), (2, False, 0.9, "auto")]
    assert sorted((r.report_id, r.reason) for r in rejected.collect()) == [(2, "unknown reviewer"), (9, "not found")]


def test_ratio_repeats_lose_nothing(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(4, 24))) for _ in range(70)] + ["", "  ", None]
    texts += [t[:-1] + "c" for t in texts[:40]] + texts[:5]
    want = {}
    for i, t in enumerate(texts):
        if t and t.strip():
            for j in range(i):
                if texts[j] and texts[j].strip() and (texts[j] == t or difflib.SequenceMatcher(None, t, texts[j]).ratio() >= 0.85):
                    want[i] = j
                    break
    got = {r.id: r.match_id for r in repeats.ratio_repeats(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", "id").collect()}
    assert set(got) == set(want)


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ("equipmnt", "the", "teh", "drawworks", "equipment")], "word string")
    known = spark.createDataFrame([("equipment", 10), ("the", 100), ("driveworks", 1)], "word string, freq long")
    assert [tuple(r) for r in spelling.corrections(words, known).collect()] == [("equipmnt", "equipment")]
    rows = spark.createDataFrame([(1, "The Equipmnt's gone"), (2, "")], "id int, t string")
    assert {r.id: r.corrected for r in spelling.corrected(rows, "id", "t", known).collect()} == {1: "The Equipment's gone", 2: ""}


def test_calibration_and_temperature(spark):
    df = spark.createDataFrame([(0.5, True), (0.7, True), (0.7, False), (0.9, True)], "confidence double, correct boolean")
    assert abs(evaluate.calibration_error(df).first().ece - (2 * 0.2 + 0.1) / 4) < 1e-12
    grid = evaluate.temperatures()
    assert len(grid) == 161 and abs(grid[-1] - 10) < 1e-9
    scored = spark.createDataFrame([(4.0, True), (4.0, False), (-4.0, False)], "margin double, truth boolean")
    best = evaluate.best_temperature(evaluate.temperature_losses(scored, grid), 161).first()
    assert 3 < best.temperature < 9 and not best.at_edge


def test_csv_and_json_lines(spark, tmp_path):
    head = ",".join(f'"{c}"' for c in files.INCIDENT_COLUMNS)
    row = ["1", "", '"2/30/2020"', '"NA"', '"a ""quoted"" b\\"'] + [""] * 11 + ['"line one\nline two"'] + [""] * 11
    (tmp_path / "x.csv").write_text(head + "\n" + ",".join(row) + "\n")
    rows = files.read_incidents(spark, str(tmp_path / "x.csv"))
    r = rows.first()
    assert (r.ID, r.UPA, r.Employer, r["Final Narrative"]) == ("1", None, "NA", "line one\nline two")
    assert files.public(rows).columns == [*files.PUBLIC_COLUMNS, "seq"]
    assert files.public(rows.drop("Nature").withColumn("Phone", F.lit("1"))).columns == [c for c in files.PUBLIC_COLUMNS if c != "Nature"] + ["seq"]
    assert [str(one(spark, files.incident_date(F.col("t")), t=t)) for t in ("02/29/2020", "02/30/2020", "", None)] == ["2020-02-29", "None", "None", "None"]
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{"id": "b", \n{"id": "c"}\n  \n')
    good, torn = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "id string")
    assert sorted(x.id for x in good.collect()) == ["a", "c"] and [x._torn for x in torn.collect()] == ['{"id": "b", ']
    files.snapshot(good, str(tmp_path), "t")
    files.snapshot(good.limit(1), str(tmp_path), "t")
    assert files.current(spark, str(tmp_path), "t").count() == 1
    sites = files.seeded_sites(spark.createDataFrame([("Moran", "elsewhere")], "site_name string, region string")).collect()
    assert len(sites) == len(fixed.SITES) and ("Moran", "elsewhere") in map(tuple, sites)


def test_ranks_and_folds(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, "a", "a", "a", "b"]), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s string, k int").repartition(5)
    got = ranks.ranked_within(df, ["s"], [F.col("k"), F.col("id")], "place", "size").collect()
    for s in (None, "a", "b"):
        want = [i for k, i in sorted((k, i) for i, t, k in rows if t == s)]
        assert [r.id for r in sorted((r for r in got if r.s == s), key=lambda r: r.place)] == want and {r.size for r in got if r.s == s} == {len(want)}
    assert sorted(r.place for r in ranks.ranked_within(df, [], [F.col("k"), F.col("id")], "place").collect()) == list(range(1, 401))
    train, test = df.where("id < 300"), df.where("id > 290 and id <> 399").select("id", "s", "k").union(spark.createDataFrame([(1000, "a", 1)], "id int, s string, k int"))
    problems = {(r.problem, r.id) for r in labels.split_problems(df, train, test, "id").collect()}
    assert problems == {("in both folds", i) for i in range(291, 300)} | {("in no fold", 399), ("not in the input", 1000)}
    more = spark.createDataFrame([(399, "x", 1), (2000, "x", 1), (2001, "x", 1), (2001, "y", 1)], "id int, s string, k int")
    corpus, refused = labels.appended(df, more, "id")
    assert corpus.count() == 401 and sorted(r.id for r in refused.collect()) == [399, 2001, 2001]
    sample = labels.balanced_sample(df.withColumn("y", F.col("s") == "a"), "y", 21, F.col("k"), F.col("id")).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in sample} == {True: 10, False: 11}


def plain_spans(body, roles):
    """All matches by regular expressions over the vocabulary, longest of those that nest."""
    alt = lambda kind: "(?:" + "|".join(re.escape(t).replace("\\ ", r"\s+") for t in sorted((t for t, ks in roles.items() if kind in ks), key=len, reverse=True)) + ")"
    end = r"(?![\w'\-])"
    patterns = {
        "equipment": rf"(?:{alt('equipment_modifier')}\s+){{0,2}}{alt('equipment_head')}",
        "location": rf"(?:(?:{'|'.join(fixed.PREPOSITIONS)})\s+)?(?:(?:{'|'.join(fixed.ARTICLES)})\s+)?(?:[^\W\d_]+\s+){{0,3}}{alt('location_head')}",
        "activity": rf"{alt('activity_verb')}(?:\s+(?!{alt('stop')}{end})[\w'\-]+){{0,12}}",
        "barrier_failure": rf"(?:(?:{'|'.join(fixed.ABSENCE_WORDS)})\s+{alt('barrier_control')}|(?:[^\W\d_]+\s+){{1,3}}{alt('absence_phrase')})",
    }
    found = set()
    for kind, p in patterns.items():
        for i in range(len(body)):
            for j in range(i + 1, len(body) + 1):
                if re.fullmatch(p, body[i:j], re.I) and not (i and re.match(r"[\w'\-]", body[i - 1])) and not re.match(r"[\w'\-]", body[j : j + 1]):
                    found.add((kind, i, j))
    return {(k, a, b) for k, a, b in found if not any(k == x and c <= a and b <= d and d - c > b - a for x, c, d in found)}


@pytest.mark.parametrize("held", [500_000, 3])  # a vocabulary that workers hold, and one that is joined
def test_spans_of_all_types_against_regular_expressions(spark, monkeypatch, held):
    monkeypatch.setattr(extract, "HELD", held)
    rng = random.Random(14)
    vocab = [("equipment_head", "pump"), ("equipment_head", "pipe"), ("equipment_modifier", "steel"), ("equipment_modifier", "pipe"), ("location_head", "pit"), ("location_head", "deck"), ("activity_verb", "welding"), ("activity_verb", "lifting"), ("stop", "when"), ("stop", "near"), ("barrier_control", "guard"), ("barrier_control", "gas test"), ("absence_phrase", "nahi tha")]
    pieces = ["pump", "Pipe", "steel", "pit", "deck", "welding", "lifting", "when", "near", "the", "a", "in", "no", "without", "guard", "gas", "test", "nahi", "tha", "4", "big-old", "x", ",", "é"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 11)))) for i in range(40)] + [(40, ""), (41, None), (42, "NO GAS  TEST; koi\tguard nahi tha")]
    table = spark.createDataFrame(vocab, "kind string, term string")
    roles = {t: {k for k, x in vocab if x == t} for _, t in vocab}
    got = extract.extracted(spark.createDataFrame(rows, "id int, t string"), "id", "t", table, flat=False).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {(s.entity_type, s.span_start, s.span_end) for s in r.spans} == plain_spans(r.t or "", roles), r.t
        assert all(r.t[s.span_start : s.span_end] == s.entity_text for s in r.spans)


def test_resolving_many_spans_equals_the_expressions(spark):
    rng, body = random.Random(15), "x" * 60
    rows = [(i, body, [span(rng.choice(fixed.ENTITY_TYPES), a, a + rng.randrange(1, 12), body) for a in (rng.randrange(48) for _ in range(rng.randrange(12)))]) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, t string, spans {spans.SPANS}").select("spans", spans.resolved(F.col("spans")).alias("r"), spans.without_nested(F.array_distinct("spans")).alias("n"))
    short = lambda found: [(s.entity_type, s.span_start, s.span_end) for s in found]
    for r in df.collect():
        assert extract._flat(short(r.spans)) == short(r.r)
        assert sorted(extract._outer(short(r.spans))) == sorted(short(r.n))


def test_mined_vocabulary(spark):
    rows = [("equipment", "bench grinder"), ("equipment", "old bench grinder"), ("location", "on the deck"), ("location", "deck"), ("activity", "lifting a pipe"), ("activity", "Lifting"), ("activity", "once"), ("barrier_failure", "no fall  arrest here"), ("barrier_failure", "without fall arrest"), ("barrier_failure", "guard nahi tha")]
    got = {(r.kind, r.term) for r in evaluate.gazetteer(spark.createDataFrame(rows, "entity_type string, entity_text string")).collect()}
    assert got == {("equipment_head", "grinder"), ("equipment_modifier", "bench"), ("location_head", "deck"), ("activity_verb", "lifting"), ("barrier_control", "fall arrest"), ("absence_phrase", "nahi tha")}


def test_enrichment_and_streams(spark, tmp_path):
    rng = random.Random(3)
    texts = [("pipe fell near the pit " if i % 2 else "driver was speeding on the road ") + str(rng.randrange(99)) for i in range(40)]
    train = spark.createDataFrame([(t, float(i % 2), [fixed.RULES[5 if i % 2 else 2]]) for i, t in enumerate(texts)], "text string, label double, tags array<string>")
    risk, rules = scoring.fit_risk(train), scoring.fit_rules(train)
    vocab = spark.createDataFrame([("equipment_head", "pipe"), ("location_head", "pit")], "kind string, term string")
    known = spark.createDataFrame([(w, 9) for w in "pipe fell near the pit driver was speeding on road".split()], "word string, freq long")
    raw = spark.createDataFrame([(1, "s1", "pipe fell near the pit", "worker"), (2, "s1", "  ", "worker"), (3, "nowhere", "pipe fell", "worker"), (4, "s1", "pipe fell near the pit", "worker"), (5, "s1", "pipe fell on the road \x00", "worker")], "report_id int, site_id string, raw_text string, reporter_role string").withColumn("submitted_at", F.lit("2024-01-01").cast("timestamp"))
    sites = spark.createDataFrame([("s1",)], "site_id string")

    def outside(batch):
        if any("road" in t for t in batch):
            raise ValueError("no roads")
        return [0.9] * len(batch)

    rows = scoring.enriched(raw, sites, risk, rules, vocab, known, LEXICON, scoring.guarded(outside)).persist()
    assert {r.report_id: (r.status, r.error, r.confidence) for r in rows.collect()} == {1: ("processed", None, 0.9), 2: (None, None, None), 3: (None, None, None), 4: ("processed", None, 0.9), 5: ("processing_failed", "ValueError: no roads", None)}
    failed = scoring.tables(rows)
    assert {r.report_id: r.status for r in failed["reports"].collect()}[5] == "processing_failed" and 5 not in {r.report_id for name in ("classifications", "tags", "precursors") for r in failed[name].collect()}
    enrich = lambda df: scoring.enriched(df, sites, risk, rules, vocab, known, LEXICON)
    out = scoring.tables(enrich(raw.where("report_id < 5")))
    assert {r.report_id: r.reject_reason for r in out["rejects"].collect()} == {2: "blank", 3: "unknown site"}
    assert all(r.sif_potential for r in out["classifications"].collect())
    assert {(r.entity_type, r.entity_text) for r in out["precursors"].collect()} == {("equipment", "pipe"), ("location", "fell near the pit")}
    assert {r.rule_name for r in out["tags"].collect()} >= {"Line of Fire"}
    thrice = enrich(raw.where("report_id in (1, 2)").union(raw.where("report_id = 1")).union(raw.where("report_id = 4").withColumn("report_id", F.lit(1))))
    assert sorted((r.report_id, r.status or "", len(r.spans or [])) for r in thrice.collect()) == [(1, "processed", 2)] * 3 + [(2, "", 0)]
    assert enrich(raw.drop("submitted_at").withColumn("submitted_at", F.lit(None).cast("timestamp"))).where("submitted_at is null").count() == 0
    raw.where("report_id < 5").write.parquet(str(tmp_path / "in"))
    stream = ingest.without_resubmissions(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")))
    ingest.start_enrichment(stream, enrich, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/reports")).count() == 1
    verdicts = spark.readStream.schema(out["classifications"].schema).parquet(str(tmp_path / "out/classifications/batch=0"))
    ingest.start_density(verdicts, "sif_potential", str(tmp_path / "d"), str(tmp_path / "ck2")).awaitTermination()
    assert ingest.density(spark.read.parquet(str(tmp_path / "d")), "sif_potential").first().total == 1


def test_late_resubmissions_are_dropped_by_the_watermark(spark, tmp_path):
    """Three batches: a repeat within the window goes, one far beyond it is new, and a late row is left out."""
    at = lambda s: f"2024-01-{s}:00"
    batches = [[("s", "a", "01 00"), ("s", "b", "01 01")], [("s", "a", "01 12"), ("s", "c", "20 00")], [("s", "a", "21 00"), ("s", "late", "02 00")]]
    stream = None
    for n, rows in enumerate(batches):
        spark.createDataFrame([(a, b, at(c.replace(" ", " ")) ) for a, b, c in rows], "site_id string, raw_text string, t string").select("site_id", "raw_text", F.to_timestamp("t", "yyyy-MM-dd HH:mm").alias("submitted_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.without_resubmissions(spark.readStream.schema("site_id string, raw_text string, submitted_at timestamp").parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.raw_text, str(r.submitted_at)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-21 00:00:00"), ("b", "2024-01-01 01:00:00"), ("c", "2024-01-20 00:00:00")]


def test_every_query_on_empty_tables(spark, tmp_path):
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    for name in tables:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("density_by_site", "rule_distribution", "review_queue", "list_reports", "report_detail", "kpis", "apply_reviews", "density_by_activity"):
        rows = registry.queries()[name](spark, str(tmp_path)).collect()
        assert len(rows) == {"rule_distribution": 9, "kpis": 1}.get(name, 0)


def test_numbers(spark):
    row = spark.range(1).select(stats.hash_bucket(F.lit("abc"), 8).alias("b"), stats.positive_weight(F.lit(0), F.lit(5)).alias("w"), stats.over_threshold(F.array(*[F.lit(x / 10) for x in (1, 2, 9, 3, 9, 0, 0, 0, 0)]), 0.2).alias("t")).first()
    import zlib

    assert (row.b, row.w) == (zlib.crc32(b"abc") % 8, 1.0)
    assert [t.rule_name for t in row.t] == ["Driving", "Hot Work", "Energy Isolation", "Confined Space"]
