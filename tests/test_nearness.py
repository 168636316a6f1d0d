"""Near-duplicates of whole texts and sequence-ratio repeats against brute force."""

import difflib
import random

import numpy as np
import pytest

from hazardlens.operators import graph, ratioindex, repeats, shingles


def text_of(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edited(rng, text, share, letters="abcdefgh XYZ.,"):
    out = []
    for c in text:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(rng.choice(letters) if r < 2 * share / 3 else c)
        if r > 1 - share / 3:
            out.append(rng.choice(letters))
    return "".join(out)


# -- components ---------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [500_000, 5])
def test_components_with_hubs_of_the_smallest_and_the_largest_id(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT", hot)
    rng = random.Random(1)
    links = [(1, i) for i in range(2, 40)] + [(i, 999) for i in range(100, 140)] + [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    links += [(5, None), (None, None), (7, 7), (8, 8_000), (8_000, 8)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in up} and len(got) == len(up)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- shingles -----------------------------------------------------------------------------------


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = frozenset() if not w else frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def brute_links(sets):
    ids = sorted(i for i in sets if sets[i])
    return {(x, y) for n, x in enumerate(ids) for y in ids[n + 1 :] if 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])}


def shingle_rows(rng):
    rows = [(i, text_of(rng, rng.choice([30, 80, 300]))) for i in range(120)]
    for i in range(120, 360):  # copies with one to six words changed
        words = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    drift = text_of(rng, 200).split()
    for i in range(360, 460):  # each is like the one before it, but the last is unlike the first
        drift[rng.randrange(200)] = f"drift{i}"
        rows.append((i, " ".join(drift)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE\ttwo"), (505, rows[0][1].upper()), (506, rows[0][1]), (507, text_of(rng, 30_000))]


def test_near_duplicates_by_shingles(spark):
    rng = random.Random(3)
    rows = shingle_rows(rng)
    sets = brute_sets(rows)
    up = {i: i for i in sets}
    linked = brute_links(sets)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    frame = spark.createDataFrame([*[(i, t, 1, "x") for i, t in rows], (None, "no id", 1, "x")], "doc_id long, text string, n int, head string")
    got = {r.doc_id: (r.n_shingles, r.class_id) for r in shingles.near_duplicates(frame, "doc_id", "text").collect()}
    assert set(got) == set(sets) and all(got[i][0] == len(sets[i]) for i in sets)
    found = sum(got[a][1] == got[b][1] for a, b in linked)
    assert found >= 0.99 * len(linked)  # recall over exact pairs
    assert all(root(i) == root(got[i][1]) for i in sets)  # nothing is put together that links don't
    # bands meet nearly surely at the threshold itself
    meets = sum(bool((a == b).any()) for a, b in ((shingles.band_hashes(np.arange(900, dtype=np.uint64)), shingles.band_hashes(np.arange(k, 900 + k, dtype=np.uint64))) for k in range(1, 100)))
    assert meets >= 98


def test_near_duplicates_of_nothing_and_of_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 20)
    assert shingles.near_duplicates(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0
    base = text_of(random.Random(4), 200).split()
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(150)] + [(200 + i, " ".join(base)) for i in range(60)] + [(300, "a b c"), (300, "d e f")]
    got = {r.id: r.class_id for r in shingles.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert len(got) == 211 and {c for i, c in got.items() if i < 300} == {0}


# -- sequence ratio -----------------------------------------------------------------------------


def brute_first(texts, threshold=0.85):
    want = {}
    for i, t in enumerate(texts):
        for j in range(i):
            if t and texts[j] and t.strip() and texts[j].strip():
                r = 1.0 if texts[j] == t else difflib.SequenceMatcher(None, t, texts[j]).ratio()
                if r >= threshold:
                    want[i] = (j, r)
                    break
    return want


def ratio_texts(rng):
    """300 texts of 5 to 900 characters, under and over the length from which frequent characters are left out."""
    letters = "eeeettaaoinshr dlucm fwypvbgk,.TAISE"
    plain = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [plain(rng.choice([5, 12, 60, 150, 260, 500])) for _ in range(70)] + [text_of(rng, rng.choice([20, 60, 160])) for _ in range(40)]
    for _ in range(170):
        texts.append(edited(rng, rng.choice(texts[:110]), rng.choice([0.01, 0.05, 0.1, 0.15, 0.2])))
    shared = plain(120)
    return [*texts, None, " ", "", *[shared + plain(140) for _ in range(10)], *texts[:7]]


@pytest.mark.parametrize("seed", [1, 2])
def test_no_pair_of_300_texts_is_lost(spark, seed):
    texts = ratio_texts(random.Random(seed))
    want = brute_first(texts)
    assert len(want) > 60
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, t string, y string")
    got = {r.id: (r.match_id, r.ratio) for r in repeats.ratio_repeats(rows, "id", "t", "id").collect()}
    assert got == {i: (j, pytest.approx(r)) for i, (j, r) in want.items()}


def test_only_rows_alike_in_a_column_are_compared(spark):
    base = text_of(random.Random(9), 60)
    rows = [(1, base, "a"), (2, base + "!", "b"), (3, base + "?", "a"), (4, base, "b"), (5, base, None), (6, base + ".", None), (7, base, "c")]
    got = repeats.ratio_repeats(spark.createDataFrame(rows, "id long, t string, site string"), "id", "t", "id", within="site").collect()
    want = {i: j for part in ("a", "b", None) for i, j in [(0, 0)] for own in [[r for r in rows if r[2] == part]] for k, v in brute_first([r[1] for r in own]).items() for i, j in [(own[k][0], own[v[0]][0])]}
    assert {r.id: r.match_id for r in got} == want


def test_the_least_number_shared_holds_for_pairs_that_are_just_alike():
    rng, near = random.Random(8), 0
    letters = "eeeettaaoinshr dlucm fwypvbgk,.TAISE"
    for n in [30, 90, 199, 200, 260, 600] * 60:
        a = "".join(rng.choice(letters) for _ in range(n)) if n % 2 else text_of(rng, n // 5)
        b = edited(rng, a, rng.choice([0.05, 0.15, 0.2, 0.25]))
        ratio = difflib.SequenceMatcher(None, b, a).ratio()
        if not a or ratio < 0.85:
            continue
        near += ratio < 0.9
        x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
        for q in ratioindex.LEVELS:
            least = ratioindex.least_shared(len(x), ratioindex.rare_characters(x), q, 0.85)
            assert len(np.intersect1d(ratioindex.grams(x, q), ratioindex.grams(y, q))) >= least
    assert near > 20


def test_sequence_ratio_of_nothing_and_of_many_near_copies(spark, monkeypatch):
    assert repeats.ratio_repeats(spark.createDataFrame([], "id long, t string"), "id", "t", "id").count() == 0
    monkeypatch.setattr(graph, "HOT", 20)
    base = text_of(random.Random(4), 40)  # under 200 characters: none is left out as frequent
    rows = [(i, base[:i] + "#" + base[i + 1 :]) for i in range(120)]
    got = repeats.ratio_repeats(spark.createDataFrame(rows, "id long, t string"), "id", "t", "id").collect()
    assert {r.id: r.match_id for r in got} == {i: 0 for i in range(1, 120)}
