"""Prefix trie, ranked lexical search and line quality against brute force, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlens.llm import lexical, prefixtrie, quality
from hazardlens.llm.common import running_within
from hazardlens.llm.toxicity import WINDOW

# -- running values -----------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_running_values_of_keys_that_lie_in_many_ranges(spark, partitions):
    rng = random.Random(int(partitions))
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 9]), i, rng.randrange(-(2**63), 2**63), rng.randrange(9)) for i in range(700)] + [(5, None, 7, 1)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = running_within(spark.createDataFrame(rows, "k long, o long, v long, w long"), "k", ["o"], {"x": ("xor", "v"), "s": ("sum", "w")}, "running").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    state, want = defaultdict(lambda: (0, 0)), {}
    for k, o, v, w in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        state[k] = (state[k][0] ^ v, state[k][1] + w)
        want[k, o] = state[k]
    assert {(r.k, r.o): (r.x, r.s) for r in got} == want


# -- 11 -----------------------------------------------------------------------------------------


def brute_trie(rows):
    """Nodes of the contract, from lists of (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    talks = {c: [t[3:] for t in sorted(turns)] for c, turns in talks.items()}
    whole = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = talks.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = {}
    for p, convs in members.items():
        kids = [q for q in below[p] if len(q) == len(p) + 1]
        leaves = [q for q in below[p] if not any(len(x) > len(q) for x in below[q])]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(p))
        out[convs[0], len(p)] = (members[p[:-1]][0] if p else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found_trie(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


TALKS = "conv_id long, turn long, role string, text string, depth long, k1 long, place string"


def talks_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TALKS)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 225), -7, -100, 4_000_000_123]:
        for turn in range(rng.choice([1, 2, 3, 5, 7, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é😀", ""])))
    rows += [(300, t, "user", "same") for t in range(90)] + [(301, t, "user", "same") for t in range(90)] + [(302, t, "user", "same") for t in range(60)]  # long chains
    rows += [(7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "user", "tie 2"), (None, 0, "user", "no conversation"), (410, 0, None, "x" * 200_000)]
    rng.shuffle(rows)
    assert found_trie(prefixtrie.trie(talks_frame(spark, rows))) == brute_trie(rows)


def test_trie_of_a_hot_conversation_and_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 16)
    rows = [(50, t, "user", f"turn {t % 3}") for t in range(400)] + [(c, t, "user", "hello") for c in range(1_000, 1_400) for t in range(7)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = found_trie(prefixtrie.trie(talks_frame(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_trie(rows)


def test_trie_of_nothing_and_of_conversations_without_turns_left(spark):
    assert prefixtrie.trie(talks_frame(spark, [])).count() == 0
    few = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][:5]  # all of their turns are dropped, and no family stands before them
    rows = [(c, 0, "user", "gone") for c in few]
    got = found_trie(prefixtrie.trie(talks_frame(spark, rows)))
    assert got == brute_trie(rows) and list(got) == [(few[0], 0)]


@pytest.mark.parametrize("shape", ["random", "chain", "star", "comb"])
def test_contraction_recovers_every_subtree(spark, shape):
    rng = random.Random(shape)
    n = 120
    up = {i: {"random": rng.randrange(i) if i else None, "chain": i - 1, "star": 0, "comb": i - 1 if i % 2 else max(0, i - 2)}[shape] if i else None for i in range(n)}
    depth = {0: 0}
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    kids, value = Counter(up.values()), {i: rng.randrange(1_000) for i in range(n)}
    want = dict(value)
    for i in range(n - 1, 0, -1):
        want[up[i]] += want[i]
    rows = [(i, depth[i], up[i], None if up[i] is None else depth[up[i]], kids[i], value[i]) for i in range(n)]
    tree = spark.createDataFrame(rows, "conv_id long, depth long, up_conv long, up_depth long, kids long, v long")
    assert {r.conv_id: r.v for r in prefixtrie.subtree_totals(tree, ("v",)).collect()} == want


# -- 12 -----------------------------------------------------------------------------------------


def brute_terms(text):
    out, now = [], ""
    for c in [*(text or ""), " "]:
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if ord(c) > 127 or c.isalnum():
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def brute_ranked(docs, items, k=50):
    found = [(i, Counter(brute_terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, length, df = len(found), sum(c.total() for _, c in found), Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(brute_terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in found:
            m = 50 + 50 * c.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def search_rows(rng, n=260):
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "日本語", "x9"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(rng.choice([1, 5, 40, 300]))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)]  # more copies than results
    docs += [(None, docs[3][1]), (None, None), (n + 99, ""), (n + 100, " \t\x7f_"), (3, docs[4][1]), (n + 101, text(30_000)), (n + 102, "W1-w2_W3\x00ÉTÉ été")]
    items = [(i, text(rng.choice([1, 8, 30]))) for i in range(30)] + [(40, docs[3][1]), (41, None), (42, ""), (43, "nobody has this"), (None, "w1"), (44, "w1 w2"), (44, "w3"), (45, "W1 w1 ÉTÉ")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, n string, idx int, score long"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")


@pytest.mark.parametrize("sizes", [(48, 2_048, 65_536, 8_192), (3, 20, 25, 5)])
def test_ranked_search(spark, monkeypatch, sizes):
    leaf, tree, block, sample = sizes
    monkeypatch.setattr(lexical, "LEAF", leaf), monkeypatch.setattr(lexical, "TREE", tree), monkeypatch.setattr(lexical, "SAMPLE", sample), monkeypatch.setattr(lexical, "PARTITION", 100)
    docs, items = search_rows(random.Random(12))
    got = lexical.ranked_search(*frames(spark, docs, items[:12] + items[30:] if block == 25 else items), block_terms=block).collect()
    want = brute_ranked(docs, items[:12] + items[30:] if block == 25 else items)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == want


def test_ranked_search_of_nothing(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.withColumn("text", F.lit("z")))):
        assert lexical.ranked_search(d, i).count() == 0
    assert lexical.ranked_search(docs, items).count() == 1  # one of one documents: the weight is still above 0


def test_bounds_hold_for_every_node_and_leave_subtrees_out():
    rng = np.random.default_rng(12)
    rows, width = [], 400
    for group in range(20):  # groups of documents alike
        base = rng.choice(width, 30, replace=False)
        rows += [np.unique(np.where(rng.random(30) < 0.05, rng.integers(0, width, 30), base)) for _ in range(40)]
    sizes = np.array([len(r) for r in rows])
    idx, val = np.concatenate(rows), rng.integers(1, 10**9, sizes.sum())
    tree = lexical.BallTree(sizes, idx, val, width, 16)
    dense = np.zeros((len(rows), width), np.int64)
    dense[np.repeat(np.arange(len(rows)), sizes), idx] = val
    asked = [sorted(rng.choice(width, n, replace=False).tolist()) for n in (1, 5, 50)] + [rows[0].tolist()]
    bound = tree.bounds(asked)
    exact = np.stack([dense[:, q].sum(1) for q in asked], 1)
    seen = np.zeros(len(rows), int)
    for n in range(len(tree.radii)):
        todo, docs = [n], []
        while todo:
            x = todo.pop()
            if tree.children[x]:
                todo += tree.children[x]
            else:
                docs += tree.order[slice(*tree.span[x])].tolist()
        assert (bound[n] >= exact[docs].max(0)).all()
        seen[docs] += tree.children[n] is None
    assert (seen == 1).all()
    best = lexical.Best(lexical.Searched(lexical.Items({}, [0, 1, 2, 3], asked), np.zeros(width), 1, 1, np.zeros(4, np.int64)), 5)
    best.search(tree, list(range(len(rows))))
    for q in range(4):
        assert sorted(((-s, -i) for s, _, i in best.found[q])) == sorted((-int(s), d) for d, s in enumerate(exact[:, q]) if s > 0)[:5]
    assert best.scored < 4 * len(rows)


# -- 13 -----------------------------------------------------------------------------------------


def brute_levels(text):
    """A few of the levels, line by line."""
    out = []
    lines = (text or "").split("\n")
    for line in lines:
        words = line.split()
        upper, letters = sum(c.isupper() for c in line), sum(c.isalpha() for c in line)
        out.append((
            np.digitize(upper / max(letters, 1), quality.SHARES), np.digitize(1 - len(set(words)) / max(len(words), 1), quality.SHARES),
            np.digitize(len(line), quality.CHARACTERS), np.digitize(sum(x.strip() == line.strip() for x in lines) if line.strip() else 1, quality.TIMES),
        ))
    return out


def test_levels_of_lines():
    texts = ["One two.\nTWO two TWO\n\nOne two. \n日本語 ÉTÉ 😀", None, "", "a" * 9_000, "\n\n"]
    feats, lengths, sizes = quality.levels(texts)
    assert sizes.tolist() == [5, 1, 1, 1, 3] and lengths.tolist() == [len(x) for t in texts for x in (t or "").split("\n")]
    got = (feats - np.arange(quality.LEVELS) * quality.LEVEL_STEPS)[:, [3, 7, 9, 11]]
    assert got.tolist() == [[int(x) for x in line] for t in texts for line in brute_levels(t)]
    assert (feats >= 0).all() and (feats < quality.LEVELS * quality.LEVEL_STEPS).all()
    together = [quality.levels([t])[0] for t in texts]
    assert np.array_equal(np.vstack(together), feats)  # a text's levels don't depend on its neighbours


def labelled_lines(n=400):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    bad = lambda: " ".join(word() + "###" for _ in range(12))
    docs, labels = [], []
    for i in range(n):
        ok = rng.random() < 0.8
        docs.append((i, "\n".join((good if ok or rng.random() < 0.1 else bad)() for _ in range(rng.randrange(1, 9)))))
        labels.append((i, int(ok), 0))
    return docs, labels


DOCS = "doc_id long, text string, score double, lines string, r int"


def test_quality(spark):
    docs, labels = labelled_lines()
    odd = [(None, docs[0][1]), (900, None), (901, ""), (902, "x\n" * (3 * WINDOW)), (903, "long " * 100_000), (904, docs[1][1]), (904, docs[1][1]), (905, "\n")]
    frame = spark.createDataFrame([(*r, 0.5, "x", 1) for r in docs + odd], DOCS)
    label = spark.createDataFrame([*labels, (0, None, 1), (None, 0, 0), (1, 1 - labels[1][1], 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(frame, label).collect()
    assert len(rows) == len(docs) + len(odd)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[904][0].score == by[904][1].score == by[1][0].score and by[None][0].score == by[0][0].score
    assert by[900][0].score == by[901][0].score and len(by[902][0].lines) == 3 * WINDOW + 1 and len(by[905][0].lines) == 2
    # a good document with one bad line keeps that line apart
    mixed = docs[next(i for i, _, _ in labels if labels[i][1])][1] + "\n" + "zz### yy### ww### " * 5 + "\n" + docs[next(i for i, _, _ in labels if labels[i][1])][1]
    model = quality.train(frame, label)
    share, lines = model.shares([mixed])
    bad = mixed.split("\n").index("zz### yy### ww### " * 5)
    assert lines[0][bad] == min(lines[0])
    weights = np.array([len(x) + 1 for x in mixed.split("\n")])
    assert share[0] == pytest.approx(float(lines[0] @ weights / weights.sum()))


def test_quality_of_nothing(spark):
    frame, label = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(frame, label).count() == 0
    rows = quality.judge(spark.createDataFrame([(1, "a", 0.0, "", 1)], DOCS), label).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)]
