"""Each operator against a brute-force version, and on nulls, ties, repeats, empty and clashing input."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from hazardlens.llm import bpe, common, langid, linededup, mixing, neardup, ngramjoin, sharding, topk, toxicity, warc
from hazardlens.llm.common import components, hashed_share
from hazardlens.llm.queries import pattern, rank_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, keep string, size long, shard int, h long, version long"


def docs_frame(spark, rows, schema=DOCS):
    """Documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", 1, 2, 3, 4) for i, t, lang, s in rows], schema)


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


def odd_texts(rng):
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    line = "A line that many documents have in common"
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, " \t\n ", "en", "b"),
        (7, "one two three", "en", "c"), (8, "ONE  two\nthree", "en", "c"), (9, f"{line}\nnine nine", "en", "c"), (10, f"  {line.upper()} \nten\n{line}", "en", "c"),
        (11, f"x\n{line}\t", "en", "d"), (12, words(rng, 30_000), "en", "d"), (12, "a second text of one id", "en", "d"), (13, "same", "en", "d"), (13, "same", "en", "d"),
        (None, f"{line}\nno id", "en", "a"), (14, "日本語 テキスト 😀 été ß", "xx", "é"), (15, "12 34 !!", "en", "a"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_frame(spark, odd_texts(random.Random(5)))


@pytest.fixture(scope="module")
def none(spark):
    return docs_frame(spark, [])


# -- 1 ------------------------------------------------------------------------------------------


def test_bpe_agrees_with_the_library():
    codec = bpe.codec(open(rank_path(), "rb").read(), pattern())
    library = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "   ", "\n", "\t", "é", "ß", "日", "😀", "1", "'s", "'", "aaaa", " ", "The", "tion", ".", "{}"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["a" * 5001, "ab" * 3000, " " * 700, "the" * 999, "é" * 500]
    for text in texts:
        ids = codec.encode(text)
        assert ids == struct.pack(f"<{len(ids) // 4}I", *library.encode_ordinary(text)), text[:60]
        assert codec.decode(ids) == text.encode()


def test_bpe_with_tokens_of_white_space_and_other_patterns():
    ranks = dict(bpe.codec(open(rank_path(), "rb").read(), pattern()).ranks)
    for more in (b"  ", b"   ", b"\n ", b" \n", b"\t ", b"\xe3\x80\x80 "):
        ranks.setdefault(more, len(ranks))
    rng = random.Random(12)
    alphabet = ["a", "bc", " ", " ", "  ", "\n", "\t", "\u3000", "\x1c", "\x85", "1", ".", "'s"]
    texts = ["a  ", "  ", "  a", "a   b", "foo ", "foo\n ", " a", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(3000))]
    for pat in (pattern(), r"\s*\S+\s*|\s+", r"\p{N}{1,3}|[^\r\n\p{L}\p{N}]?\p{L}+|\s+|[^\s\p{L}\p{N}]+"):
        codec, library = bpe.BytePairCodec(ranks, pat), tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        for text in texts:
            ids = codec.encode(text)
            assert ids == struct.pack(f"<{len(ids) // 4}I", *library.encode_ordinary(text)), (pat, text)


def test_bpe_join_of_any_cut():
    codec = bpe.codec(open(rank_path(), "rb").read(), pattern())
    rng = random.Random(2)
    for _ in range(300):
        data = "".join(rng.choice("aabethino ") for _ in range(rng.randrange(2, 90))).encode()
        cut = rng.randrange(1, len(data))
        assert codec.join(codec.merged(data[:cut]), codec.merged(data[cut:])) == codec.merged(data)


def test_bpe_rows(odd, none):
    got = bpe.digests(odd, rank_path(), pattern()).collect()
    assert len(got) == odd.count()
    text = defaultdict(list)
    for r in odd.collect():
        text[r.doc_id].append(hashlib.sha256((r.text or "").encode()).hexdigest())
    assert all(r.decoded_sha256 in text[r.doc_id] for r in got)
    empty = next(r for r in got if r.doc_id == 4)
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.digests(none, rank_path(), pattern()).count() == 0


# -- 2 ------------------------------------------------------------------------------------------


def brute_vectors(rows):
    ok = {i: (label, np.array(v, float)) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: {j for j, (m, w) in ok.items() if j != i and m == label and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98} for i, (label, v) in ok.items()}
    up = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, js in near.items():
            for j in js:
                up[i] = up[j] = min(up[i], up[j])
    return {i: (len(near.get(i, ())), up[i]) for i, _, _ in rows}


def vector_rows(n=400, width=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width))
    for i in range(0, n // 2, 4):
        x[i + 1] = x[i] + rng.normal(size=width) * 0.06
        x[i + 2] = x[i + 1] + rng.normal(size=width) * 0.1
    x[300:330] = x[0] * 2
    x[330:360] = x[5] + rng.normal(size=(30, width)) * 0.08
    rows = [(i, [float(v) for v in x[i]], i % 3 if i < n // 2 else 0) for i in range(n)]
    return rows + [(n, None, 0), (n + 1, [0.0] * width, 0), (n + 2, [float("nan")] * width, 0), (n + 3, [None] * width, 0), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_near_duplicates(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, la, 1, "x", 2) for i, v, la in rows], VECTORS + ", rep long, key string, copies int")
    stored = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    want, got = brute_vectors(stored), {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(frame).collect()}
    assert sum(n for n, _ in want.values()) > 500
    assert got == want


def test_near_duplicates_of_many_vectors_of_several_widths(spark, monkeypatch):
    """Recall over some thousands of vectors; each width has pivots of its own, and hot vectors are dealt."""
    monkeypatch.setattr(common, "HUB", 100)
    rng = np.random.default_rng(13)
    rows = []
    for width, n in ((32, 3_000), (8, 600), (1, 40)):
        x = rng.normal(size=(n, width))
        for i in range(0, n - 6, 6):
            for k in range(1, 4):
                x[i + k] = x[i + k - 1] + rng.normal(size=width) * 0.05
        x[n // 2 : n // 2 + n // 10] = x[n // 2] + rng.normal(size=(n // 10, width)) * 0.04
        x[: n // 12 : 1] = x[3]
        rows += [(len(rows) + i, [float(v) for v in x[i]], i % 2) for i in range(n)]
    frame = spark.createDataFrame(rows, VECTORS)
    stored = {r.vec_id: (np.array(r.embedding, float), r.label) for r in frame.collect()}
    want, up = Counter(), {i: i for i in stored}
    for width in (32, 8, 1):
        for label in (0, 1):
            ids = np.array([i for i, (v, la) in stored.items() if la == label and len(v) == width])
            x = np.array([stored[i][0] for i in ids])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            linked = x @ x.T >= 0.98
            np.fill_diagonal(linked, False)
            want.update(dict(zip(ids.tolist(), linked.sum(1).tolist(), strict=True)))
            root = ids.copy()
            while True:
                new = np.minimum(root, np.where(linked, root[None, :], 10**9).min(1))
                if (new == root).all():
                    break
                root = new
            up.update(zip(ids.tolist(), root.tolist(), strict=True))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(frame).collect()}
    links = sum(want.values())
    found = sum(n for n, _ in got.values())
    assert all(got[i][0] <= want[i] for i in stored) and found >= 0.999 * links
    assert sum(got[i][1] == up[i] for i in stored) >= 0.999 * len(stored)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    one = neardup.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], VECTORS)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in one) == [(-1, 0, None), (3, 0, 3)]


# -- 3 ------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = words(rng, 60, 3000).split()
        if toxic:
            text.insert(rng.randrange(60), rng.choice(["blorg", "snarkface", "snarkhead,"]))
        rows.append((i, " ".join(text), "en", "a"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return docs_frame(spark, rows + [(n, None, None, None), (n + 1, "", None, None), (None, "blorg", None, None)]), spark.createDataFrame(labels + [(0, 1, 0), (None, 0, 1), (4, None, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.tag(docs, labels).collect()}
    assert len(got) == 603
    held = [r for i, r in got.items() if i is not None and r.held_out and i < 600]
    assert len(held) > 100
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.98
    for r in held:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [text[r.doc_id][s.start : s.end] for r in held for s in r.spans]
    assert spans and all(s.strip(",") in ("blorg", "snarkface", "snarkhead") for s in spans)
    assert got[600].score == got[601].score < 0.3


def test_chain_marginals_equal_brute_force_and_the_step_by_step_pass():
    rng = np.random.default_rng(1)
    for step in ([[0.8, -0.5], [-0.4, 0.6]], [[3.0, -4.0], [-5.0, 4.0]], [[-2.0, 2.0], [1.0, -3.0]], [[0.0, 0.0], [0.0, 0.0]]):
        chain = toxicity.Chain()
        chain.step = np.array(step)
        sizes = np.array([0, 1, 31, 32, 33, 0, 400, 64, 5000, 2])
        score = rng.normal(-1, 3, sizes.sum())
        got, at = chain.marginals(score, sizes), 0
        for n in sizes:
            if n:
                full, _ = chain.window_marginals(score[None, at : at + n], np.ones((1, n), bool))
                assert np.allclose(full[0], got[at : at + n], atol=1e-12)
                at += n
        # all states of a short text
        few, weight = score[:7], np.zeros((7, 2))
        for states in product((0, 1), repeat=7):
            w = np.exp(sum(few[i] for i, s in enumerate(states) if s) + sum(chain.step[a, b] for a, b in pairwise(states)))
            weight[np.arange(7), states] += w
        assert np.allclose(chain.marginals(few, np.array([7])), weight[:, 1] / weight.sum(1))


def test_chain_fit_finds_its_own_maximum():
    """The gradient of the fit is that of the likelihood, by small steps."""
    rng = np.random.default_rng(2)
    feats = rng.integers(0, 8, (12, toxicity.FEATURES))
    tokens, toxic = rng.integers(0, 12, (40, toxicity.WINDOW)), rng.integers(0, 2, (40, toxicity.WINDOW))
    tokens[3, 40:] = -1

    def likelihood(chain):
        total = 0.0
        for row, states in zip(tokens, toxic, strict=True):
            row = row[row >= 0]
            value = chain.values(feats)[row]
            score = value[:, 0].copy()
            score[1:] += value[:-1, 1]
            score[:-1] += value[1:, 2]
            y = states[: len(row)]
            f = np.array([0.0, score[0]])
            for s in score[1:]:
                f = np.logaddexp(f[0] + chain.step[0], f[1] + chain.step[1]) + [0.0, s]
            total += score @ y + sum(chain.step[a, b] for a, b in pairwise(y)) - np.logaddexp(*f)
        return total / len(tokens) - 5e-3 * (chain.weights[:, toxicity.LEVELS :] ** 2).sum() - 5e-4 * ((chain.weights[:, : toxicity.LEVELS] ** 2).sum() + (chain.step**2).sum())

    chain = toxicity.Chain()
    before = likelihood(chain)
    chain.fit(tokens, feats, toxic, rounds=400, rate=0.05)
    best = likelihood(chain)
    assert best > before
    for place in (1, 5):
        for d in (0.05, -0.05):
            chain.weights[0, place] += d
            assert likelihood(chain) < best + 1e-3
            chain.weights[0, place] -= d


def test_toxicity_of_long_texts_repeats_and_clashing_columns(spark):
    docs, labels = labelled(spark)
    rng = random.Random(10)
    long = words(rng, 40_000, 3000).split()
    long[20_000] = "blorg"
    more = docs_frame(spark, [(2_000, " ".join(long), None, None), (2_001, "blorg", None, None), (2_002, "blorg", None, None), (2_001, "blorg", None, None), (2_003, "x" * 300_000, None, None)])
    frame = docs.union(more).selectExpr("*", "1 as score", "'y' as spans", "2 as held_out", "3 as toxic", "4 as signature", "5 as _id")
    got = toxicity.tag(frame, labels.withColumn("text", F.lit("z"))).where("doc_id >= 2000").collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.score, r.predicted))
    assert len(by[2_001]) == 2 and by[2_001][0] == by[2_001][1] == by[2_002][0] and by[2_001][0][1] == 1
    assert by[2_000][0][1] == 1 and by[2_003][0][1] == 0
    spans = next(r.spans for r in got if r.doc_id == 2_000)
    assert [" ".join(long)[s.start : s.end] for s in spans] == ["blorg"]


def test_toxicity_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.tag(none, labels).count() == 0
    docs = docs_frame(spark, [(1, "some text", None, None)])
    assert [(r.predicted, r.spans) for r in toxicity.tag(docs, labels).collect()] == [(0, [])]


# -- 4 ------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(4)
    stems = {"xa": ["stra", "keit", "ung", "sch"], "xb": ["cion", "los", "mente", "que"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(rng.randrange(1, 40))), lang, "a") for i in range(400) for lang in [rng.choice(list(stems))]]
    docs = docs_frame(spark, [*rows, (900, None, "xa", None), (901, "12 !?", None, None), (902, "", "xb", None), (903, "queloscion " * 3000, None, None), (None, "strakeitung", None, None)])
    got = {r.doc_id: r for r in langid.identify(docs, rank_path()).collect()}
    held = [(r, lang) for i, _, lang, _ in rows if (r := got[i]).held_out]
    assert len(held) > 80 and sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "xb", "xa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == 0


def test_forward_sums_all_segmentations():
    vocab = [b"a", b"b", b"ab", b"ba", b"aba"]
    prob = np.array([0.4, 0.2, 0.2, 0.1, 0.1])
    pieces = langid.Pieces(vocab)

    def brute(w):
        return 1.0 if not w else sum(p * brute(w[len(v) :]) for v, p in zip(vocab, prob, strict=True) if w.startswith(v))

    p = langid.lifted(prob[:, None], np.array([len(v) for v in vocab]))
    for w in (b"a", b"abab", b"ababababba"):
        assert np.isclose(langid.word_scores([w], pieces, p)[0, 0], np.log(brute(w)))


def exact_word(word, vocab, prob):
    """Log of the sum over all segmentations, in whole numbers."""
    sums = [Fraction(1)] + [Fraction(0)] * len(word)
    for j in range(1, len(word) + 1):
        sums[j] = sum((sums[j - len(v)] * Fraction(p) for v, p in zip(vocab, prob, strict=True) if len(v) <= j and word[j - len(v) : j] == v), Fraction(0))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


@pytest.mark.parametrize("stretch", [7, 33, 64, 4_096])
def test_forward_over_long_words_and_long_pieces(monkeypatch, stretch):
    vocab = [b"a", b"b", b"ab", b"ba", b"aba", b"abababab", b"bbbbbbbbbbbbb"]
    prob = [0.4, 0.2, 0.2, 0.1, 0.05, 0.03, 0.02]
    rng = random.Random(3)
    words_ = [b"ab" * 30, b"b" * 200, bytes(rng.choice(b"ab") for _ in range(200)), b"a", bytes(rng.choice(b"ab") for _ in range(431))]
    monkeypatch.setattr(langid, "STRETCH", stretch)
    p = langid.lifted(np.array(prob)[:, None], np.array([len(v) for v in vocab]))
    got = langid.word_scores(words_, langid.Pieces(vocab), p)[:, 0]
    assert np.allclose(got, [exact_word(w, vocab, prob) for w in words_], rtol=1e-12)


def test_expected_pieces_equal_brute_force():
    vocab, prob = [b"a", b"b", b"ab", b"aba"], [0.4, 0.3, 0.2, 0.1]

    def cuts(w):
        return [[]] if not w else [[i, *rest] for i, v in enumerate(vocab) if w.startswith(v) for rest in cuts(w[len(v) :])]

    want = np.zeros((4, 2))
    words_, langs, counts = [b"abab", b"aabba", b"babaab"], np.array([0, 1, 0]), np.array([2.0, 1.0, 3.0])
    for w, la, k in zip(words_, langs, counts, strict=True):
        every = [(c, math.prod(prob[i] for i in c)) for c in cuts(w)]
        for c, q in every:
            for i in c:
                want[i, la] += k * q / sum(q for _, q in every)
    seen = np.zeros((4, 2))
    p = langid.lifted(np.array([prob, prob]).T, np.array([len(v) for v in vocab]))
    langid._expected(langid.Pieces(vocab), words_, p, langs, counts, seen)
    assert np.allclose(seen, want)
    # long words: the lengths of the pieces to expect add up to that of the word
    seen = np.zeros((4, 2))
    langid._expected(langid.Pieces(vocab), [b"ab" * 400, b"a"], p, np.array([0, 1]), np.array([1.0, 1.0]), seen)
    assert np.isclose(seen[:, 0] @ [len(v) for v in vocab], 800)


def test_language_id_uses_the_whole_vocabulary_and_long_texts_without_spaces(spark):
    vocab = langid.vocabulary(rank_path())
    assert len(vocab) == len({line.split()[0] for line in open(rank_path(), "rb") if line.strip()} | {base64.b64encode(bytes([b])) for b in range(256)})
    rows = [(i, ("天気予報" if i % 2 else "気温上昇") * 20, "xa" if i % 2 else "xb", "a") for i in range(60)]
    got = {r.doc_id: r for r in langid.identify(docs_frame(spark, [*rows, (1000, "天気予報" * 5000, None, "a"), (1001, "天気予報" * 5000, None, "a")]), rank_path()).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == "xa" and got[1000].score == got[1001].score
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)


def test_a_bounded_share_of_any_number_of_rows_is_never_empty(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    assert rows.where(hashed_share(F.col("h"), 10_000, 9_000)).count() == 20_000
    assert 4_500 < rows.where(hashed_share(F.col("h"), 10_000, 40_000)).count() < 5_500
    for of in (10**11, 10**15, 2**62):
        least = -(2**63) + max(1, (8_000 << 64) // of) - 1
        one = spark.createDataFrame([(least,), (least + 1,)], "h long")
        assert [r.h for r in one.where(hashed_share(F.col("h"), 8_000, of)).collect()] == [least]


def test_language_id_of_nothing(spark, none):
    assert langid.identify(none, rank_path()).count() == 0
    unlabelled = docs_frame(spark, [(1, "some text", None, None)])
    assert [r.lang_pred for r in langid.identify(unlabelled, rank_path()).collect()] == ["und"]


# -- 5 ------------------------------------------------------------------------------------------


def test_sharding_is_even_gapless_and_keeps_copies_together(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(5, 40)), "en", "a") for i in range(2000)] + [(i, "one huge group of equal texts", "en", "a") for i in range(2000, 3000)]
    got = sharding.by_bytes(docs_frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    loads, slots, places = Counter(), defaultdict(list), defaultdict(set)
    text = {i: t for i, t, _, _ in rows}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[text[r.doc_id]].add(r.shard)
    assert set(loads) == set(range(24)) and max(loads.values()) - min(loads.values()) < 2000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # only a group that a border runs through is parted: the huge one, and at most one a border otherwise
    assert sum(len(p) > 1 for p in places.values()) <= 24
    pairs = [(i, f"text {i // 3} of three rows " * 3, "en", "a") for i in range(6000)]
    together = defaultdict(set)
    for r in sharding.by_bytes(docs_frame(spark, pairs)).collect():
        together[r.doc_id // 3].add(r.shard)
    assert sum(len(p) > 1 for p in together.values()) <= 23
    few = sharding.by_bytes(odd).collect()
    assert len(few) == odd.count() and {r.size for r in few if r.doc_id == 4} == {8}
    assert sharding.by_bytes(none).count() == 0


def test_sharding_deals_a_hot_text_over_slices(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 50)
    rng = random.Random(16)
    rows = [(i, "hot text" if i % 3 == 0 else words(rng, 9), "en", "a") for i in range(1500)] + [(1500, "hot text", "en", "b"), (None, "hot text", "en", "b"), (7, "hot text", "en", "b")]
    got = sharding.by_bytes(docs_frame(spark, rows)).collect()
    slots, loads = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert len(got) == 1503 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) < 200


def test_growing_the_ring_of_the_query_moves_little():
    loads = {b: 100 + b % 7 for b in range(sharding.BINS)}

    def owners(shards):
        out = defaultdict(lambda: defaultdict(float))
        for b, lo, hi, s in sharding.reach(loads, shards, 0.0):
            out[b][s] += min(hi, loads[b]) - lo
        return out

    before, after = owners(24), owners(25)
    moved = sum(max(0, v - after[b][s]) for b, row in before.items() for s, v in row.items())
    assert moved / sum(loads.values()) < 0.12


def test_ring_bounds_loads_and_moves_little():
    loads = {b: 100 + b % 7 for b in range(sharding.BINS)}

    def owners(shards):
        out = defaultdict(lambda: defaultdict(float))
        for b, lo, hi, s in sharding.reach(loads, shards, 0.1):
            out[b][s] += min(hi, loads[b]) - lo
        return out

    before, after = owners(8), owners(9)
    total = sum(loads.values())
    for o, n in ((before, 8), (after, 9)):
        load = Counter()
        for b in o.values():
            load.update(b)
        assert np.isclose(sum(load.values()), total) and max(load.values()) <= 1.1 * total / n + 2
    moved = sum(max(0, v - after[b][s]) for b, row in before.items() for s, v in row.items())
    assert moved / total < 0.35


# -- 6 ------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: 1 + i % 3 for i, s in enumerate(names)}, {}
    total = sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark, odd, none):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 30)), "en", rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(900)] + [(1000, "x y", "en", "tiny"), (1001, "", "en", "zero")]
    frame = docs_frame(spark, rows)
    got = mixing.mixture(frame).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want, took = brute_targets(sizes), Counter()
    source = {i: s for i, _, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert np.isclose(r.target, want[s]) and r.source_size == sizes[s] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        took[s] += r.taken
    assert all(abs(took[s] - want[s]) <= 30 for s in sizes)
    assert sorted(got) == sorted(mixing.mixture(frame.repartition(7)).collect())
    assert mixing.mixture(odd).count() == odd.count() and mixing.mixture(none).count() == 0


def test_mixing_of_very_many_sources(spark):
    rng = random.Random(18)
    rows = [(i, words(rng, rng.randrange(1, 9)), "en", f"site{rng.randrange(700)}") for i in range(2500)]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()
    assert len(got) == len(sizes) and all(np.isclose(r.target, want[r.source]) for r in got)


# -- 7 ------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a.example/x", big), (2, "https://www.b.example:80/y?q=1", big), (5, None, big), (3, "u\r\nX: y", "short"), (4, "http://a.example/x", "short"), (6, "http://c/", None), (7, "", ""), (8, "http://d/", "a\r\n\r\nWARC/1.0\r\nb"), (None, "http://e/", big), (9, "http://[bad", "x" * 70_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, record string")
    got = {r.page_id: r for r in warc.read_back(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 5, 3, 4, None)] == [("revisit", 5), ("revisit", 5), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert warc.read_back(pages.limit(0)).count() == 0


def test_one_huge_page_does_not_shorten_the_other_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * 2_000) for i in range(400)] + [(400, "http://a/big", "y" * 3_000_000)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    files = {k: len(list((tmp_path / "w" / k).glob("*.gz"))) for k in ("others", "big")}
    assert files == {"others": 1, "big": 1}
    got = warc.read_back(pages).collect()
    assert len(got) == 401 and {r.payload_bytes for r in got} == {2_000, 3_000_000}


def test_histories_are_ordered_over_partitions(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i % 3}", f"page {i}") for i in range(500)], "page_id long, url string, html string").repartition(9)
    rows = warc.round_trip(pages).collect()
    keys = [warc.order(tuple(r)) for r in rows]
    assert len(rows) == 500 and keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted(((rng.choice("abc"), str(rng.randrange(9)), rng.randrange(50), f"r{j}", n) for n in range(rng.randrange(12))), key=warc.order) for j in range(k)]
        assert [warc.order(x) for x in warc.LoserTree(iter(r) for r in runs)] == sorted(warc.order(x) for r in runs for x in r)


# -- 8 ------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: line.strip(linededup.WHITE).translate(str.maketrans(linededup.UPPER, linededup.LOWER))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [line for line in lines if i is None or len(h := holders[key(line)]) < 3 or max(h) == i]
        out.append((i if i is not None else -1, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 5, 60])
def test_line_dedup(spark, odd, none, partitions):
    rng = random.Random(partitions)
    lines = [f"line number {i} that documents share" for i in range(12)] + ["short"]
    rows = [(i, "\n".join(rng.choice(lines).upper() if rng.random() < 0.2 else rng.choice(lines[:1] + lines) for _ in range(rng.randrange(1, 9))), "en", "a") for i in range(300)]
    rows += odd_texts(rng)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [(r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.digests(docs_frame(spark, rows)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    # equal rows share one bitmap and each keep a row
    assert sorted(got) == brute_lines([(i, t) for i, t, _, _ in rows])
    assert linededup.digests(none).count() == 0


def test_line_dedup_of_a_key_that_goes_on_in_a_partition_with_one_other(spark):
    rows = [(i, f"the first line of many documents\nthe second line of many documents\nown {i}", "en", "a") for i in range(200)]
    # more partitions than keys: one of them ends the first key and begins the second
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in (3, 5):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.digests(docs_frame(spark, rows)).collect()]
            assert sorted(got) == brute_lines([(i, t) for i, t, _, _ in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_line_marks_leave_a_continued_key_open():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["h1", "h2", "doc_id", "version", "pos"])

    # key 1 goes on from another partition; key 2 follows alone, then in the same batch key 3 as well
    for others in ([2], [2, 3]):
        marks = linededup._marks(3)(iter([batch((1, 1, 9, 0, 0), (1, 1, 8, 0, 0), (1, 1, 7, 0, 0), *[(k, k, 5, 0, 0) for k in others])]))
        pending = [(r["h1"], r["doc_id"]) for b in marks for r in b.to_pylist() if r["pending"]]
        assert pending == [(1, 9), (1, 8), (1, 7), (others[-1], 5)]


# -- 9 ------------------------------------------------------------------------------------------


def brute_classes(rows):
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    up = {i: i for i, _ in rows}
    pairs = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    for _ in range(len(pairs) + 1):
        before = dict(up)
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
        if up == before:
            break
    return sorted((i if i is not None else -1, len(s), up[i] if i is not None else -1) for i, s in sets)


def near_copies(rng):
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, rng.randrange(6, 150)).split()
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((n, " ".join(copy), "en", "a"))
            n += 1
    passage = words(rng, 60)
    return rows + [(n + i, passage + " " + words(rng, rng.randrange(25)), "en", "a") for i in range(40)]


@pytest.mark.parametrize("hub", [500_000, 4])
def test_ngram_join(spark, none, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(11)
    rows = [(i + 100, t, a, b) for i, t, a, b in near_copies(rng)] + odd_texts(rng)
    want = brute_classes([(i, t) for i, t, _, _ in rows])
    assert len({c for _, _, c in want}) < len(rows) - 50
    frame = docs_frame(spark, rows)
    for block in (250_000, 700):
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
        got = [(r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in ngramjoin.classes(frame).collect()]
        assert sorted(got) == want
    assert ngramjoin.classes(none).count() == 0


def test_ngram_join_splits_a_chained_cluster_by_its_lists(spark, monkeypatch):
    """Documents that a chain of rare shingles holds together, without a link between most of them."""
    rng = random.Random(19)
    monkeypatch.setattr(ngramjoin, "BLOCK", 300)
    shared = [words(rng, 9, 50_000) for _ in range(41)]
    rows = [(i, f"{shared[i]} {words(rng, 60, 50_000)} {shared[i + 1]}", "en", "a") for i in range(40)]
    rows += [(100 + i, t + " " + words(rng, 2), "en", "b") for i, t, _, _ in rows[::5]]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.classes(docs_frame(spark, rows)).collect()]
    want = brute_classes([(i, t) for i, t, _, _ in rows])
    assert sorted(got) == want and sum(i != c for i, _, c in want) == 8


def test_shared_counts_do_not_grow_with_copies_in_one_gathering(spark):
    """A shingle that all documents hold goes to its bucket once for each gathering."""
    run = ngramjoin._gather(5, 8, 80)
    rows = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(range(300), pa.int64()), pa.array([f"one two three four five six own{i}" for i in range(300)])], ["doc_id", "version", "text"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngramjoin.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 0})())
        out = [r for b in run(iter([rows])) for r in b.to_pylist()]
    assert sum(r["postings"] for r in out if r["kind"] == 1) == 300 + 2
    assert {r["met"] for r in out if r["kind"] == 0} == {2}


def test_ngram_join_links_copies_on_both_sides_of_the_small_size(spark):
    rows, n = [], 0
    for size in range(ngramjoin.SMALL - 14, ngramjoin.SMALL + 1):
        for more in (1, 4, 9, 14):
            base = [f"p{n}w{k}" for k in range(size + 4)]
            copy = base + [f"p{n}new{k}" for k in range(more)]
            rows += [(n, " ".join(base), "en", "a"), (n + 1, " ".join(copy), "en", "a")]
            n += 2
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.classes(docs_frame(spark, rows)).collect()]
    assert sorted(got) == brute_classes([(i, t) for i, t, _, _ in rows])


def test_divide_skip_connects_what_brute_force_connects():
    rng = np.random.default_rng(7)
    for _ in range(30):
        pool = np.unique(rng.integers(0, 2**60, 90).astype(np.uint64))
        sets = [np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False)) for _ in range(8)]
        for s in list(sets):
            for _ in range(4):
                sets.append(np.setdiff1d(s, rng.choice(s, len(s) // 8, replace=False)))
        def classes(pairs, n=len(sets)):
            up = list(range(n))
            for _ in range(n):
                for i, j in pairs:
                    up[i] = up[j] = min(up[i], up[j])
            return up
        every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert classes(ngramjoin.divide_skip(sets)) == classes(every)


def test_divide_skip_queries_again_when_another_group_becomes_the_largest():
    x, a_new, b_new, c_new = np.split(np.arange(160, dtype=np.uint64), [100, 124, 142])
    y = x[:82]
    sets = [np.sort(np.concatenate(s)) for s in ((x, a_new), (x,), (y,), (y, b_new), (y, c_new))]
    up = list(range(5))
    for _ in up:
        for i, j in ngramjoin.divide_skip(sets):
            up[i] = up[j] = min(up[i], up[j])
    assert up == [0] * 5


@pytest.mark.parametrize("hub", [500_000, 10])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)] + [(2040, i) for i in range(2001, 2080, 3)] + [(i, 3000) for i in range(2500, 2560)] + [(None, 3), (4, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {x: x for p in pairs if None not in p for x in p}
    for _ in range(len(pairs)):
        for a, b in pairs:
            if a is not None and b is not None:
                up[a] = up[b] = min(up[a], up[b])
    assert got == {i: c for i, c in up.items() if i in got} and {i for i, c in up.items() if i != c} <= set(got)


# -- 10 -----------------------------------------------------------------------------------------


def brute_top(rows, k=5):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_top_k(spark, monkeypatch):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS + ", id int, side int")
    stored = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    for candidates, queries in ((16_384, 1_024), (50, 3)):
        monkeypatch.setattr(topk, "CANDIDATES", candidates)
        monkeypatch.setattr(topk, "QUERIES", queries)
        assert sorted(map(tuple, topk.nearest(frame).collect())) == brute_top(stored)
    huge = spark.createDataFrame([(0, [1e6, 1.0], 1), (1, [1e6, 2.0], 1), (2, [1e6, 2.0], 1)], VECTORS)
    assert sorted(map(tuple, topk.nearest(huge).collect())) == brute_top([(r.vec_id, r.embedding, 1) for r in huge.collect()])
    assert topk.nearest(spark.createDataFrame([], VECTORS)).count() == 0


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(21)
    plain = [(i, t, lang, s) for i, t, lang, s in near_copies(rng)]
    rows = [(i, t, "en", rng.choice("abc")) for i, t, _, _ in plain] + [(9_000 + i, t, None, s) for i, t, _, s in odd_texts(rng) if i is not None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], schema)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, "")
        after = [tuple(r) for r in out.collect()]
        if n < 4:
            assert out.columns == docs.columns
        if n == 0:
            assert Counter(after) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))
        if n == 1:
            want = {(i, k): 1 for i, _, _, k in brute_lines([r[:2] for r in before])}
            assert all((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) in want and r[4] == len(r[1]) for r in after) and len(after) == len(before)
        if n == 2:
            once = {r[0]: r for r in sorted(before, reverse=True)}
            assert {r[0] for r in after} == {i for i, _, c in brute_classes([(i, r[1]) for i, r in once.items()]) if i == c} and len(after) == len({r[0] for r in after})
        if n == 3:
            plan = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(docs).collect()}
            assert Counter(r[0] for r in after) == Counter({i: k for i, k in plan.items() if k})
        if n == 4:
            assert Counter((r[0], r[3]) for r in after) == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in before)
        docs = spark.createDataFrame(after, schema) if n < 4 else None


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark):
    import corpus_pipeline

    rng = random.Random(22)
    extra = ["n_lines", "n_dropped", "kept", "_id", "_language", "_epoch", "_epochs", "_version", "version", "h", "id", "count", "r", "bucket", "label", "key", "a.b", "taken", "component_id"]
    rows = [(i, t, "en", rng.choice("ab"), len(t or "")) for i, t, _, _ in near_copies(rng)[:60]] + [(i, t, None, None, len(t or "")) for i, t, _, _ in odd_texts(rng)]
    rows = [r + tuple(f"{c} of {r[0]}" for c in extra) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    full, plain = spark.createDataFrame(rows, schema), "doc_id long, text string, lang string, source string, n_chars long"
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, full, "")
        got = out.collect()
        want = stage(spark, full.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
        empty = stage(spark, full.limit(0), "")
        assert empty.count() == 0 and empty.columns == out.columns
        if n == 4:
            assert sorted(map(str, got)) == sorted(map(str, want))
            break
        assert out.columns == full.columns and out.schema["n_chars"].dataType.simpleString() == "bigint"
        assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, map(tuple, want)))
        assert all(r[5 + i] == f"{c} of {r.doc_id}" for r in got for i, c in enumerate(extra))
    assert plain.count(",") == 4


def test_what_a_stage_writes_for_itself_goes(spark):
    from pathlib import Path

    with common.passing() as gone:
        first = common.written(spark.range(3), "first")
        kept = common.written(first.selectExpr("id + 1 as id"), "kept")
        gone.pop()
    paths = {df: common._paths.get(df) for df in (first, kept)}
    assert paths[first] is None and Path(paths[kept].removeprefix("file://")).exists() and kept.count() == 3
    common.discard(kept)
    common.discard(spark.range(1))
    assert not Path(paths[kept].removeprefix("file://")).exists()


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    session = type("S", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(ValueError):
        common.shared_dir(session)
