"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Document labels become token labels through a lexicon: words and word beginnings that labelled toxic
documents hold far more often than others; a token is labelled toxic where its document is and the
lexicon holds it. A chain with two states, clean and toxic, is fitted to these tokens: what speaks
for toxic at a token are its lexicon strength, its word, beginnings and ends, and those of the tokens
before and after it. Forward-backward marginals over whole texts give offending spans; how many
toxic tokens a document is expected to hold, and how sure the surest is, give its score by logistic
regression. Models are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, in_bucket, worker_memory, written

#: Lexicon strength runs from 0 (not in it) to LEVELS - 1.
LEVELS = 4
#: Beginnings of words that count as lexicon entries, in letters.
BEGINNINGS = (3, 4, 5, 6)
#: Places for hashed features, and features of a token: its strength, word, two beginnings, two ends.
PLACES, FEATURES = 1 << 14, 6
#: Tokens of a window that the chain is fitted on, and of a stretch that is worked on side by side.
WINDOW, STRETCH = 64, 32
#: Marginal from which a token counts as evidence for its document, and as part of a span.
EVIDENCE, SPAN = 0.05, 0.5
#: Tokens that a worker remembers, and characters of the texts scored at once.
CACHE, TOGETHER = 200_000, 1_000_000
#: Marks at the ends of a token that is otherwise one word.
MARKS = ".,;:!?\"'()[]{}-"


@cache
def _runs():
    import regex

    return regex.compile(r"\p{L}+")


def words(token: str) -> list[str]:
    """Lower-case runs of letters in a token."""
    bare = token if token.isalpha() else token.strip(MARKS)
    return [bare.lower()] if bare.isalpha() else _runs().findall(token.lower())


def units(token: str) -> list[str]:
    """A token's words and their beginnings, these marked by a star."""
    out = words(token)
    return out + [w[:n] + "*" for w in out for n in BEGINNINGS if len(w) > n]


def features(token: str, strength: int) -> list[int]:
    """Places of a token's features: its strength, and hashes of what its longest word looks like."""
    import xxhash

    w = max(words(token), key=len, default="")
    if not w:
        return [strength] * FEATURES
    seen = (w, w[:3] + "*", w[:4] + "*", "*" + w[-3:], "*" + w[-4:])
    return [strength] + [LEVELS + xxhash.xxh3_64_intdigest(f) % PLACES for f in seen]


class Chain:
    """Weights of the two-state chain: what speaks for toxic at a token, and how states follow.

    ``weights`` has a row each for a token's own features, those of the one before, and after.
    """

    def __init__(self, places: int = LEVELS + PLACES, light: int = LEVELS, start: float = -3.0):
        self.weights, self.step, self.light = np.zeros((3, places)), np.zeros((2, 2)), light
        self.weights[0, :light] = start  # by default clean until the fit says otherwise

    def values(self, feats: np.ndarray) -> np.ndarray:
        """What tokens (rows of features) are worth: at their place, to the next and the previous token."""
        return self.weights[:, feats].sum(2).T

    def fit(self, tokens: np.ndarray, feats: np.ndarray, toxic: np.ndarray, rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Chain:
        """Gradient ascent on the mean log-likelihood of windows.

        ``tokens`` (windows by WINDOW) are numbers of rows of ``feats``, -1 after a text's end;
        ``toxic`` are the states of the tokens.
        """
        n, own, kinds = len(tokens), tokens, len(feats)
        there = own >= 0
        nothing = np.full((n, 1), -1)
        around = (own, np.concatenate([nothing, own[:, :-1]], 1), np.concatenate([own[:, 1:], nothing], 1))
        around = tuple(np.where(there & (a >= 0), a, kinds) for a in around)
        toxic = toxic * there
        both = there[:, 1:]
        steps = np.zeros((2, 2))
        np.add.at(steps, (toxic[:, :-1][both], toxic[:, 1:][both]), 1)
        speed, speed_steps = np.zeros_like(self.weights), np.zeros((2, 2))
        strict = np.full(self.weights.shape[1], 10 * decay)  # a word alone must not outweigh the lexicon
        strict[: self.light] = decay
        for _ in range(rounds):
            value = np.vstack([self.values(feats), np.zeros(3)])
            score = value[around[0], 0] + value[around[1], 1] + value[around[2], 2]
            node, edge = self.window_marginals(score, there)
            slope = np.zeros_like(self.weights)
            for row, a in enumerate(around):
                off = np.bincount(a.ravel(), ((toxic - node) * there).ravel(), kinds + 1)[:kinds]
                slope[row] = np.bincount(feats.ravel(), np.repeat(off, feats.shape[1]), slope.shape[1])
            for w, v, g in ((self.weights, speed, slope / n - strict * self.weights), (self.step, speed_steps, (steps - edge) / n - decay * self.step)):
                v *= 0.9
                v += g * g * 0.1
                w += rate * g / (np.sqrt(v) + 1e-4)
            rate *= 0.98
        return self

    def window_marginals(self, score: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of toxic at each token of windows, and summed probabilities of neighbouring states."""
        e, there = np.exp(np.clip(score.T, -30, 30)), there.T  # a row a place
        a = np.exp(np.clip(self.step, -30, 30))
        f, b = np.empty((2, *e.shape)), np.ones((2, *e.shape))
        f[1, 0] = e[0] / (1 + e[0])
        f[0, 0] = 1 - f[1, 0]
        for i in range(1, len(e)):
            good, bad = f[0, i - 1] * a[0, 0] + f[1, i - 1] * a[1, 0], (f[0, i - 1] * a[0, 1] + f[1, i - 1] * a[1, 1]) * e[i]
            f[1, i] = bad / (good + bad)
            f[0, i] = 1 - f[1, i]
        for i in range(len(e) - 2, -1, -1):
            good, bad = b[0, i + 1], e[i + 1] * b[1, i + 1]
            good, bad = a[0, 0] * good + a[0, 1] * bad, a[1, 0] * good + a[1, 1] * bad
            b[0, i] = np.where(there[i + 1], good / (good + bad), 0.5)
            b[1, i] = 1 - b[0, i]
        toxic = f[1] * b[1] / (f[0] * b[0] + f[1] * b[1])
        after = (b[0, 1:], e[1:] * b[1, 1:])
        pair = np.array([[f[x, :-1] * a[x, y] * after[y] for y in range(2)] for x in range(2)])
        return toxic.T, (pair / pair.sum((0, 1)) * there[1:]).sum((2, 3))

    def marginals(self, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of toxic at every token of texts that stand one after another.

        A token is a two-by-two matrix that takes the message before it to the one after it. Texts
        are cut into stretches; products of their matrices carry messages over whole stretches, and
        then all stretches are gone through side by side. This is the exact forward-backward pass.
        """
        if not len(score):
            return score
        sizes = sizes[sizes > 0]
        pieces = -(-sizes // STRETCH)
        first = np.cumsum(pieces) - pieces  # of each text, its first stretch
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(score)) - (np.cumsum(sizes) - sizes)[text]
        where = (first[text] + inside // STRETCH, inside % STRETCH)
        a = np.exp(np.clip(self.step, -30, 30))
        e = np.exp(np.clip(score, -30, 30))
        m = np.zeros((4, int(pieces.sum()), STRETCH))  # entries 00, 01, 10, 11; places after a text's end change nothing
        m[0] = m[3] = 1.0
        begins = inside == 0
        for entry, v in enumerate((np.where(begins, 1.0, a[0, 0]), np.where(begins, 0.0, a[0, 1]) * e, np.where(begins, 0.0, a[1, 0]), np.where(begins, 1.0, a[1, 1]) * e)):
            m[entry][where] = v
        m = np.ascontiguousarray(m.transpose(2, 0, 1))
        whole = m[0]
        for t in range(1, STRETCH):
            whole = np.stack([whole[0] * m[t, 0] + whole[1] * m[t, 2], whole[0] * m[t, 1] + whole[1] * m[t, 3], whole[2] * m[t, 0] + whole[3] * m[t, 2], whole[2] * m[t, 1] + whole[3] * m[t, 3]])
            whole /= whole.sum(0)
        into, back = np.full((2, whole.shape[1]), 0.5), np.full((2, whole.shape[1]), 0.5)
        for j in range(1, int(pieces.max())):
            at = first[pieces > j] + j
            p = whole[:, at - 1]
            v = np.stack([into[0, at - 1] * p[0] + into[1, at - 1] * p[2], into[0, at - 1] * p[1] + into[1, at - 1] * p[3]])
            into[:, at] = v / v.sum(0)
        for j in range(int(pieces.max()) - 2, -1, -1):
            at = first[pieces > j + 1] + j
            p = whole[:, at + 1]
            v = np.stack([p[0] * back[0, at + 1] + p[1] * back[1, at + 1], p[2] * back[0, at + 1] + p[3] * back[1, at + 1]])
            back[:, at] = v / v.sum(0)
        f = np.zeros((STRETCH, 2, whole.shape[1]))
        for t in range(STRETCH):
            f[t] = np.stack([into[0] * m[t, 0] + into[1] * m[t, 2], into[0] * m[t, 1] + into[1] * m[t, 3]])
            f[t] /= f[t].sum(0)
            into = f[t]
        toxic = np.zeros((STRETCH, whole.shape[1]))
        for t in range(STRETCH - 1, -1, -1):
            good, bad = f[t, 0] * back[0], f[t, 1] * back[1]
            toxic[t] = bad / (good + bad)
            back = np.stack([m[t, 0] * back[0] + m[t, 1] * back[1], m[t, 2] * back[0] + m[t, 3] * back[1]])
            back /= back.sum(0)
        return toxic[where[1], where[0]]


class Model:
    """Lexicon, chain and document weights; bounded by the sample they are fitted on."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.chain, self.weights = lexicon, Chain(), np.array([-20.0, 0.0, 0.0])
        self.name = uuid.uuid4().hex

    def strength(self, token: str) -> int:
        get = self.lexicon.get
        return max([get(u, 0) for u in units(token)], default=0)

    def tokens(self) -> Tokens:
        """This worker's memory of what tokens are worth, kept over all of its tasks."""
        return worker_memory(("toxicity", self.name), lambda: Tokens(self))

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
        """Of each text: toxic tokens to expect, the surest, and all marginals where a span is sure."""
        split = [(t or "").split() for t in texts]
        value, sizes = self.tokens().values(split), np.array([len(w) for w in split], np.int64)
        score = value[:, 0].copy()
        begin = np.cumsum(sizes) - sizes
        if len(score):
            inner = np.ones(len(score), bool)
            inner[begin[sizes > 0]] = False
            at = np.flatnonzero(inner)
            score[at] += value[at - 1, 1]
            score[at - 1] += value[at, 2]
        p = self.chain.marginals(score, sizes)
        some = sizes > 0
        expected, surest = np.zeros(len(texts)), np.zeros(len(texts))
        if some.any():
            expected[some] = np.add.reduceat(np.where(p >= EVIDENCE, p, 0.0), begin[some])
            surest[some] = np.maximum.reduceat(p, begin[some])
        return expected, surest, [p[a : a + n] if s >= SPAN else None for a, n, s in zip(begin, sizes, surest, strict=True)]

    def scores(self, expected: np.ndarray, surest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * np.log1p(expected) + self.weights[2] * surest, -30, 30)))


class Tokens:
    """What each token adds to the chain's score of itself, the next and the previous token."""

    def __init__(self, model: Model):
        self.model, self.known, self.used, self.long = model, {}, 0, []
        self.rows = np.zeros((CACHE, 3))

    def values(self, split: list[list[str]]) -> np.ndarray:
        for t in self.long:
            self.known.pop(t, None)
        every = set().union(*split) if split else set()
        self.long = [t for t in every if len(t) > 256]
        new = [t for t in every if t not in self.known]
        if self.used + len(new) > len(self.rows):
            self.known, self.used, new = {}, 0, list(every)
            if len(new) > len(self.rows):
                self.rows = np.zeros((2 * len(new), 3))
        if new:
            at, self.used = self.used, self.used + len(new)
            feats = np.array([features(t, self.model.strength(t)) for t in new])
            self.rows[at : self.used] = self.model.chain.values(feats)
            self.known.update(zip(new, range(at, self.used), strict=True))
        get = self.known.__getitem__
        return self.rows[np.fromiter((i for words in split for i in map(get, words)), np.int64, sum(map(len, split)))]


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.05) -> np.ndarray:
    """Newton steps for ridge logistic regression; the constant is barely held."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [decay] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge @ w), -5, 5)
    return w


def _signature(text: str) -> int:
    """Least hash of a text's runs of five words: near copies nearly always have it in common."""
    import xxhash

    words = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 10_000, chain_docs: int = 2_000, windows: int = 4_000, text_col: str = "text") -> Model:
    """Fit on at most about ``max_docs`` labelled documents, the chain on ``chain_docs`` of them.

    The sample is by a hash of doc_id; of near copies in it one is used, since copies of one toxic
    text would make all of its words look toxic. The chain sees ``windows`` windows at most, as
    numbers of features: no text of the sample reaches the driver. Of windows without a word of the
    lexicon it sees one in eight.
    Conflicting labels of one document count as toxic; documents
    without a label, an id or a text teach nothing. Lexicon counts are gathered by Spark.
    """
    given = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = given.count()
    chosen = given.where(hashed_share(F.xxhash64("doc_id", F.lit("toxic")), max_docs, n)).select(F.col("doc_id").alias("_id"), (F.col("toxic") >= 1).cast("int").alias("toxic"))
    # bounded by max_docs
    sample = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    @F.pandas_udf("long")
    def signature(text: pd.Series) -> pd.Series:
        return text.map(_signature)

    once = sample.withColumn("signature", signature("text")).groupBy("signature").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("r"))
    sample = written(once.select("r.*"), "toxic-sample")
    total, bad = (lambda r: (r[0], r[1] or 0))(sample.agg(F.count("*"), F.sum("toxic")).first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((u, toxic) for u in {u for t in set(text.split()) for u in units(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([v if k[1] else 0 for k, v in seen.items()], pa.int64()), pa.array([0 if k[1] else v for k, v in seen.items()], pa.int64())], ["unit", "bad", "good"])

    tally = sample.select("text", "toxic").mapInArrow(count, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (total - bad + 1.0))
    strong = tally.withColumn("odds", odds).where((F.col("bad") >= max(3, bad // 200)) & (F.col("bad") > 4 * F.col("good")) & (F.col("odds") > 3.0))
    # bounded by the sample's words
    model = Model({r.unit: 1 + (r.odds > 4.0) + (r.odds > 5.0) for r in strong.collect()})
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            found, states, chosen = [], [], []
            for text, toxic, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                split = text.split()
                for i in range(0, len(split), WINDOW):
                    part = split[i : i + WINDOW]
                    for t in part:
                        if t not in known:
                            known[t] = features(t, lexicon.value.strength(t))
                    rows = [known[t] for t in part]
                    # all windows with lexicon words, an eighth of the rest
                    if any(r[0] for r in rows) or i % (8 * WINDOW) == 0:
                        found.append([f for r in rows for f in r])
                        states.append([int(toxic and r[0] > 0) for r in rows])
                        chosen.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(states, pa.list_(pa.int8())), pa.array(chosen, pa.int64())], ["feats", "states", "key"])

    few = sample.orderBy(F.xxhash64("doc_id")).limit(chain_docs).select("text", "toxic", F.xxhash64("doc_id").alias("key"))
    few = few.mapInArrow(cut, "feats array<int>, states array<byte>, key long").orderBy("key").limit(windows).toPandas()
    if len(few):
        rows = [np.array(f).reshape(-1, FEATURES) for f in few.feats]
        feats, number = np.unique(np.vstack(rows), axis=0, return_inverse=True)
        tokens, toxic = np.full((len(rows), WINDOW), -1), np.zeros((len(rows), WINDOW), int)
        at = 0
        for n, (r, t) in enumerate(zip(rows, few.states, strict=True)):
            tokens[n, : len(r)], toxic[n, : len(r)] = number.ravel()[at : at + len(r)], t
            at += len(r)
        model.chain.fit(tokens, feats, toxic)
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.evidence(part)[:2] for part in together(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(np.concatenate([p[i] for p in parts] or [[]]), pa.float64()) for i in range(2))], ["toxic", "expected", "surest"])

    # three numbers for each row of the sample
    fit = sample.select("text", "toxic").mapInArrow(evidence, "toxic int, expected double, surest double").toPandas()
    if len(fit):
        x = np.stack([np.ones(len(fit)), np.log1p(fit.expected), fit.surest], 1)
        model.weights = _logistic(x, fit.toxic.to_numpy(float))
    return model


def together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in parts of TOGETHER characters, or of one longer text."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > TOGETHER:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def toxic_spans(docs: DataFrame, model: Model, text: Column) -> Column:
    """A column ``struct<score, spans>`` for whole texts: spans are code-point offsets with probability.

    Null and empty texts get the score of texts without a sign of toxicity; repeated rows score alike,
    and equal scores stay as they are. Texts of any length are scored whole. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for s in batches:
            scores, spans = [np.empty(0)], []
            for part in together(s.tolist()):
                expected, surest, marginals = model.evidence(part)
                scores.append(model.scores(expected, surest))
                for t, p in zip(part, marginals, strict=True):
                    spans.append([] if p is None else [{"start": m.start(), "end": m.end(), "p": float(p[n])} for n, m in enumerate(re.finditer(r"\S+", t)) if p[n] >= SPAN])
            yield pd.DataFrame({"score": np.concatenate(scores), "spans": pd.Series(spans, dtype=object)})

    return score.asNondeterministic()(text.cast("string"))


def tag(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """Per document: held_out, score, predicted and offending spans."""
    held = in_bucket("doc_id", 4, 2)
    model = train(docs.where(~held), labels, **fit)
    out = docs.select("doc_id", held.alias("held_out"), toxic_spans(docs, model, F.col("text")).alias("r"))
    return out.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.3).cast("int").alias("predicted"), "r.spans")
