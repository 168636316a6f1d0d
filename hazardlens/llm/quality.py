"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad, and what speaks for either are levels of what it is made of:
its length, kinds of characters, words that repeat, symbols that hang on words, lines that the text
repeats; and the same of the lines before and after it. Labels are of documents, so in the fit each
line has its document's. Exact forward-backward marginals of all lines of a whole text, weighted
with the lines' lengths, give how much of it is good, and that the document's score by logistic
regression. Models are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import sys
import unicodedata
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
from .toxicity import WINDOW, Chain, _logistic, together

#: Kinds of characters; marks are those of ordinary sentences.
SPACE, LOWER, UPPER, DIGIT, MARK, SYMBOL = range(6)
MARKS = ".,;:!?'\"()-"
#: Borders between levels of a share, of repeats, and of lengths (characters a line, letters a word).
SHARES = (0.001, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75, 0.95)
TIMES = (1.5, 2.5, 4.5, 8.5)
CHARACTERS = (0.5, 20, 50, 100, 200, 400, 800, 1_600, 6_400)
LETTERS = (0.5, 2, 3, 4, 5, 6, 8, 12, 20)
#: A line's levels, in the order of ``levels``, each of LEVEL_STEPS steps at most.
LEVELS, LEVEL_STEPS = 12, 10


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    first = {"L": LOWER, "M": LOWER, "N": DIGIT, "Z": SPACE, "C": SPACE}
    out = np.fromiter((UPPER if (c := unicodedata.category(chr(i))) in ("Lu", "Lt") else first.get(c[0], SYMBOL) for i in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1)
    out[[ord(c) for c in MARKS]] = MARK
    return out


def levels(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of texts one after another their levels, numbered apart, and lengths; and lines of each text.

    A null or empty text is one empty line.
    """
    split = [(t or "").split("\n") for t in texts]
    sizes = np.array([len(lines) for lines in split], np.int64)
    flat = [line for lines in split for line in lines]
    lengths = np.array([len(line) for line in flat], np.int64)
    # all lines one after another, each closed by a line end, so that none is empty
    code = np.frombuffer(("\n".join(flat) + "\n").encode("utf-32-le", "replace"), np.uint32) if flat else np.zeros(0, np.uint32)
    kind = worker_memory("character-kinds", _kinds)[code]
    of = np.repeat(np.arange(len(flat)), lengths + 1)
    n = len(flat)
    count = np.bincount(of * 6 + kind, minlength=6 * n).reshape(n, 6).astype(float)
    after = np.append(kind[1:], SPACE) if len(kind) else kind
    total = lambda hits: np.bincount(of[hits], minlength=n).astype(float)
    ends = (kind != SPACE) & (after == SPACE)
    wordy = (kind == LOWER) | (kind == UPPER) | (kind == DIGIT)
    words = total(ends)
    hanging = total((kind == SYMBOL) & ends)
    doubled = total((code == np.append(code[1:], 0)) & ((kind == SYMBOL) | (kind == MARK))) if len(code) else words
    alone = total((kind == SYMBOL) & np.append(True, kind[:-1] == SPACE) & (after == SPACE)) if len(code) else words
    distinct, again, twice = np.zeros(n), np.zeros(n), np.zeros(n)
    at = 0
    for lines in split:
        times = Counter(line.strip() for line in lines) if len(lines) > 1 else None
        for line in lines:
            w = line.split()
            distinct[at] = len(set(w))
            again[at] = sum(map(str.__eq__, w, w[1:]))
            twice[at] = times[line.strip()] if times and line.strip() else 1
            at += 1
    seen, letters = np.maximum(lengths, 1), count[:, LOWER] + count[:, UPPER]
    w = np.maximum(words, 1)
    shares = (count[:, DIGIT] / seen, count[:, MARK] / w, count[:, SYMBOL] / seen, count[:, UPPER] / np.maximum(letters, 1), hanging / w, doubled / w, alone / w, 1 - distinct / w, again / w)
    out = [np.digitize(s, SHARES) for s in shares]
    out += [np.digitize(lengths, CHARACTERS), np.digitize(total(wordy) / w, LETTERS), np.digitize(twice, TIMES)]
    return np.stack(out, 1) + np.arange(LEVELS) * LEVEL_STEPS, lengths, sizes


class Model:
    """Chain over lines and weights of the document's score."""

    def __init__(self):
        self.chain, self.weights = Chain(LEVELS * LEVEL_STEPS, LEVELS * LEVEL_STEPS, 0.0), np.array([0.0, 0.0])
        self.name = uuid.uuid4().hex

    def good(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good of every line, lengths of lines, and lines of each text."""
        feats, lengths, sizes = levels(texts)
        if not len(lengths):
            return np.zeros(0), lengths, sizes
        value = self.chain.values(feats)
        score = value[:, 0].copy()
        first = np.cumsum(sizes) - sizes
        inner = np.ones(len(score), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        score[at] += value[at - 1, 1]
        score[at - 1] += value[at, 2]
        return self.chain.marginals(score, sizes), lengths, sizes

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Share of each text that is good, by length (a line end counts to its line), and its lines' marginals."""
        p, lengths, sizes = self.good(texts)
        if not len(p):
            return np.zeros(0), []
        first = np.cumsum(sizes) - sizes
        weight = lengths + 1.0
        return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first), np.split(p, first[1:])

    def scores(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * share, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8_000, windows: int = 4_000, text_col: str = "text") -> Model:
    """Fit on at most about ``max_docs`` labelled documents, the chain on ``windows`` windows of WINDOW lines of them.

    Both are drawn by a hash; numbers alone, no texts, reach the driver. Conflicting labels of one
    document count as bad; documents without a label, an id or a text teach nothing. Without any
    labelled row all texts score one half.
    """
    given = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") >= 1).cast("int").alias("good"))
    chosen = given.where(hashed_share(F.xxhash64("doc_id", F.lit("quality")), max_docs, given.count())).select(F.col("doc_id").alias("_id"), "good")
    # bounded by max_docs
    sample = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sample = written(sample.select("text", "good", F.xxhash64("doc_id", F.lit("window")).alias("key")), "quality-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, states, keys = [], [], []
            for text, good, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                feats = levels([text])[0]
                for n in range(0, len(feats), WINDOW):
                    part = feats[n : n + WINDOW]
                    found.append(part.ravel().tolist())
                    states.append(good)
                    keys.append((key + n * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(states, pa.int32()), pa.array(keys, pa.int64())], ["feats", "good", "key"])

    few = sample.mapInArrow(cut, "feats array<int>, good int, key long").orderBy("key", "good", "feats").limit(windows).toPandas()
    model = Model()
    if len(few):
        rows = [np.array(f).reshape(-1, LEVELS) for f in few.feats]
        feats, number = np.unique(np.vstack(rows), axis=0, return_inverse=True)
        lines, good, at = np.full((len(rows), WINDOW), -1), np.zeros((len(rows), WINDOW), int), 0
        for n, (r, g) in enumerate(zip(rows, few.good, strict=True)):
            lines[n, : len(r)], good[n, : len(r)] = number.ravel()[at : at + len(r)], g
            at += len(r)
        model.chain.fit(lines, feats, good)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.shares(part)[0] for part in together(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.concatenate(parts or [[]]), pa.float64())], ["good", "share"])

    # two numbers for each row of the sample
    fit = sample.select("text", "good").mapInArrow(share, "good int, share double").toPandas()
    if len(fit):
        model.weights = _logistic(np.stack([np.ones(len(fit)), fit.share], 1), fit.good.to_numpy(float))
    return model


def line_quality(docs: DataFrame, model: Model, text: Column) -> Column:
    """A column ``struct<score, lines>`` for whole texts: the document's score and every line's probability of good.

    Null and empty texts are one empty line; repeated rows score alike. Texts of any length and with any
    number of lines are scored whole. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, lines array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for s in batches:
            scores, lines = [np.empty(0)], []
            for part in together(s.tolist()):
                share, marginals = model.shares(part)
                scores.append(model.scores(share))
                lines += marginals
            yield pd.DataFrame({"score": np.concatenate(scores), "lines": pd.Series(lines, dtype=object)})

    return score.asNondeterministic()(text.cast("string"))


def judge(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """Per document: held_out, score, predicted and every line's probability of good.

    A null ``doc_id`` is held out; rows that repeat an id are scored each; other columns aren't read.
    """
    held = in_bucket("doc_id", 5, 0)
    model = train(docs.where(~held), labels, **fit)
    out = docs.select("doc_id", held.alias("held_out"), line_quality(docs, model, F.col("text")).alias("r"))
    return out.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.3).cast("int").alias("predicted"), "r.lines")
