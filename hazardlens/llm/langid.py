"""Language ID by unigrams over the pieces of a fixed vocabulary, summed over all segmentations.

A language is a distribution over byte pieces. A word's probability is the sum, over every way to cut
it into pieces, of the product of their probabilities; one forward pass gives it, whatever the word's
length. A text's evidence is the sum over its words. Distributions are fitted by
expectation-maximisation on word counts of a bounded sample of labelled documents; whole texts are
scored.
"""

from __future__ import annotations

import base64
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

#: Places after which sums are scaled again, and bytes of a word that are worked on at once; the
#: sums at a stretch's end are carried into the next one.
SCALED, STRETCH = 32, 4_096
#: Cells (words times places) of one forward pass.
CELLS = 400_000
#: Factor a byte, so that products of piece probabilities stay near one.
LIFT = 24.0
#: Tokens and words that a worker remembers.
CACHE = 400_000
#: Marks at the ends of a token that is otherwise one word.
MARKS = ".,;:!?\"'()[]{}-"


def vocabulary(rank_path: str) -> list[bytes]:
    """All pieces of a public rank file, and every single byte."""
    with open(rank_path, "rb") as f:
        return sorted({base64.b64decode(line.split()[0]) for line in f if line.strip()} | {bytes([b]) for b in range(256)})


class Pieces:
    """A trie of pieces that is walked from every place of many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        node, steps, piece = {b"": 0}, [], [len(pieces)]
        for number, data in enumerate(pieces):
            at = 0
            for k in range(1, len(data) + 1):
                to = node.setdefault(data[:k], len(node))
                if to == len(piece):
                    piece.append(len(pieces))
                    steps.append(at << 8 | data[k - 1])
                at = to
            piece[at] = number
        self.piece = np.array(piece, np.int32)
        keys, child = np.array(steps, np.int64), np.arange(1, len(piece), dtype=np.int32)
        self.bits = max(4, len(keys).bit_length() + 1)
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # open addressing, all keys a probe further at a time
            at = (slot[left] + self.probes) & ((1 << self.bits) - 1)
            _, first = np.unique(at, return_index=True)
            won = first[self.keys[at[first]] < 0]
            self.keys[at[won]], self.to[at[won]] = keys[left[won]], child[left[won]]
            left = np.delete(left, won)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node after one more byte; 0 where no piece goes on so."""
        keys = node.astype(np.int64) << 8 | byte
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.to[slot], 0)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + k) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def cuts(self, words: list[bytes], upto: int | None = None) -> Cuts:
        """Where pieces stand in ``words``; with ``upto``, only those that start before that place."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        x = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        start = np.arange(len(x)) - begin[word]
        at = np.arange(len(x)) if upto is None else np.flatnonzero(start < upto)
        end, node = (begin + size)[word[at]], np.zeros(len(at), np.int32)
        found = []
        for k in range(1, self.longest + 1):
            node = self.step(node, x[at + k - 1])
            alive = node > 0
            at, end, node = at[alive], end[alive], node[alive]
            ids = self.piece[node]
            here = ids < self.n
            found.append((at[here], np.full(int(here.sum()), k), ids[here]))
            alive = at + k < end
            at, end, node = at[alive], end[alive], node[alive]
            if not len(at):
                break
        at, length, ids = (np.concatenate(c) for c in zip(*found, strict=True))
        return Cuts(word[at], start[at], length, ids, self.longest)


class Cuts:
    """Pieces in words: word, start, length and piece of each, ordered by start and length."""

    def __init__(self, word: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, longest: int):
        key = start * (longest + 1) + length
        by = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 65_536 else key, kind="stable")
        self.word, self.start, self.length, self.ids = word[by], start[by], length[by], ids[by]
        key = key[by]
        self.bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() + [len(key)] if len(key) else [0]

    def groups(self) -> list[tuple[int, int, slice]]:
        """(start, length, places in the arrays); a word is in each group once at most."""
        return [(int(self.start[a]), int(self.length[a]), slice(a, b)) for a, b in zip(self.bounds, self.bounds[1:], strict=False)]


def forward(cuts: Cuts, first: np.ndarray, places: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed probabilities of all segmentations up to each place, and logarithms of their scales.

    ``first`` holds the sums known at the first places (places, words, languages), ``value`` the
    probabilities of each cut. What stands at place i is to be scaled by ``scale[i // SCALED]``.
    """
    a = np.zeros((places + 1, *first.shape[1:]))
    a[: len(first)] = first[: places + 1]
    scale = np.zeros((places // SCALED + 1, *first.shape[1:]))
    done = 0
    for i, k, at in cuts.groups():
        while done < i // SCALED:
            done += 1
            _rescale(a, scale, done)
        rows = cuts.word[at]
        a[i + k][rows] += a[i][rows] * value[at]
    while done < places // SCALED:
        done += 1
        _rescale(a, scale, done)
    return a, scale


def _rescale(a: np.ndarray, scale: np.ndarray, block: int) -> None:
    ahead = a[block * SCALED :]
    most = ahead.max(0)
    most[most <= 0] = 1.0  # words that have ended
    ahead /= most
    scale[block] = scale[block - 1] + np.log(most)


def word_scores(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of every word in every language, over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    short = order[size[order] <= STRETCH]
    at = 0
    while at < len(short):
        n = len(short) - at
        while n > 1 and n * (size[short[at + n - 1]] + 1) > CELLS:
            n = max(1, min(n - 1, int(CELLS // (size[short[at + n - 1]] + 1))))
        part = short[at : at + n]
        places = int(size[part[-1]])
        cuts = pieces.cuts([words[w] for w in part])
        a, scale = forward(cuts, np.ones((1, n, p.shape[1])), places, p[cuts.ids])
        rows = np.arange(n)
        out[part] = np.log(a[size[part], rows]) + scale[size[part] // SCALED, rows]
        at += n
    for w in order[len(short) :]:
        data, carried, total = words[w], np.ones((1, 1, p.shape[1])), np.zeros(p.shape[1])
        for s in range(0, len(data), STRETCH):
            part = data[s : s + STRETCH + pieces.longest]
            cuts = pieces.cuts([part], STRETCH)
            a, scale = forward(cuts, carried, min(len(part), STRETCH + pieces.longest), p[cuts.ids])
            last = min(STRETCH, len(part))
            total += scale[last // SCALED, 0]
            # columns after the last place lie in later blocks of the scale, which start from it
            carried = a[last:] * np.exp(scale[np.arange(last, len(a)) // SCALED] - scale[last // SCALED])
            most = carried.max(0)
            carried, total = carried / most, total + np.log(most[0])
        out[w] = total + np.log(carried[0, 0])
    return out - size[:, None] * np.log(LIFT)


def lifted(prob: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Piece probabilities times LIFT a byte."""
    return prob * (LIFT ** lengths)[:, None]


def letter_runs(token: str) -> list[str]:
    """Lower-case runs of letters in a token."""
    if token.isalpha():
        return [token.lower()]
    bare = token.strip(MARKS)
    if bare.isalpha():
        return [bare.lower()]
    return _runs().findall(token.lower())


@cache
def _runs():
    import regex

    return regex.compile(r"\p{L}+")


def spaced(run: str) -> bytes:
    """A word's bytes with the space that starts it."""
    return b" " + run.encode()


class Model:
    """Languages, pieces and their probabilities; bounded by vocabulary times languages."""

    def __init__(self, langs: list[str], vocab: list[bytes], prob: np.ndarray):
        self.langs, self.vocab, self.prob, self.name = langs, vocab, prob, uuid.uuid4().hex

    def scorer(self) -> Scorer:
        """This worker's scorer, kept over all of its tasks."""
        return worker_memory(("langid", self.name), lambda: Scorer(self))


class Scorer:
    """A worker's side of a model: remembers what each token of a text is worth.

    Tokens of one word share the word's row of ``values``; the last column counts words.
    """

    def __init__(self, model: Model):
        self.langs, self.pieces = model.langs, Pieces(model.vocab)
        self.p = lifted(model.prob, np.array([len(v) for v in model.vocab]))
        self.known: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.values = np.zeros((4_096, len(self.langs) + 1))
        self.used, self.long = 0, []

    def _room(self, n: int) -> int:
        """Place of ``n`` new rows."""
        if self.used + n > len(self.values):
            more = np.zeros((max(self.used + n, 2 * len(self.values)), self.values.shape[1]))
            more[: self.used] = self.values[: self.used]
            self.values = more
        self.used += n
        return self.used - n

    def learn(self, tokens: set[str]) -> None:
        for t in self.long:
            self.known.pop(t, None)
            self.runs.pop(t.lower(), None)
        self.long = [t for t in tokens if len(t) > 256]
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(self.runs) + 2 * len(new) > CACHE:
            self.known.clear()
            self.runs.clear()
            self.used = 0
            new = list(tokens)
        split = [letter_runs(t) for t in new]
        runs = [r for r in dict.fromkeys(r for rs in split for r in rs) if r not in self.runs]
        at = self._room(len(runs))
        self.values[at : at + len(runs), :-1] = word_scores([spaced(r) for r in runs], self.pieces, self.p)
        self.values[at : at + len(runs), -1] = 1
        self.runs.update(zip(runs, range(at, at + len(runs)), strict=True))
        several = []
        for t, rs in zip(new, split, strict=True):
            if len(rs) == 1:
                self.known[t] = self.runs[rs[0]]
            else:
                several.append((t, [self.runs[r] for r in rs]))
        at = self._room(len(several))
        for n, (t, rows) in enumerate(several):
            self.values[at + n] = self.values[rows].sum(0)
            self.known[t] = at + n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and posteriors; ``und`` and 0 where there is no letter."""
        split = [(t or "").split() for t in texts]
        self.learn(set().union(*split) if split else set())
        langs, scores = [], []
        get = self.known.__getitem__
        for words in split:
            s = self.values[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            if not s[-1] or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            e = s[:-1]
            best = int(e.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(e - e[best]).sum()))
        return langs, scores


def train(docs: DataFrame, rank_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 8_000, rounds: int = 2) -> Model:
    """Fit a model on at most about ``max_docs`` documents that have a language and an id.

    The sample is by a hash of the id, alike at every size; runs of letters over STRETCH bytes are
    cut for the fit. Word counts, bounded by the sample, are gathered by Spark; each round of expectation-maximisation runs over their partitions, and only
    expected piece counts, bounded by vocabulary times languages, reach the driver. No labelled
    document gives a model without languages, by which every text is ``und``.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n = labelled.select("id").count()
    sample = labelled.where(hashed_share(F.xxhash64("id", F.lit("langid")), max_docs, n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter[tuple[str, bytes]] = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token, k in Counter((text or "").split()).items():
                    for r in map(spaced, letter_runs(token)):
                        for i in range(0, len(r), STRETCH):
                            c[lang, r[i : i + STRETCH]] += k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    words = written(sample.select("text", "lang").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    vocab = vocabulary(rank_path)
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    lengths = np.array([len(v) for v in vocab])
    prob = np.repeat((20.0 ** -lengths / (20.0 ** -lengths).sum())[:, None], len(langs), 1)
    trie = ("langid-pieces", uuid.uuid4().hex)  # built once a worker, for all tasks of all rounds
    for _ in range(rounds):
        p = lifted(prob, lengths)

        def expect(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            pieces, seen = worker_memory(trie, lambda: Pieces(vocab)), np.zeros((len(vocab), len(langs)))
            place = {lang: i for i, lang in enumerate(langs)}
            for batch in batches:
                lang = np.array([place[v] for v in batch.column(0).to_pylist()], np.int64)
                k = batch.column(2).to_numpy().astype(float)
                _expected(pieces, batch.column(1).to_pylist(), p, lang, k, seen)
            i, j = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(seen[i, j])], ["piece", "lang", "n"])

        found = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        seen = np.full((len(vocab), len(langs)), 0.0)
        seen[found.piece.to_numpy(), found.lang.to_numpy()] = found.n.to_numpy()
        # what no training word shows keeps a share, spread as the start was, so every text has a score
        floor = 20.0 ** -lengths / (20.0 ** -lengths).sum()
        prob = 0.98 * seen / np.maximum(seen.sum(0), 1e-9) + 0.02 * floor[:, None]
    return Model(langs, vocab, prob)


def _expected(pieces: Pieces, words: list[bytes], p: np.ndarray, lang: np.ndarray, k: np.ndarray, seen: np.ndarray) -> None:
    """Add the expected number of times each piece stands in ``words``, over all segmentations."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for at in range(0, len(order), 4_000):
        part = order[at : at + 4_000]
        while len(part):
            n = max(1, min(len(part), int(CELLS // (size[part[-1]] + 1))))
            some, part = part[len(part) - n :], part[: len(part) - n]
            ends, rows, places = size[some], np.arange(n), int(size[some].max())
            cuts = pieces.cuts([words[w] for w in some])
            value = p[cuts.ids, lang[some][cuts.word]]
            a, up = forward(cuts, np.ones((1, n)), places, value)
            # backward sums are forward sums of the reversed words
            back = Cuts(cuts.word, ends[cuts.word] - cuts.start - cuts.length, cuts.length, np.arange(len(cuts.ids)), pieces.longest)
            b, down = forward(back, np.ones((1, n)), places, value[back.ids])
            total = np.log(a[ends, rows]) + up[ends // SCALED, rows]
            left, w = ends[cuts.word] - cuts.start - cuts.length, cuts.word
            share = np.exp(up[cuts.start // SCALED, w] + down[left // SCALED, w] - total[w])
            np.add.at(seen, (cuts.ids, lang[some][w]), a[cuts.start, w] * value * b[left, w] * share * k[some][w])


def predicted(docs: DataFrame, model: Model, text: Column) -> Column:
    """A column ``struct<lang_pred, score>`` for the whole texts of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0. The score is the posterior of
    the language found, all languages being as likely beforehand, on the evidence of the whole text;
    repeated rows score alike, ties go to the first language by name. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = shared.value.scorer()
        for s in batches:
            texts, langs, scores, start, size = s.tolist(), [], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 2_000_000 or i == len(texts) - 1:
                    a, b = scorer.predict(texts[start : i + 1])
                    langs += a
                    scores += b
                    start, size = i + 1, 0
            yield pd.DataFrame({"lang_pred": langs, "score": np.array(scores, float)})

    return score.asNondeterministic()(text.cast("string"))


def identify(docs: DataFrame, rank_path: str, **fit) -> DataFrame:
    """Per document: held_out, lang_pred and score; learns from the documents not held out."""
    held = in_bucket("doc_id", 3, 1)
    model = train(docs.where(~held), rank_path, **fit)
    return docs.select("doc_id", held.alias("held_out"), predicted(docs, model, F.col("text")).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")
