"""Exact ranked lexical search by sparse ball trees.

A document is the sparse vector of what each of its terms adds to a score, an item a vector of ones,
and the score their inner product. Items are a stated query set and are worked on in blocks of a
bounded number of terms; a block reads the documents once, and only terms of the block are kept.
Documents are ranged by their two heaviest terms, so that those alike lie together, and every few
thousand of them become a ball tree: nodes with a centroid and a radius. An inner product with a node
is at most that with its centroid plus the item's norm times the radius; both are rounded upwards.
Trees are searched best-first, subtrees below the best scores so far are left out, and documents in
leaves are scored in whole numbers. Scores to beat come first from a bounded sample of documents; it
decides nothing but how much is left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_share, passing, written

#: What isn't part of a term, and where a document's length has no effect, in percent.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH_SHARE = 50
#: Results of an item, terms of a block of items, documents of a partition and of the sample.
BEST, BLOCK_TERMS, PARTITION, SAMPLE = 50, 65_536, 8_192, 8_192
#: Documents and postings of a tree at most (or one document), and documents of a leaf.
TREE, POSTINGS, LEAF = 2_048, 1 << 20, 48
#: What a bound is raised by, beyond any rounding of its sums.
SAFE = 1e-9

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, A-Z lower-cased, in their order."""
    return text.translate(_FOLD).split()


@dataclass
class Items:
    """A block of items: its vocabulary, and each item's terms as numbers."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)
    asked: list[list[int]] = field(default_factory=list)
    size: int = 0

    def add(self, item: int, terms: list[bytes]) -> None:
        self.ids.append(item)
        self.asked.append([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms])
        self.size += len(terms)


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Items]:
    """Items in blocks of at most ``most`` terms, or of one item with more."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), letters, letters.lower()), F.lit(TERM), 0)
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct().orderBy("item_id", "term")
    block = Items()
    for item, of_item in groupby(rows.toLocalIterator(), key=lambda r: r.item_id):
        asked = [r.term.encode() for r in of_item]
        if block.ids and block.size + len(asked) > most:
            yield block
            block = Items()
        block.add(item, asked)
    if block.ids:
        yield block


@dataclass
class Searched:
    """What a task needs to know: the block's items, weights of terms, the corpus, scores to beat."""

    items: Items
    weights: np.ndarray
    documents: int
    length: int
    floors: np.ndarray

    def worth(self, n: list[int], sizes: np.ndarray, idx: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each posting adds to the score of an item that asks for its term."""
        share = 100 - LENGTH_SHARE
        m = np.array([share + LENGTH_SHARE * k * self.documents // self.length for k in n], np.int64)
        return self.weights[idx] * ((1_000_000_000 * tf) // (1_000 * tf + 20 * np.repeat(m, sizes)))


class BallTree:
    """Documents as sparse vectors in a binary tree of balls; leaves hold them one after another."""

    def __init__(self, sizes: np.ndarray, idx: np.ndarray, val: np.ndarray, width: int, leaf: int = LEAF):
        self.width = width
        starts = np.cumsum(sizes) - sizes
        x = val.astype(float)
        square = np.add.reduceat(x * x, starts)
        slack = 4e-16 * (width + 8) * 4  # of sums over all dimensions, relative to squared norms
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self.parent: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        order: list[np.ndarray] = []
        placed = 0
        todo = [(np.arange(len(sizes)), -1)]
        while todo:
            rows, up = todo.pop()
            at = np.repeat(starts[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows]) + np.arange(sizes[rows].sum())
            first, i, v = np.cumsum(sizes[rows]) - sizes[rows], idx[at], x[at]
            center = np.bincount(i, v, width) / len(rows)
            own = float(center @ center)
            away = np.maximum(square[rows] - 2 * np.add.reduceat(v * center[i], first) + own, 0.0)
            most = square[rows].max() + own
            me = len(self.radii)
            self.centers.append(center)
            self.radii.append(math.sqrt(away.max() + slack * most))
            self.parent.append(up)
            self.children.append(None)
            if up >= 0:
                self.children[up] = (*(self.children[up] or ()), me)
            if len(rows) <= leaf or away.max() <= slack * most:
                self.span.append((placed, placed + len(rows)))
                placed += len(rows)
                order.append(rows)
                continue
            self.span.append((-1, -1))
            a = self._dense(int(np.argmax(away)), first, sizes[rows], i, v)
            to_a = square[rows] - 2 * np.add.reduceat(v * a[i], first)
            b = self._dense(int(np.argmax(to_a)), first, sizes[rows], i, v)
            side = np.argsort(np.add.reduceat(v * (a - b)[i], first), kind="stable")
            todo += [(rows[side[: len(rows) // 2]], me), (rows[side[len(rows) // 2 :]], me)]
        self.order = np.concatenate(order)
        at = np.repeat(starts[self.order] - (np.cumsum(sizes[self.order]) - sizes[self.order]), sizes[self.order]) + np.arange(sizes.sum())
        self.sizes, self.idx, self.val = sizes[self.order], idx[at], val[at]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def _dense(self, row: int, first: np.ndarray, sizes: np.ndarray, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        part = slice(first[row], first[row] + sizes[row])
        out[i[part]] = v[part]
        return out

    def bounds(self, asked: list[list[int]]) -> np.ndarray:
        """At least the largest inner product of every node (row) with every item (column)."""
        flat = np.array([t for q in asked for t in q])
        begin = np.cumsum([0] + [len(q) for q in asked[:-1]])
        norms = np.sqrt([float(len(q)) for q in asked])
        out = np.array([np.add.reduceat(c[flat], begin) for c in self.centers]) + np.array(self.radii)[:, None] * norms
        out = out * (1 + SAFE) + 1
        for n, up in enumerate(self.parent):
            if up >= 0:
                np.minimum(out[n], out[up], out[n])
        return out

    def leaf_scores(self, leaf: int, hit: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's documents; ``hit`` is 1 at the item's terms, else 0."""
        a, b = self.span[leaf]
        part = slice(self.starts[a], self.starts[b])
        return np.add.reduceat(self.val[part] * hit[self.idx[part]], self.starts[a:b] - self.starts[a])


class Best:
    """The best documents of every item so far; equal scores go to the smaller id, null ids come last."""

    def __init__(self, searched: Searched, k: int):
        self.searched, self.k = searched, k
        self.found: list[list[tuple]] = [[] for _ in searched.items.ids]
        self.floors = np.maximum(searched.floors, 1)
        self.scored = 0

    def search(self, tree: BallTree, ids: list[int | None]) -> None:
        """Every item through one tree, best node first."""
        items = self.searched.items
        bound = tree.bounds(items.asked)
        hit = np.zeros(tree.width, np.int64)
        for q in np.flatnonzero(bound[0] >= self.floors).tolist():
            hit[items.asked[q]] = 1
            mine = bound[:, q]
            heap = [(-mine[0], 0)]
            while heap:
                most, node = heapq.heappop(heap)
                if -most < self.floors[q]:
                    break
                if kids := tree.children[node]:
                    for kid in kids:
                        if mine[kid] >= self.floors[q]:
                            heapq.heappush(heap, (-mine[kid], kid))
                    continue
                score = tree.leaf_scores(node, hit)
                self.scored += len(score)
                for n in np.flatnonzero(score >= self.floors[q]).tolist():
                    self.take(q, int(score[n]), ids[tree.order[tree.span[node][0] + n]])
            hit[items.asked[q]] = 0

    def take(self, q: int, score: int, doc: int | None) -> None:
        mine, entry = self.found[q], (score, doc is not None, -(doc or 0))
        if len(mine) < self.k:
            heapq.heappush(mine, entry)
        else:
            heapq.heappushpop(mine, entry)
        if len(mine) == self.k:
            self.floors[q] = max(self.floors[q], mine[0][0])


def postings(docs: DataFrame, items: Items) -> DataFrame:
    """``(doc_id, docs, n, idx, tf)``: a document's terms that the block asks for, and how many it has in all.

    Documents with none of them are summed up in one row a batch: only their number and length count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            ids, lengths, idx, tf = [], [], [], []
            others = total = 0
            for row, text in enumerate(b.column(1).cast(pa.binary())):
                words = terms(text.as_py() or b"")
                seen = Counter(map(get, words))
                seen.pop(None, None)
                if seen:
                    ids.append(row)
                    lengths.append(len(words))
                    idx.append(list(seen))
                    tf.append(list(seen.values()))
                elif words:
                    others += 1
                    total += len(words)
            doc = pa.concat_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array([None], pa.int64())])
            columns = [doc, pa.array([1] * len(ids) + [others], pa.int64()), pa.array([*lengths, total], pa.int64()), pa.array([*idx, []], pa.list_(pa.int32())), pa.array([*tf, []], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "docs", "n", "idx", "tf"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(count, "doc_id long, docs long, n long, idx array<int>, tf array<long>")


def _arrays(b: pa.RecordBatch) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (doc_id, n, idx, tf): lengths, sizes of rows, and their postings one after another."""
    sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return b.column(1).to_pylist(), sizes, b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()


def search(rows: DataFrame, searched: Searched, k: int) -> DataFrame:
    """``(item_id, doc_id, score)``: each partition's best ``k`` rows of ``(doc_id, n, idx, tf)`` for every item."""
    shared = rows.sparkSession.sparkContext.broadcast(searched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        best, width = Best(s, k), len(s.weights)
        for b in batches:
            n, sizes, idx, tf = _arrays(b)
            if not len(n):
                continue
            val, ids = s.worth(n, sizes, idx, tf), b.column(0).to_pylist()
            ends = np.cumsum(sizes)
            at = 0
            while at < len(n):  # a tree's documents, cut by number and by postings
                base = ends[at] - sizes[at]
                to = min(at + TREE, max(at + 1, int(np.searchsorted(ends, base + POSTINGS, "right"))))
                part = slice(base, ends[to - 1])
                best.search(BallTree(sizes[at:to], idx[part], val[part], width), ids[at:to])
                at = to
        out = [(s.items.ids[q], None if not there else -minus, score) for q, mine in enumerate(best.found) for score, there, minus in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    return rows.select("doc_id", "n", "idx", "tf").mapInArrow(run, "item_id long, doc_id long, score long")


def _alike(rows: DataFrame, searched: Searched) -> DataFrame:
    """Rows with the numbers of their two heaviest terms, as ``h1, h2``."""
    shared = rows.sparkSession.sparkContext.broadcast(searched)

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sizes, idx, tf = _arrays(b)
            val = shared.value.worth(n, sizes, idx, tf)
            by = np.lexsort((idx, -val, np.repeat(np.arange(len(n)), sizes)))
            first = np.cumsum(sizes) - sizes
            second = np.minimum(first + 1, np.cumsum(sizes) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(idx[by[p]].astype(np.int32)) for p in (first, second))], [*b.schema.names, "h1", "h2"])

    return rows.mapInArrow(heaviest, "doc_id long, n long, idx array<int>, tf array<long>, h1 int, h2 int")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rank_block(docs: DataFrame, items: Items, k: int = BEST) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of one block of items against all documents."""
    spark = docs.sparkSession
    held = written(postings(docs, items), "postings")
    total, length, rows = held.agg(F.sum("docs"), F.sum("n"), F.count_if(F.size("idx") > 0)).first()
    if not rows:
        return _ranked(spark.createDataFrame([], "item_id long, doc_id long, score long"), k)
    rows_of = held.where(F.size("idx") > 0).select("doc_id", "n", "idx", "tf")
    weights = np.zeros(len(items.vocabulary), np.int64)
    for term, df in rows_of.select(F.explode("idx").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    searched = Searched(items, weights, total, length, np.zeros(len(items.ids), np.int64))
    sample = rows_of.where(hashed_share(F.xxhash64("doc_id", F.lit("lexical")), SAMPLE, rows))
    place = {item: q for q, item in enumerate(items.ids)}
    for r in _ranked(search(sample, searched, k), k).where(F.col("rank") == k).select("item_id", "score").collect():  # a row an item of the block
        searched.floors[place[r.item_id]] = r.score
    dealt = _alike(rows_of, searched).repartitionByRange(max(1, -(-rows // PARTITION)), "h1", "h2", F.xxhash64("doc_id")).sortWithinPartitions("h1", "h2")
    return _ranked(search(dealt, searched, k), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item with a score above 0.

    Rows of ``items`` that repeat an ``item_id`` are one item with the terms of all; those without an id
    are left out, and so are items without a term that some document holds. Each row of ``docs`` is a
    document, also where ids repeat or are null (these come last among equal scores); null and empty
    texts have no terms and count for nothing. Texts are read whole. No rows on either side give no
    rows; columns of other names aren't read.
    """
    with passing() as made:
        out = [written(rank_block(docs, block, k).select("item_id", "rank", "doc_id", "score"), "ranked") for block in blocks(items, block_terms)]
        for df in out:
            made.remove(df)
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, out)


RANKED_SQL = r"""
with doc_terms as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
counts as (select doc_id, term, count(*) tf from doc_terms group by all),
lengths as (select doc_id, count(*) n from doc_terms group by doc_id),
corpus as (select count(*) docs, sum(n)::bigint total from lengths),
found as (select term, count(*) df from counts group by term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint w from found, corpus),
scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint score
  from asked join counts using (term) join weights using (term) join lengths using (doc_id), corpus group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as "rank", doc_id, score from scored where score > 0)
select * from ranked where "rank" <= 50
"""
