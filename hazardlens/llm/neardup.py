"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample of the vectors of each width. Every vector
is described by its nearest pivots in order, and stands in the inverted list of every three of them,
within its label: two vectors meet in a list if they share three pivots or more. Pairs that meet are
verified by cosine. A pair is counted in one list only, that of the three smallest pivots it shares.
Postings hold ids; vectors come to those lists only that hold two or more. Long lists are cut into
blocks, and pairs of blocks are worked on apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt_join, hashed_share, hot_keys, written

#: Pivots of a width, the nearest that describe a vector, and vectors of a width that pivots are
#: drawn from, about.
PIVOTS, NEAREST, SAMPLE = 512, 7, 4096
#: Vectors of a block of a long list, and of a list whose pairs are worked on with those of others.
BLOCK, SHORT = 256, 24
#: Numbers (components of vectors) that a task works on at once.
TOGETHER = 2_000_000


def usable(vector: F.Column) -> F.Column:
    """Not null, without null or non-finite components, and not all zero."""
    d = vector.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(d, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By width, up to PIVOTS vectors unlike one another, from hash-ordered samples of SAMPLE vectors about.

    Where nearly all vectors are alike, pivots may be more alike too, so that there are enough.
    """
    counts = {r.width: r.n for r in vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    share = F.lit(False)
    for width, n in counts.items():
        share = share | ((F.size("v") == width) & hashed_share(F.xxhash64("v"), SAMPLE, n))
    rows = defaultdict(list)
    for v in vectors.where(share).select("v").orderBy(F.xxhash64("v")).toPandas()["v"] if counts else []:
        rows[len(v)].append(v)
    out = {}
    for width, sample in rows.items():
        x = _unit(np.array(sample, float).reshape(len(sample), width))
        for alike in (0.9, 0.97, 0.995, 0.9999, 1.0):
            chosen = x[:1]
            for row in x[1:]:
                if len(chosen) < PIVOTS and (chosen @ row).max() < alike:
                    chosen = np.vstack([chosen, row])
            if len(chosen) >= NEAREST:
                break
        out[width] = chosen
    return out


def _triples(count: int) -> np.ndarray:
    return np.array(list(combinations(range(count), 3)), np.int64).reshape(-1, 3)


def near_links(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Of ``rows(rep, label, v, copies)``: per vector linked ``(rep, n, root)``, in pieces to be summed.

    ``n`` counts copies of the vectors linked within one list; ``root`` is a vector of the same
    component. Vectors of a width that has fewer than three pivots are one list.
    """
    points = pivots(rows)
    kind = rows.schema["label"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2)
            width = np.diff(vectors.offsets.to_numpy())
            near = np.full((b.num_rows, NEAREST), -1, np.int32)
            keys: list[np.ndarray] = [np.array([-1])] * b.num_rows
            flat, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            for w, centres in points.items():
                here = np.flatnonzero(width == w)
                count = min(NEAREST, len(centres))
                if not len(here) or count < 3:
                    continue
                x = flat[starts[here][:, None] + np.arange(w)]
                own = np.sort(np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")[:, :count], axis=1)
                near[here, :count] = own
                three = own[:, _triples(count)]
                for i, k in zip(here.tolist(), (three[:, :, 0] * PIVOTS + three[:, :, 1]) * PIVOTS + three[:, :, 2], strict=True):
                    keys[i] = k
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            nears = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * NEAREST, pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, nears, lists], [*b.schema.names, "near", "keys"])

    index = written(rows.select("rep", "label", "v", "copies").mapInArrow(describe, f"rep long, label {kind}, v array<double>, copies long, near array<int>, keys array<long>"), "pivot-index")
    entries = index.select("rep", "label", F.size("v").alias("width"), F.explode("keys").alias("key"))
    lists = entries.groupBy("label", "width", "key").agg(F.count("*").alias("length")).where("length > 1").withColumn("blocks", F.ceil(F.col("length") / BLOCK).cast("int"))
    dealt = (
        entries.join(lists, ["label", "width", "key"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("label").alias("g"), "width", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep")
        .join(index.select("rep", F.col("label").cast("string").alias("label"), "v", "near", "copies"), "rep")
        .select("g", "label", "width", "key", "x", "y", "own", "rep", "copies", "near", "v")
        .repartition("g", "width", "key", "x", "y")
        .sortWithinPartitions("g", "label", "width", "key", "x", "y")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            step = max(1, TOGETHER // max(1, len(b.column(10).values) // b.num_rows))
            for i in range(0, b.num_rows, step):
                held.append(b.slice(i, step))
                rows_ = pa.Table.from_batches(held).combine_chunks()
                cut = _starts(rows_)[-1]
                if cut:
                    yield from _lists(rows_.slice(0, cut), threshold)
                held = rows_.slice(cut).combine_chunks().to_batches()
        if held:
            yield from _lists(pa.Table.from_batches(held), threshold)

    return dealt.mapInArrow(verify, "rep long, n long, root long")


def _starts(rows: pa.Table) -> np.ndarray:
    """Where lists (and pairs of their blocks) begin in sorted ``rows``."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for c in ("g", "width", "key", "x", "y"):
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    new[1:] |= label[1:] != label[:-1]
    return np.flatnonzero(new)


def _lists(rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of whole lists."""
    rows = rows.combine_chunks()
    starts = _starts(rows)
    lengths = np.diff(np.append(starts, rows.num_rows))
    width, key, own, rep, copies = (rows.column(c).to_numpy() for c in ("width", "key", "own", "rep", "copies"))
    apart = (rows.column("x").to_numpy() != rows.column("y").to_numpy())[starts]
    v, n = rows.column("v").combine_chunks(), rows.column("near").combine_chunks()
    flat, at = v.flatten().to_numpy(), v.offsets.to_numpy()
    at = at - at[0]
    near = n.flatten().to_numpy().reshape(-1, NEAREST)
    for w in np.unique(width[starts]).tolist():
        chosen = np.flatnonzero((width[starts] == w) & (lengths > 1))
        short = chosen[lengths[chosen] <= SHORT]
        if len(short):
            inside = np.repeat(np.arange(len(short)), lengths[short])
            index = np.arange(len(inside)) - np.repeat(np.cumsum(lengths[short]) - lengths[short], lengths[short]) + starts[short][inside]
            x = _unit(flat[at[index][:, None] + np.arange(w)])
            for d in range(1, int(lengths[short].max())):  # each row with the one d rows on
                i = np.flatnonzero(inside[d:] == inside[:-d])
                if not len(i):
                    break
                j = i + d
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = index[i[ok]], index[j[ok]]
                ok = ~apart[short][inside[np.searchsorted(index, i)]] | (own[i] != own[j])
                i, j = i[ok], j[ok]
                ok = _first_list(near[i], near[j], key[i])
                i, j = i[ok], j[ok]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[i], rep[j]])), pa.array(np.concatenate([copies[j], copies[i]])), pa.array(np.concatenate([rep[j], rep[i]]))], ["rep", "n", "root"])
        for c in chosen[lengths[chosen] > SHORT]:
            index = np.arange(starts[c], starts[c] + lengths[c])
            x = _unit(flat[at[index][:, None] + np.arange(w)])
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if apart[c]:
                linked &= own[index][:, None] != own[index][None, :]
            i, j = np.nonzero(linked)
            no = ~_first_list(near[index[i]], near[index[j]], key[index[i]])
            linked[i[no], j[no]] = False
            hit = np.flatnonzero(linked.any(1))
            if not len(hit):
                continue
            root = np.arange(len(index))
            while True:  # smallest place reachable
                new = np.minimum(root, np.where(linked, root[None, :], len(index)).min(1))
                if (new == root).all():
                    break
                root = new
            yield pa.RecordBatch.from_arrays([pa.array(rep[index][hit]), pa.array((linked @ copies[index])[hit].astype(np.int64)), pa.array(rep[index][root][hit])], ["rep", "n", "root"])


def _first_list(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a list is the first of those that two vectors share: that of their three smallest pivots.

    ``a`` and ``b`` are the vectors' pivots; a key below 0 is a list of vectors without pivots.
    """
    shared = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(2)
    before = (shared & (a < (key % PIVOTS)[:, None])).sum(1)
    return (key < 0) | (before == 2)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is
    ``threshold`` or more. Null, zero, or partly null or non-finite vectors link with nothing and are
    kept; a row without an id links with nothing. Equal vectors of one label are one point of the
    index, whatever their number; of rows that repeat an id, each counts as a row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label")).withColumn("h", F.xxhash64("label", "v"))
    fit = rows.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    points = written(fit.groupBy("h", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-points")
    found = written(near_links(points, threshold), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    point = points.join(counts, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    point = point.select("h", "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("class"))
    # a vector that very many rows repeat has one point, and its rows are dealt over many tasks
    out = dealt_join(rows, point, "h", hot_keys(points, "h", "copies"), "vec_id", "left", ("label", "v"))
    named = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.coalesce(F.when(named, F.col("links")), F.lit(0)).alias("n_links"), F.when(named, F.coalesce("class", "vec_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


DUPLICATES_SQL = r"""
with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where embedding is not null and label is not null),
u as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pair as (select a.vec_id x, b.vec_id y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, r) as (select vec_id, vec_id from embeddings union select reach.vec_id, pair.y from reach join pair on reach.r = pair.x),
c as (select vec_id, min(r) c from reach group by vec_id),
n as (select x, count(*) n from pair group by x)
select c.vec_id, cast(coalesce(n, 0) as bigint) n_links, c as component_id, c.vec_id = c as kept from c left join n on c.vec_id = n.x
"""
