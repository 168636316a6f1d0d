"""Exact top-k inner products by columnar branch-and-bound.

Queries and candidates are dealt to the cells of a grid. In a cell, candidates lie dimension by
dimension (vertically). A query adds up products over one block of dimensions at a time; after each
block, candidates whose sum plus the most that the remaining dimensions can add stays below the k-th
best found are dropped and the survivors are packed together. Cells' winners meet in a small final
ranking. Every query is a stated row, every candidate is compared with every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neardup import usable

#: Candidates and queries of a cell, dimensions of a block, and candidates scored at a time.
CANDIDATES, QUERIES, DIMENSIONS, CHUNK = 16_384, 1_024, 16, 2_048
#: Sums below this are exact in double precision.
EXACT = 2.0**53


def integers(vector: F.Column) -> F.Column:
    """floor(256 x) of every component, with x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256.0).cast("double"))


def cell_top(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query, candidate, score)`` of the best ``k`` candidates in a cell, ties to smaller ids."""
    exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < EXACT
    if not exact:  # huge components: sums of Python integers
        q, c = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape), np.array([[int(x) for x in r] for r in c], object).reshape(c.shape)
    out = []
    edges = list(range(0, q.shape[1], DIMENSIONS)) + [q.shape[1]]
    # candidates with much mass first, so that the k-th best rises early
    mass = (c * c).sum(1)
    by = np.lexsort((cids, -mass.astype(float)))
    cids, c = cids[by], c[by]
    columns = np.asfortranarray(c)
    left_c = [np.sqrt((c[:, a:] * c[:, a:]).sum(1).astype(float)) for a in edges]
    for qid, v in zip(qids, q, strict=True):
        best_s, best_i = np.empty(0, c.dtype), np.empty(0, np.int64)
        left_q = [float(np.sqrt(float((v[a:] * v[a:]).sum()))) for a in edges]
        for at in range(0, len(cids), CHUNK):
            stop = min(at + CHUNK, len(cids))
            rows = np.arange(at, stop)
            rows = rows[cids[rows] != qid]
            total = np.zeros(len(rows), c.dtype)
            for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if len(best_s) >= k:
                    most = total.astype(float) + left_q[n] * left_c[n][rows] * (1 + 1e-12) + 1e-6
                    stay = most >= float(best_s[k - 1])
                    if not stay.all():
                        rows, total = rows[stay], total[stay]
                if not len(rows):
                    break
                total = total + columns[rows, a:b] @ v[a:b]
            if len(rows):
                s, i = np.concatenate([best_s, total]), np.concatenate([best_i, cids[rows]])
                order = np.lexsort((i, -s.astype(float))) if exact else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j])))
                best_s, best_i = s[order[:k]], i[order[:k]]
        out += [(int(qid), int(i), max(-(2**63), min(2**63 - 1, int(s)))) for s, i in zip(best_s, best_i, strict=True)]
    return out


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best other rows by integer inner product.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an
    id; a zero vector does. Vectors of another width than the query's aren't compared with it. Ties
    go to the smaller id; a query with fewer candidates gets all of them. Rows with the query's own
    id are no candidates. Components are exact while products of 64-bit size don't overflow; beyond,
    scores stop at the ends of the 64-bit range.
    """
    whole = usable(F.col("embedding")) | F.coalesce(F.forall(F.col("embedding").cast("array<double>"), lambda x: x == 0), F.lit(False))
    rows = vectors.where(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), integers(F.col("embedding")).alias("v"), is_query.alias("query"))
    rows = rows.withColumn("width", F.size("v"))
    n = rows.agg(F.count("*").alias("c"), F.count_if("query").alias("q")).first()
    across, down = max(1, -(-n.c // CANDIDATES)), max(1, -(-n.q // QUERIES))
    part = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    whole_grid = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = (
        rows.select("id", "v", "width", F.lit(0).alias("side"), part(across, "c").alias("x"), whole_grid(down).alias("y"))
        .union(rows.where("query").select("id", "v", "width", F.lit(1).alias("side"), whole_grid(across).alias("x"), part(down, "q").alias("y")))
        .repartition("width", "x", "y")
        .sortWithinPartitions("width", "x", "y", "side", "id")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def solve() -> pa.RecordBatch:
            ids, sides = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            x = np.concatenate([h[2] for h in held])
            found = cell_top(ids[sides == 1], x[sides == 1], ids[sides == 0], x[sides == 0], k) if (sides == 1).any() else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

        for b in batches:
            width, x, y = (b.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2))
            key = np.stack([width, x, y], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:], strict=False):
                if e > a:
                    if at is not None and tuple(key[a]) != at:
                        yield solve()
                        held = []
                    at = tuple(key[a])
                    piece = b.slice(a, e - a)
                    held.append((piece.column(4).to_numpy(), piece.column(3).to_numpy(), piece.column(5).flatten().to_numpy().reshape(e - a, int(key[a][0]))))
        if held:
            yield solve()

    found = dealt.select("width", "x", "y", "side", "id", "v").mapInArrow(search, "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 50 == 0)


NEAREST_SQL = r"""
with v as (select vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(x * 256) as bigint)) e from embeddings
  where embedding is not null and len(list_filter(cast(embedding as double[]), lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5
"""
