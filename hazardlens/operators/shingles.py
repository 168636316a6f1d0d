"""Near-duplicates of whole texts by shared runs of words: MinHash bands find pairs, exact Jaccard decides.

Equal sets of shingles are one set from the start, so copies never meet in a bucket. A bucket is
settled against its smallest member first, which is one comparison a member however large it is; only
members that are still in another class than most of their bucket are then compared with the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .graph import components, dealt_join, hot_keys

#: Words of a shingle, and the similarity of near-duplicates in percent.
WORDS, PERCENT = 5, 80
#: Bands of the signature, and hashes of a band: a pair of similarity 0.8 meets in none with probability 5e-5.
BANDS, ROWS = 25, 5
#: Shingles that are hashed at a time.
CHUNK = 4_096

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words, A-Z folded; of fewer words, the whole."""
    import xxhash

    tokens = (text or b"").translate(_FOLD).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    known = {t: xxhash.xxh3_64_intdigest(t) for t in set(tokens)}
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mixed(out + h[i : len(h) - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of a set's MinHash signature."""
    seeds = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), CHUNK):
        least = np.minimum(least, _mixed(shingles[at : at + CHUNK, None] ^ seeds[None, :]).min(0))
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _mixed(out ^ row)
    return out


def texts(rows: DataFrame, id_col: str, body: str) -> DataFrame:
    """``(_id, t)`` of rows that have an id."""
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(body).cast("string").alias("t"))


def sets(given: DataFrame, kept: str) -> DataFrame:
    """``(_id, n, k1, k2)`` of ``given(_id, t)``, a set's size and two hashes of it all, and what is ``kept``: its ``shingles`` or ``bands``.

    Empty texts have no shingles and no bands.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t.as_py()) for t in b.column(1).cast(pa.binary())]
            whole = lambda s, seed: int(_mixed(s + np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
            held = found if kept == "shingles" else [band_hashes(s) if len(s) else s for s in found]
            columns = [b.column(0), pa.array(map(len, found), pa.int64()), pa.array([whole(s, 1) for s in found], pa.int64()), pa.array([whole(s, 2) for s in found], pa.int64()), pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n", "k1", "k2", kept])

    return given.mapInArrow(made, f"_id long, n long, k1 long, k2 long, {kept} array<long>")


def _linked(pairs: DataFrame, given: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose sets are as alike as asked, by the sets themselves.

    Only ids that stand in a pair have their sets made again from ``given(_id, t)``, in the version
    that ``chosen(_id, k1, k2)`` names.
    """

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    wanted = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    asked = sets(given.join(wanted, "_id", "left_semi"), "shingles")
    held = stored(asked.join(chosen, ["_id", "k1", "k2"], "left_semi").dropDuplicates(["_id"]).select("_id", "shingles"))
    of = lambda end: held.select(F.col("_id").alias(end), F.col("shingles").alias(f"s_{end}"))
    # the end of fewer pairs is joined first; a center of very many pairs is dealt over parts
    met = dealt_join(pairs.join(of("a"), "a"), of("b"), "b", hot_keys(pairs, "b"), "a")
    return met.select("a", "b", "s_a", "s_b").mapInArrow(alike, "a long, b long")


def near_duplicates(rows: DataFrame, id_col: str, body: str, percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, class_id)`` of every row: the smallest id its text reaches over links of Jaccard ``percent`` or more.

    Null and blank texts have no shingles and are classes of their own; rows that repeat an id count as
    one, whose text is the one of the smallest hash; rows without an id are left out. Links that bands
    miss (see BANDS) are the only ones lost: no bucket is capped, and what a bucket's center doesn't
    settle is compared pair by pair across its classes.
    """
    given = texts(rows, id_col, body)
    every = stored(sets(given, "bands"))
    once = stored(every.groupBy("_id").agg(F.min(F.struct("k1", "k2", "n")).alias("s")).select("_id", "s.n", "s.k1", "s.k2"))
    real = once.where("n > 0")
    heads = stored(real.groupBy("k1", "k2").agg(F.min("_id").alias("head")))
    chosen = heads.select(F.col("head").alias("_id"), "k1", "k2")
    members = every.join(chosen, ["_id", "k1", "k2"]).dropDuplicates(["_id"]).select("_id", "n", F.posexplode("bands").alias("band", "h"))
    # a bucket of one member, as most are, is gone after the first count
    centers = members.groupBy("band", "h").agg(F.min(F.struct("_id", "n")).alias("center"), F.count("*").alias("m")).where("m > 1").drop("m")
    buckets = stored(members.join(centers, ["band", "h"]))

    def fits(x: str, y: str) -> Column:
        """Sizes alone may tell sets apart."""
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    first = buckets.where("_id <> center._id").where(fits("n", "center.n")).select(F.col("_id").alias("a"), F.col("center._id").alias("b")).distinct()
    links = stored(_linked(stored(first), given, chosen, percent))
    classes = components(links)
    named = buckets.join(classes, F.col("_id") == F.col("node"), "left").select("band", "h", "_id", "n", F.coalesce("component", "_id").alias("class"))
    sizes = named.groupBy("band", "h", "class").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("band", "h").agg(F.max_by("class", F.struct("k", "class")).alias("most"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    mixed = stored(named.join(mixed, ["band", "h"]))
    # members outside their bucket's largest class, against all of other classes; a pair of two of them once
    probe = mixed.where("class <> most").select("band", "h", F.col("_id").alias("a"), F.col("n").alias("n_a"), F.col("class").alias("of_a"))
    met = mixed.join(probe, ["band", "h"]).where((F.col("class") != F.col("of_a")) & ((F.col("class") == F.col("most")) | (F.col("_id") < F.col("a")))).where(fits("n", "n_a"))
    more = _linked(stored(met.select("a", F.col("_id").alias("b")).distinct()), given, chosen, percent)
    classes = components(links.union(more))
    # every row: the head of its set, and that head's class; a set may be that of most rows
    copies = dealt_join(real, heads.withColumnRenamed("k2", "_k2"), "k1", hot_keys(real, "k1"), "_id").where("k2 = _k2")
    found = copies.join(classes, F.col("head") == F.col("node"), "left").select("_id", F.coalesce("component", "head").alias("class_id"))
    return once.join(found, "_id", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "_id").alias("class_id"))
