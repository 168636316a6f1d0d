"""Resubmitted reports: exact repeats, and repeats by sequence ratio against earlier texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import discard, drop_shuffles, small_side, stored
from . import ratioindex
from .graph import dealt_join, hot_keys
from .ranks import ranked_within


#: Characters of the earlier texts that a worker holds, a text counting as so many more than it has.
BLOCK, EACH = 16_000_000, 1_000
#: Characters of the texts that are shuffled at a time.
SLICE = 2_000_000_000


def exact_repeats(rows: DataFrame, id_col: str, body: str, order: str) -> DataFrame:
    """``(id, first_id)`` of every row whose text came earlier; null texts repeat nothing."""
    texts = rows.where(F.col(body).isNotNull()).select(F.col(id_col), F.sha2(F.col(body), 256).alias("_text"), F.struct(F.col(order).alias("o"), F.col(id_col).alias("id")).alias("_at"))
    # minima are taken before the shuffle, and no text is shuffled, so a group may hold most of the rows
    first = texts.groupBy("_text").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return texts.join(first, "_text").select(id_col, F.col("_first.id").alias("first_id")).where(F.col(id_col) != F.col("first_id"))


def _blocks(firsts: DataFrame, threshold: float) -> DataFrame:
    """``firsts(id, part, n)`` with the ``band`` and ``chunk`` of each text, which with its part name its block.

    A part that a worker can hold is one block. A larger one is cut into bands of lengths, as only texts of one band
    or of two that adjoin can be alike, and these by id into chunks.
    """
    width = math.log((2 - threshold) / threshold) + 1e-6
    sizes = firsts.groupBy("part").agg(F.sum(F.col("n") + EACH).alias("_chars"))
    band = F.when(F.col("_chars") <= BLOCK, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / width) + 1).cast("int")
    ranked = ranked_within(firsts.join(sizes, "part").withColumn("band", band), ["part", "band"], [F.col("id")])
    each = F.greatest(F.floor(BLOCK / (F.exp(F.col("band") * width) + EACH)), F.lit(1))
    return ranked.withColumn("chunk", F.when(F.col("band") == 0, 0).otherwise(F.floor((F.col("_rank") - 1) / each)).cast("int")).drop("_rank", "_chars")


def _found(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of blocks, each followed by the later texts that go past it, as ``(a, y, ratio, grams)`` of those that are like one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None

        def out(rows: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            hits = [(i, *hit) for i, t in rows if (hit := block.first(i, t))]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["a", "y", "ratio", "grams"])

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal block
            block = ratioindex.Earlier([i for i, _ in held], [t for _, t in held], threshold)
            yield from out(held)

        for b in batches:
            later = []
            for *at, past, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != now:
                    if later:
                        yield from out(later)
                        later = []
                    if now is not None and block is None:
                        yield from built()
                    now, held, block = at, [], None
                if past:
                    if block is None:
                        yield from built()
                    later.append((i, t))
                else:
                    held.append((i, t))
            if later:
                yield from out(later)
        if now is not None and block is None:
            yield from built()

    return found


def _first_alike(texts: DataFrame, threshold: float) -> DataFrame:
    """``(a, y, ratio)`` of ``texts(id, t, n, part, band, chunk)``: the first earlier text of the part that each is like.

    Each block of texts is held by a worker once, and the later texts of its part and of lengths that may be
    like its own go past it. Blocks are gone through in slices (see SLICE), whose shuffles go before the next.
    """
    key = ["part", "band", "chunk"]
    blocks = stored(texts.groupBy(key).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("n"), F.count("*").alias("rows")))
    held = blocks.select(*key, "low", F.explode(F.array([F.col("band") + d for d in (-1, 0, 1)])).alias("to_band"))
    ends = blocks.select(F.col("part").alias("to_part"), F.col("band").alias("to"), F.col("chunk").alias("to_chunk"), "high", "n")
    meet = (F.col("part") == F.col("to_part")) & (F.col("to_band") == F.col("to")) & (F.col("high") > F.col("low"))
    links = stored(held.join(ends, meet).where("to <> band or to_chunk <> chunk").select(*key, "to", "to_chunk", "n"))
    moved = blocks.select("n").union(links.select("n")).agg(F.sum("n")).first()[0] or 0
    slices = max(1, -(-moved // SLICE))
    parts = max(2 * texts.sparkSession.sparkContext.defaultParallelism, 2 * -(-blocks.count() // slices))
    hits = []
    for k in range(slices):
        mine = F.pmod(F.xxhash64(*key), F.lit(slices)) == k
        own = texts.where(mine).select(*key, F.lit(False).alias("past"), "id", "t")
        to = small_side(links.where(mine).drop("n"))
        past = texts.select("part", F.col("band").alias("to"), F.col("chunk").alias("to_chunk"), "id", "t").join(to, ["part", "to", "to_chunk"]).select(*key, F.lit(True).alias("past"), "id", "t")
        rows = own.union(past).repartition(min(parts, 2_000), *key).sortWithinPartitions(*key, "past", "id")
        hits.append(stored(rows.mapInArrow(_found(threshold), "a long, y long, ratio double, grams long")))
        drop_shuffles(texts.sparkSession)
    first = stored(reduce(DataFrame.union, hits).groupBy("a").agg(F.min(F.struct("y", "ratio")).alias("m")).select("a", "m.y", "m.ratio"))
    discard(blocks, links, *hits)
    return first


def ratio_repeats(rows: DataFrame, id_col: str, body: str, order: str, threshold: float = fixed.SIMILARITY_THRESHOLD, within: str | None = None) -> DataFrame:
    """``(id, match_id, ratio)``: the first earlier text whose sequence ratio reaches ``threshold``.

    With ``within``, a column, only rows that are alike in it (null too) are compared.

    Texts come in the order of ``order``, ties by id. Equal texts are one text of the first that came; null
    and blank texts repeat nothing. Candidates come from an index that loses no pair (see ``ratioindex``), made of
    a bounded block of texts at a time: what is shuffled are texts, once for each block that they go past.
    A text is compared with its candidates in a block from the first one on, up to the one that is like it: so a
    group of near copies costs one comparison a text and block. Ratios are worked out only where letters and
    q-grams leave them possible.
    """
    part = F.lit(0).cast("long") if within is None else F.xxhash64(F.col(within).isNull(), F.col(within))
    keyed = rows.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "").select(F.col(id_col).alias("_row"), F.col(body).alias("t"), F.length(body).cast("long").alias("n"), part.alias("part"), F.sha2(F.concat(part.cast("string"), F.lit(":"), F.col(body)), 256).alias("_text"), F.struct(F.col(order).alias("at"), F.col(id_col).alias("row")).alias("_at"))
    firsts = keyed.groupBy("_text").agg(F.min("_at").alias("_at"), F.min("part").alias("part"), F.min("n").alias("n")).select("_text", "_at", F.col("_at.at").alias("at"), F.col("_at.row").alias("row"), "part", "n")
    # texts are numbered in the order in which they came
    places = ranked_within(firsts, [], [F.col("at"), F.col("row")]).select("_text", "_at", "row", "part", "n", F.col("_rank").cast("long").alias("id"))
    places = _blocks(places, threshold)
    texts = stored(keyed.select("_text", "_at", "t").join(places, ["_text", "_at"]).dropDuplicates(["_text"]).select("id", "t", "n", "part", "band", "chunk", "_text", "row"))
    first = _first_alike(texts, threshold)
    first = first.join(texts.select(F.col("id").alias("y"), F.col("row").alias("near")), "y").select(F.col("a").alias("id"), "near", "ratio")
    known = texts.select("id", "_text", F.col("row").alias("first")).join(first, "id", "left")
    out = dealt_join(keyed.select("_row", "_text"), known.drop("id"), "_text", hot_keys(keyed, "_text"), "_row")
    same = F.col("_row") != F.col("first")
    out = out.select(F.col("_row").alias(id_col), F.coalesce("near", F.when(same, F.col("first"))).alias("match_id"), F.coalesce("ratio", F.when(same, F.lit(1.0))).alias("ratio"))
    return out.where("match_id is not null")


def without(rows: DataFrame, repeats: DataFrame, id_col: str) -> DataFrame:
    """Rows that repeat nothing, for counts with resubmissions removed."""
    return rows.join(repeats.select(id_col), id_col, "left_anti")
