"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Shards own arcs of a ring through virtual nodes. Rows fall on the ring by a hash of their text, so
equal texts fall together. Each shard takes rows up to its bound; what overflows goes on clockwise
to the next shard with room. The ring is divided into a fixed number of bins: loads of bins decide
how far each shard reaches, and a running sum inside bins tells every row where it falls. Bins are
cut into cells by further bits of the hash, more of them the more rows there are; a huge group of
equal texts has cells of its own, dealt by a hash of the id, and stays in one stretch of the ring.
"""

from __future__ import annotations

import hashlib
from math import log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_enough, written

#: Bins of the ring, and virtual nodes of a shard.
BINS, NODES = 4096, 64
#: Rows of a cell, about; more rows of one text than HOT get slices of about HOT rows each.
CELL, HOT = 20_000, 100_000
#: Up to so many hot texts are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, clockwise; places are 64-bit."""
    return sorted((int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(nodes))


def reach(loads: dict[int, int], shards: int, slack: float = 0.0, nodes: int = NODES) -> list[tuple[int, float, float, int]]:
    """``(bin, from, to, shard)``: which shard takes which part of each bin's bytes.

    Bins are visited clockwise; a bin belongs to the first virtual node at or after its end. A shard
    takes up to ``(1 + slack)`` times the mean load, the rest goes to the next node's shard.
    """
    places = ring(shards, nodes)
    width = 2**64 // BINS
    total = sum(loads.values())
    room = [total * (1 + slack) / shards] * shards
    out, at = [], 0
    for b in sorted(loads):
        while at < len(places) and places[at][0] < (b + 1) * width - 1:
            at += 1
        start, load = 0.0, float(loads[b])
        for n in range(len(places)):
            s = places[(at + n) % len(places)][1]
            take = min(room[s], load - start)
            if take > 0:
                out.append((b, start, start + take, s))
                room[s] -= take
                start += take
            if start >= load:
                break
        if start < load or not load:  # rounding left a rest, or nothing to weigh
            s = max(range(shards), key=lambda i: (room[i], -i))
            if out and out[-1][0] == b:
                out[-1] = (b, out[-1][1], load + 1, out[-1][3])
            else:
                out.append((b, start, load + 1, s))
        else:
            out[-1] = (b, out[-1][1], load + 1, out[-1][3])
    return out


def shard(docs: DataFrame, shards: int = 24, slack: float = 0.05, extra: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``extra``; a row goes where its middle byte
    falls. No shard holds more than ``1 + slack`` times the mean, give or take the rows on the
    borders of what it takes. Equal texts fall together unless a border runs through their very
    group. Null texts count as empty, null ids are ordered first; rows alike in id and text may swap
    slots. Slots run from 0 without gaps in each shard. No rows give no rows; other columns aren't
    read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(text)
    rows = written(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + extra).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), hashed.alias("h"), F.shiftrightunsigned(hashed, 52).cast("int").alias("bin")),
        "shard-rows",
    )
    bits = max(2, min(40, int(log2(rows.count() / BINS / CELL + 1)) + 1))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 52 - bits).bitwiseAND((1 << bits) - 1))
    # a hot text stands in a cell that is hot; both are at most a HOT-th of all rows
    full = rows.groupBy("bin", "cell").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bin", "cell")
    hot = written(rows.join(F.broadcast(full) if small_enough(full, BROADCAST_ROWS) else full, ["bin", "cell"]).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.ceil(F.col("n") / HOT).alias("slices")), "shard-hot")
    rows = rows.join(F.broadcast(hot) if small_enough(hot, BROADCAST_ROWS) else hot, "h", "left")
    # the order inside a cell: first all texts that aren't hot, then each hot one by its slices
    rows = rows.withColumn("own", F.when(F.col("slices").isNotNull(), F.col("h"))).withColumn("slice", F.coalesce(F.pmod(F.xxhash64("id", F.lit(7)), "slices"), F.lit(0))).drop("slices")
    place = ["cell", "own", "slice"]
    cells = rows.groupBy("bin", *place).agg(F.sum("size").alias("bytes"))
    # BINS rows at most
    loads = {r.bin: r.bytes for r in cells.groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect()}
    spark = docs.sparkSession
    plan = spark.createDataFrame(reach(loads, shards, slack), "bin int, low double, high double, shard int")
    starts = cells.withColumn("start", F.sum("bytes").over(Window.partitionBy("bin").orderBy(*place)) - F.col("bytes")).select(*[F.col(c).alias(f"_{c}") for c in ("bin", *place)], "start")
    same = (F.col("bin") == F.col("_bin")) & (F.col("cell") == F.col("_cell")) & F.col("own").eqNullSafe(F.col("_own")) & (F.col("slice") == F.col("_slice"))
    inside = Window.partitionBy("bin", *place).orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(starts, same).drop("_bin").withColumn("middle", F.col("start") + F.col("upto") - F.col("size") / 2)
    # BINS rows and one for each border of a shard at most
    dealt = placed.join(F.broadcast(plan.withColumnRenamed("bin", "_bin")), (F.col("bin") == F.col("_bin")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
    dealt = written(dealt.select("id", "size", "text_crc32", "bin", *place, "shard", "upto"), "shard-placed")
    counts = dealt.groupBy("shard", "bin", *place).agg(F.count("*").alias("rows"))
    by_bin = counts.groupBy("shard", "bin").agg(F.sum("rows").alias("rows"))
    bins = by_bin.select(F.col("shard").alias("_shard"), F.col("bin").alias("_b"), (F.sum("rows").over(Window.partitionBy("shard").orderBy("bin")) - F.col("rows")).alias("bin_first"))
    before = counts.withColumn("first", F.sum("rows").over(Window.partitionBy("shard", "bin").orderBy(*place)) - F.col("rows"))
    before = before.join(F.broadcast(bins), (F.col("shard") == F.col("_shard")) & (F.col("bin") == F.col("_b"))).select(F.col("shard").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("bin", *place)], (F.col("first") + F.col("bin_first")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "bin", *place).orderBy("upto", "id"))
    out = dealt.withColumn("n", number).join(before, (F.col("shard") == F.col("_s")) & same)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))


def by_bytes(docs: DataFrame) -> DataFrame:
    """24 shards of near equal bytes: no slack, so every shard is filled to the mean."""
    return shard(docs, 24, slack=0.0).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
