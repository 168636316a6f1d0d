"""Joins whose keys may hold most of the rows, and connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

#: A key with more rows than this is hot: its rows are dealt over so many parts in joins.
HOT, PARTS = 500_000, 64


def hot_keys(rows: DataFrame, key: str) -> list:
    """Keys with more than HOT rows; at most a HOT-th of all rows."""
    return [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(key).collect()]


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, few rows for each key, where ``hot`` keys hold very many rows of ``left``.

    Their rows are dealt over PARTS parts by a hash of ``spread``; those of ``right`` stand in all parts.
    """
    if not hot:
        return left.join(right, key, how)
    names = left.sparkSession.createDataFrame([(h, True) for h in hot], f"`{key}` {left.schema[key].dataType.simpleString()}, _hot boolean")  # bounded: see hot_keys
    zero = F.lit(0).cast("long")
    left = left.join(F.broadcast(names), key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(PARTS))).otherwise(zero))
    right = right.join(F.broadcast(names), key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(zero, F.lit(PARTS - 1).cast("long"))).otherwise(F.array(zero)))).drop("_hot")
    return left.drop("_hot").join(right, [key, "_part"], how).drop("_part")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(node, component)``: every linked node and the smallest one it reaches.

    In each round a node's larger neighbours go to its smallest one, and then its smaller neighbours and
    itself do, until nothing changes. Neighbourhoods are never gathered: minima are taken before the
    shuffle, and the links of a hub are dealt over parts on whichever side it stands. Rounds are written,
    so a lost executor costs one. Null ends and links to oneself are ignored.
    """
    now = stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = state.n, state.h
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        large = stored(dealt_join(now.select(F.col("b").alias("a"), F.col("a").alias("b")), least, "a", hot_keys(now, "b"), "b", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        both = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        after = stored(dealt_join(large, least, "a", hot_keys(large, "a"), "b").select(F.explode(both).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        discard(now, large)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
