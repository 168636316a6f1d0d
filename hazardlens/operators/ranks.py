"""Exact ranks inside strata without one task for a stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, stored


def ranked_within(rows: DataFrame, strata: list[str], order: list[Column], rank: str = "_rank", size: str | None = None) -> DataFrame:
    """``rows`` with their place from 1 in each stratum by ``order``, which leaves no ties, and the stratum's ``size``.

    Rows are ranged by stratum and order and written, so ranges stay as they are; a place is the
    stratum's rows in the ranges before and the place inside its own. Only a row for each range and
    stratum goes through a window of its own.
    """
    keyed = rows.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    places = [F.expr(f"_o{i}") for i in range(len(order))]
    ranged = stored(keyed.repartitionByRange(*[F.col(c) for c in strata], *places).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *strata).agg(F.count("*").alias("_n"))
    mine = Window.partitionBy(*strata)
    before = sizes.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], (F.sum("_n").over(mine.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(mine).alias("_size"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    inside = F.row_number().over(Window.partitionBy("_part", *strata).orderBy(*places))
    # a row for each range and stratum: few, unless strata are very many
    out = ranged.join(small_side(stored(before)), same).withColumn(rank, F.col("_before") + inside)
    out = out.withColumn(size, F.col("_size")) if size else out
    return out.select(*rows.columns, rank, *([size] if size else []))
