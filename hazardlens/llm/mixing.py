"""Mixing sources to target weights: hash-random order within a source, cut at its budget.

Every document gets a random key from a hash of its id. Within a source, documents are ranged by key
into buckets of equal width, more of them the more rows there are, so even a source with most rows
is spread; bucket sums and a running sum inside each bucket give every document its place in the
source's words. Whole epochs take all,
the last one takes documents while at least half of each fits the budget left.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, written

#: Bits of the random key; rows that a bucket holds at most, about, and the fewest bits of a bucket.
KEY_BITS, BUCKET, LEAST_BITS = 60, 100_000, 6


def words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def random_key(id_col: str, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code-point order, null last, weigh as ``weights`` repeating. All words are shared by
    weight; what would pass ``most`` times a source's size goes to the others by weight. The level
    where that settles is found by the order in which sources reach their limits. One row a source;
    no source gives no row, and sources may be as many as domains are.
    """
    placed = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"n": "one"}, "mix-sources").drop("one")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    named = placed.withColumn("w", w.cast("long")).withColumn("limit", F.col("source_size") * most)
    order = [F.col("limit") / F.col("w"), F.col("n")]
    ranked = running(named, order, {"limits": "limit", "weights": "w"}, "mix-limits")
    whole = ranked.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_weights")).first()
    total, all_weights = whole.total or 0, whole.all_weights or 1
    level = (F.lit(total).cast("long") - F.col("limits")).cast("double") / (F.lit(all_weights).cast("long") - F.col("weights"))
    reached = ranked.withColumn("level", level).where(F.col("level") * F.col("w") <= F.col("limit"))
    # the first source that stays below its limit sets the level
    settled = reached.agg(F.min(F.struct(order[0].alias("at"), "n", "level")).alias("s")).first().s
    level = settled.level if settled else 0.0
    return ranked.select("source", "source_size", F.least(F.col("limit").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``(id, version, source, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` counts the words the mix takes, repeats included; it is a multiple of ``size`` and at
    most ``most`` times it. A null text has size 0; a null source is a source of its own, the last; a
    null id is hashed as the empty text. Reruns agree; equal ids are ordered by a hash of the text,
    and equal rows may be cut either way. No rows give no rows.
    """
    rows = written(
        docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("version"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), random_key(id_col, seed).alias("key")),
        "mix-sizes",
    )
    bits = min(KEY_BITS, max(LEAST_BITS, int(log2(rows.count() / BUCKET + 1)) + 1))
    rows = rows.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    starts = buckets.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = starts.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "version").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - epochs * F.col("source_size")
    middle = 2 * (F.col("start") + F.col("upto")) - F.col("size")
    taken = F.col("size") * (epochs + F.when(middle <= 2 * left, 1).otherwise(0))
    return placed.withColumn("taken", F.least(taken, F.col("size") * most).cast("long")).select(F.col("id").alias(id_col), "version", "source", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame) -> DataFrame:
    """The mix of all rows by the weights 1, 2, 3; see ``mix`` for odd rows."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


MIXTURE_SQL = r"""
with rows_ as (
  select doc_id, text, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
    cast('0x' || substr(md5('mix' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) k from documents),
sizes as (select source, cast(sum(size) as bigint) s, row_number() over (order by source nulls last) n from rows_ group by source),
w as (select *, cast([1, 2, 3][1 + (n - 1) % 3] as bigint) w, 3 * s as lim from sizes),
lv as (select *, cast(sum(s) over () - coalesce(sum(lim) over (order by lim::double / w::double, n rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(w) over (order by lim::double / w::double, n rows between current row and unbounded following) as double) lv from w),
lam as (select lv from lv where lv * w <= lim order by lim::double / w::double, n limit 1),
goal as (select source, s, least(cast(lim as double), (select lv from lam) * w) target from lv),
placed as (select rows_.*, s, target, cast(case when s > 0 then floor(target / s) else 0 end as bigint) e,
    cast(sum(size) over (partition by rows_.source order by k, doc_id rows between unbounded preceding and current row) as bigint) upto
  from rows_ join goal on rows_.source is not distinct from goal.source)
select doc_id, size, s as source_size, target,
  cast(least(3 * size, size * (e + case when 2 * upto - size <= 2 * (target - e * s) then 1 else 0 end)) as bigint) taken from placed
"""
