"""Shared helpers: the folder all executors share, written tables, and distributed components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

T = TypeVar("T")

#: A node with more links than this is a hub: its links are dealt over so many parts in joins.
HUB, HUB_PARTS = 500_000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is set, a local session gets one of its own; on a cluster a folder of one machine
    would lose rows without a word, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_passing: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if _passing:
        _passing[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more; others are left alone."""
    path = _paths.pop(df, None)
    if path is not None:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that ``written`` makes inside go at the end, but for those taken off the given list."""
    mine: list[DataFrame] = []
    _passing.append(mine)
    try:
        yield mine
    finally:
        _passing.remove(mine)
        for df in mine:
            discard(df)


def private(*names: str) -> list[str]:
    """Column names that no given table has."""
    mark = uuid.uuid4().hex[:12]
    return [f"_{name}_{mark}" for name in names]


_memory: dict[object, object] = {}


def worker_memory(owner: object, make: Callable[[], T]) -> T:
    """What ``make`` gave in this Python worker for ``owner``, kept over tasks.

    A worker holds the memory of one owner at a time: when another operator runs in it, what the
    last one remembered goes, so that a chain of operators needs no more than its largest.
    """
    if owner not in _memory:
        release_memory()
        _memory[owner] = make()
    return _memory[owner]


def release_memory() -> None:
    """What ``worker_memory`` holds in this Python worker goes, as in operators that remember nothing themselves."""
    if _memory:
        _memory.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_bucket(id_col: str, modulus: int, remainder: int) -> F.Column:
    """crc32(id as text) mod ``modulus`` equals ``remainder``; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def hashed_share(hashed: F.Column, most: int, of: int) -> F.Column:
    """Whether a 64-bit hash falls into the share ``most / of`` of all hashes; never none of them."""
    return F.lit(True) if of <= most else hashed < F.lit(max(1, (most << 64) // of) - 2**63)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows, looking at no more than that many."""
    return df.limit(most_rows + 1).count() <= most_rows


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the smallest node of each.

    Alternating large-star and small-star rounds: in every round each node hands its neighbours to
    its smallest neighbour, so the number of rounds is logarithmic in practice and no node's
    neighbour list is ever held in memory; minima are pre-aggregated before each shuffle, and the
    links of a hub, on whichever side it stands, are dealt over HUB_PARTS parts. Each round is written to the shared folder, so a
    lost executor costs one round at most, and the round before it is deleted then. Null ends and
    self-links are ignored; no edges give no rows.
    """
    # every link from its larger end to its smaller one
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = written(pairs, "edges"), None
    while True:
        per = current.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        # hubs are at most a HUB-th of all links
        state = per.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.collect_list(F.when(F.col("n") > HUB, F.col("b"))).alias("hubs")).first()
        if before is not None and (state.n, state.h) == before:
            break
        before = state.n, state.h
        # large star: larger neighbours are linked to the smallest of the neighbourhood
        least = current.groupBy("a").agg(F.min("b").alias("m"))
        large = dealt_join(current.select(F.col("b").alias("a"), F.col("a").alias("b")), least, "a", state.hubs, "b", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).distinct()
        # it has no more rows than ``current``, so few rows have no hub on this side
        many = (state.n or 0) > HUB
        large = written(large, "edges") if many else large
        # small star: each node's smaller neighbours and itself go to the smallest of them
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            dealt_join(large, least2, "a", hot_keys(large.groupBy("a").agg(F.count("*").alias("n")), "a", "n") if many else [], "b")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = written(small, "edges")
        discard(current)
        discard(large)
        current = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: str, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (and ``also``), where ``hot`` keys hold very many rows of ``left``.

    Their rows are dealt over HUB_PARTS parts by a hash of ``spread``, and those of ``right``, few
    for each key, stand in all parts. ``hot`` is a list bounded by the rows over HUB.
    """
    if not hot:
        return left.join(right, [key, *also], how)
    part, mark = private("part", "hot")
    names = left.sparkSession.createDataFrame([(h, True) for h in hot], f"`{key}` {left.schema[key].dataType.simpleString()}, `{mark}` boolean")
    nothing, last = F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long")
    left = left.join(F.broadcast(names), key, "left").withColumn(part, F.when(F.col(mark), F.pmod(F.xxhash64(spread), F.lit(HUB_PARTS))).otherwise(nothing)).drop(mark)
    right = right.join(F.broadcast(names), key, "left").withColumn(part, F.explode(F.when(F.col(mark), F.sequence(nothing, last)).otherwise(F.array(nothing)))).drop(mark)
    return left.join(right, [key, part, *also], how).drop(part)


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys of ``counts`` with more than HUB rows; at most a HUB-th of all rows."""
    return [r[0] for r in counts.where(F.col(n) > HUB).select(key).collect()]


def running(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with sums of columns over the rows before each in the order of ``order``, none in one task.

    ``sums`` gives, by new column, the column added up; rows are ranged by ``order``, which must leave
    no ties, and sums of whole ranges, a row a partition, are added to those inside them.
    """
    part, base = private("part", "base")
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()), name)
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(f"{base}{i}") for i, c in enumerate(sums.values())])
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, *[F.coalesce(F.sum(f"{base}{i}").over(ahead), F.lit(0)).alias(f"{base}{i}") for i in range(len(sums))])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(totals), part)
    return out.select(*df.columns, *[(F.col(f"{base}{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(new) for i, (new, c) in enumerate(sums.items())])


def table_rows(df: DataFrame, count: F.Column | None = None) -> int:
    """How many rows a written table has, or another whole number over all of them (0 for none)."""
    return df.agg(F.count("*") if count is None else count).first()[0] or 0


def running_within(df: DataFrame, key: str, order: list[str], values: dict[str, tuple[str, str]], name: str) -> DataFrame:
    """``df`` with running values within each ``key`` in the order of ``order`` (null first), the row itself included.

    ``values`` gives, by new column, ``("sum" or "xor", long column)``. Rows are ranged by key and order, so
    a key of any size may lie in many ranges; ranges are gone through batch by batch, and what a key has
    come to at the end of a range, a row a range, is added in those after it. The key is a long.
    """
    part, row, upto, carried = private("part", "row", "upto", "carried")
    schema = df.schema
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    steps = [(how == "sum", df.columns.index(c)) for how, c in values.values()]
    at = df.columns.index(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, n = None, np.zeros(len(steps), np.int64), 0
        for b in batches:
            if not len(b):
                continue
            keys = b.column(at).to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))  # of each row, its key's first row in the batch
            out = []
            for i, (adds, c) in enumerate(steps):
                v = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                put = np.add if adds else np.bitwise_xor
                if not new[0]:
                    v[0] = put(v[0], before[i])
                upto_now = put.accumulate(v)
                base = put(upto_now[start], v[start]) if not adds else upto_now[start] - v[start]
                got = upto_now - base if adds else put(upto_now, base)
                before[i] = got[-1]
                out.append(pa.array(got))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.arange(n, n + len(keys)))], [*b.schema.names, *values, row])
            n += len(keys)

    wider = StructType([*schema.fields, *[StructField(n, LongType()) for n in (*values, row)]])
    scanned = written(ranged.mapInArrow(scan, wider).withColumn(part, F.spark_partition_id()), name)
    # a row a range: its last key and what that has come to
    tails = scanned.groupBy(part).agg(F.max_by(F.struct(key, *values), row).alias("t")).select(part, *[F.col(f"t.{c}").alias(c) for c in (key, *values)])
    following = Window.orderBy(part)
    along = Window.partitionBy(key).orderBy(part)
    put = {n: F.sum(n) if how == "sum" else F.bit_xor(n) for n, (how, _) in values.items()}
    tails = tails.withColumn(carried, F.lead(part).over(following)).select(F.col(carried).alias(part), F.col(key).alias(upto), *[put[n].over(along).alias(f"{n}{carried}") for n in values])
    out = scanned.join(F.broadcast(tails.where(F.col(part).isNotNull()).withColumnRenamed(part, carried)), (F.col(part) == F.col(carried)) & (F.col(key) == F.col(upto)), "left")
    nothing = F.lit(0).cast("long")
    more = {n: F.coalesce(f"{n}{carried}", nothing) for n in values}
    return out.select(*df.columns, *[(F.col(n) + more[n] if how == "sum" else F.col(n).bitwiseXOR(more[n])).alias(n) for n, (how, _) in values.items()])
