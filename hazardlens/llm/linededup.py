"""Line dedup: hashes of lines in a range-partitioned order, streamed; keep bitmaps come back.

Line keys are hashed to 128 bits, range-partitioned and sorted by hash, then document (largest
first) and position. One pass over a partition sees every key's occurrences in order and decides
them as they go by; only the first and last key of a partition may go on in its neighbours, and
these few keys, two a partition at most, are settled by a small aggregate. No text is shuffled
until the bitmaps, one bit a line, are put to use.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, release_memory, written

#: The white space that ends of a line lose.
WHITE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _marks(min_docs: int):
    """One pass over a sorted partition: lines to drop, and lines of the two keys at its ends."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the key that the last batch ended with
        opening = True

        def decide(rows: list[np.ndarray], first_open: bool, last_open: bool) -> pa.RecordBatch:
            h1, h2, doc, version, pos = rows
            n = len(h1)
            key = np.ones(n, bool)
            key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new = key.copy()
            new[1:] |= doc[1:] != doc[:-1]
            start = np.flatnonzero(key)
            run = np.cumsum(key) - 1
            seen = np.cumsum(new)
            order = seen - seen[start][run]  # 0 for the largest document of the key
            docs = np.add.reduceat(new.astype(np.int64), start) if n else start
            edge = np.zeros(len(start), bool)
            edge[:1] |= first_open
            edge[-1:] |= last_open  # the same key where there is but one
            pending = edge[run]
            out = pending | ((order >= 1) & (docs[run] >= min_docs))
            return pa.RecordBatch.from_arrays(
                [pa.array(x[out]) for x in (doc, version, pos, h1, h2)] + [pa.array(pending[out]), pa.array((new & pending).astype(np.int64)[out])],
                ["doc_id", "version", "pos", "h1", "h2", "pending", "docs"],
            )

        def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        release_memory()
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(5)]
            if not len(rows[0]):
                continue
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(other[-1] + 1) if len(other) else 0
            if held and not cut and (held[0][0][0], held[0][1][0]) != (rows[0][0], rows[1][0]):
                yield decide(joined(held), opening, False)
                held, opening = [], False
            if cut:
                yield decide(joined([*held, [x[:cut] for x in rows]]), opening, False)
                held, opening = [], False
            held.append([x[cut:] for x in rows])
        if held:
            yield decide(joined(held), opening, True)

    return walk


def drop_marks(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, version, pos)`` of every line to drop; ``version`` tells texts of one id apart.

    Rows without an id or text have no lines here. No rows give no rows; columns other than
    ``doc_id`` and ``text`` aren't read.
    """
    lines = (
        docs.where("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "version", F.col("pos").cast("long").alias("pos"), line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "version", "pos")
    )
    # sampling for the ranges and dealing read these short rows; texts are split once
    lines = written(lines, "line-hashes")
    ordered = lines.repartitionByRange("h1", "h2", F.col("doc_id").desc()).sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), "version", "pos")
    marks = written(ordered.mapInArrow(_marks(min_docs), "doc_id long, version long, pos long, h1 long, h2 long, pending boolean, docs long"), "line-marks")
    pending = marks.where("pending")
    # at most two keys a partition
    stats = pending.groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    settled = pending.join(F.broadcast(stats), ["h1", "h2"]).where("doc_id < keeper")
    return marks.where("not pending").select("doc_id", "version", "pos").union(settled.select("doc_id", "version", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """A row per document and text: ``(doc_id, version, n_lines, n_dropped, keep)``.

    ``keep`` is a zlib-compressed bitmap, a bit a line, and null where every line stays. A key found
    in ``min_docs`` documents or more keeps its lines in the largest ``doc_id`` holding it. A null or
    empty text is one empty line. Rows without an id keep all lines and count for no key; rows that
    repeat an id count as one document; equal rows share a bitmap.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(1)).alias("n_lines"), F.lit(None).cast("long").alias("pos"))
    marks = drop_marks(docs, min_chars, min_docs).withColumn("n_lines", F.lit(None).cast("int")).select("doc_id", "version", "n_lines", "pos")
    rows = base.union(marks).groupBy("doc_id", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drops"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            n, drops, keep = b.column(2).to_numpy(), b.column(3), []
            for i in range(b.num_rows):
                at = drops[i].values.to_numpy()
                if not len(at):
                    keep.append(None)
                    continue
                bits = np.ones(n[i], np.uint8)
                bits[at] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            counts = pa.array(np.diff(drops.offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int64()), counts, pa.array(keep, pa.binary())], ["doc_id", "version", "n_lines", "n_dropped", "keep"])

    return rows.mapInArrow(pack, "doc_id long, version long, n_lines long, n_dropped long, keep binary")


def _apply(text: str, keep: bytes) -> str:
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits.tolist(), strict=True) if bit)


def kept_texts(docs: DataFrame, bitmaps: DataFrame, kept: str = "kept", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with what the bitmaps keep of each text in ``kept``, and the line counts.

    A null text keeps the empty line. Columns of ``docs`` under the three given names are replaced,
    all others stay as they are.
    """
    id_, version, keep, lines, dropped = private("id", "version", "keep", "lines", "dropped")
    b = bitmaps.select(F.col("doc_id").alias(id_), F.col("version").alias(version), F.col("n_lines").alias(lines), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep))

    @F.pandas_udf("string")
    def applied(text: pd.Series, keep: pd.Series) -> pd.Series:
        release_memory()
        return pd.Series([t if k is None else _apply(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)

    joined = docs.join(b, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(version)))
    joined = joined.withColumns({kept: F.coalesce(applied("text", keep), F.lit("")), n_lines: F.col(lines), n_dropped: F.col(dropped)})
    return joined.drop(id_, version, keep, lines, dropped)


def digests(docs: DataFrame) -> DataFrame:
    """Line counts and the SHA-256 of what is kept, a row a row; see ``keep_bitmaps`` for odd rows."""
    rows = docs.select("doc_id", "text")
    return kept_texts(rows, keep_bitmaps(rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
with lines as (
  select doc_id, i, l, translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) i from documents)),
hot as (select k, max(doc_id) keeper from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select lines.*, keeper is not null and doc_id < keeper as gone from lines left join hot using (k))
select doc_id, cast(count(*) as bigint) n_lines, cast(count(*) filter (gone) as bigint) n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (not gone), '')) kept_sha256
from marked group by doc_id
"""
