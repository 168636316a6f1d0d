"""Jaccard self-join of documents on word n-grams by T-occurrence search.

1. Which documents can link at all? A link needs a share of a document's shingles to stand in
   another one. Shingles of a fixed part of the hash space are gathered, packed, by bucket; each
   document gets a count of its shingles that some other set holds, and goes on only if enough.
   Small sets give all their shingles, but are tested on all only if no partner gives just the part.
   Sets gathered together are counted among themselves at once, so a shingle that very many hold
   goes to its bucket once for each gathering, and not once for each document.
2. Documents with the same set become one. Of those left, shingles that at least two share are
   ordered from rare to frequent; a link must show within the rare end (prefix), so documents that
   meet there fall into clusters, by distributed components.
3. In every cluster, T-occurrence search by DivideSkip: short inverted lists are merged by a heap,
   long ones are probed by binary search. A large cluster is split into pairs of blocks, or into the
   lists of its prefixes (and these into blocks), whichever needs fewer sets to be read. Pairs that
   are already connected aren't tried again, which loses no component.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt_join, hot_keys, release_memory, small_enough, worker_memory, written

#: Part of the hash space gathered in step 1, in eighths; sets under SMALL shingles give them all.
EIGHTHS, SMALL = 3, 64
#: Postings a worker gathers before it packs them, and documents among them at most; the place that
#: stands for sets which were counted already.
FLUSH, FLUSH_DOCS, COUNTED = 1_000_000, 30_000, 0xFFFF
#: Documents of a bucket, about, and postings of a task that counts buckets.
BUCKET_DOCS, TASK = 2_000, 5_000_000
#: Shingles of a block in step 3.
BLOCK = 250_000
#: Up to so many rows (16 bytes each) a table of ids is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = 5, known: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of all its words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map((_WordHashes() if known is None else known).__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h += _mixed(w[i : len(w) - k + 1 + i] * np.uint64(_MULTIPLIERS[i % 8]) + np.uint64(i))
    return np.unique(_mixed(h))


def _least_overlap(n, percent: int):
    """Shingles that a set of ``n`` must share with any set it links with."""
    return (n * percent + 99) // 100


def _common(h: np.ndarray) -> np.ndarray:
    """Hashes in the part of the hash space that sets of every size give."""
    return h[: np.searchsorted(h, np.uint64(EIGHTHS << 61))]


def _tested_whole(n, percent: int):
    """Whether all partners of a set of ``n`` give all their hashes: they have under SMALL."""
    return n * 100 < percent * SMALL


def _gather(n: int, bits: int, percent: int):
    """Rows of documents (kind 0) and of packed postings by bucket (kind 1)."""
    import xxhash

    names = ["kind", "flush", "place", "doc_id", "version", "n", "window", "k1", "k2", "met", "met_in_common", "bucket", "postings", "hashes", "owners"]
    plain = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        hashes = worker_memory("shingles", _WordHashes)
        rows: list[tuple] = []
        sets: dict[bytes, int] = {}
        kept: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, sets, kept, total, number
            if not rows:
                return
            fid = (task << 24) + number
            number += 1
            h = np.concatenate(kept) if kept else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
            by = np.argsort(h, kind="stable")
            h, owner = h[by], owner[by]
            # shingles that several of these sets hold: all of them are counted now, one posting tells the others
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            several = ~first
            several[:-1] |= ~first[1:]
            met = np.bincount(owner[several], minlength=len(kept))
            met_in_common = np.bincount(owner[several & (h < np.uint64(EIGHTHS << 61))], minlength=len(kept))
            cols = list(zip(*rows, strict=True))
            m, places = len(rows), np.array(cols[0])
            values = [pa.array(c, t) for c, t in zip(cols, plain[:7], strict=True)] + [pa.array(met[places]), pa.array(met_in_common[places])]
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([fid] * m, pa.int64()), *values, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names)
            h, owner = h[first], np.where(several, COUNTED, owner)[first].astype(np.uint16)
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            low = np.ascontiguousarray((h << np.uint64(bits) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            starts = np.concatenate([[0], cut]) if len(h) else np.empty(0, np.int64)
            ends = np.concatenate([cut, [len(h)]]) if len(h) else np.empty(0, np.int64)
            for a in range(0, len(starts), 512):
                s, e = starts[a : a + 512], ends[a : a + 512]
                k = len(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1] * k, pa.int32()), pa.array([fid] * k, pa.int64()), *(pa.nulls(k, t) for t in plain), pa.array(bucket[s]), pa.array(e - s), pa.array([low[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary()), pa.array([owner[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary())],
                    names,
                )
            rows, sets, kept, total = [], {}, [], 0

        for batch in batches:
            ids, versions, texts = batch.column(0), batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                h = shingles(texts[i].as_py(), n, hashes)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                k1, k2 = np.frombuffer(digest, np.int64).tolist()
                common = _common(h)
                part = h if len(h) < SMALL else common
                place = sets.get(digest)
                if place is None:
                    place = sets[digest] = len(kept)
                    kept.append(part)
                    total += len(part)
                rows.append((place, ids[i].as_py(), versions[i].as_py(), len(h), len(h) if _tested_whole(len(h), percent) else len(common), k1, k2))
                if total >= FLUSH or len(rows) >= FLUSH_DOCS:
                    yield from flush()
        yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket: how many of each owner's postings stand in another gathering too."""
    release_memory()
    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[0] != held[-1][0] and size >= FLUSH:
                yield _counted(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3]) // 2
    if held:
        yield _counted(held)


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    """Counts of whole buckets given as ``(bucket, flush, hashes, owners)``."""
    bucket, flushes, raw, owners = zip(*rows, strict=True)
    size = np.array([len(x) // 2 for x in owners])
    h = np.zeros((size.sum(), 8), np.uint8)
    h[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
    number = np.cumsum(np.diff(np.array(bucket), prepend=bucket[0]) != 0)  # of the bucket, among these
    h = h.view("<u8")[:, 0] | np.repeat(number.astype(np.uint64) << np.uint64(40), size)
    owner = np.frombuffer(b"".join(owners), np.uint16).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(h, kind="stable")
    h, owner, row = h[order], owner[order], row[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    held = same.copy()
    held[:-1] |= same[1:]
    held &= owner != COUNTED
    keys, n = np.unique(row[held] << 16 | owner[held], return_counts=True)
    row = keys >> 16
    return pa.RecordBatch.from_arrays([pa.array(np.array(flushes)[row]), pa.array((keys & 0xFFFF).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(np.array(bucket)[row])], ["flush", "place", "shared", "bucket"])


class _Groups:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.up[b] = a
            self.size[a] += self.size[b]


def divide_skip(sets: list[np.ndarray], percent: int = 80, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among ``sets`` that suffice to connect all that linked sets connect.

    Every set is a query against the inverted lists of all: its longest lists are put aside, the
    others merged; whoever stands in enough of these is looked up in the long ones by binary
    search. Sets of the largest group found so far are put off; in the end, those of one group need
    no query, as a pair that would join two groups has an end outside it, and the others are queried
    after all. With ``sides``, only pairs across the two sides are wanted.
    """
    n, links, groups = len(sets), [], _Groups(len(sets))
    if n < 2:
        return links
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(h, kind="stable")
    h, owner = h[by], owner[by]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    values, lengths = h[start], np.diff(np.append(start, len(h)))
    places = [np.searchsorted(values, s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    weight = np.array([lengths[p].sum() for p in places])

    def query(x: int) -> None:
        p = places[x]
        p = p[lengths[p] > 1]
        need = int(_least_overlap(sizes[x], percent))
        if len(p) < need:
            return
        p = p[np.argsort(lengths[p], kind="stable")]
        long = min(need - 1, int(need / (0.0085 * log2(lengths[p[-1]]) + 1)))
        short, long_ = p[: len(p) - long], p[len(p) - long :]
        hits = _merge([owner[start[i] : start[i] + lengths[i]] for i in short.tolist()], need - long)
        probes = np.sort(values[long_])
        root = groups.find(x)
        for y, count in hits:
            if y == x or groups.find(y) == root or (sides is not None and sides[x] == sides[y]):
                continue
            if not percent * sizes[x] <= 100 * sizes[y] or not percent * sizes[y] <= 100 * sizes[x]:
                continue
            s = sets[y]
            at = np.searchsorted(s, probes)
            common = count + int((s[np.minimum(at, len(s) - 1)] == probes).sum())
            if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                links.append((x, y))
                groups.join(x, y)
                root = groups.find(x)

    largest, put_off = 0, []
    for x in np.argsort(-weight, kind="stable").tolist():
        if groups.size[groups.find(largest)] > 1 and groups.find(x) == groups.find(largest):
            put_off.append(x)
            continue
        query(x)
        if groups.size[groups.find(x)] > groups.size[groups.find(largest)]:
            largest = x
    # one group for all that stay without a query: the one that holds most of them
    held = Counter(map(groups.find, put_off))
    spared = max(held, key=held.get, default=0)
    for x in put_off:
        if groups.find(x) != groups.find(spared):
            query(x)
    return links


def _merge(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Members of at least ``least`` sorted lists and in how many they are.

    By a heap over the lists' heads that skips to the least-th smallest head.
    """
    rows = [x.tolist() for x in lists]
    heap = [(row[0], i, 0) for i, row in enumerate(rows) if row]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out.append((top, len(popped)))
            target = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, i, at in popped:
            row = rows[i]
            at += 1
            while at < len(row) and row[at] < target:
                at += 1
            if at < len(row):
                heapq.heappush(heap, (row[at], i, at))
    return out


def links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents, links): ``(doc_id, version, n_shingles, k1, k2)`` of every row, and links ``(a, b)``
    between documents of different sets, enough to connect all that linked documents connect."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    # up to 24 bits the five bytes kept of a hash and its bucket tell all of it; beyond, a few more sets go on
    bits = max(8, int(log2(max(rows.count(), 1) / BUCKET_DOCS + 1)) + 1)
    gathered = written(
        rows.mapInArrow(_gather(n, bits, percent), "kind int, flush long, place int, doc_id long, version long, n int, window int, k1 long, k2 long, met long, met_in_common long, bucket long, postings long, hashes binary, owners binary"),
        "shingle-postings",
    )
    known = gathered.where("kind = 0")
    packed = gathered.where("kind = 1")
    tasks = int((packed.agg(F.sum("postings")).first()[0] or 0) / TASK) + 1
    packed = packed.select("bucket", "flush", "hashes", "owners")
    # no task has more than about TASK postings, whatever the number of shuffle partitions is set to
    packed = packed.repartition(tasks, "bucket") if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else packed.repartition("bucket")
    counts = packed.sortWithinPartitions("bucket").mapInArrow(_shared, "flush long, place int, shared long, bucket long")
    in_common = F.when(F.col("bucket") < EIGHTHS << (bits - 3), F.col("shared"))
    counts = counts.groupBy("flush", "place").agg(F.sum("shared").alias("shared"), F.sum(in_common).alias("in_common"))
    can_miss = F.col("n") - _floor_div(F.col("n") * percent + 99, 100)
    possible = known.where("n > 0 and doc_id is not null").join(counts, ["flush", "place"], "left").where(F.when(_tested_whole(F.col("n"), percent), F.col("met") + F.coalesce("shared", F.lit(0))).otherwise(F.col("met_in_common") + F.coalesce("in_common", F.lit(0))) >= F.greatest(F.col("window") - can_miss, F.lit(0)))
    heads = written(possible.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "version")).alias("d")).select("d.doc_id", "d.version").distinct(), "shingle-heads")
    found = rows.join(F.broadcast(heads) if small_enough(heads, BROADCAST_ROWS) else heads, ["doc_id", "version"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_memory("shingles", _WordHashes)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, n, hashes).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    held = written(found.dropDuplicates(["doc_id", "version"]).select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles array<long>"), "shingle-sets")
    size = F.size("shingles").alias("n")
    postings = held.select("doc_id", size, F.explode("shingles").alias("h"))
    often = postings.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    need = _floor_div(F.col("n") * percent + 99, 100)
    prefixes = (
        postings.join(often, "h")
        .groupBy("doc_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("s"))
        .where(F.size("s") >= need)
        .select("doc_id", F.explode(F.slice("s", F.lit(1), F.size("s") - need.cast("int") + 1)).alias("p"))
        .select("doc_id", F.col("p.h").alias("h"))
    )
    prefixes = written(prefixes, "shingle-prefixes")
    lists = written(prefixes.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1"), "shingle-lists")
    meet = dealt_join(prefixes, lists, "h", hot_keys(lists, "h", "k"), "doc_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    clusters = written(components(meet), "shingle-clusters")
    member = held.join(clusters, held.doc_id == clusters.node).select("doc_id", "component", "shingles", size)
    whole = clusters.join(held.select("doc_id", size), F.col("node") == F.col("doc_id")).groupBy("component").agg(F.sum("n").alias("load")).withColumn("blocks", F.ceil(F.col("load") / BLOCK).cast("int"))
    # Of clusters of several blocks: are the lists of their prefixes, each with its own blocks, less to read?
    large = whole.where("blocks > 1")
    parts = prefixes.join(clusters.join(large.select("component"), "component"), F.col("doc_id") == F.col("node")).join(lists.select("h"), "h").join(held.select("doc_id", size), "doc_id")
    parts = parts.groupBy("component", "h").agg(F.sum("n").alias("load")).withColumn("blocks", F.ceil(F.col("load") / BLOCK).cast("int"))
    cost = parts.groupBy("component").agg(F.sum(F.col("load") * F.col("blocks")).alias("by_lists"))
    split = written(large.join(cost, "component").where(F.col("by_lists") < F.col("load") * F.col("blocks")).select("component"), "shingle-splits")
    to_split = F.broadcast(split) if small_enough(split, BROADCAST_ROWS) else split
    kept_whole = member.join(to_split, "component", "left_anti").join(whole.select("component", "blocks"), "component").withColumn("h", F.lit(0).cast("long"))
    by_lists = member.join(to_split, "component").join(prefixes.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).join(parts.select("component", "h", "blocks"), ["component", "h"])
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = (
        kept_whole.unionByName(by_lists.drop("_id"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", "h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "shingles")
    )
    # many small clusters to a task, each with its own rows together
    dealt = dealt.repartition("component", "h", "x", "y").sortWithinPartitions("component", "h", "x", "y")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        at, docs_, own_, sets_ = None, [], [], []

        def solve() -> pa.RecordBatch:
            sides = np.array(own_) if at[2] != at[3] else None
            pairs = divide_skip(sets_, percent, sides)
            return pa.RecordBatch.from_arrays([pa.array([docs_[i] for i, _ in pairs], pa.int64()), pa.array([docs_[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            cs, hs, xs, ys, os_, ds, ss = b.columns
            keys = list(zip(cs.to_pylist(), hs.to_pylist(), xs.to_pylist(), ys.to_pylist(), strict=True))
            for i, key in enumerate(keys):
                if key != at and at is not None:
                    yield solve()
                    docs_, own_, sets_ = [], [], []
                at = key
                docs_.append(ds[i].as_py())
                own_.append(os_[i].as_py())
                sets_.append(ss[i].values.to_numpy().view(np.uint64))
        if at is not None:
            yield solve()

    edges = dealt.mapInArrow(search, "a long, b long")
    return known.select("doc_id", "version", F.col("n").cast("long").alias("n_shingles"), "k1", "k2"), edges


def _floor_div(a, b: int):
    return F.floor(a / b)


def join_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, version, n_shingles, component_id)`` for every row of ``docs``.

    Documents link when their sets of distinct word n-grams share ``percent`` or more of their
    union; ``component_id`` is the smallest id reachable by links. Texts of fewer than ``n`` words
    have one shingle, all their words; null, empty and blank texts have none and link with nothing,
    nor do rows without an id (their class is null). Rows that repeat an id are one document of
    whatever their texts link with.
    """
    known, edges = links(docs, n, percent)
    real = known.where("doc_id is not null and n_shingles > 0")
    heads = written(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")).where("rows > 1"), "shingle-copies")
    # copies of one set hang on its smallest id; one edge a document
    copies = dealt_join(real, heads, "k1", hot_keys(heads, "k1", "rows"), "doc_id", also=("k2",)).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    classes = components(edges.union(copies)).withColumnRenamed("node", "_node")
    return known.join(classes, F.col("doc_id") == F.col("_node"), "left").select("doc_id", "version", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """Set size and class of every row of ``docs``; see ``join_classes`` for odd rows."""
    return join_classes(docs).select("doc_id", "n_shingles", "component_id")


CLASSES_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
p as (select doc_id, hash(unnest(s)) h, len(s) n from sets),
pair as (select a.doc_id x, b.doc_id y from p a join p b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ as (select x, y from pair union all select y, x from pair),
reach(doc_id, r) as (select doc_id, doc_id from sets union select reach.doc_id, both_.y from reach join both_ on reach.r = both_.x)
select sets.doc_id, cast(len(s) as bigint) n_shingles, min(r) component_id from sets join reach using (doc_id) group by sets.doc_id, len(s)
"""
