"""Byte-level BPE as a monoid: encodings of two neighbouring byte runs join into the encoding of both.

A run of bytes is encoded by encoding its halves and joining them. The join rests on one fact about
rank-ordered merging: a token row is what merging yields if and only if every two neighbours of it
are what merging yields from their own bytes. So a join re-encodes a window of tokens around the
border, and widens it on a side while the window's outer token and the token next to it would not
stay apart; once both sides hold, nothing outside the window can change. Decoding is the plain
homomorphism: bytes of the halves, concatenated.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import worker_memory

#: Bytes up to which a run is merged directly, and up to which a run's ids are remembered.
LEAF, KEPT = 4, 12
#: Entries a worker's memory of words, runs or neighbour tests holds before the older half goes.
CACHE = 150_000
#: A space between two characters that aren't white space; the usual text has no other spaces.
_SINGLE, _OTHER = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s|\A |\s\Z")
#: Patterns of which no match spans the place before such a space.
CUT_AT_SPACES = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of ``base64 rank`` lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class BytePairCodec:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.spaced = pattern in CUT_AT_SPACES
        self.pairs = _Memory(lambda ab: self.merged(self.token[ab[0]] + self.token[ab[1]]))
        self.runs = _Memory(self.split)
        self.first = _Memory(lambda w: self.word(w, self.first))
        self.later = _Memory(lambda w: self.word(" " + w, self.later))
        self.marks = {m: struct.pack("<I", ranks[m.encode()]) for m in ".,;:!?"} if self.matches("a.") == ["a", "."] else {}

    # -- merging of a short run -------------------------------------------------------------

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Ids after merging by rank, lowest first and leftmost first among equals."""
        if len(data) > 64:
            return self._merged_long(data)
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        end, nxt, prev = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and nxt[i] == j and end[j] == stop):
                continue
            end[i], nxt[i], alive[j] = stop, nxt[j], False
            if nxt[i] < n:
                prev[nxt[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return tuple(ranks[data[i : end[i]]] for i in range(n) if alive[i])

    # -- the monoid -------------------------------------------------------------------------

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """Ids of the two runs together."""
        if not a or not b:
            return a or b
        pair = self.pairs
        window, i, j = pair[a[-1], b[0]], 1, 1
        if window == (a[-1], b[0]):
            return a + b
        while True:
            left = i == len(a) or pair[a[-i - 1], window[0]] == (a[-i - 1], window[0])
            right = j == len(b) or pair[window[-1], b[j]] == (window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i = i if left else min(len(a), 2 * i)
            j = j if right else min(len(b), 2 * j)
            window = self.merged(b"".join(map(self.token.__getitem__, a[len(a) - i :] + b[:j])))

    def split(self, data: bytes) -> tuple[int, ...]:
        """Ids of a run of bytes: those of its halves, joined."""
        n = len(data)
        return self.merged(data) if n <= LEAF else self.join(self.run(data[: n // 2]), self.run(data[n // 2 :]))

    def run(self, data: bytes) -> tuple[int, ...]:
        return self.runs[data] if len(data) <= KEPT else self.split(data)

    def match(self, data: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern; a match that is itself a token stays whole."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.run(data)

    # -- texts ------------------------------------------------------------------------------

    def packed(self, text: str) -> bytes:
        """Ids of every match in ``text`` as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        for m in self.matches(text):
            out += self.match(m.encode())
        return struct.pack(f"<{len(out)}I", *out)

    def word(self, text: str, memory: dict[str, bytes]) -> bytes:
        """Packed ids of a word with or without a space before it; ``memory`` holds words of its kind."""
        bare = text[1:] if memory is self.later else text
        if bare.isalpha():
            ids = self.match(text.encode())
            return struct.pack(f"<{len(ids)}I", *ids)
        if bare[:-1].isalpha() and bare[-1] in self.marks:
            return memory[bare[:-1]] + self.marks[bare[-1]]
        return self.packed(text)

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; null gives none.

        Under the patterns of CUT_AT_SPACES, no match spans the place before a single space between
        two characters that aren't white space, so the text falls apart there into words that can be
        encoded alone and remembered. Under other patterns all matches are encoded one by one.
        """
        if not text:
            return b""
        if not self.spaced:
            return self.packed(text)
        first, *rest = _SINGLE.split(text) if _OTHER.search(text) else text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.token.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))


class _Memory(dict):
    """Remembers what ``make`` gave for a key; when full, only what was used since it last was stays."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = found
        return found


def codec(data: bytes, pattern: str) -> BytePairCodec:
    """This worker's codec for a rank file."""
    return worker_memory(("bpe", hash(data), pattern), lambda: BytePairCodec(read_ranks(data), pattern))


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again: ``(id, n_tokens, ids, decoded)``, a row a row.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes of their tokens. Null
    and empty texts give no ids; a null id passes through; repeated rows are encoded each; other
    columns aren't read. No shuffle: the table of ranks, bounded by the vocabulary, is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    with open(rank_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            size, start = 0, 0
            ids: list[bytes] = []
            back: list[bytes] = []
            for i in range(batch.num_rows):
                ids.append(c.encode(batch.column(1)[i].as_py()))
                back.append(c.decode(ids[-1]))
                size += len(ids[-1]) + len(back[-1])
                if size > 4_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, i + 1 - start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                        ["id", "n_tokens", "ids", "decoded"],
                    )
                    size, start, ids, back = 0, i + 1, [], []

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(trips, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Token count and SHA-256 of the ids and of the decoded bytes of every document."""
    return round_trip(docs, rank_path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
