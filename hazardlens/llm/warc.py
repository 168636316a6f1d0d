"""WARC archives with revisit records, read back through an externally merged index.

Records are written by Spark's text sink: two CRLFs end a record, which is the sink's line separator
here. Reading back, a task parses archives by Content-Length and gives the captures of each archive
as a run sorted by URL key and time. Runs are dealt by ranges of that order, and every range merges
its pieces of the runs with a loser tree, so partitions together hold globally ordered histories.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_enough, written

#: Bytes of payload that an archive holds about, before compression; pages of more than BIG times
#: the mean stand in archives of their own kind, so that they don't make all archives short.
ARCHIVE, BIG = 16_000_000, 64
#: Rows of a run that are held as Python objects while runs are merged.
AHEAD = 64
#: Up to so many digests with several payloads are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Columns of a capture and their types.
CAPTURE = {"urlkey": "string", "captured": "string", "page_id": "long", "archive": "string", "offset": "long", "length": "long", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long"}
_TYPES = {"string": pa.string(), "long": pa.int64()}


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels from the right, then the path; scheme and port drop out."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + ("?" + u.query.lower() if u.query else "")


def records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``(record, payload_bytes)``: a WARC record per page as text, without the two CRLFs at its end.

    Of pages with equal payloads of ``least_bytes`` or more, the largest page_id is the response.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(F.encode(payload, "utf-8")).alias("digest"))
    keepers = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "keeper")
    keepers = written(keepers, "warc-keepers")
    keepers = F.broadcast(keepers) if small_enough(keepers, BROADCAST_ROWS) else keepers
    rows = rows.join(keepers, F.col("digest") == F.col("_digest"), "left")
    revisit = F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number("page_id"), F.lit(">"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), number("keeper"), F.lit(">")))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("html"))).alias("record"), "bytes")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """Write gzip-compressed archives of about ARCHIVE bytes below ``path``.

    Pages of more than BIG times the mean size, of which there are few, go into archives of their
    own, so an archive of others is at most BIG times ARCHIVE bytes long whatever the largest page is.
    """
    bytes_ = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    mean = float(pages.agg(F.avg(bytes_)).first()[0] or 0) + 500
    n, big_mean = pages.where(bytes_ > BIG * mean).agg(F.count("*"), F.avg(bytes_)).first()
    found = records(pages, least_bytes)
    kinds = [("others", F.col("bytes") <= BIG * mean, mean)] + ([("big", F.col("bytes") > BIG * mean, float(big_mean))] if n else [])
    for name, chosen, size in kinds:
        each = max(1, int(ARCHIVE / size))
        found.where(chosen).select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", each).text(f"{path}/{name}")


def parse(archive: str, data: bytes) -> list[tuple]:
    """Captures of one archive, sorted by URL key, time and page; payloads are held against their digests."""
    raw, at, out = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0, []
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[at:end].decode().split("\r\n")[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive}: no record ends at {stop}")
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
        kind = head["WARC-Type"]
        if kind == "response":
            digest, size = hashlib.sha1(raw[start:stop]).hexdigest(), stop - start
            if digest != head["WARC-Payload-Digest"].removeprefix("sha1:"):
                raise ValueError(f"{archive}: payload at {start} doesn't match its digest")
        page, ref = head["WARC-Record-ID"][10:-1], head.get("WARC-Refers-To", "<urn:page:>")[10:-1]
        out.append((url_key(head.get("WARC-Target-URI", "")), head["WARC-Date"], int(page) if page else None, archive, at, stop - at, kind, size, digest, int(ref) if ref else None))
        at = stop + 4
    return sorted(out, key=order)


def order(capture: tuple) -> tuple:
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[3], capture[4]


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so a new head plays one path.

    Runs are gone through once, and of each only its head is held.
    """

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs, self.rows = [], []
        for run in map(iter, runs):
            row = next(run, None)
            if row is not None:
                self.runs.append(run)
                self.rows.append(row)
        self.heads = [order(r) for r in self.rows]
        self.losers = [-1] * max(len(self.runs), 1)
        for i in range(len(self.runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run ``a`` goes before run ``b``; an ended run goes last."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its match
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[w := self.losers[0]] is not None:
            yield self.rows[w]
            row = self.rows[w] = next(self.runs[w], None)
            self.heads[w] = None if row is None else order(row)
            self._play(w)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, t in enumerate(CAPTURE.values())], list(CAPTURE))


def _run(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of one run's pieces, AHEAD at a time; how Spark shipped them may have turned their order."""
    run = pa.Table.from_batches(pieces)
    keys = ("urlkey", "captured", "page_id", "archive", "offset")
    run = run.take(pc.sort_indices(run, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start"))
    for b in run.to_batches(max_chunksize=AHEAD):
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def capture_histories(archives: DataFrame) -> DataFrame:
    """Globally ordered captures of ``archives(path, content)``: by URL key, time and page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = parse(b.column(0)[i].as_py().rsplit("/", 1)[-1], b.column(1)[i].as_py())
                for a in range(0, len(rows), 5_000):
                    yield _batch(rows[a : a + 5_000])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces of a run arrive in its order, those of different runs in turn; all stay packed in Arrow
        runs: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            ends = [*pc.run_end_encode(b.column("archive")).run_ends.to_pylist()] if b.num_rows else []
            for start, end in zip([0, *ends], ends, strict=False):
                runs.setdefault(b.column("archive")[start].as_py(), []).append(b.slice(start, end - start))
        out = []
        for row in LoserTree(_run(pieces) for pieces in runs.values()):
            out.append(row)
            if len(out) == 5_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    kinds = ", ".join(f"{c} {t}" for c, t in CAPTURE.items())
    runs = written(archives.mapInArrow(read, kinds), "warc-runs")
    return runs.repartitionByRange("urlkey", "captured", "page_id", "archive", "offset").mapInArrow(merge, kinds)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in the shared folder, and give their captures.

    A null html is an empty payload, a null url an empty one; a row without page_id is a response
    that refers to nothing. Rows that repeat a page_id each have a record. No rows give no archives
    and no captures.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    return capture_histories(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def read_back(pages: DataFrame) -> DataFrame:
    """What the archives say of each page; see ``round_trip`` for odd rows. Other columns aren't read."""
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


READ_BACK_SQL = r"""
with p as (select page_id, strlen(coalesce(html, '')) b, sha1(coalesce(html, '')) d from pages),
k as (select d, max(page_id) keeper from p where b >= 1000 group by d having count(*) > 1)
select page_id, cast(b as bigint) payload_bytes, d as payload_digest, case when page_id < keeper then 'revisit' else 'response' end record_type,
  case when page_id < keeper then keeper end refers_to from p left join k using (d)
"""
