"""A corpus from documents to tokens: language ID, line dedup, near duplicates, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
``documents``. What a stage decides takes effect: documents without a known language go, dropped
lines leave the text, one document of each group of near copies stays (the smallest doc_id), the
mix repeats or leaves out documents as its budgets say, and the last stage gives token digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import bpe, langid, linededup, mixing, ngramjoin
from hazardlens.llm.common import discard, in_bucket, passing, private, small_enough, table, written
from hazardlens.llm.queries import pattern, rank_path
from hazardlens.session import ship_package

#: Posterior under which a document's language counts as unknown.
LANGUAGE_FLOOR = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null, empty and letterless texts are rejected.

    Rows that repeat an id or a text are judged alike; a null id is no bar. No rows give no rows, and
    without a labelled row all are rejected. Columns of any other name go along unread.
    """
    ship_package(spark)
    model = langid.train(docs.where(~in_bucket("doc_id", 3, 1)), rank_path())
    (found,) = private("language")
    known = (F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= LANGUAGE_FLOOR)
    return docs.withColumn(found, langid.predicted(docs, model, F.col("text"))).where(known).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a larger id repeats.

    A null text stays null, rows without an id keep all lines, and rows that repeat an id count as
    one document. ``n_chars`` follows the text; other columns go along. No rows give no rows.
    """
    ship_package(spark)
    text, lines, dropped = private("text", "lines", "dropped")
    kept = linededup.kept_texts(docs, linededup.keep_bitmaps(docs), text, lines, dropped)
    new = F.when(F.col("text").isNotNull(), F.col(text))
    changed = {"text": new, "n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id; rows without an id stay.

    Of rows that repeat an id, the one with the least text (null first) goes on. Texts without a word
    have no copies. Other columns go along; no rows give no rows.
    """
    ship_package(spark)
    # Rows that repeat an id: one text of each id goes on. Ids alone are counted; texts move only if some repeat.
    (n, row) = private("n", "row")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1).select("doc_id")
    if repeated.limit(1).count():
        again = docs.join(repeated, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])).alias(row))
        docs = written(docs.join(repeated, "doc_id", "left_anti").unionByName(again.select("doc_id", f"{row}.*").select(*_columns(docs))), "distinct-ids")
    losers = written(ngramjoin.join_classes(docs).where("doc_id <> component_id").select("doc_id"), "near-copies")
    return docs.join(F.broadcast(losers) if small_enough(losers, ngramjoin.BROADCAST_ROWS) else losers, "doc_id", "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or in several epochs.

    A null source is a source of its own; texts without words take up no budget and go. Rows that
    are alike in id and text are taken as often as the one of them that is taken most; other columns
    go along. No rows give no rows.
    """
    ship_package(spark)
    id_, version, epochs, epoch = private("id", "version", "epochs", "epoch")
    plan = mixing.mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias(id_), F.col("version").alias(version)).agg(F.max(F.expr("cast(taken div size as int)")).alias(epochs))
    taken = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(version)))
    return taken.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(epochs)))).select(*_columns(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of the bytes they decode to, a row a row.

    A null text has no tokens. Columns other than ``doc_id`` and ``text`` aren't read; no rows give
    no rows.
    """
    ship_package(spark)
    return bpe.digests(docs, rank_path(), pattern())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Language ID and BPE can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage has written for itself is deleted when its result is there, and so is the result of
    the stage before it.
    """
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing() as gone:
            kept = written(stage(spark, docs, sf_dir), name)
            gone.pop()  # the result, which was written last
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
