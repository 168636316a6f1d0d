"""Audits of stored tables and corpora: shapes, versions, outcomes, tag support, ids, coverage, usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def _parts(frames: dict[str, DataFrame]) -> DataFrame:
    """Long table ``(part, name, n)`` of frames ``(name, n)``."""
    long = lambda part, df: df.select(F.lit(part).alias("part"), F.col(df.columns[0]).cast("string").alias("name"), F.col(df.columns[1]).cast("long").alias("n"))
    return reduce(DataFrame.union, [long(part, df) for part, df in frames.items()])


def stored_shape(reports: DataFrame, classifications: DataFrame, tags: DataFrame, spans: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """What an ingest stored: verdicts, statuses, languages, tags, tagged and untagged reports, spans, and how many scores a density table holds."""
    tagged = reports.select("report_id").join(tags.select("report_id").distinct().withColumn("t", F.lit("tagged")), "report_id", "left")
    return _parts(
        {
            "sif_potential": classifications.groupBy("sif_potential").count(),
            "status": reports.groupBy("status").count(),
            "language": reports.groupBy("language_detected").count(),
            "tags": tags.agg(F.lit("tags"), F.count("*")),
            "tagging": tagged.groupBy(F.coalesce("t", F.lit("untagged"))).count(),
            "spans": spans.agg(F.lit("spans"), F.count("*")),
            **({} if density is None else {"density": density.agg(F.lit("distinct rank scores"), F.countDistinct("rank_score"))}),
        }
    )


def version_census(classifications: DataFrame, version: str = "model_version", stale: str = "interim") -> DataFrame:
    """Verdicts of each model version; those whose name begins with ``stale`` are marked."""
    return classifications.groupBy(F.col(version).alias("model_version")).agg(F.count("*").alias("n")).withColumn("stale", F.coalesce(F.col("model_version").startswith(stale), F.lit(False)))


def outcome_table(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Rows of each combination of outcome flags; a missing outcome counts as none."""
    return rows.groupBy(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()]).agg(F.count("*").alias("n"))


def outcome_margins(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``outcome_table`` with its margins: a flag that is null is summed over, and ``level`` says which are."""
    named = rows.select(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()])
    return named.cube(*flags).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def tag_support(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """Per rule: rows that have it, whether a model can be fitted on it, whether it is the rarest such rule."""
    names = rows.sparkSession.createDataFrame([(i, r) for i, r in enumerate(fixed.RULES)], "ordinal int, rule_name string")
    held = rows.select(F.explode(F.array_distinct(tags)).alias("rule_name")).groupBy("rule_name").agg(F.count("*").alias("support"))
    out = names.join(F.broadcast(held.where(F.col("rule_name").isin(*fixed.RULES))), "rule_name", "left").withColumn("support", F.coalesce("support", F.lit(0)))
    # one row: nine rules at most stand behind it
    rarest = out.where("support > 0").agg(F.min_by("rule_name", F.struct("support", "ordinal")).alias("_rarest"))
    return out.join(F.broadcast(rarest)).withColumn("trainable", F.col("support") > 0).withColumn("rarest", F.coalesce(F.col("rule_name") == F.col("_rarest"), F.lit(False))).drop("_rarest")


def tags_per_row(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """How many rows have how many tags; no list is no tags."""
    return rows.groupBy(F.coalesce(F.array_size(tags), F.lit(0)).alias("n_tags")).agg(F.count("*").alias("n"))


def usage(calls: DataFrame, model: str, tokens_in: Column, tokens_out: Column, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """Calls, tokens and cost of an annotation run by model; prices are for a million tokens."""
    out = calls.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("calls"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
    return out.withColumn("tokens", F.col("tokens_in") + F.col("tokens_out")).withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows, ids, and rows beyond the first of their id; a null id is an id like others."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("ids")).withColumn("repeated", F.col("n_rows") - F.col("ids"))


def selected(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is wanted, wanted ids that no row has)."""
    ids = wanted.select(key).distinct()
    return rows.join(ids, key, "left_semi"), ids.join(rows, key, "left_anti")


def without_span(corpus: DataFrame, span: str = "precursor_barrier_failure", order: str = "id", limit: int | None = None) -> DataFrame:
    """Rows to extract a span from again, in order of id; all of them unless a limit is asked for."""
    rows = corpus.where(F.col(span).isNull()).orderBy(order)
    return rows if limit is None else rows.limit(limit)


def coverage(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that have each column before and after a backfill."""
    count = lambda df, name: df.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "field", name)
    return count(before, "before").join(count(after, "after"), "field").withColumn("filled", F.col("after") - F.col("before"))


def corpus_records(rows: DataFrame, body: str = "raw_text", tags: str = "iogp_rules") -> DataFrame:
    """Annotated rows as corpus records: known tags kept, others set apart, quotes located in the text.

    ``precursor_<type>`` holds a quote on the way in and ``struct<text, start, end>`` (null if the
    text doesn't hold it) on the way out.
    """
    known = F.array(*[F.lit(r) for r in fixed.RULES])
    out = rows.withColumn("iogp_rules_rejected", F.array_except(F.coalesce(tags, F.array().cast("array<string>")), known)).withColumn("iogp_rules", F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda r: F.array_contains(known, r)))
    return out.withColumns({f"precursor_{t}": text.located(F.col(body), text.ascii_punctuation(F.col(f"precursor_{t}"))) for t in fixed.ENTITY_TYPES})


def stratum_table(folds: DataFrame, strata: list[str]) -> DataFrame:
    """Per stratum: rows, those of either fold, and whether it was too small to give a test row."""
    out = folds.groupBy(*strata).agg(F.count("*").alias("total"), F.count_if(F.col("fold") == "train").alias("train"), F.count_if(F.col("fold") == "test").alias("test"))
    return out.withColumn("too_small", F.col("test") == 0)


def verified(found: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """``(check, got, want, ok)`` of counts against published ones; a check that one side lacks isn't ok."""
    got = found.select(F.col(key).alias("check"), F.col(value).alias("got"))
    want = wanted.select(F.col(key).alias("check"), F.col(value).alias("want"))
    return got.join(want, "check", "full").withColumn("ok", F.coalesce(F.col("got") == F.col("want"), F.lit(False)))
