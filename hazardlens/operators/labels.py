"""Rule labels, audits of titles and codes, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, stats, text
from ..session import small_side
from .ranks import ranked_within


def label_rule(rows: DataFrame, event: str = "event_title", nature: str = "nature_title") -> DataFrame:
    """Hits of the four tests, their union and the hit string, from the two titles alone."""

    def of_event(e: Column) -> Column:
        a1 = text.contains_any(e, fixed.FALL) & ~e.contains(fixed.LOW_FALL)
        return F.struct(a1.alias("a1"), text.contains_any(e, fixed.HIGH_ENERGY).alias("a2"), text.contains_any(e, fixed.BARRIER).alias("a3"))

    # each title is normalised once a row
    nature_hit = text.bound(text.normalized_title(F.col(nature)), lambda n: text.contains_any(n, fixed.LETHAL_NATURE))
    out = rows.select("*", text.bound(text.normalized_title(F.col(event)), of_event).alias("_event"), nature_hit.alias("b"))
    flags = ("a1", "a2", "a3", "b")
    out = out.select(*rows.columns, "_event.a1", "_event.a2", "_event.a3", "b")
    hits = F.concat_ws(",", *[F.when(F.col(k), F.lit(k.upper())) for k in flags])
    return out.withColumn("sif_potential", F.col("a1") | F.col("a2") | F.col("a3") | F.col("b")).withColumn("rule_hits", hits)


def exclusions(rows: DataFrame, id_col: str = "id", seq: str = "seq", event: str = "event_title", narrative: str = "narrative", nature: str = "nature_title") -> DataFrame:
    """Flags e1..e4 and ``excluded``: pattern, later duplicate id in the whole input, a title of event or nature missing, short narrative."""
    later = F.row_number().over(Window.partitionBy(id_col).orderBy(seq)) > 1
    return rows.withColumns(
        {
            "e1": F.coalesce(text.contains_any(text.normalized_title(F.col(event)), fixed.EXCLUDE_EVENT), F.lit(False)),
            "e2": later,
            "e3": F.col(event).isNull() | F.col(nature).isNull(),
            "e4": F.coalesce(F.length(narrative) < 20, F.lit(False)),
        }
    ).withColumn("excluded", F.col("e1") | F.col("e2") | F.col("e3") | F.col("e4"))


def contributions(labelled: DataFrame) -> DataFrame:
    """Rows hit by each test, by any A test, and by B alone; totals and positives."""
    a = F.col("a1") | F.col("a2") | F.col("a3")
    return labelled.agg(
        F.count("*").alias("frame"), F.count_if("sif_potential").alias("positive"), F.count_if("a1").alias("a1"), F.count_if("a2").alias("a2"),
        F.count_if(F.col("a3") & ~F.col("a1") & ~F.col("a2")).alias("a3_new"), F.count_if(a).alias("a_total"), F.count_if("b").alias("b_total"), F.count_if(F.col("b") & ~a).alias("b_new"),
    )


def title_inventory(rows: DataFrame, title: str) -> DataFrame:
    """Per normalised title: rows, and how many and which raw titles fall together in it."""
    pairs = rows.groupBy(text.normalized_title(F.col(title)).alias("title"), F.col(title).alias("raw")).agg(F.count("*").alias("n"))
    return pairs.groupBy("title").agg(F.sum("n").alias("n_rows"), F.count("raw").alias("raw_titles"), F.sort_array(F.collect_set("raw")).alias("collapsed"))


def top_negative_titles(labelled: DataFrame, title: str = "event_title", limit: int = 20) -> DataFrame:
    """The commonest normalised titles of rows that no test calls serious."""
    n = labelled.where("not sif_potential").groupBy(text.normalized_title(F.col(title)).alias("title")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "title").limit(limit)


def code_collisions(rows: DataFrame, code: str, title: str, era: Column) -> DataFrame:
    """Codes whose titles differ between the two eras."""
    sets = rows.groupBy(F.col(code).alias("code")).agg(F.sort_array(F.collect_set(F.when(~era, F.col(title)))).alias("before"), F.sort_array(F.collect_set(F.when(era, F.col(title)))).alias("after"))
    return sets.where((F.size("before") > 0) & (F.size("after") > 0) & (F.col("before") != F.col("after")))


def era_stability(rows: DataFrame, era: Column, positive: Column) -> DataFrame:
    out = rows.groupBy(era.alias("late")).agg(F.count("*").alias("n_rows"), F.sum(positive.cast("long")).alias("positives"))
    return out.withColumn("share", stats.rate(F.col("positives"), F.col("n_rows")))


def balanced_sample(rows: DataFrame, label: str, count: int, *order: Column) -> DataFrame:
    """``count // 2`` positives and the rest negatives (or all there are), first by ``order``; rows without a label stay out."""
    placed = ranked_within(rows.where(F.col(label).isNotNull()), [label], list(order))
    return placed.where(F.col("_rank") <= F.when(F.col(label), F.lit(count // 2)).otherwise(F.lit(count - count // 2))).drop("_rank")


def split_by_stratum(rows: DataFrame, strata: list[str], share: float, *order: Column, names: tuple[str, str] = ("test", "train")) -> DataFrame:
    """``fold`` is test for ``bround(share * n)`` rows of each stratum, first by ``order``, else train."""
    placed = ranked_within(rows, strata, list(order), size="_size")
    n_test = F.bround(F.col("_size") * F.lit(share)).cast("long")
    return placed.withColumn("fold", F.when(F.col("_rank") <= n_test, names[0]).otherwise(names[1])).drop("_rank", "_size")


def validation_split(tagged: DataFrame, share: float, *order: Column, id_col: str = "report_id", tags: str = "tags") -> DataFrame:
    """Training rows parted into validation and train by their rarest rule, so that rare rules stand in both."""
    return split_by_stratum(rarest_rule(tagged, id_col, tags), ["stratum"], share, *order, names=("validation", "train"))


def split_problems(rows: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``(problem, key)`` of a split: ids in both folds, in neither, or in a fold only."""
    ids, a, b = (df.select(key).distinct() for df in (rows, train, test))
    name = lambda df, problem: df.select(F.lit(problem).alias("problem"), key)
    folds = a.union(b).distinct()
    return name(a.join(b, key, "left_semi"), "in both folds").union(name(ids.join(folds, key, "left_anti"), "in no fold")).union(name(folds.join(ids, key, "left_anti"), "not in the input"))


def appended(corpus: DataFrame, more: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(corpus with the new rows, rows refused because their id is there already or comes twice)."""
    once = more.groupBy(key).agg(F.count("*").alias("_k")).where("_k = 1").select(key).join(corpus.select(key), key, "left_anti")
    return corpus.unionByName(more.join(once, key, "left_semi")), more.join(once, key, "left_anti")


def top_up(rows: DataFrame, body: str, signals: dict[str, str], each: int, *order: Column) -> DataFrame:
    """For every rule of ``signals(rule, pattern)``, ``each`` rows whose text shows it, first by ``order``."""
    shown = F.array_compact(F.array(*[F.when(F.col(body).rlike(p), F.lit(r)) for r, p in signals.items()]))
    hits = rows.withColumn("wanted_rule", F.explode(shown))
    return ranked_within(hits, ["wanted_rule"], list(order)).where(F.col("_rank") <= each).drop("_rank")


def noise_tiers(rows: DataFrame, key: Column, id_col: str, shares: tuple[float, float] = (0.6, 0.3)) -> DataFrame:
    """Exact tier sizes over all rows by their rank in the order of a hash-like ``key``, ties by id.

    Ranks come from ranges of the key, as many as there are partitions, so no task sees all rows.
    """
    placed = ranked_within(rows, [], [key, F.col(id_col)], size="_all")
    clean, moderate = F.bround(F.col("_all") * F.lit(shares[0])), F.bround(F.col("_all") * F.lit(shares[1]))
    tier = F.when(F.col("_rank") <= clean, "clean").when(F.col("_rank") <= clean + moderate, "moderate").otherwise("heavy")
    return placed.withColumn("noise_tier", tier).drop("_rank", "_all")


def rarest_rule(tagged: DataFrame, id_col: str = "report_id", tags: str = "tags") -> DataFrame:
    """Each row's rarest tag over all rows (ties to the earlier rule), ``none`` without tags."""
    each = tagged.select(F.col(id_col).alias("_id"), F.explode(tags).alias("rule")).distinct()
    counts = each.groupBy("rule").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(r) for r in fixed.RULES]), F.col("rule"))
    best = each.join(small_side(counts), "rule").groupBy("_id").agg(F.min(F.struct("n", place.alias("p"), "rule")).alias("r")).select("_id", F.col("r.rule").alias("stratum"))
    return tagged.join(best, F.col(id_col) == F.col("_id"), "left").drop("_id").withColumn("stratum", F.coalesce("stratum", F.lit("none")))


def split_report(rows: DataFrame, label: str, tier: str, tags: str, spans: str) -> DataFrame:
    """Long table ``(part, name, n, sparse)``: labels, tiers, tags of every rule, untagged rows, span coverage."""
    total = rows.agg(F.count("*").alias("_all"))
    part = lambda p, df: df.select(F.lit(p).alias("part"), F.col(df.columns[0]).cast("string").alias("name"), F.col(df.columns[1]).alias("n"))
    names = rows.sparkSession.createDataFrame([(r,) for r in fixed.RULES], "rule string")
    tagged = names.join(rows.select(F.explode(tags).alias("rule")).groupBy("rule").count(), "rule", "left").select("rule", F.coalesce("count", F.lit(0)))
    out = part("label", rows.groupBy(label).count()).union(part("tier", rows.groupBy(tier).count())).union(part("rule", tagged))
    out = out.union(part("untagged", rows.where(F.size(tags) == 0).agg(F.lit("untagged"), F.count("*"))))
    covered = rows.select(F.explode(F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))).alias("t")).groupBy("t").count()
    out = out.union(part("span", covered)).join(F.broadcast(total))
    return out.withColumn("sparse", (F.col("part") == "rule") & (F.col("n") < F.greatest(F.lit(1), F.bround(F.col("_all") * 0.01)))).drop("_all")


def leaks(train: DataFrame, test: DataFrame, key: str, body: str) -> DataFrame:
    """Test rows whose id or whose text also stands in the training fold."""
    by_id = test.join(train.select(key).distinct(), key, "left_semi").select(key, F.lit("id").alias("leak"))
    h = lambda df: df.withColumn("_h", F.xxhash64(body))
    by_text = h(test).join(h(train.select(body)).select("_h", body).distinct(), ["_h", body], "left_semi").select(key, F.lit("text").alias("leak"))
    return by_id.union(by_text)


def ingested_responses(responses: DataFrame, required: list[str], item_schema: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejected batches with their ``reason``) of ``responses(batch_id, expected, body)``: JSON ``{"items": [...]}``.

    A batch counts only if it parses, holds a list of the expected number of items, item i has index i and
    the required fields aren't blank; else the whole batch is rejected. Bodies are read as VARIANT, so one of
    another shape is told apart from one with fields missing. Batch ids are unique.
    """
    fields = dict(f.split(":") for f in item_schema.split(","))
    body = F.try_parse_json(text.json_object(F.col("body")))
    item = lambda v: F.struct(*[F.try_variant_get(v, f"$.{c}", kind).alias(c) for c, kind in fields.items()])
    # a batch is judged where it stands: nothing is shuffled
    parsed = responses.withColumn("_body", body).withColumn("_items", F.transform(F.try_variant_get("_body", "$.items", "array<variant>"), item))
    misplaced = F.exists(F.transform("_items", lambda x, i: F.coalesce(x["index"] != i, F.lit(True))), lambda wrong: wrong)
    blank = F.exists("_items", lambda x: F.exists(F.array(*[x[c].cast("string") for c in required]), lambda v: v.isNull() | (F.trim(v) == "")))
    reason = (
        F.when(F.col("_body").isNull(), "not JSON").when(F.col("_items").isNull(), "no list of items")
        .when(~F.size("_items").eqNullSafe(F.col("expected")), "other number of items").when(misplaced, "items out of place").when(blank, "required field missing")
    )
    told = parsed.withColumn("reason", reason)
    items = told.where("reason is null").select("batch_id", F.posexplode("_items").alias("place", "_item")).select("batch_id", "place", *[f"_item.{c}" for c in fields])
    return items, told.where("reason is not null").select(*[F.col(f"`{c}`") for c in responses.columns], "reason")


def fill_only(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Missing values of ``old`` from ``new``; ``changed`` lists the columns filled."""
    fresh = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in cols])
    out = old.join(fresh, F.col(key) == F.col("_key"), "left")
    changed = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in cols]))
    return out.withColumn("changed", changed).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in cols}).drop("_key", *[f"_{c}" for c in cols])


def merged_tags(old: Column, new: Column) -> Column:
    """Union of two tag lists in display order; unknown names are left out."""
    return stats.canonical(F.array_union(old, new))


def rejected_tags(tags: Column) -> Column:
    return F.array_sort(F.array_except(tags, F.array(*[F.lit(r) for r in fixed.RULES])))
