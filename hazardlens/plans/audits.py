"""Queries of the audits, the intake of reports and responses, and further measures of quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, stats, text
from ..operators import audits, cleaning, evaluate, labels, reads, scoring, spelling
from ..session import shared_folder, stored
from ..streaming import ingest
from .registry import _REPORTS, _RULES, _SCORES, _SITES, _TAGS, _VERDICTS, _WILSON, query
from .views import Tables, planted, planted_sql

_KNOWN_TAGS = "known as (select report_id, list(distinct rule_name) tags from tagged group by 1)"
_CONTROL = "'(?i)(^|[^\\pL\\pN_])(" + "|".join(fixed.CONTROL_TERMS).replace(r"\w*", r"[\pL\pN_]*") + ")([^\\pL\\pN_]|$)'"


def _tagged_documents(t: Tables) -> DataFrame:
    known = t.tags().where(F.col("rule_name").isin(*fixed.RULES)).groupBy("report_id").agg(F.collect_set("rule_name").alias("tags"))
    rows = t.documents.select(F.col("doc_id").alias("report_id"), "lang").join(known, "report_id", "left")
    return rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


# -- intake -------------------------------------------------------------------------------------


@query("select doc_id, case when text is null or length(text) < 1 then 'empty' when length(text) > 20000 then 'too long' when trim(regexp_replace(replace(text, chr(0), ''), '\\s+', ' ', 'g')) = '' then 'blank' when doc_id % 5 = 0 then 'unknown role' when try_cast(substr(source, 4) as integer) is null then 'no site' end reject_reason from documents")
def validation(t: Tables) -> DataFrame:
    role = F.when(F.col("doc_id") % 5 == 0, "visitor").otherwise("worker")
    rows = t.documents.select("doc_id", text.reject_reason(F.col("text"), role, F.expr("try_cast(substring(source, 4) as int)")).alias("reject_reason"))
    return rows


@query(f"with {_REPORTS}, {_VERDICTS}, {_SITES}, q as (select report_id, coalesce(site_name, 'No site recorded') site_name, submitted_at, confidence from verdicts join reports using (report_id) left join sites using (site_id) where confidence < 0.65 and review_status = 'auto' order by confidence, report_id limit 200) select * from q where submitted_at >= timestamp '2024-01-01' and submitted_at < timestamp '2024-01-02' and confidence >= 0.30")
def queue_view(t: Tables) -> DataFrame:
    queue = reads.review_queue(t.reports(), t.classifications(), t.sites(), limit=200)
    return reads.queue_view(queue, since="2024-01-01", until="2024-01-01", band="mid").select("report_id", "site_name", "submitted_at", "confidence")


@query("with n as (select distinct c_custkey k from customer), o as (select distinct user_id k from events) select k as id, 'missing' side from n where k not in (select k from o) union all select k, 'unexpected' from o where k not in (select k from n)")
def id_difference(t: Tables) -> DataFrame:
    return reads.difference(t.customer.select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")), "id")


@query("select doc_id from documents where text is not null and text not in (select text from conversations where text is not null) union all select doc_id from documents where text is null")
def unseen_texts(t: Tables) -> DataFrame:
    return reads.unseen(t.documents.select("doc_id", "text"), t.conversations.select("text"), "text").select("doc_id")


@query(f"with {_SITES} select c_custkey, 'NATION_' || (c_nationkey + c_custkey % 2 * 5) site_name, site_id, case when site_id is null then 'unknown site' end reject_reason from customer left join sites on site_name = 'NATION_' || (c_nationkey + c_custkey % 2 * 5)")
def site_lookup(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.concat(F.lit("NATION_"), (F.col("c_nationkey") + F.col("c_custkey") % 2 * 5).cast("string")).alias("site_name"))
    return reads.site_ids_by_name(rows, t.sites())


@query(f"with {_VERDICTS}, d as (select user_id report_id, event_id seq, event_id % 2 = 0 keep from events where event_type = 'purchase') select report_id, seq, case when keep then sif_potential else not sif_potential end sif_potential from d left join verdicts using (report_id)")
def expand_decisions(t: Tables) -> DataFrame:
    return reads.expand_decisions(t.decisions().drop("sif_potential"), t.classifications()).select("report_id", "seq", "sif_potential")


@query("select conv_id || '/' || turn batch_id, 0 place, text body from conversations where conv_id % 7 <> 0 and conv_id % 5 <> 0 and text is not null and trim(text, ' ') <> ''")
def response_items(t: Tables) -> DataFrame:
    """Each turn as a response of one item; of every seventh conversation one more is expected, every fifth numbers it wrongly."""
    item = F.struct((F.col("conv_id") % 5 == 0).cast("int").alias("index"), F.col("text").alias("body"))
    expected = F.when(F.col("conv_id") % 7 == 0, 2).otherwise(1)
    responses = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("batch_id"), expected.alias("expected"), F.concat(F.lit("here: "), F.to_json(F.struct(F.array(item).alias("items")))).alias("body"))
    items, _ = labels.ingested_responses(responses, ["body"], "index:int,body:string")
    return items.select("batch_id", F.col("index").alias("place"), "body")


@query(
    "select conv_id || '/' || turn // 4 batch_id, count(*)::integer + (conv_id % 5 = 0)::integer expected, case when conv_id % 11 = 0 then 'not JSON' when conv_id % 7 = 0 then 'no list of items' when conv_id % 5 = 0 then 'other number of items' when conv_id % 3 = 0 then 'items out of place' when conv_id % 2 = 0 or bool_or(text is null or trim(text, ' ') = '') then 'required field missing' end reason "
    "from conversations group by conv_id, turn // 4 having reason is not null"
)
def rejected_batches(t: Tables) -> DataFrame:
    """Four turns of a conversation as a response of several items; many are of another shape, number, order, or lack a field."""
    k = F.col("conv_id")
    turns = t.conversations.groupBy("conv_id", F.expr("turn div 4").alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("said"))
    first = F.when((k % 3 == 0) & (k % 5 != 0), 1).otherwise(0)
    said = F.transform("said", lambda x, i: F.struct((i + first).alias("index"), F.when((k % 2 == 0) & (i == 0), F.lit(" ")).otherwise(x["text"]).alias("body")))
    body = F.when(k % 11 == 0, F.lit("{nothing}")).when(k % 7 == 0, F.lit('{"items": {"index": 0, "body": "one"}}')).otherwise(F.concat(F.lit("here: "), F.to_json(F.struct(said.alias("items")))))
    expected = F.size("said") + F.when(k % 5 == 0, 1).otherwise(0)
    responses = turns.select(F.concat_ws("/", "conv_id", "part").alias("batch_id"), expected.alias("expected"), body.alias("body"))
    return labels.ingested_responses(responses, ["body"], "index:int,body:string")[1].select("batch_id", "expected", "reason")


@query("select doc_id, coalesce(lang, source) lang, case when lang is null and source is not null then 'lang' else '' end changed from documents")
def fill_only(t: Tables) -> DataFrame:
    done = labels.fill_only(t.documents.select("doc_id", "lang"), t.documents.select("doc_id", F.col("source").alias("lang")), "doc_id", ["lang"])
    return done.select("doc_id", "lang", F.array_join("changed", ",").alias("changed"))


#: Every fifth document has lost its language.
_GAPS = "case when doc_id % 5 <> 0 then lang end"


def _with_gaps(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))


@query(f"with d as (select doc_id, {_GAPS} lang, source from documents) select 'lang' field, count(lang) as before, count(coalesce(lang, source)) as after, count(coalesce(lang, source)) - count(lang) filled from d")
def coverage_change(t: Tables) -> DataFrame:
    old = _with_gaps(t)
    new = labels.fill_only(old, t.documents.select("doc_id", F.col("source").alias("lang")), "doc_id", ["lang"])
    return audits.coverage(old, new, ["lang"])


@query(f"select doc_id from documents where {_GAPS} is null")
def missing_language(t: Tables) -> DataFrame:
    return audits.without_span(_with_gaps(t), "lang", "doc_id").select("doc_id")


@query("select distinct user_id id from events where user_id not in (select doc_id from labels)")
def wanted_missing(t: Tables) -> DataFrame:
    return audits.selected(t.labels.select(F.col("doc_id").alias("id")), t.events.select(F.col("user_id").alias("id")), "id")[1]


@query("select doc_id, case when doc_id % 3 = 0 then 'Driving' else '' end kept, case when doc_id % 4 = 0 then 'Housekeeping' else '' end rejected, case when p > 0 then p - 1 end span_start, case when p > 0 then p - 1 + length(q) end span_end from (select doc_id, strpos(text, q) p, q from (select doc_id, text, string_split(text, chr(10))[-1] q from documents) where q <> '' union all select doc_id, 0, '' from (select doc_id, string_split(text, chr(10))[-1] q from documents) where q is null or q = '')")
def corpus_records(t: Tables) -> DataFrame:
    """Every document as an annotated row that quotes its own last line."""
    names = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, "Driving"), F.when(F.col("doc_id") % 4 == 0, "Housekeeping")))
    last = F.element_at(F.split("text", "\n"), -1)
    none = F.lit(None).cast("string")
    rows = t.documents.select("doc_id", F.col("text").alias("raw_text"), names.alias("iogp_rules"), last.alias("precursor_activity"), *[none.alias(f"precursor_{x}") for x in fixed.ENTITY_TYPES if x != "activity"])
    done = audits.corpus_records(rows)
    return done.select("doc_id", F.array_join("iogp_rules", ",").alias("kept"), F.array_join("iogp_rules_rejected", ",").alias("rejected"), F.col("precursor_activity.start").alias("span_start"), F.col("precursor_activity.end").alias("span_end"))


# -- audits -------------------------------------------------------------------------------------


@query(f"with {_VERDICTS}, {_RULES}, {_TAGS}, o as (select count(*) n from lineitem join part on l_partkey = p_partkey), r as (select doc_id report_id, coalesce(lang, 'none') lang, confidence from documents left join verdicts on doc_id = report_id) select 'sif_potential' part, sif_potential::varchar as name, count(*) n from verdicts group by 2 union all select 'status', case when confidence >= 0.65 then 'processed' else 'needs_review' end, count(*) from r group by 2 union all select 'language', lang, count(*) from r group by 2 union all select 'tags', 'tags', count(*) from tagged union all select 'tagging', case when report_id in (select report_id from tagged) then 'tagged' else 'untagged' end, count(*) from r group by 2 union all select 'spans', 'spans', n from o union all select 'density', 'distinct rank scores', (with g as (select count(*) total, cast(sum(sif_potential::int) as bigint) positives from documents join verdicts on doc_id = report_id join nation on n_nationkey = try_cast(substr(source, 4) as integer) group by n_nationkey) select count(distinct {_WILSON}) from g)")
def stored_shape(t: Tables) -> DataFrame:
    status = stats.status(F.col("confidence"))
    reports = t.documents.select(F.col("doc_id").alias("report_id"), F.coalesce("lang", F.lit("none")).alias("language_detected"))
    reports = reports.join(t.classifications().select("report_id", "confidence"), "report_id", "left").withColumn("status", status)
    known = t.tags().where(F.col("rule_name").isin(*fixed.RULES)).distinct()
    density = reads.density_by_site(t.reports(), t.classifications(), t.sites(), digits=None)
    return audits.stored_shape(reports, t.classifications(), known, t.order_spans(), density)


@query("select event_type model_version, count(*) n, starts_with(event_type, 'error') as stale from events group by 1")
def version_census(t: Tables) -> DataFrame:
    return audits.version_census(t.events, "event_type", "error")


@query("select l_quantity > 40 hospitalised, l_discount > 0.05 amputation, l_tax > 0.04 eye, count(*) n from lineitem group by all")
def outcome_table(t: Tables) -> DataFrame:
    return audits.outcome_table(t.lineitem, {"hospitalised": F.col("l_quantity") > 40, "amputation": F.col("l_discount") > 0.05, "eye": F.col("l_tax") > 0.04})


@query("with f as (select l_quantity > 40 hospitalised, l_discount > 0.05 amputation, l_tax > 0.04 eye from lineitem) select hospitalised, amputation, eye, grouping_id(hospitalised, amputation, eye)::int as \"level\", count(*) n from f group by cube (hospitalised, amputation, eye)")
def outcome_margins(t: Tables) -> DataFrame:
    return audits.outcome_margins(t.lineitem, {"hospitalised": F.col("l_quantity") > 40, "amputation": F.col("l_discount") > 0.05, "eye": F.col("l_tax") > 0.04})


@query(f"with {_RULES}, {_TAGS}, s as (select r.ordinal::int ordinal, r.rule_name, count(distinct report_id) support from rules r left join tagged using (rule_name) group by all) select ordinal, rule_name, support, support > 0 trainable, rule_name = (select arg_min(rule_name, (support, ordinal)) from s where support > 0) rarest from s")
def tag_support(t: Tables) -> DataFrame:
    return audits.tag_support(_tagged_documents(t))


@query(f"with {_RULES}, {_TAGS}, {_KNOWN_TAGS} select coalesce(len(tags), 0)::int n_tags, count(*) n from documents left join known on doc_id = report_id group by 1")
def tags_per_row(t: Tables) -> DataFrame:
    return audits.tags_per_row(_tagged_documents(t))


@query("select l_returnflag model, count(*) calls, cast(sum(l_quantity::bigint) as bigint) tokens_in, cast(sum(l_linenumber) as bigint) tokens_out, cast(sum(l_quantity::bigint) + sum(l_linenumber) as bigint) tokens, (sum(l_quantity::bigint)::double * 3.0::double + sum(l_linenumber)::double * 15.0::double) / 1000000.0::double as cost from lineitem group by 1")
def annotation_usage(t: Tables) -> DataFrame:
    return audits.usage(t.lineitem, "l_returnflag", F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), 3.0, 15.0)


@query("select count(*) n_rows, count(distinct user_id) ids, count(*) - count(distinct user_id) repeated from events")
def duplicate_ids(t: Tables) -> DataFrame:
    return audits.duplicate_ids(t.events, "user_id")


@query("with r as (select toxic, quality, row_number() over (partition by toxic, quality order by (doc_id * 7919) % 10007, doc_id) n, count(*) over (partition by toxic, quality) k from labels) select toxic, quality, count(*) total, count(*) filter (n > round_even(k * 0.15::double, 0)) train, count(*) filter (n <= round_even(k * 0.15::double, 0)) test, count(*) filter (n <= round_even(k * 0.15::double, 0)) = 0 too_small from r group by 1, 2")
def stratum_table(t: Tables) -> DataFrame:
    folds = labels.split_by_stratum(t.labels.select("doc_id", "toxic", "quality"), ["toxic", "quality"], 0.15, (F.col("doc_id") * 7919) % 10007, F.col("doc_id"))
    return audits.stratum_table(folds, ["toxic", "quality"])


@query(f"with {_RULES}, {_TAGS}, n as (select count(*) a from documents), r as (select rule_name, count(distinct report_id) n from rules left join tagged using (rule_name) group by 1) select 'label' part, coalesce((doc_id % 3 = 0)::varchar, '') as name, count(*) n, false sparse from documents group by 2 union all select 'tier', lang, count(*), false from documents group by 2 union all select 'rule', rule_name, n, n < greatest(1, round_even(a * 0.01::double, 0)) from r, n union all select 'untagged', 'untagged', count(*), false from documents where doc_id not in (select report_id from tagged) union all select 'span', 'activity', count(*), false from documents where doc_id in (select l_orderkey from lineitem join part on l_partkey = p_partkey) having count(*) > 0")
def split_report(t: Tables) -> DataFrame:
    found = t.order_spans().groupBy("report_id").agg(F.collect_set(F.struct("entity_type")).alias("spans"))
    rows = _tagged_documents(t).join(found, "report_id", "left").withColumn("label", F.col("report_id") % 3 == 0)
    return labels.split_report(rows, "label", "lang", "tags", "spans")


@query("with g as (select n_regionkey::varchar as \"check\", count(*) got from nation group by 1), w as (select r_regionkey::varchar as \"check\", 5::bigint want from region) select \"check\", got, want, coalesce(got = want, false) ok from g full join w using (\"check\")")
def verified_counts(t: Tables) -> DataFrame:
    found = t.nation.groupBy(F.col("n_regionkey").cast("string").alias("region")).count()
    return audits.verified(found, t.region.select(F.col("r_regionkey").cast("string").alias("region"), F.lit(5).cast("long").alias("count")), "region", "count")


@query(f"with d as (select doc_id, {planted_sql('control')} text from documents) select count(*) filter (doc_id % 3 = 0) with_barrier, count(*) filter (doc_id % 3 = 0 and regexp_matches(text, {_CONTROL})) as found, count(*) filter (regexp_matches(text, {_CONTROL})) flagged from d")
def control_coverage(t: Tables) -> DataFrame:
    return evaluate.control_coverage(t.documents.withColumns({"has": F.col("doc_id") % 3 == 0, "text": planted("control")}), "text", "has")


_SINGLE = "|".join(c for c in fixed.CONTROL_TERMS if " " not in c).replace(r"\w*", r"[\pL\pN_]*")
_SEVERAL = " union all ".join(
    rf"select lower(unnest(regexp_extract_all(t, '(?i)(^|[^\pL\pN_])({c})([^\pL\pN_]|$)', 2))) term from p".replace(r"\w*", r"[\pL\pN_]*") for c in fixed.CONTROL_TERMS if " " in c
)


@query(rf"with p as (select text || case when doc_id % 3 = 0 then ' was not guarded' when doc_id % 4 = 0 then ' bina isolation permit' else '' end t from documents), w as (select unnest(regexp_extract_all(lower(t), '[\pL\pN_]+')) term from p), s as (select term from w where regexp_full_match(term, '{_SINGLE}') union all {_SEVERAL}) select term, count(*) n from s group by 1")
def control_census(t: Tables) -> DataFrame:
    """How often each control term is said in all documents, most of them with a remark on a control added."""
    remark = F.when(F.col("doc_id") % 3 == 0, " was not guarded").when(F.col("doc_id") % 4 == 0, " bina isolation permit").otherwise("")
    return t.documents.select(F.explode(text.control_terms(F.concat("text", remark))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("select count(*) gold, count(*) filter (regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(" + "|".join(fixed.ABSENCE_WORDS) + ")([^\\pL\\pN_]|$)')) reachable from conversations")
def barrier_ceiling(t: Tables) -> DataFrame:
    return evaluate.barrier_ceiling(t.conversations.select(F.lit("barrier_failure").alias("entity_type"), F.col("text").alias("entity_text")))


_ASCII = r"^[a-z]{4,}$"


@query("with b as (select distinct unnest(regexp_extract_all(lower(text), '[\\pL\\pN_''\\-]+')) word from benchmark), d as (select word, count(*) n from (select unnest(regexp_extract_all(lower(text), '[\\pL\\pN_''\\-]+')) word from conversations) where regexp_matches(word, '^[a-z]{4,}$') group by 1 having count(*) >= 3) select b.word, d.word candidate from b, d where regexp_matches(b.word, '^[a-z]{4,}$') and b.word not in (select word from d) and damerau_levenshtein(b.word, d.word) = 1")
def spelling_pairs(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(text.words(F.col("text"))).alias("word")).where(F.col("word").rlike(_ASCII))
    known = t.conversations.select(F.explode(text.words(F.col("text"))).alias("word")).where(F.col("word").rlike(_ASCII)).groupBy("word").agg(F.count("*").alias("freq")).where("freq >= 3")
    return spelling.candidates(words, known).select("word", "candidate")


@query()
def cleaned_with_dictionary(t: Tables) -> DataFrame:
    """All turns cleaned with the words of the documents as the dictionary."""
    known = t.documents.select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq")).where("freq >= 5")
    turns = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("turn_id"), "text")
    return cleaning.clean_reports(turns, "turn_id", "text", known, {"los": "the", "die": "the", "del": "of"})


# -- quality ------------------------------------------------------------------------------------


def _rule_scores(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(n).alias("rule_name")) for i, n in enumerate(fixed.RULES)]))
    rows = ids.select("doc_id", each.alias("x"))
    return rows.select("x.rule_name", (F.col("doc_id") % (F.col("x.r") + 2) == 0).alias("truth"), (((F.col("doc_id") * (F.col("x.r") + 3)) % 100) / F.lit(100.0)).alias("p"))


_GRID = f"{_RULES}, g as (select i as place, 0.05::double * i threshold from (select unnest(range(1, 20)) i)), c as (select place, threshold, rule_name, count(*) filter (truth) support, count(*) filter (truth and p >= threshold) tp, count(*) filter (not truth and p >= threshold) fp, count(*) filter (truth and p < threshold) fn from (select rule_name, doc_id % (ordinal + 2) = 0 truth, ((doc_id * (ordinal + 3)) % 100)::double / 100.0::double p from documents, rules), g group by 1, 2, 3), m as (select place::int place, threshold, coalesce(avg(case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0.0::double end) filter (support > 0), 0.0) macro_f1 from c group by 1, 2)"


@query(f"with {_GRID} select * from m")
def tag_thresholds(t: Tables) -> DataFrame:
    return evaluate.tag_thresholds(_rule_scores(t))


@query("select count(*) filter (doc_id % 2 <> 0 and doc_id % 3 <> 0) no_rule, count(*) filter (doc_id % 2 <> 0 and doc_id % 3 <> 0 and doc_id % 5 <> 0) left_empty from documents")
def empty_lists(t: Tables) -> DataFrame:
    one = lambda *ks: F.array_compact(F.array(*[F.when(F.col("doc_id") % k == 0, fixed.RULES[k]) for k in ks]))
    return evaluate.empty_lists(t.documents.select(one(2, 3).alias("truth"), one(5).alias("predicted")))


@query(f"with {_SCORES} select min(confidence) least, avg(confidence) mean, max(confidence) greatest, count(*) filter (confidence < 0.65) as below, count(*) n from s2")
def confidence_range(t: Tables) -> DataFrame:
    return evaluate.confidence_range(t.scores())


@query(f"with {_SCORES} select count(distinct p >= 0.5) predictions, count(distinct p >= 0.5) < 2 as constant from scores")
def constant_check(t: Tables) -> DataFrame:
    return evaluate.constant_check(t.scores().withColumn("said", F.col("p") >= 0.5), "said")


@query(f"with {_SCORES}, m as (select avg(ln(1 + exp(-(case when truth then margin else -margin end)))) train_loss, avg(p) filter (truth) - avg(p) filter (not truth) separation from scores) select train_loss, separation, coalesce(train_loss <= 0.3 and abs(separation) >= 0.05, false) usable, concat_ws('; ', case when not coalesce(train_loss <= 0.3, false) then 'loss over its target' end, case when not coalesce(abs(separation) >= 0.05, false) then 'classes not separated' end) reasons from m")
def usability(t: Tables) -> DataFrame:
    signed = F.when(F.col("truth"), F.col("margin")).otherwise(-F.col("margin"))
    loss = t.scores().agg(F.avg(F.log1p(F.exp(-signed))).alias("train_loss"), (F.avg(F.when(F.col("truth"), F.col("p"))) - F.avg(F.when(~F.col("truth"), F.col("p")))).alias("separation"))
    return evaluate.usability(loss)


@query(f"with {_SCORES}, g as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85])::double threshold), w as (select threshold, count(*) filter (confidence >= threshold) auto_published, count(*) filter (confidence < threshold) reviewed, count(*) filter (confidence >= threshold and truth and not correct) missed_sif, case when count(*) filter (confidence >= threshold) > 0 then count(*) filter (confidence >= threshold and correct)::double / count(*) filter (confidence >= threshold) end auto_accuracy from s2, g group by 1) select * from w order by auto_accuracy desc nulls last, auto_published desc, threshold limit 1")
def best_threshold(t: Tables) -> DataFrame:
    return evaluate.best_threshold(evaluate.threshold_sweep(t.scores(), [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85]))


# -- models -------------------------------------------------------------------------------------


@query()
def risk_scores(t: Tables) -> DataFrame:
    """The risk scorer, fitted on all labelled documents, over every document."""
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = scoring.fit_risk(docs.join(t.labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id").select("text", "label"))
    return scoring.score_risk(model, docs).select("doc_id", "sif_potential", "confidence")


@query()
def rule_tags(t: Tables) -> DataFrame:
    """The rule tagger, fitted on tagged labelled documents, over every document."""
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tagged = _tagged_documents(t).join(t.labels.select(F.col("doc_id").alias("report_id")).distinct(), "report_id", "left_semi").select(F.col("report_id").alias("doc_id"), "tags")
    models = scoring.fit_rules(docs.join(tagged, "doc_id").select("text", "tags"))
    return scoring.score_rules(models, docs, 0.5).select("doc_id", F.array_join(F.transform("tags", lambda x: x["rule_name"]), ",").alias("rules"))


def _held_out(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Labelled documents in two folds by label: what models are fitted on, and what they are judged by."""
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    folds = labels.split_by_stratum(rows, ["toxic"], 0.25, (F.col("doc_id") * 7919) % 10007, F.col("doc_id"))
    return folds.where("fold = 'train'").drop("fold"), folds.where("fold = 'test'").drop("fold")


@query()
def risk_quality(t: Tables) -> DataFrame:
    """The risk scorer on labelled documents that it wasn't fitted on.

    Temperature and threshold are chosen on one half of them; confusion and calibration, at that
    temperature, are those of the other half.
    """
    train, test = _held_out(t)
    model = scoring.fit_risk(train.select("text", F.col("toxic").cast("double").alias("label")))
    said = scoring.score_risk(model, test).select((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("chosen"), (F.col("toxic") == 1).alias("truth"), "p", "margin")
    said = stored(said.withColumns({"confidence": stats.confidence(F.col("p")), "correct": (F.col("p") >= 0.5) == F.col("truth")}))
    grid, tuned = evaluate.temperatures(), said.where("chosen")
    best = evaluate.best_threshold(evaluate.threshold_sweep(tuned, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85])).select("threshold", "auto_published", "auto_accuracy")
    temperature = stored(evaluate.best_temperature(evaluate.temperature_losses(tuned, grid), len(grid)).select("temperature", "loss"))
    judged = said.where("not chosen").join(F.broadcast(temperature.select("temperature"))).withColumn("p", F.coalesce(1 / (1 + F.exp(-F.col("margin") / F.col("temperature"))), F.col("p")))
    judged = stored(judged.withColumn("confidence", stats.confidence(F.col("p"))))
    # one row each
    return evaluate.confusion(judged).join(F.broadcast(evaluate.calibration_error(judged))).join(F.broadcast(temperature)).join(F.broadcast(best))


@query()
def tag_quality(t: Tables) -> DataFrame:
    """The rule tagger on labelled documents that it wasn't fitted on: the table of all rules."""
    train, test = _held_out(t)
    tagged = _tagged_documents(t).select(F.col("report_id").alias("doc_id"), "tags")
    models = scoring.fit_rules(train.join(tagged, "doc_id").select("text", "tags"))
    said = scoring.score_rules(models, test.select("doc_id", "text"), 0.5).select("doc_id", F.transform("tags", lambda x: x["rule_name"]).alias("said"))
    rule = F.explode(F.array(*[F.lit(r) for r in fixed.RULES])).alias("rule_name")
    rows = said.join(tagged, "doc_id").select("tags", "said", rule)
    return evaluate.per_rule(rows.select("rule_name", F.array_contains("tags", F.col("rule_name")).alias("truth"), F.array_contains("said", F.col("rule_name")).alias("predicted")))


# -- streams ------------------------------------------------------------------------------------


def _arriving(t: Tables, name: str) -> DataFrame:
    """A table as a stream; the pattern lets it be one file or a folder."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.dir}/{name}.parque[t]")


@query("select toxic group_name, count(*) total, cast(sum(quality) as bigint) positives from labels group by 1")
def stream_density(t: Tables) -> DataFrame:
    """Labels as a stream: each batch stores its counts; they are compacted, and reading sums what there is."""
    root, schema = shared_folder(t.spark), "toxic int, total long, positives long"
    arriving = _arriving(t, "labels").select("toxic", (F.col("quality") == 1).alias("sif_potential"))
    ingest.start_density(arriving, "toxic", f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    ingest.compact(t.spark, f"{root}/counts", "toxic", schema)
    return ingest.density(ingest.deltas(t.spark, f"{root}/counts", schema), "toxic")


@query("select coalesce(source, '') site_id, count(distinct text) first_texts from documents where text is not null group by 1")
def stream_resubmissions(t: Tables) -> DataFrame:
    """Documents as a stream of reports of one day: the first of equal texts of a source goes on."""
    root = shared_folder(t.spark)
    arriving = _arriving(t, "documents").where("text is not null")
    reports = arriving.select(F.coalesce("source", F.lit("")).alias("site_id"), F.col("text").alias("raw_text"), F.lit("2024-01-01").cast("timestamp").alias("submitted_at"))
    first = ingest.without_resubmissions(reports).select("site_id", "text_hash")
    first.writeStream.format("parquet").option("path", f"{root}/first").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("site_id string, text_hash string").parquet(f"{root}/first").groupBy("site_id").agg(F.count("*").alias("first_texts"))
