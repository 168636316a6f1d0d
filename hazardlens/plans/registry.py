"""Queries over the given tables for every operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, spans, stats, text
from ..operators import cleaning, evaluate, extract, labels, reads, repeats, spelling
from ..session import stored
from .views import Tables, planted, planted_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# -- SQL pieces ---------------------------------------------------------------------------------

_WILSON = "case when total > 0 then greatest((positives::double / total + 1.96::double * 1.96::double / (2 * total::double) - 1.96::double * sqrt((positives::double / total * (1 - positives::double / total) + 1.96::double * 1.96::double / (4 * total::double)) / total::double)) / (1 + 1.96::double * 1.96::double / total::double), 0.0) else 0.0 end"
_RATE = "case when total > 0 then positives::double / total else 0.0 end"
_REPORTS = "reports as (select doc_id report_id, cast(substr(source, 4) as integer) site_id, text raw_text, timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) submitted_at from documents)"
_VERDICTS = "verdicts as (select doc_id report_id, toxic = 1 sif_potential, 0.5::double + ((doc_id * 37) % 50) / 100.0::double confidence, case when doc_id % 7 = 0 then 'confirmed' when doc_id % 11 = 0 then 'overridden' else 'auto' end review_status from labels)"
_SITES = "sites as (select n_nationkey site_id, n_name site_name, r_name region from nation join region on n_regionkey = r_regionkey)"
_RULES = "rules as (select unnest(range(0, 9)) ordinal, unnest([" + ", ".join(f"'{r}'" for r in fixed.RULES) + "]) rule_name)"
_TAGS = "tagged as (select doc_id report_id, rule_name, ordinal from documents, rules where doc_id % (ordinal + 2) = 0)"
_SCORES = "scores as (select doc_id, toxic = 1 truth, (((doc_id * 37) % 200) - 100) / 25.0::double margin, 1 / (1 + exp(-((((doc_id * 37) % 200) - 100) / 25.0::double))) p from labels), s2 as (select *, greatest(p, 1 - p) confidence, (p >= 0.5) = truth correct from scores)"


_W, _G = r"[\pL\pN_]+", r"[^\pL\pN_]+"


def _sql_span(name: str, first: int, n: int) -> str:
    """SQL of the place ``name_s, name_e`` of ``n`` words from word ``first`` on, as the views find it."""
    lead = rf"^([^\pL\pN_]*{_W}" + (rf"(?:{_G}{_W}){{{first - 2}}}" if first > 2 else "") + rf"{_G})"
    body = lead[:-1] + rf")({_W}(?:{_G}{_W}){{{n - 1}}})"
    return f"length(regexp_extract(text, '{lead}', 1)) {name}_s, length(regexp_extract(text, '{lead}', 1)) + length(regexp_extract(text, '{body}', 2)) {name}_e"


_SPANS = f"w as (select doc_id, text, {_sql_span('g', 3, 3)}, {_sql_span('v', 4, 3)}, {_sql_span('o', 8, 2)} from documents where regexp_matches(text, '^[^\\pL\\pN_]*{_W}(?:{_G}{_W}){{8}}')), sp as (select doc_id, text, g_s, g_e, case when doc_id % 2 = 0 then v_s else o_s end p_s, case when doc_id % 2 = 0 then v_e else o_e end p_e from w)"


def _sql_f1(k: str) -> str:
    return f"case when predicted > 0 then {k}::double / predicted else 0.0 end {k}_precision, case when gold > 0 then {k}::double / gold else 0.0 end {k}_recall, case when {k} > 0 then 2 * ({k}::double / predicted) * ({k}::double / gold) / ({k}::double / predicted + {k}::double / gold) else 0.0 end {k}_f1"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


# -- density and reads --------------------------------------------------------------------------


@query(f"with {_REPORTS}, {_VERDICTS}, {_SITES}, g as (select site_id, site_name group_name, region, count(*) total, cast(sum(sif_potential::int) as bigint) positives from reports join verdicts using (report_id) join sites using (site_id) group by all) select *, {_RATE} rate, {_WILSON} rank_score from g")
def density_by_site(t: Tables) -> DataFrame:
    return reads.rank_order(reads.density_by_site(t.reports(), t.classifications(), t.sites(), digits=None))


@query(f"with {_SITES}, g as (select site_id, site_name group_name, region, count(*) total, cast(sum((l_returnflag = 'R')::int) as bigint) positives from lineitem join supplier on l_suppkey = s_suppkey join sites on s_nationkey = site_id group by all) select *, {_RATE} rate, {_WILSON} rank_score from g")
def density_by_site_returns(t: Tables) -> DataFrame:
    rows = t.line_verdicts().groupBy("site_id").agg(F.count("*").alias("total"), F.sum(F.col("sif_potential").cast("long")).alias("positives"))
    named = rows.join(t.sites().withColumnRenamed("site_name", "group_name"), "site_id").select("site_id", "group_name", "region", "total", "positives")
    return reads.rank_order(reads.ranked(named, digits=None))


@query(f"with b as (select distinct l_orderkey k, coalesce(nullif(lower(split_part(trim(p_name), ' ', 1)), ''), 'unspecified') group_name from lineitem join part on l_partkey = p_partkey), v as (select l_orderkey k, max((l_returnflag = 'R')::int) sif from lineitem group by 1), g as (select group_name, count(*) total, cast(sum(sif) as bigint) positives from b join v using (k) group by 1) select *, {_RATE} rate, {_WILSON} rank_score from g")
def density_by_activity(t: Tables) -> DataFrame:
    return reads.rank_order(reads.density_by_activity(t.order_verdicts(), t.order_spans(), digits=None))


@query(f"with {_RULES}, {_TAGS} select r.ordinal::int ordinal, r.rule_name, count(distinct report_id) report_count from rules r left join tagged using (rule_name) group by all")
def rule_distribution(t: Tables) -> DataFrame:
    return reads.rule_distribution(t.tags()).orderBy("ordinal")


@query(f"with {_REPORTS}, {_VERDICTS}, {_SITES} select report_id, site_name, coalesce(raw_text, '') raw_text, submitted_at, sif_potential, confidence from verdicts join reports using (report_id) left join sites using (site_id) where confidence < 0.65 and review_status = 'auto' order by confidence, report_id limit 50")
def review_queue(t: Tables) -> DataFrame:
    return reads.review_queue(t.reports(), t.classifications(), t.sites())


@query(f"with {_REPORTS}, {_VERDICTS} select report_id, submitted_at, confidence, case when length(x) > 180 then x[:180] || '…' else x end excerpt from (select *, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) x from reports join verdicts using (report_id) where sif_potential) order by submitted_at desc, report_id limit 10")
def high_risk_feed(t: Tables) -> DataFrame:
    rows = reads.list_reports(t.reports(), t.classifications(), t.tags(), t.order_spans(), sif_potential=True, limit=10)
    return rows.select("report_id", "submitted_at", "confidence", text.excerpt(F.col("raw_text")).alias("excerpt"))


@query(f"with {_REPORTS}, {_VERDICTS}, {_RULES}, {_TAGS} select report_id, submitted_at, sif_potential, confidence, review_status from reports join verdicts using (report_id) where review_status = 'auto' and report_id in (select report_id from tagged where rule_name = 'Hot Work') and submitted_at >= timestamp '2024-01-01 02:00:00' order by submitted_at desc, report_id limit 50")
def list_reports(t: Tables) -> DataFrame:
    rows = reads.list_reports(t.reports(), t.classifications(), t.tags(), t.order_spans(), review_status="auto", rule="Hot Work", since="2024-01-01 02:00:00")
    return rows.select("report_id", "submitted_at", "sif_potential", "confidence", "review_status")


@query(f"with {_REPORTS}, {_VERDICTS}, sp as (select distinct l_orderkey report_id from lineitem join part on l_partkey = p_partkey where p_name ilike 'small%') select report_id, submitted_at, sif_potential, confidence from reports left join verdicts using (report_id) where report_id in (select report_id from sp) order by submitted_at desc, report_id limit 200")
def drill_down(t: Tables) -> DataFrame:
    rows = reads.list_reports(t.reports(), t.classifications(), t.tags(), t.order_spans(), activity="small", limit=200)
    return rows.select("report_id", "submitted_at", "sif_potential", "confidence")


@query(f"with {_REPORTS}, {_VERDICTS}, {_RULES}, {_TAGS}, tags as (select report_id, rule_name from tagged union all select doc_id, 'Housekeeping' from documents where doc_id % 13 = 0 union all select report_id, rule_name from tagged where report_id % 10 = 0), n as (select report_id, count(*) k from tags group by 1), o as (select l_orderkey report_id, count(*) s from lineitem join part on l_partkey = p_partkey group by 1) select r.report_id, r.site_id, confidence, coalesce(k, 0) n_tags, coalesce(s, 0) n_spans from reports r left join verdicts using (report_id) left join n using (report_id) left join o using (report_id)")
def report_detail(t: Tables) -> DataFrame:
    rows = reads.report_detail(t.reports(), t.sites(), t.classifications(), t.tags(), t.order_spans())
    return rows.select("report_id", "site_id", "classification.confidence", F.size("tags").cast("long").alias("n_tags"), F.size("spans").cast("long").alias("n_spans"))


@query(f"with {_REPORTS}, {_VERDICTS}, {_SITES}, {_RULES}, {_TAGS}, g as (select site_name group_name, count(*) total, cast(sum(sif_potential::int) as bigint) positives from reports join verdicts using (report_id) join sites using (site_id) group by all), d as (select *, {_WILSON} rank_score from g) select cast(coalesce(sum(total), 0) as bigint) total_reports, cast(coalesce(sum(positives), 0) as bigint) sif_reports, (select group_name from d order by rank_score desc, total desc, group_name limit 1) top_site, (select count(distinct rule_name) from tagged) rules_seen, (select least(count(*), 200) from verdicts where confidence < 0.65 and review_status = 'auto') queue, (select count(*) >= 200 from verdicts where confidence < 0.65 and review_status = 'auto') queue_capped, case when sum(total) > 0 then sum(positives)::double / sum(total)::double else 0.0 end overall_rate from d")
def kpis(t: Tables) -> DataFrame:
    density = reads.density_by_site(t.reports(), t.classifications(), t.sites(), digits=None)
    waiting = t.classifications().where((F.col("confidence") < fixed.CONFIDENCE_THRESHOLD) & (F.col("review_status") == "auto"))
    return reads.kpis(density, waiting, reads.rule_distribution(t.tags()))


@query(f"with {_VERDICTS}, d as (select user_id report_id, arg_max(case when event_id % 2 = 0 then 'confirmed' else 'overridden' end, (ts, event_id)) s, arg_max(event_id % 2 = 0, (ts, event_id)) v from events where event_type = 'purchase' group by 1) select report_id, coalesce(v, sif_potential) sif_potential, confidence, coalesce(s, review_status) review_status from verdicts left join d using (report_id)")
def apply_reviews(t: Tables) -> DataFrame:
    done, _ = reads.apply_reviews(t.classifications(), t.decisions())
    return done.select("report_id", "sif_potential", "confidence", "review_status")


@query(f"with {_VERDICTS} select user_id report_id, event_id seq, 'not found' reason from events where event_type = 'purchase' and user_id not in (select report_id from verdicts)")
def rejected_reviews(t: Tables) -> DataFrame:
    return reads.apply_reviews(t.classifications(), t.decisions())[1].select("report_id", "seq", "reason")


@query(f"with {_SITES} select site_id, site_name, region from sites order by site_name")
def sites(t: Tables) -> DataFrame:
    return t.sites().orderBy("site_name")


@query("select o_custkey report_id, count(*) n_children, sum(o_totalprice) total from orders where o_orderpriority = '1-URGENT' group by 1")
def matching_children(t: Tables) -> DataFrame:
    children = t.orders.select(F.col("o_custkey").alias("report_id"), "o_orderpriority", "o_totalprice")
    parents = t.customer.select(F.col("c_custkey").alias("report_id"))
    rows = reads.matching_children(parents, children, F.col("o_orderpriority") == "1-URGENT", "children")
    return rows.select("report_id", F.size("children").cast("long").alias("n_children"), F.aggregate("children", F.lit(0.0), lambda a, c: a + c["o_totalprice"]).alias("total"))


# -- labels, samples, splits --------------------------------------------------------------------

_EVENTS = ["ring", "bolt", "gear"]


_FLAGS = (
    "e as (select doc_id, " + _norm(planted_sql("event")) + " x, " + _norm(planted_sql("nature")) + " y from documents), "
    "f as (select doc_id, regexp_matches(x, 'fall to lower level|fall through surface|jump to lower level') and not contains(x, 'less than 6 feet') a1, regexp_matches(x, '" + "|".join(fixed.HIGH_ENERGY) + "') a2, contains(x, 'curtailed by') a3, regexp_matches(y, '" + "|".join(fixed.LETHAL_NATURE) + "') b from e)"
)
_CONTRIBUTIONS = "count(*) frame, count(*) filter (a1 or a2 or a3 or b) positive, count(*) filter (a1) a1, count(*) filter (a2) a2, count(*) filter (a3 and not a1 and not a2) a3_new, count(*) filter (a1 or a2 or a3) a_total, count(*) filter (b) b_total, count(*) filter (b and not (a1 or a2 or a3)) b_new"


def _titled(t: Tables) -> DataFrame:
    """Documents as titles of events and natures; some name what the labelling rule looks for."""
    return labels.label_rule(t.documents.select("doc_id", planted("event").alias("event_title"), planted("nature").alias("nature_title")))


@query(f"with {_FLAGS} select doc_id, a1, a2, a3, b, concat_ws(',', case when a1 then 'A1' end, case when a2 then 'A2' end, case when a3 then 'A3' end, case when b then 'B' end) rule_hits from f")
def label_rule(t: Tables) -> DataFrame:
    return _titled(t).select("doc_id", "a1", "a2", "a3", "b", "rule_hits")


@query(f"with {_FLAGS} select {_CONTRIBUTIONS} from f")
def rule_contribution(t: Tables) -> DataFrame:
    return labels.contributions(_titled(t))


@query("select " + _norm("p_name") + " title, count(*) n_rows, count(distinct p_name) raw_titles, array_to_string(list_sort(list(distinct p_name)), '|') as collapsed from part group by 1")
def title_inventory(t: Tables) -> DataFrame:
    return labels.title_inventory(t.part, "p_name").withColumn("collapsed", F.array_join("collapsed", "|"))


@query("with s as (select o_custkey code, list_sort(list_distinct(list(o_orderpriority) filter (year(o_orderdate) < 1998))) b, list_sort(list_distinct(list(o_orderpriority) filter (year(o_orderdate) >= 1998))) a from orders group by 1) select code, array_to_string(b, '|') titles_before, array_to_string(a, '|') titles_after from s where len(b) > 0 and len(a) > 0 and b <> a")
def code_collision(t: Tables) -> DataFrame:
    rows = labels.code_collisions(t.orders, "o_custkey", "o_orderpriority", F.year("o_orderdate") >= 1998)
    return rows.select("code", F.array_join("before", "|").alias("titles_before"), F.array_join("after", "|").alias("titles_after"))


@query("select year(o_orderdate) >= 1998 late, count(*) n_rows, cast(sum((o_orderpriority in ('1-URGENT', '2-HIGH'))::int) as bigint) positives, sum((o_orderpriority in ('1-URGENT', '2-HIGH'))::int)::double / count(*) as share from orders group by 1")
def era_stability(t: Tables) -> DataFrame:
    return labels.era_stability(t.orders, F.year("o_orderdate") >= 1998, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query(
    "with e as (select o_orderkey id, o_orderkey % 11 = 0 or o_orderkey % 13 = 0 e3, o_orderkey % 11 <> 0 and o_orderkey % 7 = 0 e1, row_number() over (partition by case when o_orderkey % 3 = 0 then o_custkey else -o_orderkey end order by o_orderkey) > 1 e2, o_orderkey % 17 <> 0 and o_orderkey % 5 = 0 e4 from orders) "
    "select id, e1, e2, e3, e4, e1 or e2 or e3 or e4 excluded from e"
)
def exclusion_frame(t: Tables) -> DataFrame:
    """Orders as incidents, with missing titles of both kinds, excluded events, repeated ids and short or missing narratives among them."""
    k = F.col("o_orderkey")
    event = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.lit("Animal  bites, nonvenomous")).otherwise(F.col("o_orderpriority"))
    story = F.when(k % 17 == 0, F.lit(None)).when(k % 5 == 0, F.lit("nineteen characters")).otherwise(F.lit("a narrative of enough length"))
    id_ = F.when(k % 3 == 0, F.col("o_custkey")).otherwise(-k)
    rows = t.orders.select(id_.alias("id"), k.alias("seq"), event.alias("event_title"), F.when(k % 13 != 0, F.col("o_orderstatus")).alias("nature_title"), story.alias("narrative"))
    return labels.exclusions(rows).select(F.col("seq").alias("id"), "e1", "e2", "e3", "e4", "excluded")


@query("select doc_id, positive from (select doc_id, toxic = 1 positive, row_number() over (partition by toxic order by (doc_id * 7919) % 10007, doc_id) n from labels) where n <= 50")
def balanced_sample(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", (F.col("toxic") == 1).alias("positive"))
    return labels.balanced_sample(rows, "positive", 100, (F.col("doc_id") * 7919) % 10007, F.col("doc_id"))


@query("with r as (select doc_id, row_number() over (order by (doc_id * 7919) % 10007, doc_id) n, count(*) over () k from documents) select doc_id, case when n <= round_even(k * 0.6::double, 0) then 'clean' when n <= round_even(k * 0.6::double, 0) + round_even(k * 0.3::double, 0) then 'moderate' else 'heavy' end noise_tier from r")
def noise_tiers(t: Tables) -> DataFrame:
    return labels.noise_tiers(t.documents.select("doc_id"), (F.col("doc_id") * 7919) % 10007, "doc_id")


@query("with r as (select doc_id, toxic, quality, row_number() over (partition by toxic, quality order by (doc_id * 7919) % 10007, doc_id) n, count(*) over (partition by toxic, quality) k from labels) select doc_id, toxic, quality, case when n <= round_even(k * 0.15::double, 0) then 'test' else 'train' end fold from r")
def stratified_split(t: Tables) -> DataFrame:
    return labels.split_by_stratum(t.labels.select("doc_id", "toxic", "quality"), ["toxic", "quality"], 0.15, (F.col("doc_id") * 7919) % 10007, F.col("doc_id"))


@query(f"with {_RULES}, {_TAGS}, n as (select rule_name, count(distinct report_id) n from tagged group by 1), b as (select report_id, arg_min(rule_name, (n, ordinal)) stratum from tagged join n using (rule_name) group by 1) select doc_id report_id, coalesce(stratum, 'none') stratum from documents left join b on doc_id = report_id")
def rarest_rule(t: Tables) -> DataFrame:
    tagged = t.documents.select(F.col("doc_id").alias("report_id")).join(t.tags().where(F.col("rule_name").isin(*fixed.RULES)).groupBy("report_id").agg(F.collect_set("rule_name").alias("tags")), "report_id", "left")
    return labels.rarest_rule(tagged).select("report_id", "stratum")


#: CRC-32 of the digits of doc_id: a table of 256 steps, then one look-up a byte.
_CRC_STEPS = "".join(f", t{k} as (select b, xor(c >> 1, 3988292384 * (c & 1)) c from t{k - 1})" for k in range(1, 9))


@query(f"with t0 as (select b, b c from (select unnest(range(0, 256)) b)){_CRC_STEPS}, crc as (select list(c order by b) t from t8) select doc_id, cast(xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::bigint) % 8 as bigint) site from documents, crc")
def site_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", stats.hash_bucket(F.col("doc_id"), 8).alias("site"))


@query("with r as (select doc_id, text, row_number() over (order by (doc_id * 7919) % 10007, doc_id) n from documents), f as (select doc_id, text, (doc_id * 7919) % 10 < 2 test from r) select doc_id, 'text' leak from f where test and text in (select text from f where not test)")
def leakage(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text").withColumn("test", (F.col("doc_id") * 7919) % 10 < 2)
    return labels.leaks(rows.where("not test"), rows.where("test"), "doc_id", "text")


# -- texts --------------------------------------------------------------------------------------


@query(f"with p as (select doc_id, {planted_sql('script')} t from documents) select doc_id, regexp_matches(t, '[\\x{{0900}}-\\x{{097F}}]') devanagari, case when length(x) > 180 then x[:180] || '…' else x end excerpt from (select *, trim(regexp_replace(t, '\\s+', ' ', 'g')) x from p)")
def script_and_excerpt(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", planted("script").alias("text"))
    return rows.select("doc_id", text.has_devanagari(F.col("text")).alias("devanagari"), text.excerpt(F.col("text")).alias("excerpt"))


@query("select doc_id, regexp_matches(" + planted_sql("control") + ", '(?i)(^|[^\\pL\\pN_])(" + "|".join(fixed.CONTROL_TERMS).replace(r"\w*", r"[\pL\pN_]*") + ")([^\\pL\\pN_]|$)') names_control from documents")
def control_language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.names_control(planted("control")).alias("names_control"))


def _sql_map(terms: dict[str, str]) -> str:
    return "map([" + ", ".join(f"'{k}'" for k in terms) + "], [" + ", ".join("'" + v.replace("'", "''") + "'" for v in terms.values()) + "])"


def _sql_mapped(body: str, terms: dict[str, str]) -> str:
    """SQL of whole words replaced by ``terms``; those of several words stand first."""
    for term in sorted((k for k in terms if " " in k), key=len, reverse=True):
        body = f"regexp_replace({body}, '(?i)(^|[^\\pL\\pN_]){term}([^\\pL\\pN_]|$)', '\\1{terms[term]}\\2', 'g')"
    single = {k: v for k, v in terms.items() if " " not in k}
    return f"array_to_string(list_transform(regexp_extract_all({body}, '[\\pL\\pN_]+|[^\\pL\\pN_]+'), lambda p: coalesce({_sql_map(single)}[lower(p)], p)), '')"


@query(f"select doc_id, {_sql_mapped(planted_sql('acronym'), fixed.ACRONYMS)} expanded from documents")
def acronym_expand(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.expand_acronyms(planted("acronym")).alias("expanded"))


#: A lexicon for texts in French, Spanish and German, as that of Roman Hindi is a parameter.
_LEXICON = {"los": "the", "die": "the", "del": "of", "que": "that", "la": "the", "und": "and"}
#: What planted misspellings are repaired to.
_REPAIRED = ["equipment", "working", "safety"]
_SPARED = sorted(set(fixed.DOMAIN_WORDS) | set(_LEXICON) | {w for v in _LEXICON.values() for w in v.split()} | set(fixed.ACRONYMS) | {w for v in fixed.ACRONYMS.values() for w in v.split()} | {"dg", "set"})


@query(
    f"with stems as (select regexp_replace(lower(unnest(regexp_extract_all(text, '[\\pL\\pN_'']+'))), chr(39) || 's$', '') word from documents), known as (select word from stems group by 1 having length(word) >= 4 or count(*) >= 40 union select unnest([{', '.join(repr(w) for w in [*_SPARED, *_REPAIRED])}])), "
    f"ex as (select doc_id, {planted_sql('misspelt')} raw, {_sql_mapped(planted_sql('spelt'), fixed.ACRONYMS)} e from documents), m as (select doc_id, raw, {_sql_mapped('e', _LEXICON)} n, len(list_filter(regexp_extract_all(lower(e), '[\\pL\\pN_]+'), lambda w: list_contains([{', '.join(repr(w) for w in _LEXICON)}], w))) mapped from ex), "
    "u as (select doc_id, count(*) unknown from (select doc_id, lower(unnest(regexp_extract_all(n, '[a-zA-Z]+(?:''[a-zA-Z]+)*'))) word from m) where word not in (select word from known) group by 1), "
    "j as (select m.*, coalesce(unknown, 0) unknown, case when mapped + coalesce(unknown, 0) = 0 then 1.0::double else mapped::double / (mapped + coalesce(unknown, 0)) end share, raw is null or trim(regexp_replace(raw, '\\s', ' ', 'g')) = '' blank from m left join u using (doc_id)) "
    "select doc_id, case when blank then '' when share < 0.5 then raw else n end cleaned_text, case when blank then 'en' when mapped > 0 then 'hi-en' else 'en' end language_detected, case when blank then 1.0::double else share end confidence, not blank and share < 0.5 degraded from j"
)
def clean_reports(t: Tables) -> DataFrame:
    """Whole documents cleaned, some with misspelt words at their end.

    The dictionary holds every word of the documents that is long enough for the repair of spelling,
    common short ones, and what the misspelt words should be; these are repaired.
    """
    known = spelling.stems(t.documents, "text").groupBy("word").agg(F.count("*").alias("freq")).where((F.length("word") >= 4) | (F.col("freq") >= 40))
    known = known.union(t.spark.createDataFrame([(w, 1) for w in _REPAIRED], "word string, freq long"))
    return cleaning.clean_reports(t.documents.withColumn("text", planted("misspelt")), "doc_id", "text", known, _LEXICON, digits=None).select("doc_id", "cleaned_text", "language_detected", F.col("normalization_confidence").alias("confidence"), "degraded")


@query()
def redact_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.redacted(F.col("text")).alias("redacted"))


@query(f"select doc_id, {planted_sql('redacted', 'lower(text)')} redacted from documents")
def redacted_remarks(t: Tables) -> DataFrame:
    """Whole documents without capitals, and a remark after each that names people, days, places, or nobody."""
    return t.documents.select("doc_id", F.lower("text").alias("text")).select("doc_id", text.redacted(planted("name")).alias("redacted"))


@query("with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_''\\-]+')) word from documents) select word, count(*) n, count(distinct doc_id) docs from w group by 1")
def word_census(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(text.words(F.col("text"))).alias("word"))
    return rows.groupBy("word", "doc_id").agg(F.count("*").alias("k")).groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query("with w as (select distinct left(x, 2) || substr(x, 4) word from (select lower(split_part(p_name, ' ', 1)) x from part)), d as (select distinct lower(split_part(p_name, ' ', 1)) candidate from part) select word, candidate from w, d where length(word) >= 4 and word not in (select candidate from d) and damerau_levenshtein(word, candidate) = 1")
def spelling_candidates(t: Tables) -> DataFrame:
    first = F.lower(F.split("p_name", " ")[0])
    words = t.part.select(F.concat(F.substring(first, 1, 2), F.substring(first, 4, 1000)).alias("word"))  # a letter is left out
    known = t.part.groupBy(F.lower(F.split("p_name", " ")[0]).alias("word")).agg(F.count("*").alias("freq"))
    return spelling.candidates(words.where("word is not null"), known).select("word", "candidate")


@query(f"with {_RULES}, p as (select doc_id, rule_name, ordinal, ((doc_id * 37 + ordinal * 101) % 97) / 97.0::double p from documents, rules) select doc_id, string_agg(rule_name, '|' order by round_even(p, 3) desc, ordinal) filter (p >= 0.7) tags, count(*) filter (p >= 0.7) n from p group by doc_id")
def tag_decisions(t: Tables) -> DataFrame:
    """Probabilities of all rules as tags, surest first, of those that reach the threshold."""
    p = F.array(*[((F.col("doc_id") * 37 + i * 101) % 97) / F.lit(97.0) for i in range(len(fixed.RULES))])
    tags = t.documents.select("doc_id", stats.over_threshold(p, 0.7).alias("t"))
    return tags.select("doc_id", F.nullif(F.array_join(F.transform("t", lambda x: x["rule_name"]), "|"), F.lit("")).alias("tags"), F.size("t").cast("long").alias("n"))


# -- spans --------------------------------------------------------------------------------------


def _all_spans(t: Tables) -> DataFrame:
    gold, said = t.word_spans()
    one = gold.select("report_id", F.lit("location").alias("entity_type"), "span_start", "span_end").union(said.select("report_id", F.lit("activity"), "span_start", "span_end"))
    return one.join(t.documents.select(F.col("doc_id").alias("report_id"), "text"), "report_id").withColumn("entity_text", F.substr("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")))


def _listed(t: Tables) -> DataFrame:
    rows = _all_spans(t)
    return rows.groupBy("report_id", "text").agg(F.collect_list(F.struct("entity_type", "entity_text", "span_start", "span_end")).alias("spans"))


@query(f"with {_SPANS}, x as (select *, p_s < g_e and g_s < p_e crossing, p_e - p_s > g_e - g_s or (p_e - p_s = g_e - g_s and p_s < g_s) later_wins from sp), k as (select doc_id, text, 'location' entity_type, g_s s, g_e e from x where not (crossing and later_wins) union all select doc_id, text, 'activity', p_s, p_e from x where not crossing or later_wins) select doc_id report_id, entity_type, substr(text, s + 1, e - s) entity_text, s::int span_start, e::int span_end from k")
def span_resolve(t: Tables) -> DataFrame:
    return _listed(t).select("report_id", F.explode(spans.resolved(F.col("spans"))).alias("s")).select("report_id", "s.*")


_SEGMENTS = (
    "o as (select doc_id, text, case when g_s < p_s or (g_s = p_s and g_e >= p_e) then [g_s, g_e, p_s, p_e] else [p_s, p_e, g_s, g_e] end x, case when g_s < p_s or (g_s = p_s and g_e >= p_e) then ['location', 'activity'] else ['activity', 'location'] end n from sp), "
    "k as (select doc_id, text, case when x[3] >= x[2] then [{'a': 0, 'b': x[1], 't': null}, {'a': x[1], 'b': x[2], 't': n[1]}, {'a': x[2], 'b': x[3], 't': null}, {'a': x[3], 'b': x[4], 't': n[2]}, {'a': x[4], 'b': length(text), 't': null}] else [{'a': 0, 'b': x[1], 't': null}, {'a': x[1], 'b': x[2], 't': n[1]}, {'a': x[2], 'b': length(text), 't': null}] end s from o), "
    "f as (select doc_id, text, list_filter(s, lambda e: e.b > e.a) s from k), e as (select doc_id, text, unnest(s) s, unnest(range(0, len(s)))::int place from f)"
)


@query(f"with {_SPANS}, {_SEGMENTS} select doc_id report_id, place, substr(text, s.a + 1, s.b - s.a) as text, s.t as entity_type from e")
def segments(t: Tables) -> DataFrame:
    return _listed(t).select("report_id", F.posexplode(spans.segments(F.col("text"), F.col("spans"))).alias("place", "s")).select("report_id", "place", "s.text", "s.entity_type")


@query(f"with {_SPANS}, x as (select doc_id, concat_ws(',', case when doc_id % 4 = 1 then 'negative' end, case when doc_id % 4 = 2 then 'out of range' end, case when doc_id % 4 <> 0 then 'text differs' end, case when doc_id % 4 = 3 then 'unknown type' end, case when case when doc_id % 4 = 1 then -5 else g_s end < p_e and p_s < case when doc_id % 4 = 2 then length(text) + 9 else g_e end then 'overlap' end) broken from sp) select doc_id report_id, broken from x where broken <> ''")
def span_violations(t: Tables) -> DataFrame:
    """Spans of all documents, three in four of them with a fault put in, and the invariants they break."""
    k = F.col("report_id") % 4
    faulty = lambda s: F.struct(F.when(k == 3, "weather").otherwise(s["entity_type"]).alias("entity_type"), F.when(k > 0, "other text").otherwise(s["entity_text"]).alias("entity_text"), F.when(k == 1, -5).otherwise(s["span_start"]).alias("span_start"), F.when(k == 2, F.length("text") + 9).otherwise(s["span_end"]).alias("span_end"))
    listed = _listed(t).withColumn("spans", F.transform(F.col("spans").cast(spans.SPANS), lambda s: F.when(s["entity_type"] == "location", faulty(s).cast(spans.SPANS[6:-1])).otherwise(s)))
    rows = listed.withColumn("broken", F.array_join(spans.violations(F.col("text"), F.col("spans")), ","))
    return rows.where("broken <> ''").select("report_id", "broken")


@query(f"with {_SPANS}, c as (select count(*) gold, count(*) predicted, count(*) filter (g_s = p_s and g_e = p_e) exact, count(*) filter (p_s < g_e and g_s < p_e) as overlap from sp) select 'activity' entity_type, *, {_sql_f1('exact')}, {_sql_f1('overlap')} from c where gold > 0")
def span_scores(t: Tables) -> DataFrame:
    return evaluate.span_scores(*t.word_spans())


@query(f"with {_SPANS} select 'activity' a, 'location' b, count(distinct doc_id) reports, count(*) pairs from sp where p_s < g_e and g_s < p_e having count(*) > 0")
def overlap_pairs(t: Tables) -> DataFrame:
    return evaluate.overlap_pairs(_all_spans(t))


@query(f"with {_SPANS}, i as (select word, count(*) inside from (select unnest(regexp_extract_all(lower(substr(text, g_s + 1, g_e - g_s)), '[\\pL\\pN_''\\-]+')[2:]) word from sp) group by 1), a as (select word, count(*) as after from (select regexp_extract(lower(substr(text, g_e + 1, 24)), '[\\pL\\pN_''\\-]+') word from sp) where word <> '' group by 1) select word, after, coalesce(inside, 0) inside from a left join i using (word) where regexp_matches(word, '^\\pL+$') and after > coalesce(inside, 0) and after >= 2")
def activity_stop(t: Tables) -> DataFrame:
    gold, _ = t.word_spans()
    rows = gold.join(t.documents.select(F.col("doc_id").alias("report_id"), "text"), "report_id")
    part = rows.select(F.substr("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("entity_text"), F.substr("text", F.col("span_end") + 1, F.lit(24)).alias("following"))
    return evaluate.stop_words(part).select("word", "after", "inside")


@query(
    "with k as (select unnest([0, 1, 2, 3, 7]) r, unnest(['equipment', 'location', 'activity', 'barrier_failure', 'barrier_failure']) entity_type, unnest(['steel pump', 'near the pit', 'Welding old parts', 'no guard', 'helmet nahi tha']) entity_text) "
    "select doc_id, entity_type, entity_text, (length(text) + 2)::int span_start, (length(text) + 2 + length(entity_text))::int span_end from documents join k on doc_id % 10 = r where text is not null"
)
def planted_spans(t: Tables) -> DataFrame:
    """Spans of all types by a small fixed vocabulary, planted at the end of whole documents among what only looks like them."""
    terms = [("equipment_head", "pump"), ("equipment_modifier", "steel"), ("location_head", "pit"), ("activity_verb", "welding"), ("stop", "when"), ("barrier_control", "guard"), ("absence_phrase", "nahi tha")]
    rows = t.documents.select("doc_id", planted("span").alias("text"))
    found = extract.extracted(rows, "doc_id", "text", t.spark.createDataFrame(terms, "kind string, term string"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query("with w as (select string_split(lower(p_name), ' ') w from lineitem join part on l_partkey = p_partkey) select 'activity_verb' kind, w[1] term, count(*) n from w group by all having count(*) >= 2")
def gazetteer(t: Tables) -> DataFrame:
    return evaluate.gazetteer(t.order_spans())


def _gold_of_four_types(t: Tables) -> DataFrame:
    """Marked words of every line of twelve words or more of whole documents: an activity, equipment, a location, and what follows an absence word."""
    word, gap = r"[\p{L}\p{N}_]++", r"[^\p{L}\p{N}_]++"
    lines = t.documents.select(F.col("doc_id").alias("report_id"), F.explode(F.split("text", "\n")).alias("text"))
    rows = lines.where(F.col("text").rlike(rf"^(?:[^\p{{L}}\p{{N}}_]*+{word}){{12}}"))
    part = lambda first, n: F.regexp_extract("text", rf"^(?:[^\p{{L}}\p{{N}}_]*+{word}){{{first - 1}}}{gap}({word}(?:{gap}{word}){{{n - 1}}})", 1)
    barrier = F.regexp_extract("text", r"(?i)(?<![\p{L}\p{N}_])((?:no|not|without|missing|koi)\s+[\p{L}\p{N}_'\-]+)", 1)
    found = F.array(*[F.struct(F.lit(k).alias("entity_type"), v.alias("entity_text")) for k, v in (("activity", part(3, 3)), ("equipment", part(6, 2)), ("location", part(9, 2)), ("barrier_failure", barrier))])
    return rows.select("report_id", "text", F.explode(found).alias("s")).select("report_id", "text", "s.*").where("entity_text <> ''")


def _vocabulary(t: Tables) -> DataFrame:
    found = _gold_of_four_types(t)
    following = F.when(F.col("entity_type") == "activity", F.substr("text", F.locate("entity_text", F.col("text")) + F.length("entity_text"), F.lit(24)))
    # every kind of term is mined from it; of the lines only what follows an activity is kept
    gold = stored(found.select("entity_type", "entity_text", following.alias("following")))
    return extract.vocabulary(evaluate.gazetteer(gold), evaluate.stop_words(gold.where("entity_type = 'activity'").select("entity_text", "following")))


@query()
def extract_spans(t: Tables) -> DataFrame:
    """Spans of all four types in all documents, by the whole vocabulary mined from them."""
    found = extract.extracted(t.documents.select("doc_id", "text"), "doc_id", "text", _vocabulary(t))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


# -- model quality ------------------------------------------------------------------------------


@query(f"with {_SCORES}, c as (select count(*) filter (p >= 0.5 and truth) tp, count(*) filter (p >= 0.5 and not truth) fp, count(*) filter (p < 0.5 and truth) fn, count(*) filter (p < 0.5 and not truth) tn from scores) select *, (tp + tn)::double / (tp + fp + fn + tn) accuracy, (tp + fp)::double / (tp + fp + fn + tn) positive_rate, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp::double / (tp + fn) else 0.0 end as recall, case when tp > 0 then 2 * (tp::double / (tp + fp)) * (tp::double / (tp + fn)) / (tp::double / (tp + fp) + tp::double / (tp + fn)) else 0.0 end f1 from c")
def confusion(t: Tables) -> DataFrame:
    return evaluate.confusion(t.scores()).select("tp", "fp", "fn", "tn", "accuracy", "positive_rate", "precision", "recall", "f1")


@query(f"with {_SCORES}, b as (select cast(ceil((confidence - 0.5) * 20) as bigint) b, count(*) n, cast(sum(correct::int) as bigint) hits from s2 where confidence > 0.5 group by 1) select b - 1 as bin, n, hits from b")
def calibration_bins(t: Tables) -> DataFrame:
    s = t.scores().where("confidence > 0.5")
    return s.groupBy((F.ceil((F.col("confidence") - 0.5) * 20) - 1).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("hits"))


@query(f"with {_SCORES}, b as (select ceil((confidence - 0.5) * 20) b, count(*) n, avg(correct::int) a, avg(confidence) c from s2 group by 1) select coalesce(sum(n * abs(a - c)) filter (b > 0) / sum(n), 0.0) ece from b")
def ece(t: Tables) -> DataFrame:
    return evaluate.calibration_error(t.scores())


@query(f"with {_SCORES}, g as (select i::int place, 0.05::double * pow(200.0::double, i / 160.0::double) temperature from (select unnest(range(0, 161)) i)), l as (select place, temperature, avg(ln(1 + exp(-(case when truth then margin else -margin end) / temperature))) loss from scores, g group by 1, 2) select place, temperature, loss, place in (0, 160) at_edge from l order by loss, place limit 1")
def temperature_grid(t: Tables) -> DataFrame:
    grid = evaluate.temperatures()
    return evaluate.best_temperature(evaluate.temperature_losses(t.scores(), grid), len(grid))


@query(f"with {_SCORES}, g as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85])::double threshold) select threshold, count(*) filter (confidence >= threshold) auto_published, count(*) filter (confidence < threshold) reviewed, count(*) filter (confidence >= threshold and truth and not correct) missed_sif, case when count(*) filter (confidence >= threshold) > 0 then count(*) filter (confidence >= threshold and correct)::double / count(*) filter (confidence >= threshold) end auto_accuracy from s2, g group by 1")
def threshold_sweep(t: Tables) -> DataFrame:
    return evaluate.threshold_sweep(t.scores(), [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85])


def _decisions(t: Tables) -> DataFrame:
    ids = t.documents.select(F.col("doc_id").alias("d"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(n).alias("rule_name")) for i, n in enumerate(fixed.RULES)]))
    return ids.select("d", each.alias("x")).select("x.rule_name", (F.col("d") % (F.col("x.r") + 2) == 0).alias("truth"), (F.col("d") % (F.col("x.r") + 3) == 0).alias("predicted"))


_PER_RULE = f"{_RULES}, c as (select rule_name, count(*) filter (doc_id % (ordinal + 2) = 0) support, count(*) filter (doc_id % (ordinal + 2) = 0 and doc_id % (ordinal + 3) = 0) tp, count(*) filter (doc_id % (ordinal + 2) <> 0 and doc_id % (ordinal + 3) = 0) fp, count(*) filter (doc_id % (ordinal + 2) = 0 and doc_id % (ordinal + 3) <> 0) fn from documents, rules group by 1), p as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp::double / (tp + fn) else 0.0 end as recall from c), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end f1 from p)"


@query(f"with {_PER_RULE} select *, case when support = 0 then 'not computable' when support < 3 then 'low support' else 'reported' end status from f")
def per_rule(t: Tables) -> DataFrame:
    return evaluate.per_rule(_decisions(t))


@query(f"with {_PER_RULE} select coalesce(avg(f1) filter (support >= 3), 0.0) macro_f1, count(*) filter (support >= 3) covered, case when sum(2 * tp + fp + fn) > 0 then 2.0::double * sum(tp) / sum(2 * tp + fp + fn) else 0.0 end micro_f1 from f")
def macro_f1(t: Tables) -> DataFrame:
    return evaluate.macro_f1(evaluate.per_rule(_decisions(t)), 3).drop("covered_rules")


# -- resubmissions ------------------------------------------------------------------------------


@query("with f as (select doc_id, first_value(doc_id) over (partition by text order by doc_id) first_id from documents where text is not null) select * from f where doc_id <> first_id")
def exact_dup(t: Tables) -> DataFrame:
    return repeats.exact_repeats(t.documents.select("doc_id", "text"), "doc_id", "text", "doc_id")


@query(f"with {_REPORTS}, {_VERDICTS}, {_SITES}, once as (select report_id from (select report_id, row_number() over (partition by raw_text order by report_id) n from reports) where n = 1), g as (select site_id, site_name group_name, region, count(*) total, cast(sum(sif_potential::int) as bigint) positives from reports join once using (report_id) join verdicts using (report_id) join sites using (site_id) group by all) select *, {_RATE} rate, {_WILSON} rank_score from g")
def density_dedup(t: Tables) -> DataFrame:
    reports = t.reports()
    again = repeats.exact_repeats(reports.select("report_id", "raw_text"), "report_id", "raw_text", "report_id")
    return reads.density_by_site(repeats.without(reports, again, "report_id"), t.classifications(), t.sites(), digits=None)
