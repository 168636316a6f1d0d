"""The given tables as the logical inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


#: What stands at the end of documents, by ``doc_id`` modulo the first number, for rules that no document meets by itself.
PLANTED = {
    "event": (12, {0: ". Other fall to lower level 20 feet", 1: ". Other fall to lower level less than 6 feet", 2: ". Struck by falling object, or equipment", 3: " Fall or jump curtailed by personal fall arrest system", 4: " EXPLOSION of nonpressurized vapors"}),
    "nature": (10, {0: ". Electrocutions, electric shocks", 1: ". Asphyxiations, strangulations, suffocations", 2: ". Cuts, lacerations"}),
    "control": (9, {0: " the guard was NOT locked", 4: " guardian angels of lockers", 7: " isolated by a banksman"}),
    "acronym": (8, {0: " no PPE, LOTO by the hse", 3: " ppe-check by xPPE", 5: " SIMOPS_1 h2s."}),
    "script": (6, {2: " सुरक्षा", 4: " suraksha"}),
    "span": (10, {0: "; steel pump", 1: "; near the pit", 2: "; Welding old parts when wet", 3: "; no guard", 4: "; pump-like steelpump", 5: "; no old guard", 6: "; nahi tha", 7: "; helmet nahi tha"}),
    "name": (6, {0: " and then Ramesh Kumar fell", 1: ". Dr. Sen", 2: " on a Monday", 3: " near Duliajan Road", 4: ". Slipped", 5: ", Asha, who"}),
    "redacted": (6, {0: " and then [REDACTED] fell", 1: ". Dr. [REDACTED]", 2: " on a Monday", 3: " near Duliajan Road", 4: ". Slipped", 5: ", [REDACTED], who"}),
    "misspelt": (7, {0: " Equipmnt", 2: " wrking saefty", 3: " equipment"}),
    "spelt": (7, {0: " Equipment", 2: " working safety", 3: " equipment"}),
}


def planted_sql(kind: str, body: str = "text") -> str:
    """SQL of ``body`` with what ``planted`` adds."""
    k, said = PLANTED[kind]
    return f"({body} || case doc_id % {k} " + " ".join(f"when {r} then '{t}'" for r, t in said.items()) + " else '' end)"


def planted(kind: str, body: str = "text") -> Column:
    k, said = PLANTED[kind]
    end = F.lit("")
    for r, t in said.items():
        end = F.when(F.col("doc_id") % k == r, F.lit(t)).otherwise(end)
    return F.concat(F.col(body), end)


class Tables:
    """Given tables of one folder, and views on them; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sites(self) -> DataFrame:
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("site_name"), F.col("r_name").alias("region"))

    def reports(self) -> DataFrame:
        at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
        return self.documents.select(F.col("doc_id").alias("report_id"), F.substring("source", 4, 9).cast("int").alias("site_id"), F.col("text").alias("raw_text"), at.alias("submitted_at"))

    def classifications(self) -> DataFrame:
        status = F.when(F.col("doc_id") % 7 == 0, "confirmed").when(F.col("doc_id") % 11 == 0, "overridden").otherwise("auto")
        return self.labels.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("report_id"), (F.col("toxic") == 1).alias("sif_potential"), (0.5 + ((F.col("doc_id") * 37) % 50) / 100.0).alias("confidence"), status.alias("review_status"))

    def tags(self) -> DataFrame:
        ids = self.documents.select(F.col("doc_id").alias("report_id"))
        each = F.filter(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(name).alias("rule_name")) for i, name in enumerate(fixed.RULES)]), lambda x: F.col("report_id") % (x["r"] + 2) == 0)
        tagged = ids.select("report_id", F.explode(each).alias("t")).select("report_id", "t.rule_name")
        unknown = ids.where("report_id % 13 = 0").select("report_id", F.lit("Housekeeping").alias("rule_name"))
        return tagged.union(unknown).union(tagged.where("report_id % 10 = 0"))

    def order_spans(self) -> DataFrame:
        lines = self.lineitem.select(F.col("l_orderkey").alias("report_id"), "l_partkey").join(self.part.select("p_partkey", F.col("p_name").alias("entity_text")), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select("report_id", F.lit("activity").alias("entity_type"), "entity_text")

    def order_verdicts(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_orderkey").alias("report_id")).agg(F.max(F.col("l_returnflag") == "R").alias("sif_potential"))

    def line_verdicts(self) -> DataFrame:
        return self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("site_id"), (F.col("l_returnflag") == "R").alias("sif_potential"))

    def decisions(self) -> DataFrame:
        e = self.events.where("event_type = 'purchase'")
        return e.select(F.col("user_id").alias("report_id"), F.when(F.col("event_id") % 2 == 0, "confirmed").otherwise("overridden").alias("review_status"), (F.col("event_id") % 2 == 0).alias("sif_potential"), F.lit(None).cast("string").alias("reviewed_by"), F.col("ts").alias("decided_at"), F.col("event_id").alias("seq"))

    def scores(self) -> DataFrame:
        margin = (((F.col("doc_id") * 37) % 200) - 100) / 25.0
        rows = self.labels.select("doc_id", (F.col("toxic") == 1).alias("truth"), margin.alias("margin")).withColumn("p", 1 / (1 + F.exp(-F.col("margin"))))
        rows = rows.withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p")))
        return rows.withColumn("correct", (F.col("p") >= 0.5) == F.col("truth"))

    def titles(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("event_title"), F.col("p_type").alias("nature_title"), F.col("p_name").alias("narrative"))

    def word_spans(self) -> tuple[DataFrame, DataFrame]:
        """Gold: words 3 to 5 of a text. Predicted: words 4 to 6 for even ids, else 8 and 9."""
        word = r"[\p{L}\p{N}_]++"
        gap = r"[^\p{L}\p{N}_]++"
        lead = lambda n: rf"^((?:[^\p{{L}}\p{{N}}_]*+{word}){{{n}}}{gap})"
        rows = self.documents.select("doc_id", "text").where(F.col("text").rlike(rf"^(?:[^\p{{L}}\p{{N}}_]*+{word}){{9}}"))

        def span(first: int, n: int):
            start = F.length(F.regexp_extract("text", lead(first - 1), 1))
            body = F.regexp_extract("text", rf"^(?:[^\p{{L}}\p{{N}}_]*+{word}){{{first - 1}}}{gap}({word}(?:{gap}{word}){{{n - 1}}})", 1)
            return start, start + F.length(body)

        def frame(s, e, rows=rows):
            return rows.select(F.col("doc_id").alias("report_id"), F.lit("activity").alias("entity_type"), s.alias("span_start"), e.alias("span_end"))

        gold, even, odd = span(3, 3), span(4, 3), span(8, 2)
        pick = lambda a, b: F.when(F.col("doc_id") % 2 == 0, a).otherwise(b)
        return frame(*gold), frame(pick(even[0], odd[0]), pick(even[1], odd[1]))
