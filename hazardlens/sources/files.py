"""Readers and writers: incident CSV, JSON lines, Parquet tables, metrics and snapshots."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed

#: Columns of the incident CSV, in file order.
INCIDENT_COLUMNS = [
    "ID", "UPA", "EventDate", "Employer", "Address1", "Address2", "City", "State", "Zip", "Latitude", "Longitude",
    "Primary NAICS", "Hospitalized", "Amputation", "Loss of Eye", "Inspection", "Final Narrative", "Nature", "NatureTitle",
    "Part of Body", "Part of Body Title", "Event", "EventTitle", "Source", "SourceTitle", "Secondary Source",
    "Secondary Source Title", "FederalState",
]
#: Columns that may leave the raw frame; the others identify people or places.
PUBLIC_COLUMNS = ["ID", "EventDate", "Hospitalized", "Amputation", "Loss of Eye", "Final Narrative", "Nature", "NatureTitle", "Event", "EventTitle"]

SERVICE = {
    "sites": "id string, name string, region string, latitude double, longitude double",
    "users": "id string, name string, role string, site_id string",
    "reports": "id string, site_id string, raw_text string, cleaned_text string, language_detected string, reporter_role string, submitted_at timestamp, status string",
    "classifications": "id string, report_id string, sif_potential boolean, confidence double, model_version string, review_status string, reviewed_by string",
    "tags": "id string, report_id string, rule_name string, confidence double",
    "precursors": "id string, report_id string, entity_type string, entity_text string, span_start int, span_end int",
}
_SPAN = "struct<text:string,start:int,end:int>"
CORPUS = (
    "id string, site_name string, region string, raw_text string, noise_tier string, sif_potential boolean, sif_rule_hits string, osha_event_title string, osha_nature_title string, osha_narrative string, iogp_rules array<string>, iogp_rules_rejected array<string>, "
    f"precursor_activity {_SPAN}, precursor_location {_SPAN}, precursor_equipment {_SPAN}, precursor_barrier_failure {_SPAN}"
)


def read_incidents(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All columns as strings; only the empty string, quoted or not, is null; narratives may span lines.

    A file with quoted line ends can't be split, so rows are dealt out after reading; ``seq`` is the
    order in the file. Convert once to Parquet for repeated use.
    """
    schema = StructType([StructField(c, StringType()) for c in INCIDENT_COLUMNS])
    rows = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=True).csv(path)
    rows = rows.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns], F.monotonically_increasing_id().alias("seq"))
    return rows.repartition(partitions) if partitions else rows


def public(incidents: DataFrame) -> DataFrame:
    """Only the columns that may leave the raw frame, those of them that are there; all others, known or not, go."""
    return incidents.select(*[F.col(f"`{c}`") for c in PUBLIC_COLUMNS if c in incidents.columns], *[c for c in ("seq",) if c in incidents.columns])


def incident_date(value: Column) -> Column:
    """Month, day and year with slashes as a date; null where it is none."""
    return F.try_to_date(value, "MM/dd/yyyy")


def read_json_lines(spark: SparkSession, path: str, schema: str = CORPUS) -> tuple[DataFrame, DataFrame]:
    """(good rows, torn lines): blank lines are skipped, lines that don't parse are kept apart to be counted."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    torn = F.col("r").isNull() | F.col("r._torn").isNotNull()
    return parsed.where(~torn).select("r.*").drop("_torn"), parsed.where(torn).select(F.col("value").alias("_torn"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(tables: dict[str, DataFrame], root: str) -> None:
    """Add rows to each table; persist what they have in common first, as each is worked out by itself."""
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{root}/{name}")


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a new snapshot, then add a pointer to it; the ones before stay as backups.

    A pointer is one small file that is committed whole, so a reader sees the old table or the new one.
    """
    spark = df.sparkSession
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.createDataFrame([(time.time_ns(), path)], "at long, path string").coalesce(1).write.mode("append").json(f"{root}/{name}.current")
    return path


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest snapshot."""
    pointers = spark.read.schema("at long, path string").json(f"{root}/{name}.current")
    return spark.read.parquet(pointers.orderBy(F.desc("at")).first().path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def unfinished(wanted: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows still to be worked on: ids that the output doesn't hold."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def published(vocab: DataFrame, root: str, name: str = "patterns") -> str:
    """A mined vocabulary as the next snapshot of its table, one row a term."""
    return snapshot(vocab.select("kind", "term"), root, name)


def seeded_sites(sites: DataFrame) -> DataFrame:
    """``sites(site_name, region)`` with the sites of the field that it doesn't have yet."""
    seeds = sites.sparkSession.createDataFrame(fixed.SITES, "site_name string, region string")
    return sites.select("site_name", "region").unionByName(seeds.join(sites.select("site_name"), "site_name", "left_anti"))
