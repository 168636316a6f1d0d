"""Queries of near-duplicates over whole documents, with SQL that compares all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import reads, repeats, shingles
from .registry import query
from .views import Tables

#: Words are parted at ASCII white space; A-Z are lower-cased.
_SETS = r"""words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
runs as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end s from words)"""


@query(f"""with recursive {_SETS},
posted as (select doc_id, len(s) n, md5(unnest(s)) h from runs),
alike as (select a.doc_id x, b.doc_id y from posted a join posted b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reached(doc_id, other) as (select doc_id, doc_id from runs union select reached.doc_id, y from reached join alike on other = x)
select runs.doc_id, len(s)::bigint n_shingles, min(other) class_id from runs join reached using (doc_id) group by runs.doc_id, len(s)""")
def near_dup_shingles(t: Tables) -> DataFrame:
    return shingles.near_duplicates(t.documents, "doc_id", "text")


@query()
def near_dup_ratio(t: Tables) -> DataFrame:
    """Documents whose text an earlier one of their source nearly has, by sequence ratio over whole texts."""
    return repeats.ratio_repeats(t.documents.select("doc_id", "text", "source"), "doc_id", "text", "doc_id", within="source")


@query()
def density_near_dedup(t: Tables) -> DataFrame:
    """Density by site with reports left out whose text an earlier report of the site nearly has."""
    reports = t.reports()
    again = repeats.ratio_repeats(reports.select("report_id", "raw_text", "site_id"), "report_id", "raw_text", "report_id", within="site_id")
    return reads.density_by_site(repeats.without(reports, again, "report_id"), t.classifications(), t.sites(), digits=None)
