"""Text functions as column expressions. Offsets are code points; matching never depends on locale."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WORD = r"[\p{L}\p{N}_]"
#: Where a word begins and ends, alike in every Java version.
BEGIN, END = rf"(?<!{WORD})", rf"(?!{WORD})"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether a text holds one of the patterns as it stands; byte searches, each faster than a regular expression."""
    return reduce(Column.__or__, [text.contains(p) for p in patterns])


def normalized_title(title: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and spaces as a space, single spaces, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]", " "), "\\s+", " "))


def pieces(text: Column) -> Column:
    """Words and what stands between them, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"({WORD}+|[^\p{{L}}\p{{N}}_]+)"), 1)


def _several(terms: Iterable[str]) -> list[str]:
    """Terms of several words, longest first."""
    return sorted((t for t in terms if re.search(r"\W", t)), key=len, reverse=True)


def _hits(words: Column, terms: list[str]) -> Column:
    """Which single-word ``terms`` stand among ``words``: one look-up a word in a hash set."""
    return F.array_intersect(words, F.array(*[F.lit(t) for t in terms]).cast("array<string>"))


def mapped(text: Column, terms: Mapping[str, str]) -> Column:
    """Whole words (any case) replaced by what ``terms`` says; terms of several words go first, longest first.

    The words of a text are held against all terms at once; only those terms that stand in it, few
    in number, are then looked up word by word. A text without any stays as it is.
    """
    for term in _several(terms):
        text = F.regexp_replace(text, rf"(?i){BEGIN}\Q{term}\E{END}", terms[term])
    single = {t: v for t, v in terms.items() if not re.search(r"\W", t)}
    if not single:
        return text
    table = F.create_map(*[F.lit(x) for kv in single.items() for x in kv])

    def replaced(parts: Column) -> Column:
        found = _hits(F.transform(parts, F.lower), list(single))
        few = lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(table, k)))
        put = lambda m: F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(m, F.lower(p)), p)), "")
        return bound(found, lambda keys: F.when(F.size(keys) > 0, bound(few(keys), put)))

    return F.coalesce(bound(pieces(text), replaced), text)


def expand_acronyms(text: Column, terms: Mapping[str, str] = fixed.ACRONYMS) -> Column:
    return mapped(text, terms)


def lexicon_counts(text: Column, terms: Mapping[str, str]) -> Column:
    """``struct<text, mapped>``: text by ``terms``, and how many terms were replaced."""
    hits, rest = F.lit(0), text
    for term in _several(terms):
        pattern = rf"(?i){BEGIN}\Q{term}\E{END}"
        hits = hits + F.regexp_count(rest, F.lit(pattern))
        rest = F.regexp_replace(rest, pattern, "\u0001" * 3)
    singles = [t for t in terms if not re.search(r"\W", t)]
    words = F.transform(F.regexp_extract_all(rest, F.lit(rf"({WORD}+)"), 1), F.lower)
    single = bound(words, lambda ws: bound(_hits(ws, singles), lambda keys: F.when(F.size(keys) > 0, F.size(F.filter(ws, lambda w: F.array_contains(keys, w)))).otherwise(0)))
    return F.struct(mapped(text, terms).alias("text"), (hits + single).cast("int").alias("mapped"))


def has_devanagari(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u0900-\\u097F]"), F.lit(False))


def redacted(text: Column) -> Column:
    """Names after a title, and capitalised words inside a sentence that aren't known otherwise."""
    titled = F.regexp_replace(text, rf"\b((?:{'|'.join(fixed.HONORIFICS)})\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", "$1 [REDACTED]")
    marked = F.regexp_replace(titled, r"(?<=[a-z,]\s)([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\b", "\u0002$1\u0003")
    spared = F.regexp_replace(marked, "\u0002((?:" + "|".join(fixed.NOT_NAMES) + ")(?:\\s[A-Z][a-z]+)?)\u0003", "$1")
    return F.regexp_replace(spared, "\u0002[^\u0003]*\u0003", "[REDACTED]")


def names_control(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + BEGIN + "(?:" + "|".join(fixed.CONTROL_TERMS) + ")" + END), F.lit(False))


def control_terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + BEGIN + "(" + "|".join(fixed.CONTROL_TERMS) + ")" + END), 1), F.lower)


def states_absence(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + BEGIN + "(" + "|".join(fixed.ABSENCE_WORDS) + ")" + END), F.lit(False))


def ascii_punctuation(text: Column) -> Column:
    """Typographic dashes, quotes and spaces as ASCII, the ellipsis as three dots, soft hyphens gone."""
    return F.replace(F.translate(text, fixed.TYPOGRAPHIC, fixed.PLAIN), F.lit("…"), F.lit("..."))


def excerpt(text: Column, n: int = fixed.EXCERPT_CHARS) -> Column:
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def words(text: Column) -> Column:
    """Lower-case words with their apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_'\-]+)"), 1)


def activity_bucket(text: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.element_at(F.split(F.trim(F.regexp_replace(text, "\\s+", " ")), " "), 1)), F.lit("")), F.lit("unspecified"))


def located(text: Column, quote: Column) -> Column:
    """``struct<text, start, end>`` of a quote: exact, else any case and trimmed; null if it isn't there."""
    exact = F.when(quote != "", F.call_function("locate", quote, text))
    bare = F.trim(quote)
    loose = F.call_function("locate", F.lower(bare), F.lower(text))
    part = F.substr(text, loose, F.length(bare))
    return (
        F.when(exact > 0, F.struct(quote.alias("text"), (exact - 1).alias("start"), (exact - 1 + F.length(quote)).alias("end")))
        .when((bare != "") & (loose > 0) & (F.lower(part) == F.lower(bare)), F.struct(part.alias("text"), (loose - 1).alias("start"), (loose - 1 + F.length(bare)).alias("end")))
    )


def json_object(text: Column) -> Column:
    """From the first brace to the last; without braces, the trimmed text."""
    found = F.regexp_extract(text, "\\{[\\s\\S]*\\}", 0)
    return F.when(found != "", found).otherwise(F.trim(text))


def reject_reason(raw: Column, role: Column, site: Column, roles: Iterable[str] = fixed.ROLES) -> Column:
    """Why a report is rejected, null if it isn't; its length is judged before NULs are stripped."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "\\x00", ""), "\\s+", " "))
    return (
        F.when(raw.isNull() | (F.length(raw) < 1), "empty")
        .when(F.length(raw) > fixed.MAX_REPORT_CHARS, "too long")
        .when(bare == "", "blank")
        .when(role.isNull() | ~role.isin(*roles), "unknown role")
        .when(site.isNull(), "no site")
    )


def without_nul(text: Column) -> Column:
    return F.regexp_replace(text, "\\x00", "")
