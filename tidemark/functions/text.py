"""Text functions: cleaning, parsing, categories, rendering, validation of model replies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import col

NUMBERED = r"^\s*(\d+)\.\s*(.+?)\s*(?:\s-\s|:)\s*(.+?)\s*$"
UNREPRESENTABLE = "Unrepresentable"


def strip_markup(c: str | Column) -> Column:
    """Without asterisks, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\*+", ""))


def normalise_dashes(c: str | Column) -> Column:
    """Dashes of any kind become a hyphen, runs of white space one space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "[‐-―−]", "-"), r"\s+", " "))


def numbered_items(c: str | Column) -> Column:
    """Array of (no, name, definition) from lines ``N. Name - Definition`` or ``N. Name: Definition``."""
    lines = F.filter(F.split(strip_markup(c), "\n"), lambda x: x.rlike(NUMBERED))
    part = lambda x, i: F.regexp_extract(x, NUMBERED, i)
    return F.transform(lines, lambda x: F.struct(part(x, 1).cast("long").alias("no"), part(x, 2).alias("name"), part(x, 3).alias("definition")))


def first_category(c: str | Column, patterns: Mapping[str, str], other: str = "Other") -> Column:
    """Name of the first pattern that occurs."""
    out = F.lit(other)
    for name, pattern in reversed(list(patterns.items())):
        out = F.when(F.lower(col(c)).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def all_categories(c: str | Column, patterns: Mapping[str, str]) -> Column:
    """Names of all patterns that occur, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(col(c)).rlike(p), F.lit(n)) for n, p in patterns.items()]))


def tokens(c: str | Column, stopwords: Sequence[str] = (), min_length: int = 3) -> Column:
    """Distinct lower-case words ``[a-z0-9]+`` of at least some length that are no stopwords."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), 1)
    keep = F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*stopwords) if stopwords else F.length(w) >= min_length)
    return F.array_distinct(keep)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared over all distinct tokens; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(col(a), col(b))).cast("double"), F.size(F.array_union(col(a), col(b))).cast("double")), F.lit(0.0))


def percent(c: str | Column) -> Column:
    """Share as a percentage of one digit; ``none`` where missing."""
    return F.coalesce(F.when(col(c).isNotNull(), F.concat(F.format_string("%.1f", half_away(col(c).cast("double") * 100, 1)), F.lit("%"))), F.lit("none"))


def number(c: str | Column, digits: int = 2) -> Column:
    return F.coalesce(F.when(col(c).isNotNull(), F.format_string(f"%.{digits}f", half_away(col(c).cast("double"), digits))), F.lit("none"))


def half_away(c: Column, digits: int) -> Column:
    """Halves away from zero, where what the order of a sum takes from a half (1e-7 of the last digit) doesn't decide."""
    return F.when(F.abs(c) * 10**digits < 2.0**52, F.signum(c) * F.floor(F.abs(c) * 10**digits + 0.5 + 1e-7) / 10**digits).otherwise(c)


def text_or_none(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("none"))


def outer_json(c: str | Column) -> Column:
    """The outermost braces of a reply with what they hold."""
    body = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.when(F.length(body) > 0, body)


#: Single quotes that open or close a text of a literal: next to a bracket, comma or colon. An apostrophe inside a word is none.
LITERAL_QUOTES = r"(?<=[\[{(,:]\s{0,9})'|'(?=\s*[\]}),:])"


def parse_reply(c: str | Column, schema: str) -> Column:
    """The JSON object in a reply by a schema; a reply in single quotes is tried second; null if neither reads."""
    body = outer_json(c)
    mode = {"mode": "PERMISSIVE"}
    return F.coalesce(*[F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema, mode)) for x in (body, F.regexp_replace(F.regexp_replace(body, '"', "'"), LITERAL_QUOTES, '"'))])


def valid_labels(labels: str | Column, taxonomy: str | Column) -> Column:
    """The labels that the taxonomy has, in their order, or that say nothing fits."""
    return F.filter(col(labels), lambda x: F.array_contains(col(taxonomy), x) | (x == UNREPRESENTABLE))


def keyword_warnings(text: str | Column, keywords: Sequence[str]) -> Column:
    """The keywords that occur in the text, in their order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(col(text)), k))


def schema_errors(fields: Mapping[str, str | Column], lists: Mapping[str, str | Column]) -> Column:
    """What is missing: a text that is null or blank, a list that is null or empty."""
    texts = [F.when(F.coalesce(F.trim(col(c)), F.lit("")) == "", F.lit(f"{n} is missing")) for n, c in fields.items()]
    rows = [F.when(F.coalesce(F.size(col(c)), F.lit(0)) <= 0, F.lit(f"{n} is empty")) for n, c in lists.items()]
    return F.array_compact(F.array(*texts, *rows))


def mapped(c: str | Column, fixes: Mapping[str, str]) -> Column:
    """The correction of a known slip, else the value itself."""
    out = col(c)
    for wrong, right in fixes.items():
        out = F.when(col(c) == wrong, F.lit(right)).otherwise(out)
    return out
