"""Column functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: corporate suffixes
CORPORATE_SUFFIXES = ("holdings", "group", "corp", "corporation", "ltd", "limited", "llc", "inc", "incorporated", "co", "company", "plc", "gmbh", "ag", "sa", "sas")
_SUFFIX = rf"(?i)\s+({'|'.join(CORPORATE_SUFFIXES)})\b\.?$"


def strip_space(c: Column) -> Column:
    """Trim of all white space, not of blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Null where nothing but white space is left."""
    return F.nullif(strip_space(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def corporate_suffix(c: Column) -> Column:
    """The corporate suffix that ends a name, lower-cased; null if none does."""
    return F.nullif(F.lower(F.regexp_extract(c, _SUFFIX, 1)), F.lit(""))


def name_stem(c: Column) -> Column:
    """The name without ONE trailing corporate suffix."""
    return strip_space(F.regexp_replace(c, _SUFFIX, ""))


def normalize_name(c: Column) -> Column:
    """Stem, lower case, single spaces."""
    return F.regexp_replace(F.lower(name_stem(c)), r"\s+", " ")


def slugify(c: Column, most: int = 40, empty: str = "run") -> Column:
    """Lower-case words joined by hyphens, cut to ``most`` characters."""
    slug = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, most), r"-+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", empty).otherwise(slug)


def model_slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def strip_links(c: Column) -> Column:
    """Markdown images, inline links and reference links as their text; images go first (fixed patterns)."""
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(c, r"\[([^\]]+)\]\[[^\]]+\]", "$1")


def truncate_with_marker(c: Column, most: int) -> Column:
    """The first ``most`` characters and a note of the full length, where there are more."""
    note = F.concat(F.lit("\n\n[...truncated; full body is "), F.length(c), F.lit(" chars...]"))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), note)).otherwise(c)


def truncate_tokens(c: Column, most: int) -> Column:
    """The first ``most`` blank-separated tokens; no limit where it is 0 or less."""
    return c if most <= 0 else F.array_join(F.slice(F.split(c, " "), 1, most), " ")


# fixed values: the families of secret keys
SECRET_PATTERNS = (
    r"(?i)sk-(?:ant-(?:admin\d+-|api\d+-)?|proj-|svcacct-|or-v1-)?[A-Za-z0-9_\-]{20,}",
    r"tvly-[A-Za-z0-9]{20,}",
    r"lmnr_[A-Za-z0-9]{20,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}",
    r"ya29\.[A-Za-z0-9_\-]+",
    r"ghp_[A-Za-z0-9]{36}",
)


def scrub_secrets(c: Column, mark: str = "SCRUBBED") -> Column:
    """Keys of the known families behind a mark."""
    for pattern in SECRET_PATTERNS:
        c = F.regexp_replace(c, pattern, mark)
    return c


# fixed value: what counts as a numeric claim (a number, its unit if any, and one more word if any)
NUMERIC_CLAIM = r"\$?(?:\d[\d,.]*\d|\d)(?:\s*(?:million|billion|[MBK]|%|months?|years?))?(?:\s+\w+)?"


def numeric_claims(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NUMERIC_CLAIM})"), F.lit(1))


def claims_grounded(claim: Column, body: Column) -> Column:
    """Whether each numeric claim of a text stands verbatim in ``body``; true without numbers, false without a body."""
    numbers = numeric_claims(claim)
    return F.when(F.size(numbers) == 0, True).otherwise(F.coalesce(F.forall(numbers, lambda n: F.contains(body, n)), F.lit(False)))


# fixed value: what a synthesis says where it met an injection
INJECTION_MARKER = "prompt_injection_attempted"


def injection_flag(c: Column, marker: str = INJECTION_MARKER) -> Column:
    return F.coalesce(strip_space(c) == marker, F.lit(False))


def format_hits(hits: Column, most: int = 500) -> Column:
    """``- title — url`` and a snippet for each struct of an array, or a note that there is none."""
    line = lambda h: F.concat(F.lit("- "), F.coalesce(h["title"], F.lit("(no title)")), F.lit(" — "), F.coalesce(h["url"], F.lit("")), F.lit("\n  "), F.substring(F.coalesce(h["snippet"], F.lit("")), 1, most))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, line), "\n")).otherwise("(no results)")
