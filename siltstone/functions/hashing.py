"""Keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def short_sha256(c: Column) -> Column:
    """The first 16 hexadecimal digits."""
    return F.substring(F.sha2(c, 256), 1, 16)


def joined_key(*parts: Column, separator: str = "|") -> Column:
    """sha256 of the parts with the separator between them; a null part counts as empty (concat_ws would skip it)."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def pair_key(a: Column, b: Column) -> Column:
    """The same key for both orders of a pair."""
    return F.concat(F.least(a, b), F.char(F.lit(1)), F.greatest(a, b))


def response_key(system: Column, prompt: Column) -> Column:
    return short_sha256(F.concat(F.coalesce(system, F.lit("")), F.char(F.lit(31)), prompt))


def row_id(name: Column, description: Column) -> Column:
    """The name, or eight digits of the description's sha1."""
    return F.coalesce(F.nullif(name, F.lit("")), F.substring(F.sha1(description), 1, 8))
