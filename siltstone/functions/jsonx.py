"""Answers in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiebreak_decision(c: Column) -> Column:
    """The decision of an answer, ``different`` where it is malformed or unknown."""
    d = F.lower(F.get_json_object(c, "$.decision"))
    return F.when(d.isin("same", "different"), d).otherwise("different")


#: Characters of a text that a slop judge sees.
JUDGED = 6000


def judged_head(text: Column) -> Column:
    """What a slop judge is given of a text."""
    return F.substring(text, 1, JUDGED)


def slop_score(c: Column) -> Column:
    """0 for text that is no JSON; 1 for JSON that is no object or does not say ``true``; 0 where it does."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    said = F.to_json(F.try_variant_get(v, "$.is_dead_company", "variant"))  # a string keeps its quotes
    return F.when(v.isNull(), 0.0).when(~kind.startswith("OBJECT"), 1.0).when(said == "true", 0.0).otherwise(1.0)
