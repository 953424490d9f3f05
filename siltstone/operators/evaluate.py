"""Evaluation: assertions on syntheses, comparison with a baseline, exit codes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import claims_grounded, strip_space
from siltstone.functions.urls import hosts_allowed
from siltstone.operators.corpus import duplicate_ids
from siltstone.operators.reports import PERSPECTIVES

ASSERTIONS = ("where_diverged_nonempty", "sources_allowed", "lifespan_positive", "claims_grounded")
#: Exit codes: nothing got worse, something did, the dataset is unusable.
GOOD, WORSE, UNUSABLE = 0, 1, 2


def diverges(text: Column) -> Column:
    """Something other than white space is said."""
    return F.coalesce(strip_space(text) != "", F.lit(False))


def lifespan_positive(months: Column) -> Column:
    """Unknown, or over 0."""
    return F.coalesce(months > 0, F.lit(True))


def all_grounded(claims: list[Column], body: Column) -> Column:
    """Every numeric claim of every text (null texts have none) stands verbatim in the body."""
    out = F.lit(True)
    for c in claims:
        out = out & claims_grounded(F.coalesce(c, F.lit("")), F.coalesce(body, F.lit("")))
    return out


def assertions(syntheses: DataFrame, bodies: DataFrame, allowed: Column) -> DataFrame:
    """(row_id, candidate_id, the four ASSERTIONS, all_ok) of syntheses with where_diverged, why_similar, rationales (array), lifespan_months, sources."""
    rows = syntheses.drop("body").join(bodies.select("candidate_id", "body"), "candidate_id", "left")
    texts = [F.col("why_similar"), *(F.get("rationales", F.lit(i)) for i in range(len(PERSPECTIVES)))]
    checks = {
        "where_diverged_nonempty": diverges(F.col("where_diverged")), "sources_allowed": F.coalesce(hosts_allowed(F.col("sources"), allowed), F.lit(True)),
        "lifespan_positive": lifespan_positive(F.col("lifespan_months")), "claims_grounded": all_grounded(texts, F.col("body")),
    }
    out = rows.select("row_id", "candidate_id", *(c.alias(k) for k, c in checks.items()))
    every = F.lit(True)
    for k in ASSERTIONS:
        every = every & F.col(k)
    return out.withColumn("all_ok", every)


def results(checked: DataFrame) -> DataFrame:
    """(row_id, candidate_id, assertion, ok), the form that baselines have."""
    pairs = F.array(*(F.struct(F.lit(k).alias("assertion"), F.col(k).alias("ok")) for k in ASSERTIONS))
    return checked.select("row_id", "candidate_id", F.explode(pairs).alias("x")).select("row_id", "candidate_id", "x.*")


def candidate_counts(checked: DataFrame) -> DataFrame:
    """(row_id, candidates_count)."""
    return checked.groupBy("row_id").agg(F.count("*").alias("candidates_count"))


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(row_id, candidate_id, assertion, change) on both levels.

    An assertion that was true and is false is a regression, false before and true now an improvement.  A
    candidate that is gone is one regression (assertion null) if any of its assertions was true; one that is new
    is a warning, and so is a new assertion of a known candidate.
    """
    key = ["row_id", "candidate_id"]
    was, now = baseline.groupBy(*key).agg(F.bool_or("ok").alias("any_true")), current.select(*key).distinct()
    gone = was.join(now, key, "left_anti").where("any_true").select(*key, F.lit(None).cast("string").alias("assertion"), F.lit("regression").alias("change"))
    new = now.join(was, key, "left_anti").select(*key, F.lit(None).cast("string").alias("assertion"), F.lit("warning").alias("change"))
    both = was.join(now, key, "left_semi").select(*key)
    b, c = baseline.join(both, key, "left_semi").withColumnRenamed("ok", "was"), current.join(both, key, "left_semi").withColumnRenamed("ok", "now")
    one = b.join(c, [*key, "assertion"], "full")
    change = F.when(F.col("was") & ~F.coalesce("now", F.lit(False)), "regression").when(F.col("was").isNull(), "warning").when(~F.col("was") & F.col("now"), "improvement")
    return one.select(*key, "assertion", change.alias("change")).where("change is not null").unionByName(gone).unionByName(new)


def exit_code(changes: DataFrame) -> int:
    return GOOD if changes.where("change = 'regression'").isEmpty() else WORSE


def check_dataset(rows: DataFrame, row_id: str = "row_id", scope: str | None = None) -> None:
    """Row ids must be there once each, and a scope must name one."""
    twice = [r[row_id] for r in duplicate_ids(rows, row_id).limit(20).collect()]
    if twice:
        raise ValueError(f"row ids that stand twice: {', '.join(sorted(map(str, twice)))}")
    if scope is not None and rows.where(F.col(row_id) == scope).isEmpty():
        raise ValueError(f"no row {scope}")


def baseline_json(current: DataFrame) -> str:
    """The results as sorted JSON: row, candidate, assertion.  A dataset of pitches is small: it is read by people."""
    out: dict = {}
    for r in current.collect():
        out.setdefault(str(r.row_id), {"assertions": {}})["assertions"].setdefault(str(r.candidate_id), {})[r.assertion] = r.ok
    for row in out.values():
        row["candidates_count"] = len(row["assertions"])
    return json.dumps({"rows": out}, indent=2, sort_keys=True) + "\n"


def read_baseline(spark, text: str) -> DataFrame:
    """The table of a baseline's JSON; an empty text has none."""
    rows = json.loads(text)["rows"] if text.strip() else {}
    flat = [(r, c, a, ok) for r, row in rows.items() for c, checks in row["assertions"].items() for a, ok in checks.items()]
    return spark.createDataFrame(flat, "row_id string, candidate_id string, assertion string, ok boolean")
