"""Ranked candidates, risks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import strip_space

MOST_HIGH = 4


def mean_score(*columns: str) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)


def top_by_similarity(ranked: DataFrame, least: float, n: int) -> DataFrame:
    """query_id, candidate_id, pos, mean of the candidates at ``least`` or over, the first ``n`` in ranked order."""
    w = Window.partitionBy("query_id").orderBy("pos", F.desc("mean"), "candidate_id")
    return ranked.where(F.col("mean") >= least).withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def dropped_counts(ranked: DataFrame, least: float) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.count_if(F.col("mean") >= least).alias("kept"), F.count_if(F.col("mean") < least).alias("dropped"))


def length_errors(ranked: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """Queries whose ranking does not have min(n, candidates) entries."""
    have = ranked.groupBy("query_id").agg(F.count("*").alias("have"))
    want = candidates.groupBy("query_id").agg(F.least(F.count("*"), F.lit(n)).alias("want"))
    return want.join(have, "query_id", "left").select("query_id", F.coalesce("have", F.lit(0)).alias("have"), "want").where("have <> want")


def distinct_lessons(lessons: DataFrame, key: list[str], text: str, order: str) -> DataFrame:
    """The first of lessons that are equal but for case and outer white space."""
    w = Window.partitionBy(*key, F.lower(strip_space(F.col(text)))).orderBy(order)
    return lessons.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_severity(risks: DataFrame, most: int = MOST_HIGH) -> DataFrame:
    """Over ``most`` high risks of a query, those raised by the fewest become medium (earlier ones first)."""
    w = Window.partitionBy("query_id", "severity").orderBy("n_raised", "pos")
    count = F.count("*").over(Window.partitionBy("query_id", "severity"))
    demoted = (F.col("severity") == "high") & (F.col("_n") <= F.col("_c") - most)
    rows = risks.withColumn("_n", F.row_number().over(w)).withColumn("_c", count)
    return rows.withColumn("severity", F.when(demoted, "medium").otherwise(F.col("severity"))).drop("_n", "_c")


def severity_order() -> Column:
    return F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)


def consolidate(risks: DataFrame, valid: DataFrame, injected: DataFrame) -> DataFrame:
    """query_id, pos, summary, severity, raised_by, n_raised, rank.

    Ids that are no candidate of the query go from raised_by, risks with none left go; queries with an injected
    synthesis have none.  ``risks``: query_id, pos, summary, severity, raised_by; ``valid``: query_id, ids.
    """
    rows = risks.join(injected.select("query_id").distinct(), "query_id", "left_anti").join(valid, "query_id")
    rows = rows.withColumn("raised_by", F.filter("raised_by", lambda x: F.array_contains("ids", x))).withColumn("n_raised", F.size("raised_by").cast("long")).where("n_raised > 0")
    w = Window.partitionBy("query_id").orderBy(severity_order(), F.desc("n_raised"), "pos")
    return cap_severity(rows.drop("ids")).withColumn("rank", F.row_number().over(w).cast("long"))


def running_budget(costs: DataFrame, key: str, seq: str, cost: str, cap: float) -> DataFrame:
    """The first row of each key whose running cost passes the cap, with the sum so far: it is recorded, then stops."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    over = costs.withColumn("spent", F.round(F.sum(cost).over(w), 6)).where(F.col("spent") > cap)
    return over.groupBy(key).agg(F.min(seq).alias("breach"), F.min_by("spent", seq).alias("spent"))


def baseline_diff(baseline: DataFrame, current: DataFrame, key: list[str], value: str) -> DataFrame:
    """regression: true before and false or missing now; warning: new now; improvement: false before, true now."""
    rows = baseline.select(*key, F.col(value).alias("was")).join(current.select(*key, F.col(value).alias("now")), key, "full")
    change = F.when(F.col("was") & ~F.coalesce("now", F.lit(False)), "regression").when(F.col("was").isNull(), "warning").when(~F.col("was") & F.col("now"), "improvement")
    return rows.withColumn("change", change).where("change is not null")
