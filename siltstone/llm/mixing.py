"""Mixing to target weights with soft memberships, in DataFrame operations only.

A naive Bayes classifier with Gaussian statistics is fitted on the labelled table and gives each document a
posterior over the labelled domains.  Nonnegative rates per document are then fitted so that the expected
domain totals of tokens, sum(rate * tokens * posterior), meet the targets: projected gradient steps on the
squared misses, in the metric of the domains' Gram matrix, starting from rate 1.  At most STEPS steps are
shortened by a ridge; steps without it follow until every domain is within TOLERANCE of its target.  A nearly empty
domain is a domain like any other: its target holds, so what little there is of it is repeated as often as that takes.
A target is given up only where no step lowers the misses any more, as for a domain that no document belongs to; the
log says so, and ``misses`` gives the domains' targets and totals.  A step needs sums over domains and
pairs of domains only, so that is what reaches the driver, and a rate is a fold over the steps so far.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.components import written

#: The label column whose values are the domains, and the domains' target weights; those of values without labels are left out.
DOMAIN = "quality"
TARGETS = {"1": 0.97, "0": 0.03}
STEPS, TOLERANCE = 12, 1e-7
#: Added to the Gram matrix in the first STEPS steps, as a share of all tokens: rates do not fall to 0 at once for a rare domain's sake.
RIDGE = 1e-3
FEATURES = ("log_words", "word_length", "symbols", "capitals", "wide")
#: Posteriors are tempered: the statistics are not independent.
TEMPER = 0.5


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (words) and FEATURES.  A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.length("t").alias("chars"), F.octet_length("t").alias("bytes"),
        F.expr(r"cast(regexp_count(t, '[^\\x20\\x09-\\x0D]+') as bigint)").alias("n_tokens"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>!", ""))).alias("marks"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("upper"),
    )
    words, chars = F.greatest(F.col("n_tokens"), F.lit(1)), F.greatest(F.col("chars"), F.lit(1))
    return base.select(
        "doc_id", "n_tokens", F.log1p("n_tokens").alias("log_words"), F.log1p(F.col("chars") / words).alias("word_length"),
        F.log1p(F.col("marks") * 10 / words).alias("symbols"), F.log1p(F.col("upper") * 20 / chars).alias("capitals"), ((F.col("bytes") - F.col("chars")) * 4 / chars).alias("wide"),
    )


def domains(labels: DataFrame, column: str = DOMAIN) -> DataFrame:
    """(doc_id, domain) of the labelled rows; repeated ids count once."""
    rows = labels.select("doc_id", F.col(column).cast("string").alias("domain")).where("doc_id is not null and domain is not null")
    return rows.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def posteriors(stats: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """``stats`` with an array ``p`` over the domains that have labels; one domain, all of it, without labels."""
    train = stats.join(domains(labels), "doc_id")
    moments = [f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("mean", F.avg), ("var", F.var_pop))]
    fitted = train.groupBy("domain").agg(F.count("*").alias("n"), *moments).orderBy("domain").collect()
    if not fitted:
        return stats.withColumn("p", F.array(F.lit(1.0))), ["all"]
    total = sum(r.n for r in fitted)
    logs = []
    for r in fitted:
        log = F.lit(float(np.log(r.n / total)))
        for c in FEATURES:
            mean, var = r[f"mean_{c}"], max(r[f"var_{c}"], 1e-3)
            # beyond six deviations a value says no more than that
            far = F.least((F.col(c) - F.lit(float(mean))) * (F.col(c) - F.lit(float(mean))) / F.lit(float(var)), F.lit(36.0))
            log = log - F.lit(TEMPER) * (far / 2 + F.lit(float(np.log(var) / 2)))
        logs.append(log)
    high = F.array_max("logs")
    out = stats.withColumn("logs", F.array(*logs)).withColumn("e", F.transform("logs", lambda x: F.exp(x - high)))
    out = out.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    return out.drop("logs", "e"), [r.domain for r in fitted]


def _rate(steps: list[list[float]], k: int, most: float | None = None) -> Column:
    if not steps:
        return F.lit(1.0)
    history = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in steps))

    def next_rate(r: Column, step: Column) -> Column:
        move = sum((F.col("p")[i] * step[i] for i in range(1, k)), F.col("p")[0] * step[0])
        return F.greatest(F.lit(0.0), r - move if most is None else F.least(r - move, F.lit(float(most))))

    return F.aggregate(history, F.lit(1.0), next_rate)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, keep: str | None, most: float | None = None) -> tuple[DataFrame, list[str], list[list[float]], np.ndarray, np.ndarray]:
    """Documents with posteriors, the domains, the steps, and the domains' totals of tokens after them: reached and wanted.

    With ``most`` rates are projected to 0 .. ``most``, and steps go in the metric of the Gram matrix's diagonal: a domain that
    the bound keeps short of its target pulls its own documents to the bound, and takes nothing from those of the others.
    """
    targets = targets or TARGETS
    stats, names = posteriors(written(spark, statistics(docs), "statistics"), labels)
    table = written(spark, stats.select("doc_id", "n_tokens", "p"), "posteriors")
    k = len(names)
    w = np.array([targets.get(n, 0.0) for n in names])
    w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """The domains' totals, and the Gram matrix of the documents with a rate."""
        rated = table.select("n_tokens", "p", _rate(steps, k, most).alias("r"))
        tokens = F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(0)
        sums = [F.sum(F.col("r") * F.col("n_tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]
        row = rated.agg(*sums, *(F.sum(tokens * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
        return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    steps: list[list[float]] = []
    have, gram = totals(steps)
    total = have.sum()
    ridged = gram + np.eye(k) * max(total * RIDGE, 1e-9)
    if keep in names and w[names.index(keep)] > 0:
        total = have[names.index(keep)] / w[names.index(keep)]
    want = w * total
    least = TOLERANCE * max(total, 1.0)
    far = lambda x: np.abs(x - want).max(initial=0.0)
    if most is not None:
        return table, names, *_bounded(totals, have, want, np.maximum(np.diag(gram), 1e-9), least), want
    for _ in range(STEPS):
        if far(have) <= least:
            break
        steps.append(np.linalg.solve(ridged, have - want).tolist())
        have, active = totals(steps)
    inverse = np.linalg.pinv(gram)
    size = lambda x: float((x - want) @ inverse @ (x - want))
    while far(have) > least:
        # Newton's step on the documents that have a rate; where it does not help, the plain one, which never raises the misses
        for metric, worth in ((active, 0.25), (gram, 1.0)):
            step = np.linalg.lstsq(metric, have - want, rcond=None)[0].tolist()
            after, left = totals([*steps, step])
            if size(after) < worth * size(have):
                break
        if size(after) >= size(have) or np.abs(after - have).max() <= least * 1e-3:
            break
        steps.append(step)
        have, active = after, left
    for n, x, y in zip(names, have, want, strict=True):
        if abs(x - y) > least:
            logging.getLogger(__name__).warning("domain %s: %.1f tokens, target %.1f", n, x, y)
    return table, names, steps, have, want


def _bounded(totals, have: np.ndarray, want: np.ndarray, scale: np.ndarray, least: float) -> tuple[list[list[float]], np.ndarray]:
    """(steps, totals after them) of projected gradients under a bound, until the misses end or no step lowers them by a hundredth."""
    steps: list[list[float]] = []
    size = lambda x: float(((x - want) ** 2 / scale).sum())
    while np.abs(have - want).max(initial=0.0) > least:
        step = ((have - want) / scale).tolist()
        after, _ = totals([*steps, step])
        if size(after) > 0.99 * size(have):
            break
        steps.append(step)
        have = after
    return steps, have


def mixing_rates(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: str | None = None, most: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, domain (likeliest), posterior (its share), rate (9 digits).

    The targets are shares of the documents' own total of tokens; with ``keep`` of that total at which the
    domain ``keep`` holds what it has.  No rate is over ``most``; what that leaves short of a target is in ``misses``.  Empty texts have no tokens and follow their posterior.  Repeated rows
    count each; other columns are ignored; an empty table gives none.
    """
    table, names, steps, _, _ = fit(spark, docs, labels, targets, keep, most)
    best = F.array_max("p")
    domain = F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position("p", best).cast("int"))
    return table.select("doc_id", "n_tokens", domain.alias("domain"), F.round(best, 9).alias("posterior"), F.round(_rate(steps, len(names), most), 9).alias("rate"))


def misses(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: str | None = None, most: float | None = None) -> DataFrame:
    """(domain, want, have): the tokens that each domain should hold, and those that it holds at the rates."""
    _, names, _, have, want = fit(spark, docs, labels, targets, keep, most)
    return spark.createDataFrame([(n, float(x), float(y)) for n, x, y in zip(names, want, have, strict=True)], "domain string, want double, have double")


def mixed(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: str | None = None, most: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more by a hash of doc_id for the rest.

    Rows that repeat a doc_id (null is one) take its largest rate each; empty texts follow their posterior; all columns
    are kept; an empty table gives none.
    """
    rates = mixing_rates(spark, docs, labels, targets, keep, most).groupBy(F.col("doc_id").alias("id")).agg(F.max("rate").alias("rate"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(rates.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return joined.withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
