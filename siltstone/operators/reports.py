"""The query pipeline for a batch of pitches, from facets to reports, as one plan over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.dates import whole_months
from siltstone.functions.prompts import synthesis_values
from siltstone.functions.text import injection_flag, strip_links
from siltstone.operators import ranked as rank
from siltstone.operators.graph import written as put
from siltstone.operators.models import Completer, asked
from siltstone.operators.postings import PostingIndex
from siltstone.operators.retrieval import hybrid
from siltstone.operators.vectorindex import VectorIndex

PERSPECTIVES = ("business_model", "market", "gtm", "stage_scale")
_SCORES = ", ".join(f"{p}: struct<score: double, rationale: string>" for p in PERSPECTIVES)
RERANKED = f"ranked array<struct<candidate_id: string, {_SCORES}>>"
SYNTHESIS = f"name string, one_liner string, similarity struct<{_SCORES}>, why_similar string, where_diverged string, failure_causes array<string>, lessons array<string>"
RISKS = "risks array<struct<summary: string, applies_because: string, raised_by: array<string>, severity: string>>, injection boolean"


def extract_facets(pitches: DataFrame, facets: tuple[str, ...], completer: Completer, config: Config) -> DataFrame:
    """``pitches`` (query_id, name, description) with a column for each facet: values outside the taxonomy, and failed calls, are ``other``."""
    listed = "; ".join(f"{f}: {', '.join(config.taxonomy.get(f, ()))}" for f in facets)
    rows = asked(pitches, "facet_extract", {"taxonomy": F.lit(listed), "description": F.coalesce("description", F.lit(""))}, ", ".join(f"{f} string" for f in facets), completer, config.models["facet"])
    for f in facets:
        value = F.col(f"answer.{f}")
        allowed = value.isin(*config.taxonomy[f]) if config.taxonomy.get(f) else value.isNotNull()
        rows = rows.withColumn(f, F.when(F.coalesce(allowed, F.lit(False)), value).otherwise("other"))
    return rows.drop("answer", "error").withColumnRenamed("cost_usd", "facet_cost")


def rerank(retrieved: DataFrame, pitches: DataFrame, completer: Completer, config: Config) -> DataFrame:
    """(query_id, candidate_id, pos, mean, scores): one call for a query's candidates (query_id, candidate_id, summary, pos).

    A query's list is its k candidates at most.  A ranking must have min(n, candidates) entries, no more and no less, else the
    query ends with an error; ids that were not retrieved go.
    """
    line = F.struct("pos", F.concat("candidate_id", F.lit(": "), F.coalesce("summary", F.lit(""))).alias("s"))
    lists = retrieved.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n").alias("candidates"), F.count("*").alias("_n"))
    facets = F.to_json(F.struct(*(c for c in pitches.columns if c in ("sector", "geography", "customer_type", "monetization"))))
    rows = pitches.join(lists, "query_id")
    rows = asked(rows, "llm_rerank", {"description": F.coalesce("description", F.lit("")), "facets": facets, "candidates": F.col("candidates")}, RERANKED, completer, config.models["rerank"])
    want = F.least(F.col("_n"), F.lit(config.n_synthesize))
    whole = F.when(F.size("answer.ranked") == want, True).otherwise(F.raise_error(F.format_string("query %s: ranking of %d for %d", F.col("query_id").cast("string"), F.coalesce(F.size("answer.ranked"), F.lit(-1)), want)).cast("boolean"))
    found = rows.where(whole).select("query_id", F.col("cost_usd").alias("rerank_cost"), F.posexplode("answer.ranked").alias("pos", "r"))
    mean = rank.mean_score(*(f"r.{p}.score" for p in PERSPECTIVES))
    found = found.select("query_id", "rerank_cost", F.col("r.candidate_id").alias("candidate_id"), F.col("pos").cast("long"), mean.alias("mean"))
    return found.join(retrieved.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")


def synthesize(chosen: DataFrame, completer: Completer, config: Config) -> DataFrame:
    """Syntheses of (query_id, candidate_id, pos, name, description, body, dates, sources): failed ones go; ``injection`` marks those that met one."""
    values = synthesis_values(F.col("name"), F.coalesce("description", F.lit("")), F.col("candidate_id"), F.col("founding_date"), F.col("failure_date"), F.col("body"))
    rows = asked(chosen, "synthesize", values, SYNTHESIS, completer, config.models["synthesize"]).where("error is null")
    mean = rank.mean_score(*(f"answer.similarity.{p}.score" for p in PERSPECTIVES))
    months = whole_months(F.col("founding_date"), F.col("failure_date"))
    return rows.withColumn("mean", mean).withColumn("lifespan_months", months).withColumn("injection", injection_flag(F.col("answer.where_diverged"))).withColumnRenamed("cost_usd", "synthesis_cost")


def consolidate(syntheses: DataFrame, pitches: DataFrame, completer: Completer, config: Config) -> DataFrame:
    """Ranked risks of each query from the distinct lessons of its syntheses; none where a synthesis met an injection."""
    lessons = syntheses.select("query_id", "candidate_id", "pos", F.posexplode("answer.lessons").alias("at", "lesson")).withColumn("order", F.struct("pos", "at"))
    distinct = rank.distinct_lessons(lessons, ["query_id", "candidate_id"], "lesson", "order")
    line = F.struct("pos", "at", F.concat("candidate_id", F.lit(": "), "lesson").alias("s"))
    lists = distinct.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n").alias("lessons"))
    rows = pitches.join(lists, "query_id")
    rows = asked(rows, "consolidate_risks", {"description": F.coalesce("description", F.lit("")), "lessons": F.col("lessons")}, RISKS, completer, config.models["consolidate"])
    risks = rows.where("error is null").select("query_id", F.posexplode("answer.risks").alias("pos", "r")).select("query_id", F.col("pos").cast("long"), "r.*")
    valid = syntheses.groupBy("query_id").agg(F.collect_set("candidate_id").alias("ids"))
    risks = risks.join(rows.where("answer.injection").select("query_id"), "query_id", "left_anti")
    return rank.consolidate(risks, valid, syntheses.where("injection"))


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), strip_links(x))), "\n")


def candidate_section() -> Column:
    """A synthesis as a section of the report; links lose their targets, sources are plain."""
    text = lambda c: strip_links(F.coalesce(F.col(c), F.lit("")))
    score = lambda p: F.concat(F.lit(f"| {p} | "), F.format_string("%.1f", F.col(f"answer.similarity.{p}.score")), F.lit(" | "), text(f"answer.similarity.{p}.rationale"), F.lit(" |"))
    table = _lines("| Perspective | Score | Rationale |", "| --- | --- | --- |", *(score(p) for p in PERSPECTIVES))
    failed = F.coalesce(F.date_format("failure_date", "yyyy-MM-dd"), F.lit("unknown"))
    lived = F.coalesce(F.concat(F.col("lifespan_months").cast("string"), F.lit(" months")), F.lit("unknown"))
    parts = [F.concat(F.lit("## "), "answer.name"), text("answer.one_liner"), _lines(F.concat(F.lit("Failure date: "), failed), F.concat(F.lit("Lifespan: "), lived))]
    for title, body in (
        ("Similarity", table), ("Why similar", text("answer.why_similar")), ("Where diverged", text("answer.where_diverged")), ("Failure causes", _bullets(F.col("answer.failure_causes"))),
        ("Lessons", _bullets(F.col("answer.lessons"))), ("Sources", F.array_join(F.coalesce("sources", F.array().cast("array<string>")), "\n")),
    ):
        parts += [F.lit(f"{title}:"), body]
    return F.concat_ws("\n\n", *parts)


def banner(candidates: Column, dropped: Column, least: float) -> Column:
    """Why a report has no candidates; null where it has some."""
    head = f"No comparables passed similarity threshold {least:.1f}. "
    some = F.concat(F.lit(head), dropped.cast("string"), F.lit(" candidate(s) were filtered out. Try a lower min_similarity."))
    return F.when(candidates == 0, F.when(dropped > 0, some).otherwise(head + "The pitch may be outside the corpus, or the threshold (min_similarity) too strict."))


def render(pitches: DataFrame, syntheses: DataFrame, risks: DataFrame, counts: DataFrame, config: Config, generated_at: str) -> DataFrame:
    """(query_id, report): header, banner or risks and candidates, footer.  A report is a pitch's n candidates at most."""
    sections = syntheses.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate_id", F.col("answer.name").alias("name"), candidate_section().alias("s")))).alias("c"))
    item = F.struct("rank", "severity", "summary", "applies_because", "raised_by")
    rows = pitches.join(sections, "query_id", "left").join(risks.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("k")), "query_id", "left").join(counts, "query_id", "left")
    names = F.map_from_entries(F.transform(F.coalesce("c", F.array()), lambda x: F.struct(x["candidate_id"], x["name"])))
    n = F.coalesce(F.size("c"), F.lit(0))
    rows = rows.withColumn("_n", F.when(F.col("c").isNull(), 0).otherwise(n)).withColumn("_names", names)

    def risk(x: Column) -> Column:
        who = F.array_join(F.transform(x["raised_by"], lambda i: F.coalesce(F.element_at("_names", i), i)), ", ")
        return F.concat(
            x["rank"].cast("string"), F.lit(". ["), F.upper(x["severity"]), F.lit("] "), strip_links(x["summary"]), F.lit("\n   Applies because: "), strip_links(F.coalesce(x["applies_because"], F.lit(""))),
            F.lit("\n   Raised by: "), who, F.lit(" ("), F.size(x["raised_by"]).cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(")"),
        )

    money = lambda c: F.format_string("%.4f", F.coalesce(F.col(c), F.lit(0.0)))
    left = F.format_string("%.4f", F.lit(config.budget_usd) - F.coalesce("cost_usd", F.lit(0.0)))
    over = F.when(F.coalesce("cost_usd", F.lit(0.0)) > config.budget_usd, "True").otherwise("False")
    meta = [("cost_usd_total", money("cost_usd")), ("budget_remaining_usd", left), ("budget_exceeded", over), ("K_retrieve", F.lit(str(config.k_retrieve))), ("N_synthesize", F.lit(str(config.n_synthesize))), ("min_similarity_score", F.lit(f"{config.min_similarity:.1f}"))]
    footer = F.concat_ws("\n\n", F.lit("---"), F.lit("Pipeline meta:"), _lines(*(F.concat(F.lit(f"- {k}: "), v) for k, v in meta)), F.lit("Models:"), _lines(*(f"- {k}: {v}" for k, v in sorted(config.models.items()))))
    dropped = F.coalesce(F.col("filtered_pre") + F.col("filtered_post"), F.lit(0))
    report = F.concat_ws(
        "\n\n", F.concat(F.lit("# Report for "), F.coalesce("name", F.col("query_id").cast("string"))), F.concat(F.lit("Pitch: "), strip_links(F.coalesce("description", F.lit("")))), F.lit(f"Generated: {generated_at}"),
        banner(F.col("_n"), dropped, config.min_similarity), F.when(F.size("k") > 0, F.concat(F.lit("## Top risks across all comparables\n\n"), F.array_join(F.transform("k", risk), "\n\n"))),
        F.when(F.col("_n") > 0, F.array_join(F.transform("c", lambda x: x["s"]), "\n\n")), footer,
    )
    return rows.select("query_id", report.alias("report"))


def debug_text(hits: DataFrame) -> DataFrame:
    """(query_id, listing): rank, id and score of a query's hits, one a line."""
    line = F.struct("rank", F.format_string("%d. %s %.6f", "rank", F.col("canonical_id").cast("string"), "score").alias("s"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n").alias("listing"))


def run_queries(pitches: DataFrame, points: DataFrame, documents: DataFrame, completer: Completer, config: Config, generated_at: str, facets: tuple[str, ...] = ("sector", "geography"), extracted: bool = False, dense: VectorIndex | None = None, sparse: PostingIndex | None = None) -> dict[str, DataFrame]:
    """The whole batch: ``syntheses``, ``risks``, ``counts`` and ``reports``.

    Hits, rankings, syntheses and risks are written once to the shared folder: several of the results read them, and
    a lost executor does not cost the calls again.  ``pitches``: query_id, name, description, text, embedding, cutoff if wanted, and the facets if ``extracted``;
    ``points``, ``dense`` and ``sparse``: see ``retrieval.hybrid``; ``documents``: canonical_id, name, summary, body, founding_date,
    failure_date, sources.  Facets, retrieval, reranking, threshold, synthesis, second threshold, risks, report.
    """
    queries = pitches if extracted else put(extract_facets(pitches, facets, completer, config), "queries")
    hits = put(hybrid(points, queries, config.k_retrieve, facets, config.facet_boost, config.rrf_k, dense=dense, sparse=sparse), "hits")
    known = hits.join(documents.select("canonical_id", "summary"), "canonical_id").select("query_id", F.col("canonical_id").cast("string").alias("candidate_id"), F.col("rank").alias("pos"), "summary")
    order = put(rerank(known, queries, completer, config), "ranking")
    chosen = rank.top_by_similarity(order, config.min_similarity, config.n_synthesize)
    about = documents.withColumn("candidate_id", F.col("canonical_id").cast("string")).select("candidate_id", "body", "founding_date", "failure_date", "sources")
    asked_for = chosen.select("query_id", "candidate_id", "pos").join(queries.select("query_id", "name", "description"), "query_id").join(about, "candidate_id")
    written = put(synthesize(asked_for, completer, config), "syntheses")
    kept = written.where(F.col("mean") >= config.min_similarity)
    risks = put(consolidate(kept, queries, completer, config), "risks")
    pre = order.groupBy("query_id").agg(F.max("rerank_cost").alias("_rc")).join(chosen.groupBy("query_id").agg(F.count("*").alias("_c")), "query_id", "left")
    post = written.groupBy("query_id").agg(F.count_if(F.col("mean") < config.min_similarity).alias("_p"), F.sum("synthesis_cost").alias("_sc"))
    counts = queries.select("query_id").join(pre, "query_id", "left").join(post, "query_id", "left")
    counts = counts.select("query_id", F.greatest(config.n_synthesize - F.coalesce("_c", F.lit(0)), F.lit(0)).alias("filtered_pre"), F.coalesce("_p", F.lit(0)).alias("filtered_post"), F.round(F.coalesce("_rc", F.lit(0.0)) + F.coalesce("_sc", F.lit(0.0)), 6).alias("cost_usd"))
    return {"syntheses": kept, "risks": risks, "counts": counts, "reports": render(queries, kept, risks, counts, config, generated_at)}
