"""Ranking of chunks for many queries at once: dense and sparse legs, fusion, boosts, parents.

Both legs search an index (``vectorindex``, ``postings``) that is built once and may be kept; where none is given, one is
made for the call.  Scores are rounded before ranking and ties go to the smaller id, so ranks do not depend on the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import postings, vectorindex
from siltstone.operators.hits import DIGITS, topk


def dense_leg(points: DataFrame, queries: DataFrame, k: int, index: vectorindex.VectorIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` nearest chunks by cosine for each query, of those that its cut-off admits.

    Exact, over all chunks that have a vector of the index's width; queries without one have no rows.
    """
    return (index or vectorindex.temporary(points)).search(queries, k)


def sparse_leg(points: DataFrame, queries: DataFrame, k: int, index: postings.PostingIndex | None = None, k1: float = postings.K1, b: float = postings.B) -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25, both sides weighted; chunks without a shared term are not in it."""
    return (index or postings.temporary(points)).search(queries, k, k1, b)


def rrf(legs: list[DataFrame], k: int, rrf_k: int = 60, rank_base: int = 1) -> DataFrame:
    """Reciprocal rank fusion: (query_id, chunk_id, score), the best ``k`` of each query."""
    rows = None
    for leg in legs:
        one = leg.select("query_id", "chunk_id", (1.0 / (rrf_k + F.col("rank") - 1 + rank_base)).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return topk(fused, "query_id", [F.desc("score"), F.asc("chunk_id")], k)


def facet_match(query: dict[str, str], point: dict[str, str]) -> F.Column:
    """All of the query's facets that are not ``other`` equal the chunk's, and there is one: all or nothing."""
    asked, same = F.lit(False), F.lit(True)
    for f in query:
        q, p = F.col(query[f]), F.col(point[f])
        given = F.coalesce(q != "other", F.lit(False))
        asked, same = asked | given, same & (~given | F.coalesce(p == q, F.lit(False)))
    return asked & same


def parent_collapse(hits: DataFrame, score: str = "score") -> DataFrame:
    """The best chunk of each parent: higher score, then lower chunk_idx; empty parents are dropped."""
    rows = hits.where(F.coalesce(F.col("canonical_id").cast("string"), F.lit("")) != "")
    return topk(rows, ["query_id", "canonical_id"], [F.desc(score), F.asc("chunk_idx")], 1).drop("rank")


def hybrid(points: DataFrame, queries: DataFrame, k: int = 10, facets: tuple[str, ...] = ("sector", "geography"), facet_boost: float = 0.01, rrf_k: int = 60, rank_base: int = 1, dense: vectorindex.VectorIndex | None = None, sparse: postings.PostingIndex | None = None) -> DataFrame:
    """Filter, two legs of 2k, fusion to 2k, facet boost, best chunk of each parent, first k.

    ``points``: chunk_id, canonical_id, chunk_idx, text, embedding, facets and dates; ``queries``: query_id,
    text, embedding, facets, cutoff; ``dense`` and ``sparse``: the indexes of ``points``.  Payloads join after ranking.
    """
    fused = rrf([dense_leg(points, queries, 2 * k, dense), sparse_leg(points, queries, 2 * k, sparse)], 2 * k, rrf_k, rank_base).drop("rank")
    hits = boosted(fused, points, queries, facets, facet_boost)
    best = parent_collapse(hits)
    return topk(best, "query_id", [F.desc("score"), F.asc("canonical_id"), F.asc("chunk_idx")], k).select("query_id", "canonical_id", "chunk_idx", "score", "rank")


def boosted(hits: DataFrame, points: DataFrame, queries: DataFrame, facets: tuple[str, ...] = ("sector", "geography"), facet_boost: float = 0.01) -> DataFrame:
    """``hits`` (query_id, chunk_id, score) with their payload and the boost of those whose facets all match added to the score."""
    asked = queries.select("query_id", *(F.col(f).alias(f"q_{f}") for f in facets))
    payload = points.select("chunk_id", "canonical_id", "chunk_idx", *facets)
    rows = hits.join(asked, "query_id").join(payload, "chunk_id")
    boost = F.when(facet_match({f: f"q_{f}" for f in facets}, {f: f for f in facets}), facet_boost).otherwise(0.0)
    return rows.withColumn("boost", boost).withColumn("score", F.round(F.col("score") + boost, DIGITS))
