"""What a model may call while it writes a synthesis, and the chunker, as table functions; calls share a quota."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.chunks import OVERLAP, WINDOW, spans

#: Calls of one synthesis, at most; characters of a post-mortem, and of a hit's snippet; hits of a search.
QUOTA, BODY, SNIPPET, HITS = 8, 8000, 500, 5


@F.udtf(returnType="chunk_idx bigint, start bigint, stop bigint")
class HeadingWindows:
    """The windows of one text, for LATERAL: ``heading_windows(text)``; no rows for a text that is null or empty."""

    def eval(self, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int]]:
        yield from spans(text, window, overlap)


def register(spark: SparkSession, documents: DataFrame, chunks: DataFrame | None = None) -> None:
    """Makes ``heading_windows`` (for LATERAL), and over ``documents`` (canonical_id, body) the view that ``get_post_mortem`` reads."""
    spark.udtf.register("heading_windows", HeadingWindows)
    documents.select("canonical_id", "body").createOrReplaceTempView("post_mortems")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_post_mortem(wanted STRING) RETURNS TABLE (canonical_id STRING, body STRING)
      RETURN SELECT canonical_id, CASE WHEN length(body) > {BODY} THEN concat(substr(body, 1, {BODY}), '\n\n[...truncated; full body is ', length(body), ' chars...]') ELSE body END AS body FROM post_mortems WHERE canonical_id = wanted""")


def post_mortem(body):
    """A body as a tool gives it: its head, and a note of how long it is if that is not all."""
    note = F.concat(F.lit("\n\n[...truncated; full body is "), F.length(body).cast("string"), F.lit(" chars...]"))
    return F.when(F.length(body) > BODY, F.concat(F.substring(body, 1, BODY), note)).otherwise(body)


def answered(calls: DataFrame, documents: DataFrame, found: DataFrame | None = None, quota: int = QUOTA) -> DataFrame:
    """(synthesis_id, seq, outcome, result) of calls (synthesis_id, seq, tool, argument), in their order within a synthesis.

    All tools of a synthesis share ``quota``: later calls are ``refused`` and reach no table.  ``get_post_mortem`` gives the body of the
    document (canonical_id, body) that its argument names, or is ``not_found``; ``search_corpus`` the hits of ``found`` (argument, result), an empty
    list without any; other tools are ``unknown``, and count too.
    """
    order = Window.partitionBy("synthesis_id").orderBy("seq")
    rows = calls.withColumn("_n", F.row_number().over(order))
    within = rows.where(F.col("_n") <= quota)
    bodies = documents.select(F.col("canonical_id").cast("string").alias("argument"), post_mortem(F.col("body")).alias("_body"))
    got = within.where("tool = 'get_post_mortem'").join(bodies, "argument", "left").select("synthesis_id", "seq", F.when(F.col("_body").isNull(), "not_found").otherwise("answered").alias("outcome"), F.col("_body").alias("result"))
    asked = within.where("tool = 'search_corpus'")
    hits = asked.join(found.select("argument", "result"), "argument", "left") if found is not None else asked.withColumn("result", F.lit(None).cast("string"))
    hits = hits.select("synthesis_id", "seq", F.lit("answered").alias("outcome"), F.coalesce("result", F.lit("[]")).alias("result"))
    nothing = F.lit(None).cast("string").alias("result")
    other = within.where("tool is null or tool not in ('get_post_mortem', 'search_corpus')").select("synthesis_id", "seq", F.lit("unknown").alias("outcome"), nothing)
    refused = rows.where(F.col("_n") > quota).select("synthesis_id", "seq", F.lit("refused").alias("outcome"), nothing)
    return got.unionByName(hits).unionByName(other).unionByName(refused)
