"""Table functions, quotas, and repairs that leave a damaged corpus clean."""

from pyspark.sql import functions as F

from siltstone.operators import models, tools
from siltstone.operators.ingest import Corpus, ingest
from siltstone.operators.repair import corpus_drift, repair


def test_table_functions(spark):
    docs = spark.createDataFrame([("a", "x" * 8001), ("b", "short"), ("c", None)], "canonical_id string, body string")
    tools.register(spark, docs)
    text = " ".join(["w"] * 900)
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("SELECT id, c.* FROM texts, LATERAL heading_windows(t) c ORDER BY 1, 2").collect()] == [(1, 0, 0, 768), (1, 1, 640, 900)]
    assert spark.sql("SELECT body FROM get_post_mortem('a')").first().body == "x" * 8000 + "\n\n[...truncated; full body is 8001 chars...]"
    assert spark.sql("SELECT body FROM get_post_mortem('zz')").count() == 0
    calls = spark.createDataFrame([("s", 1, "get_post_mortem", "b"), ("s", 2, "search_corpus", "q"), ("s", 3, "get_post_mortem", "zz"), ("s", 4, "rm", "b"), ("s", 5, "get_post_mortem", "a"), ("t", 9, "search_corpus", "none")], "synthesis_id string, seq int, tool string, argument string")
    found = spark.createDataFrame([("q", '[{"canonical_id": "a"}]')], "argument string, result string")
    got = {(r.synthesis_id, r.seq): (r.outcome, r.result) for r in tools.answered(calls, docs, found, quota=4).collect()}
    assert got == {("s", 1): ("answered", "short"), ("s", 2): ("answered", '[{"canonical_id": "a"}]'), ("s", 3): ("not_found", None), ("s", 4): ("unknown", None), ("s", 5): ("refused", None), ("t", 9): ("answered", "[]")}


def test_repair(spark, tmp_path):
    store, embedder = Corpus(spark, f"file://{tmp_path}/corpus"), models.HashEmbedder(4)
    schema = "source string, source_id string, text string, canonical_id string"
    entries = spark.createDataFrame([("hn", str(i), f"text {i}", f"c{i // 2}.example") for i in range(8)], schema)
    judged = spark.createDataFrame([], "_key string, judged double")
    ingest(store, entries, models.LabelClassifier(judged, "judged"), embedder, lambda d: d, 1, "2024")
    assert corpus_drift(store).count() == 0 and repair(store, 2, embedder, "2024").count() == 0
    state = lambda: {n: sorted(str(r) for r in store.table(n).drop("seq", "merged_at").collect()) for n in ("journal", "raw", "canonical", "chunks")}
    whole = state()
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "canonical_id string")
    # a: chunks lost; b: a row pending again; c: a text overwritten; d: a raw text without a row; e: chunks of nobody
    store.delete_chunks(one("c0.example"), 3)
    store.append("journal", store.table("journal").where("source_id = '2'").withColumn("merge_state", F.lit("pending")), 8)
    store.append("canonical", store.table("canonical").where("canonical_id = 'c2.example'").withColumn("merged", F.lit("spoilt")).withColumn("content_hash", F.lit("0")), 4)
    store.append("raw", spark.createDataFrame([("csv", "77", "nobody's")], "source string, source_id string, text string"), 5)
    store.append("chunks", store.table("chunks").where("canonical_id = 'c3.example'").withColumn("canonical_id", F.lit("gone.example")), 6)
    found = {(r.drift, r.id, r.action) for r in repair(store, 9, embedder, "2024").collect()}
    assert found == {("a", "c0.example", "rechunk"), ("b", "c1.example", "reprocess"), ("c", "c2.example", "remerge"), ("d", "csv:77", "reingest"), ("e", "gone.example", "delete_chunks")}
    after = state()
    assert {n: after[n] for n in ("journal", "canonical", "chunks")} == {n: whole[n] for n in ("journal", "canonical", "chunks")} and len(after["raw"]) == 9
    n = len(store.commits.snapshot()[1])
    assert {(r.drift, r.id) for r in repair(store, 10, embedder, "2024").collect()} == {("d", "csv:77")} and len(store.commits.snapshot()[1]) == n
