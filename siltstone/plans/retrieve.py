"""Queries of retrieval: legs, fusion, boosts, parents, aliases."""

from __future__ import annotations

from pyspark.sql import functions as F


from siltstone.config import Config
from siltstone.operators import corpus, graph, models, reports, retrieval, vectorindex
from siltstone.plans.bindings import POINTS_SQL, indexes, pitches, pitches_sql, points, table

QUERIES, ORACLE = {}, {}
K = 30


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_DENSE_ALL = """dense AS (
  SELECT query_id, chunk_id, round(list_dot_product(p.embedding, q.embedding) / (sqrt(list_dot_product(p.embedding, p.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 9) AS score
  FROM points p, pitches q WHERE p.embedding IS NOT NULL AND q.embedding IS NOT NULL{where})"""
_RANKED = "{to} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {of}) WHERE rank <= {k})"
_SPARSE = """tok AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM points) GROUP BY 1, 2),
len AS (SELECT chunk_id, sum(tf) AS dl FROM tok GROUP BY 1),
qtok AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM pitches) GROUP BY 1, 2),
qlen AS (SELECT query_id, sum(qf) AS ql FROM qtok GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM tok GROUP BY 1), mean AS (SELECT avg(dl) AS a FROM len), cnt AS (SELECT count(*)::DOUBLE AS n FROM points),
sparse AS (
  SELECT query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) * (qf * 2.2 / (qf + 1.2 * (0.25 + 0.75 * ql / a)))), 6) AS score
  FROM tok JOIN qtok USING (term) JOIN df USING (term) JOIN len USING (chunk_id) JOIN qlen USING (query_id), mean, cnt GROUP BY 1, 2)"""
_HEAD = f"WITH {POINTS_SQL}, {pitches_sql()}"
_RECENT = """(cutoff IS NULL OR (NOT failure_unknown AND failure_date >= cutoff) OR (failure_unknown AND NOT founding_unknown AND founding_date >= cutoff) OR (failure_unknown AND founding_unknown))"""


@query(f"{_HEAD}, {_DENSE_ALL.format(where='')}, {_RANKED.format(to='r', of='dense', k=2 * K)} SELECT query_id, chunk_id, score, rank FROM r")
def dense_topk(spark, d):
    return retrieval.dense_leg(points(spark, d), pitches(spark, d), 2 * K, indexes(spark, d)[0])


@query(f"{_HEAD}, {_SPARSE}, {_RANKED.format(to='r', of='sparse', k=2 * K)} SELECT query_id, chunk_id, score, rank FROM r")
def bm25_topk(spark, d):
    return retrieval.sparse_leg(points(spark, d), pitches(spark, d), 2 * K, indexes(spark, d)[1])


_FUSED = f"""{_RANKED.format(to="dr", of="dense", k=2 * K)}, {_RANKED.format(to="sr", of="sparse", k=2 * K)},
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM dr UNION ALL SELECT query_id, chunk_id, rank FROM sr) GROUP BY 1, 2),
{_RANKED.format(to="fr", of="fused", k=2 * K)}"""


@query(f"{_HEAD}, {_DENSE_ALL.format(where='')}, {_SPARSE}, {_FUSED} SELECT query_id, chunk_id, score, rank FROM fr")
def rrf_fusion(spark, d):
    p, q, (dense, sparse) = points(spark, d), pitches(spark, d), indexes(spark, d)
    return retrieval.rrf([retrieval.dense_leg(p, q, 2 * K, dense), retrieval.sparse_leg(p, q, 2 * K, sparse)], 2 * K)


_MATCH = "((q.sector <> 'other' OR q.geography <> 'other') AND (q.sector = 'other' OR q.sector = p.sector) AND (q.geography = 'other' OR q.geography = p.geography))"


@query(f"""{_HEAD}, {_DENSE_ALL.format(where='')}, {_RANKED.format(to='r', of='dense', k=2 * K)}
SELECT r.query_id, chunk_id, CASE WHEN {_MATCH} THEN 0.01 ELSE 0.0 END::DOUBLE AS boost FROM r JOIN points p USING (chunk_id) JOIN pitches q ON q.query_id = r.query_id""")
def facet_boost(spark, d):
    """The boost of each hit of the dense leg: all of the query's facets, or nothing."""
    p, q = points(spark, d), pitches(spark, d)
    return retrieval.boosted(retrieval.dense_leg(p, q, 2 * K, indexes(spark, d)[0]), p, q).select("query_id", "chunk_id", "boost")


def _hybrid_sql(cutoff: bool) -> str:
    head = f"WITH RECURSIVE {POINTS_SQL}, {pitches_sql(cutoff=cutoff)}"
    where = f" AND {_RECENT}" if cutoff else ""
    sparse = _SPARSE
    if cutoff:
        sparse = sparse.replace("sparse AS (", "sparse_all AS (", 1) + f", sparse AS (SELECT s.query_id, s.chunk_id, s.score FROM sparse_all s JOIN points USING (chunk_id) JOIN pitches q ON q.query_id = s.query_id WHERE {_RECENT})"
    return f"""{head}, {_DENSE_ALL.format(where=where)}, {sparse}, {_FUSED},
hits AS (SELECT f.query_id, canonical_id, chunk_idx, round(f.score + CASE WHEN {_MATCH} THEN 0.01 ELSE 0 END, 9) AS score FROM fr f JOIN points p USING (chunk_id) JOIN pitches q ON q.query_id = f.query_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, canonical_id ORDER BY score DESC, chunk_idx) AS rn FROM hits) WHERE rn = 1),
ranked AS (SELECT query_id, canonical_id, chunk_idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_id, chunk_idx) AS rank FROM best)"""


@query(_hybrid_sql(True) + f" SELECT * FROM ranked WHERE rank <= {K}")
def hybrid_retrieve(spark, d):
    dense, sparse = indexes(spark, d)
    return retrieval.hybrid(points(spark, d), pitches(spark, d, cutoff=True), K, dense=dense, sparse=sparse)


@query("""SELECT conv_id % 7 AS query_id, conv_id AS canonical_id, turn AS chunk_idx, score FROM (
  SELECT *, length(text) % 13 / 10.0::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id % 7, conv_id ORDER BY length(text) % 13 DESC, turn) AS rn FROM conversations) WHERE rn = 1""")
def parent_collapse(spark, d):
    hits = table(spark, d, "conversations").select((F.col("conv_id") % 7).alias("query_id"), F.col("conv_id").alias("canonical_id"), F.col("turn").alias("chunk_idx"), (F.length("text") % 13 / 10.0).alias("score"))
    return retrieval.parent_collapse(hits)


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS BIGINT) AS rank FROM lineitem")
def stable_rank(spark, d):
    return retrieval.topk(table(spark, d, "lineitem"), "l_suppkey", [F.desc("l_quantity"), "l_orderkey", "l_linenumber"], 2**31 - 1).select("l_orderkey", "l_linenumber", "rank")


_PAIRS = "SELECT min(doc_id) OVER (PARTITION BY text) AS a, doc_id AS b FROM documents"


@query(f"SELECT b AS id, a AS component FROM (SELECT *, count(*) OVER (PARTITION BY a) AS c FROM ({_PAIRS})) WHERE c > 1")
def alias_components(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    least = docs.groupBy("h", "n").agg(F.min("doc_id").alias("a"))
    return graph.components(docs.join(least, ["h", "n"]).select("a", F.col("doc_id").alias("b")))


@query(_hybrid_sql(False) + f""", top AS (SELECT * FROM ranked WHERE rank <= {K}),
edge AS (SELECT x.query_id, x.canonical_id AS a, y.canonical_id AS b FROM top x JOIN top y ON x.query_id = y.query_id AND (y.canonical_id = x.canonical_id + 1 AND x.canonical_id % 3 = 0 OR y.canonical_id = x.canonical_id * 2 AND x.canonical_id % 5 = 1 AND x.canonical_id > 0)),
both_ways AS (SELECT * FROM edge UNION ALL SELECT query_id, b, a FROM edge),
reach AS (SELECT query_id, canonical_id AS a, canonical_id AS b FROM top UNION SELECT r.query_id, r.a, e.b FROM reach r JOIN both_ways e ON r.query_id = e.query_id AND r.b = e.a),
comp AS (SELECT query_id, a AS canonical_id, min(b) AS component FROM reach GROUP BY 1, 2),
placed AS (SELECT query_id, component, canonical_id, score, row_number() OVER (PARTITION BY query_id, component ORDER BY score DESC, canonical_id) AS rn FROM top JOIN comp USING (query_id, canonical_id))
SELECT query_id, max(canonical_id) FILTER (rn = 1) AS canonical_id, max(score) AS score, coalesce(string_agg(CAST(canonical_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn > 1), '') AS aliases FROM placed GROUP BY query_id, component""")
def alias_collapse(spark, d):
    p = points(spark, d)
    dense, sparse = indexes(spark, d)
    top = retrieval.hybrid(p, pitches(spark, d), K, dense=dense, sparse=sparse).withColumn("alias_canonicals", F.array().cast("array<bigint>"))
    ids = p.select("canonical_id").distinct()
    edges = ids.where("canonical_id % 3 = 0").select("canonical_id", (F.col("canonical_id") + 1).alias("target"))
    edges = edges.unionByName(ids.where("canonical_id % 5 = 1").select("canonical_id", (F.col("canonical_id") * 2).alias("target")))
    out = graph.collapse_aliases(top, edges)
    return out.select("query_id", "canonical_id", "score", F.array_join(F.transform("alias_canonicals", lambda x: x.cast("string")), ",").alias("aliases"))


@query("""SELECT doc_id, substr(text, 1, 500) AS snippet FROM (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE lang = 'en' AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'of')) WHERE rn <= 10""")
def text_search(spark, d):
    docs = table(spark, d, "documents")
    found = indexes(spark, d)[1].holding(["the", "of"])  # a chunk of the points is a document
    return corpus.text_hits(docs, "doc_id", found, F.col("lang") == "en").select("doc_id", "snippet")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_exists(spark, d):
    return corpus.having(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query(_hybrid_sql(True) + f""", sc AS (SELECT query_id, canonical_id AS id, rank, ((canonical_id % 11) + (canonical_id % 7) + (canonical_id % 5) + 4) / 4.0 AS mean FROM ranked WHERE rank <= {K}),
ch AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM sc WHERE mean >= 4.0),
n AS (SELECT query_id, count(*) AS chosen, count(*) FILTER (mean - id % 2 >= 4.0) AS kept, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FILTER (mean - id % 2 >= 4.0) AS candidates FROM ch WHERE rn <= 5 GROUP BY 1)
SELECT q.query_id, coalesce(candidates, '') AS candidates, 5 - coalesce(chosen, 0)::BIGINT AS filtered_pre, coalesce(chosen - kept, 0)::BIGINT AS filtered_post, coalesce(kept, 0)::BIGINT AS n_raised,
  (coalesce(kept, 0) + CASE WHEN kept > 0 THEN 1 ELSE 0 END)::BIGINT AS sections, coalesce(kept, 0) = 0 AS banner FROM pitches q LEFT JOIN n USING (query_id)""")
def query_pipeline(spark, d):
    """Pitches to reports; the answers of the models are column expressions over the prompts, as a stand-in for recorded ones.

    The ranking is of all K candidates: those at the threshold first, in the prompt's order, so none of them is lost to its length of five.
    """
    p, (dense, sparse) = points(spark, d), indexes(spark, d)
    asked = pitches(spark, d, cutoff=True).withColumn("name", F.concat(F.lit("p"), "query_id")).withColumn("description", F.lit("a pitch"))
    entity = F.concat(F.lit("c"), "canonical_id")
    documents = p.select("canonical_id").distinct().select("canonical_id", entity.alias("name"), F.lit("s").alias("summary"), F.lit("b").alias("body"), F.lit("2010-01-01").cast("date").alias("founding_date"), F.lit(None).cast("date").alias("failure_date"), F.array(F.lit("https://a.example")).alias("sources"))

    def values(i, less=0):
        n = i.cast("long")
        return {"business_model": n % 11 - less * 4 * (n % 2), "market": n % 7, "gtm": n % 5, "stage_scale": F.lit(4)}

    def scores(i, less=0):
        return [F.struct(v.cast("double").alias("score"), F.lit("r").alias("rationale")).alias(k) for k, v in values(i, less).items()]

    def alike(i):
        return sum(values(i).values()) >= 4 * len(reports.PERSPECTIVES)

    ids = F.regexp_extract_all("prompt", F.lit(r"(?m)^(\d+): "), F.lit(1))
    one = F.regexp_extract("prompt", r"Company (\d+),", 1)
    order = F.concat(F.filter(ids, alike), F.filter(ids, lambda i: ~alike(i)))
    ranking = F.to_json(F.struct(F.transform(F.slice(order, 1, 5), lambda i: F.struct(i.alias("candidate_id"), *scores(i))).alias("ranked")))
    texts = [F.lit(x).alias(k) for k, x in (("one_liner", "o"), ("why_similar", "w"), ("where_diverged", "d"))]
    lists = [F.array(F.lit(x)).alias(k) for k, x in (("failure_causes", "f"), ("lessons", "l"))]
    synthesis = F.to_json(F.struct(F.concat(F.lit("c"), one).alias("name"), F.struct(*scores(one, 1)).alias("similarity"), *texts, *lists))
    risk = F.struct(F.lit("s").alias("summary"), F.lit("a").alias("applies_because"), F.concat(ids, F.array(F.lit("-1"))).alias("raised_by"), F.lit("high").alias("severity"))
    risks = F.to_json(F.struct(F.array(risk).alias("risks"), F.lit(False).alias("injection")))
    answer = F.when(F.col("stage") == "llm_rerank", ranking).when(F.col("stage") == "synthesize", synthesis).otherwise(risks)
    out = reports.run_queries(asked, p, documents, models.Heuristic(lambda: answer), Config(k_retrieve=K, n_synthesize=5, min_similarity=4.0), "2024-01-01", extracted=True, dense=dense, sparse=sparse)
    item = F.struct("pos", "candidate_id")
    kept = out["syntheses"].groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["candidate_id"]), ",").alias("candidates"))
    rows = out["counts"].join(kept, "query_id", "left").join(out["risks"].select("query_id", "n_raised"), "query_id", "left").join(out["reports"], "query_id")
    sections, banner = F.size(F.split("report", "\n## ")) - 1, F.contains("report", F.lit("No comparables passed similarity threshold 4.0."))
    return rows.select("query_id", F.coalesce("candidates", F.lit("")).alias("candidates"), F.col("filtered_pre").cast("long"), F.col("filtered_post").cast("long"), F.coalesce("n_raised", F.lit(0)).cast("long").alias("n_raised"), sections.cast("long").alias("sections"), banner.alias("banner"))


@query("SELECT doc_id AS chunk_id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'width ' || (CASE WHEN vec_id % 13 = 0 THEN 63 ELSE 64 END) END AS fault FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL OR vec_id % 13 = 0")
def dim_check(spark, d):
    """Chunks without a vector, and those whose vector was cut short: a table of 64 numbers does not take them."""
    cut = F.when(F.col("chunk_id") % 13 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return vectorindex.faults(points(spark, d).withColumn("embedding", cut), 64)
