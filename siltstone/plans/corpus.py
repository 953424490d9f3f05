"""Queries of sources, gates, keyed tables, merges and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing
from siltstone.operators import corpus as ops
from siltstone.operators import graph, ingest, tables
from siltstone.plans.bindings import table
from siltstone.plans.scalars import visible_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# sources


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS source_id, '# ' || role || chr(10) || chr(10) || text AS markdown_text FROM conversations WHERE turn % 5 <> 4 AND conv_id >= 5 AND conv_id % 10 <> 9")
def src_json_hits(spark, d):
    """Saved result pages of hits; hits without a string id are dropped, and those before the epoch, and pages past the last."""
    from siltstone.sources.readers import hits_to_entries

    hit = F.struct(F.when(F.col("turn") % 5 != 4, F.concat_ws("-", "conv_id", "turn")).alias("objectID"), F.col("role").alias("title"), F.col("text").alias("story_text"), F.lit(None).cast("string").alias("comment_text"), F.col("conv_id").alias("created_at_i"))
    page = F.struct((F.col("conv_id") % 10).alias("page"), F.lit(9).alias("nbPages"), F.collect_list(hit).alias("hits"))
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(page).alias("page"))
    return hits_to_entries(pages, "page", since_epoch=5).select("source_id", "markdown_text")


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'https://a.example/' || c_custkey WHEN c_custkey % 3 = 1 THEN 'https://b.example' END AS url FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_name, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'https://a.example/' || c_custkey WHEN c_custkey % 3 = 1 THEN 'https://b.example' END FROM customer WHERE c_custkey % 7 = 0")
def src_csv_coalesce(spark, d):
    from siltstone.sources.readers import company_entries

    rows = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_custkey").cast("string")).alias("uuid"), F.concat(F.lit(" "), "c_name").alias("company_name"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://a.example/"), "c_custkey")).otherwise("").alias("homepage_url"), F.when(F.col("c_custkey") % 3 == 1, "https://b.example").alias("website"),
    )
    return company_entries(rows).select("source_id", "name", "url")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT src_ord, id FROM (SELECT *, row_number() OVER (ORDER BY src_ord, id) AS rn FROM (SELECT 0 AS src_ord, s_suppkey AS id FROM supplier UNION ALL SELECT 1, c_custkey FROM customer UNION ALL SELECT 2, p_partkey FROM part)) WHERE rn <= 500")
def union_limit(spark, d):
    """Sources in order, up to a global limit: a top-k, so later sources are read only as far as it needs."""
    return ops.gathered([table(spark, d, t).select(F.col(c).alias("id")) for t, c in (("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"))], "id", 500)


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'own' WHEN page_id % 4 = 1 THEN 'archive ' || page_id WHEN page_id % 4 = 2 THEN 'extract ' || page_id ELSE '' END AS body FROM pages")
def enrich_coalesce(spark, d):
    """A chain of enrichers: each fills what is still missing from its own answers."""
    pages = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "own").alias("body"))
    archive = pages.select("page_id", F.when(F.col("page_id") % 4 <= 1, F.format_string('{"archived_snapshots": {"closest": {"available": true, "url": "archive %s"}}}', F.col("page_id").cast("string"))).otherwise('{"archived_snapshots": {}}').alias("answer"))
    extract = pages.select("page_id", F.when(F.col("page_id") % 4 == 2, F.format_string('{"results": [{"raw_content": "extract %s"}]}', F.col("page_id").cast("string"))).otherwise('{"results": []}').alias("answer"))

    chain = [ops.enricher(archive, "page_id", ops.archived_page(F.col("answer"))), ops.enricher(extract, "page_id", ops.extracted_page(F.col("answer")))]
    return ops.enriched(pages, chain).select("page_id", F.coalesce("body", F.lit("")).alias("body"))


@query("""SELECT event_id, CAST(2000000 * rn + max(arrival - 2000000 * rn) OVER (PARTITION BY user_id ORDER BY rn) AS BIGINT) AS at_us FROM (
  SELECT event_id, user_id, epoch_us(ts) AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""")
def throttle_schedule(spark, d):
    """Requests of a host at least 2 s apart: next = max(arrival, previous + gap), in closed form."""
    rows = table(spark, d, "events").withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")))
    return ops.throttled(rows, "user_id", "arrival", 2000000, "event_id").select("event_id", F.col("at").alias("at_us"))


@query("SELECT role, substr(sha256(text), 1, 16) AS text_hash, count(*)::BIGINT AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def cassette_dup_check(spark, d):
    return table(spark, d, "conversations").groupBy("role", hashing.short_sha256(F.col("text")).alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")


# keyed tables


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def upsert_latest(spark, d):
    return tables.latest(table(spark, d, "events"), ["user_id", "event_type"], "event_id", F.col("event_type") == "error").select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_antijoin(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.delete_keys(table(spark, d, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_coalesce(spark, d):
    c = table(spark, d, "customer")
    changes = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment"))
    return tables.update_coalesce(c.select("c_custkey", "c_name", "c_mktsegment"), changes, ["c_custkey"], ["c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_linestatus = 'F')")
def incremental_skip(spark, d):
    batch = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("skip_key"), "l_linenumber")
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("F").alias("skip_key"))
    return tables.incremental(batch, done, ["k", "skip_key"]).select(F.col("k").alias("l_orderkey"), "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'same' ELSE 'different' END AS decision, o_orderstatus = 'F' AS hit FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def memo_join(spark, d):
    """The memo is asked by pair, model and template: what was decided under an older template does not hit."""
    asked = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("m").alias("model"), F.lit("t1").alias("template_sha"))
    template = F.when(F.col("o_orderstatus") == "F", "t1").otherwise("t0")
    memo = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("m").alias("model"), template.alias("template_sha"), F.lit("same").alias("decision"))
    return tables.memoized(asked, memo, ["l_orderkey", "model", "template_sha"], "decision", F.lit("different")).drop("model", "template_sha")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def reverse_lookup(spark, d):
    """The canonical of a source row: complete before pending before the rest."""
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "pending").otherwise("resolver_flipped")
    journal = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("canonical_id"), state.alias("merge_state"))
    return ops.owners(journal).select(F.col("source_id").alias("o_custkey"), F.col("canonical_id").alias("o_orderkey"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def journal_pending(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


# gates and merges


@query("""SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 0.0 WHEN quality IS NULL THEN 0.0 ELSE 1.0 - quality END::DOUBLE AS score,
  CASE WHEN text = '' THEN 'skipped_empty' WHEN source NOT IN ('src0', 'src1') AND 1.0 - quality > 0.7 THEN 'quarantined' ELSE 'kept' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def slop_split(spark, d):
    """Vetted sources and failed classifiers score 0; over the threshold goes to quarantine."""
    judged = table(spark, d, "labels").select("doc_id", (1.0 - F.col("quality")).alias("judged"))
    return ops.slop_scores(table(spark, d, "documents"), judged, "doc_id", ["src0", "src1"]).select("doc_id", "score", "outcome")


@query("""SELECT count(*)::BIGINT AS total, count(*) FILTER (quality IS NULL)::BIGINT AS errors, count(*) FILTER (1 - quality >= 1)::BIGINT AS still_slop, count(*) FILTER (1 - quality < 1)::BIGINT AS declassified FROM documents LEFT JOIN labels USING (doc_id)""")
def reclassify_counts(spark, d):
    """Quarantined rows judged again: the threshold itself still counts as slop."""
    judged = table(spark, d, "labels").select("doc_id", (1.0 - F.col("quality")).alias("judged"))
    rows = ops.reclassified(table(spark, d, "documents"), judged, "doc_id", 1.0)
    return ops.counters(rows, "decision", {"errors": "error", "still_slop": "still_slop", "declassified": "declassified"}).withColumnRenamed("seen", "total")


@query("SELECT count(*)::BIGINT AS seen, count(*) FILTER (event_type = 'error')::BIGINT AS errors, count(*) FILTER (event_type = 'purchase')::BIGINT AS processed, count(*) FILTER (event_type = 'view')::BIGINT AS skipped FROM events")
def ingest_counters(spark, d):
    return ops.counters(table(spark, d, "events"), "event_type", {"errors": "error", "processed": "purchase", "skipped": "view"})


@query("SELECT event_id, p->>'k' AS k FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"k\": \"v' || event_id || '\"}' END AS p FROM events) WHERE p IS NOT NULL")
def malformed_drop(spark, d):
    """Payloads that do not parse are dropped."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": "v'), "event_id", F.lit('"}'))).when(F.col("event_id") % 3 == 1, '{"k": ').otherwise("")
    return ops.payloads(table(spark, d, "events").withColumn("raw", raw), "raw", "k string").select("event_id", F.col("payload.k").alias("k"))


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def enum_violations(spark, d):
    taxonomy = spark.createDataFrame([("o_orderpriority", x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "facet string, value string")
    return ops.not_in_taxonomy(table(spark, d, "orders"), "o_orderpriority", taxonomy)


@query("""SELECT conv_id, m, substr(sha256(m), 1, 16) AS combined_hash FROM (
  SELECT conv_id, string_agg('## ' || role || ':' || conv_id || '-' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 9 END, conv_id || '-' || turn) AS m FROM conversations GROUP BY 1)""")
def section_merge(spark, d):
    """Sections of one entity in a fixed order: reliability of the source, then source id."""
    sections = table(spark, d, "conversations").select("conv_id", F.col("role").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("source_id"), "text")
    return ops.merged_sections(sections, "conv_id", {"system": 0, "user": 1}).select("conv_id", F.col("merged").alias("m"), F.col("content_hash").alias("combined_hash"))


@query("SELECT user_id, event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events)")
def first_value_domain(spark, d):
    """The first known value of a key before each row."""
    rows = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return ops.first_known(rows, "user_id", "event_id", "value", "anchor").select("user_id", "event_id", "anchor")


_RECONCILE = """WITH j AS (SELECT o_orderkey AS id, o_orderstatus AS st, o_totalprice > 200000 AS changed FROM orders), chunks AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 11 <> 0), tree AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 13 <> 0), raw AS (SELECT o_orderkey + CASE WHEN o_orderkey % 17 = 0 THEN 100000000 ELSE 0 END AS id FROM orders)"""


@query(f"""{_RECONCILE} SELECT 'a' AS drift, t.id FROM tree t WHERE t.id NOT IN (SELECT id FROM chunks)
UNION ALL SELECT 'b', id FROM j WHERE st = 'P' UNION ALL SELECT 'c', t.id FROM tree t JOIN j USING (id) WHERE changed
UNION ALL SELECT 'd', id FROM raw WHERE id NOT IN (SELECT id FROM j) UNION ALL SELECT 'd', r.id FROM raw r JOIN j USING (id) WHERE r.id NOT IN (SELECT id FROM tree)
UNION ALL SELECT 'e', id FROM raw WHERE id % 23 = 0 UNION ALL SELECT 'f', id FROM j WHERE st = 'O' AND id % 19 = 0""")
def reconcile_drift(spark, d):
    from siltstone.operators.repair import drift

    orders = table(spark, d, "orders")
    journal = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 19 == 0), "resolver_flipped").otherwise("complete").alias("merge_state"), F.when(F.col("o_totalprice") > 200000, "new").otherwise("old").alias("content_hash"), F.lit(1).alias("seq"))
    journal = journal.unionByName(journal.where("id % 3 = 0").withColumn("seq", F.lit(0)).withColumn("content_hash", F.lit(None).cast("string")).withColumn("merge_state", F.lit("complete")))
    journal = journal.unionByName(journal.where("id % 5 = 0 and seq = 1").withColumn("seq", F.lit(2)).withColumn("content_hash", F.lit("later")).withColumn("merge_state", F.lit("complete")))
    chunks = table(spark, d, "lineitem").where("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("id")).distinct()
    tree = orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("combined_hash"))
    raw = orders.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 17 == 0, 100000000).otherwise(0)).alias("id"))
    return drift(journal, tree, raw, chunks, raw.where("id % 23 = 0"))


@query("SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN CAST(event_id % 10 - 3 AS VARCHAR) END AS value, event_id % 10 = 3 AS failed FROM events")
def error_isolation(spark, d):
    """A fan-out whose failing calls keep their errors beside their rows and do not end the others."""

    def call(text: str) -> str:
        n = int(text) % 10 - 3
        return str(n * (100 // n) // (100 // n)) if n else str(100 // n)

    rows = ingest.summarized(table(spark, d, "events").withColumn("id", F.col("event_id").cast("string")), call, "id", "value")
    return rows.select("event_id", "value", F.col("error").startswith("ZeroDivisionError").alias("failed")).fillna(False, ["failed"])


@query("""SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (rn <= 50) AS shown, greatest(count(*) - 50, 0)::BIGINT AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type IN ('error', 'view', 'click')) GROUP BY 1""")
def error_cap(spark, d):
    """The first 50 events of a kind, and how many more there are."""
    rows = table(spark, d, "events").where(F.col("event_type").isin("error", "view", "click"))
    return ops.first_events(rows, "user_id", "event_id").select("user_id", F.array_join(F.col("shown").cast("array<string>"), ",").alias("shown"), "more")


@query("SELECT source, CAST(doc_id AS VARCHAR) AS source_id, sha256(doc_id || '|' || coalesce(sha256(text), '')) AS skip_key, n_chars, 0::BIGINT AS seq FROM documents")
def stream_ingest(spark, d):
    """The documents table as a stream, merged batch by batch into a keyed table; skip keys make a second run a no-op."""
    from siltstone.streaming.ingest import ingest_documents

    return ingest_documents(spark, d)


@query(f"""SELECT CASE WHEN page_id % 3 = 0 THEN 'N' || page_id ELSE u END AS source_id, u AS url FROM (SELECT page_id, 'https://h' || (page_id % 7) || '.example/' || page_id AS u, {visible_sql()} AS t FROM pages)
WHERE length(t) >= 500 AND page_id % 4 <> 3 AND page_id % 11 <> 0 AND page_id % 7 <> 1""")
def src_curated(spark, d):
    """Every page as a curated item; one site forbids reading, some answers fail, some items have no URL."""
    from siltstone.sources.readers import curated_rows

    url = F.format_string("https://h%d.example/%d", F.col("page_id") % 7, "page_id")
    pages = table(spark, d, "pages").withColumn("url", url)
    items = pages.where("page_id % 4 <> 3").select(F.col("page_id").alias("pos"), "url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("N"), "page_id")).otherwise(" ").alias("startup_name"))
    robots = F.when(F.col("page_id") % 7 == 1, "User-agent: *\nDisallow: /").when(F.col("page_id") % 7 == 2, "User-agent: other\nDisallow: /")
    fetched = pages.select("url", "html", F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"), robots.alias("robots"))
    return curated_rows(items, fetched).select("source_id", "url")


@query("""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, doc_id % 10 > 7 AND source <> 'src0' AS slop, doc_id % 5 <> 0 AS later, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN ' again' ELSE '' END AS t2 FROM documents),
o AS (SELECT *, NOT slop AND (t <> '' OR later AND t2 <> '') AS there, CASE WHEN NOT later THEN 'absent' WHEN t2 = '' THEN 'skipped_empty' WHEN slop THEN 'quarantined' WHEN t2 <> t THEN 'processed' ELSE 'skipped' END AS outcome FROM d)
SELECT 'c' || (doc_id // 4)::VARCHAR AS canonical_id, substr(sha256(string_agg('## ' || source || ':' || doc_id || chr(10) || chr(10) || t2, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id::VARCHAR) FILTER (there)), 1, 16) AS content_hash,
  count(*) FILTER (there)::BIGINT AS n_sections, count(*) FILTER (outcome = 'processed')::BIGINT AS processed, count(*) FILTER (outcome = 'skipped')::BIGINT AS skipped, count(*) FILTER (outcome = 'quarantined')::BIGINT AS quarantined
FROM o GROUP BY doc_id // 4 HAVING count(*) FILTER (there) > 0""")
def ingest_batches(spark, d):
    """Two batches of all documents, the second without a fifth of them and with a third of the rest changed; then the compacted tables."""
    from siltstone.operators.models import HashEmbedder, LabelClassifier

    docs = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("c"), F.floor(F.col("doc_id") / 4).cast("string")).alias("canonical_id"), "doc_id")
    judged = docs.select(F.concat_ws("\x1f", "source", "source_id").alias("_key"), (F.col("doc_id") % 10 / 10).alias("judged"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
    store = ingest.Corpus(spark, graph.shared_dir(spark, "corpus"))
    for seq, batch in ((1, docs), (2, docs.where("doc_id % 5 <> 0").withColumn("text", changed))):
        outcomes = ingest.ingest(store, batch.drop("doc_id"), LabelClassifier(judged, "judged"), HashEmbedder(8), lambda rows: rows, seq, "2024", ("src0",))
    store.compact()
    key = ["source", "source_id"]
    sections = store.table("journal").where("merge_state = 'complete'").groupBy("canonical_id").agg(F.count("*").alias("n_sections"))
    counted = outcomes.select(*key, "outcome").join(docs.select(*key, "canonical_id"), key).groupBy("canonical_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("processed", "skipped", "quarantined")))
    rows = store.table("canonical").select("canonical_id", "content_hash").join(sections, "canonical_id").join(counted, "canonical_id", "left")
    return rows.select("canonical_id", "content_hash", "n_sections", *(F.coalesce(o, F.lit(0)).alias(o) for o in ("processed", "skipped", "quarantined")))


@query("""WITH e AS (SELECT event_id AS seq, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'd' || user_id || '.example' END AS domain, user_id % 9 = 0 AS platform, CASE WHEN event_id % 4 <> 0 THEN 1995 + event_id * 7 % 25 END AS year, event_id % 3 = 0 AS suffixed FROM events),
f AS (SELECT domain, min(seq) AS first_seq FROM e WHERE NOT platform AND domain <> '' GROUP BY 1),
a AS (SELECT domain, min(seq) AS aseq, arg_min(year, seq) AS ayear FROM e JOIN f USING (domain) WHERE NOT platform AND year IS NOT NULL AND (seq = first_seq OR NOT suffixed) GROUP BY 1)
SELECT seq, CASE WHEN platform OR domain = '' THEN 'platform' WHEN aseq < seq AND abs(year - ayear) > 10 THEN 'recycled' WHEN suffixed AND seq > first_seq THEN 'subsidiary' ELSE 'domain' END AS reason FROM e LEFT JOIN f USING (domain) LEFT JOIN a USING (domain)""")
def stream_domains(spark, d):
    """All events as a stream in which each domain keeps its anchor: what resolution in batch says of them."""
    from siltstone.streaming.resolve import resolved_events

    return resolved_events(spark, d)
