"""Queries of resolution, reranking, risks, reports, budgets and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing, prompts, text, urls
from siltstone.operators import budget, corpus, evaluate, graph, models, ranked, reports, resolve
from siltstone.plans.bindings import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# resolution

_ENTRIES = """entries AS (SELECT event_id AS seq, user_id, CASE WHEN user_id % 9 = 0 THEN 'medium.com' WHEN user_id % 11 = 0 THEN '' ELSE 'd' || user_id || '.example' END AS domain,
  user_id % 9 = 0 AS platform, CASE WHEN event_id % 4 <> 0 THEN 1995 + event_id * 7 % 25 END AS year, event_id % 3 = 0 AS suffixed FROM events),
every AS (SELECT * FROM entries)"""


def _entries(spark, d):
    e = table(spark, d, "events")
    domain = F.when(F.col("user_id") % 9 == 0, "https://medium.com/@x").when(F.col("user_id") % 11 == 0, "").otherwise(F.concat(F.lit("https://d"), "user_id", F.lit(".example/a")))
    name = F.when(F.col("event_id") % 3 == 0, "Acme Inc.").otherwise("Acme")
    rows = e.select(F.col("event_id").alias("seq"), "user_id", urls.registrable_domain(domain).alias("domain"), F.when(F.col("event_id") % 4 != 0, 1995 + F.col("event_id") * 7 % 25).alias("year"), text.corporate_suffix(name).isNotNull().alias("suffixed"))
    return rows.withColumn("platform", urls.is_platform(F.col("domain")))


#: In the band between the same (0.9) and the different (0.5) are pairs of similarity 0.7; a memo of another template says the opposite.
_SAME = "CASE (3 * {a} + 7 * {b}) % 10 WHEN 0 THEN true WHEN 1 THEN true WHEN 3 THEN CASE WHEN ({a} + {b}) % 2 = 0 THEN {a} % 4 = 0 ELSE {a} % 3 = 0 END ELSE false END"


@query(f"""WITH RECURSIVE {_ENTRIES},
f AS (SELECT domain, min(seq) AS first_seq FROM entries WHERE NOT platform AND domain <> '' AND seq % 17 <> 0 GROUP BY 1),
a AS (SELECT domain, min(seq) AS aseq, arg_min(year, seq) AS ayear FROM entries JOIN f USING (domain) WHERE NOT platform AND year IS NOT NULL AND seq % 17 <> 0 AND (seq = first_seq OR NOT suffixed) GROUP BY 1),
t AS (SELECT seq, user_id, domain, CASE WHEN platform OR domain = '' THEN 'platform' WHEN aseq < seq AND abs(year - ayear) > 10 THEN 'recycled' WHEN suffixed AND seq > first_seq THEN 'subsidiary' ELSE 'domain' END AS reason FROM every LEFT JOIN f USING (domain) LEFT JOIN a USING (domain)),
c AS (SELECT seq, seq * 7919 % 40 AS k, 's' || user_id % 5 AS sector, CASE WHEN seq % 17 = 0 THEN 'hint' || seq % 2 WHEN reason = 'domain' THEN domain ELSE 'n' || lpad(CAST(seq * 7919 % 40 AS VARCHAR), 2, '0') || '::s' || user_id % 5 END AS id,
  CASE WHEN seq % 17 = 0 THEN 'alias_hint' ELSE reason END AS reason FROM t),
p AS (SELECT seq, CASE WHEN seq % 14 = 0 THEN 'other' ELSE id END AS prior, seq % 3 = 0 AS blocked FROM c WHERE seq % 7 = 0 AND k >= 30),
o AS (SELECT c.*, coalesce(prior = id, true) AS adds, row_number() OVER (PARTITION BY sector ORDER BY seq) AS n FROM c LEFT JOIN p USING (seq) WHERE contains(id, '::')),
there AS (SELECT split_part(prior, '::', 2) AS sector, prior AS id FROM p WHERE contains(prior, '::') AND NOT blocked GROUP BY ALL),
fold AS (
  SELECT sector, 0::BIGINT AS n, (SELECT min(id) FROM there x WHERE x.sector = s.sector) AS m1, (SELECT min(id) FROM there x WHERE x.sector = s.sector AND id > (SELECT min(id) FROM there y WHERE y.sector = s.sector)) AS m2, NULL::BIGINT AS seq, NULL::VARCHAR AS resolved
  FROM (SELECT DISTINCT sector FROM o) s
  UNION ALL
  SELECT sector, n, CASE WHEN added THEN least(m1, id) ELSE m1 END, CASE WHEN NOT added OR id = m1 THEN m2 WHEN m1 IS NULL THEN NULL WHEN id < m1 THEN m1 ELSE least(m2, id) END, seq, resolved
  FROM (SELECT *, adds AND resolved = id AS added FROM (
    SELECT *, CASE WHEN sib IS NOT NULL AND {_SAME.format(a="k", b="CAST(substr(sib, 2, 2) AS BIGINT)")} THEN sib ELSE id END AS resolved FROM (
      SELECT o.sector, o.n, o.seq, o.id, o.k, o.adds, m1, m2, CASE WHEN o.id <> m1 THEN m1 ELSE m2 END AS sib FROM fold JOIN o ON o.sector = fold.sector AND o.n = fold.n + 1)))),
r AS (SELECT c.seq, coalesce(resolved, id) AS canonical_id, reason, prior FROM c LEFT JOIN fold ON fold.seq = c.seq LEFT JOIN p ON p.seq = c.seq)
SELECT seq, canonical_id, reason, CASE WHEN prior <> canonical_id THEN 'flip' WHEN canonical_id IN (SELECT prior FROM p) OR seq > min(seq) OVER (PARTITION BY canonical_id) THEN 'merge' ELSE 'create' END AS action FROM r""")
def resolve_entities(spark, d):
    """Hints, domains, demotions, tier-2 ids folded onto siblings in arrival order, against a journal that knows some, some blocked, some under other ids."""
    number = F.col("seq") * 7919 % 40
    entries = _entries(spark, d).withColumn("name", F.concat(F.lit("n"), F.lpad(number.cast("string"), 2, "0"))).withColumn("sector", F.concat(F.lit("S"), F.col("user_id") % 5))
    entries = entries.withColumn("alias_hint", F.when(F.col("seq") % 17 == 0, F.concat(F.lit("hint"), F.col("seq") % 2))).withColumn("source", F.lit("events")).withColumn("source_id", F.col("seq").cast("string"))
    ids = graph.written(resolve.entity_ids(entries).select("seq", "source", "source_id", "sector", "canonical_id"), "resolution")
    state = F.when(F.col("seq") % 3 == 0, "alias_blocked").when(F.col("seq") % 2 == 0, "pending").otherwise("complete").alias("merge_state")
    prior = ids.where((F.col("seq") % 7 == 0) & (number >= 30)).select("source", "source_id", F.when(F.col("seq") % 14 == 0, "other").otherwise(F.col("canonical_id")).alias("canonical_id"), state)
    # what was decided before and what is answered now, of each name with the five smallest of its sector
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    pairs = ids.select((number).alias("a"), F.lower("sector").alias("s")).distinct().select("a", "s", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("b")).where("a <> b")
    key = hashing.pair_key(F.concat(F.lit("n"), two(F.col("a")), F.lit("::"), F.col("s")), F.concat(F.lit("n"), two(F.col("b")), F.lit("::"), F.col("s")))
    said = lambda yes: F.when(yes, "same").otherwise("different").alias("decision")
    asked = pairs.where("(3 * a + 7 * b) % 10 = 3").withColumn("pair_key", key)
    even = asked.where("(a + b) % 2 = 0")
    memo = even.select("pair_key", F.lit("m").alias("model"), F.lit("t1").alias("template_sha"), said(F.col("a") % 4 == 0))
    memo = memo.unionByName(asked.select("pair_key", F.lit("m").alias("model"), F.lit("t0").alias("template_sha"), said(F.col("a") % 4 != 0)))
    answers = asked.where("(a + b) % 2 = 1").select("pair_key", said(F.col("a") % 3 == 0))
    k = lambda c: F.substring(c, 2, 2).cast("long")
    x = (3 * k("a") + 7 * k("b")) % 10
    similarity = lambda rows: rows.withColumn("similarity", F.when(x < 2, 0.9).when(x == 3, 0.7).otherwise(0.5))
    memo, answers = graph.written(memo, "memo"), graph.written(answers, "answers")
    return resolve.resolve_entities(entries, prior, memo, similarity, answers, model="m", template="t1")[0]


@query("""SELECT s_suppkey, (SELECT min(x.s_name) FROM supplier x WHERE x.s_nationkey = s.s_nationkey AND x.s_name <> s.s_name) AS sibling FROM supplier s""")
def sibling_min(spark, d):
    """The smallest other id of the sector."""
    return corpus.siblings_of(table(spark, d, "supplier"), "s_nationkey", "s_name").select("s_suppkey", "sibling")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.85 THEN 'same' WHEN s <= 0.65 THEN 'different' WHEN l_orderkey % 2 = 0 THEN 'same' ELSE 'different' END AS decision FROM (SELECT *, l_quantity / 50.0 AS s FROM lineitem)""")
def tier3_band(spark, d):
    decided = F.when(F.col("l_orderkey") % 2 == 0, "same")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", resolve.band(F.col("l_quantity") / 50.0, decided).alias("decision"))


# reranking

_RANKED = "ranked AS (SELECT l_orderkey AS query_id, l_linenumber AS candidate_id, l_linenumber AS pos, (l_quantity / 5 + l_discount * 100 + l_tax * 100 + l_linenumber) / 4 AS mean FROM lineitem)"


def _ranked(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("candidate_id"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_quantity") / 5).alias("business_model"), (F.col("l_discount") * 100).alias("market"), (F.col("l_tax") * 100).alias("gtm"), F.col("l_linenumber").alias("stage_scale"))
    return rows.withColumn("mean", ranked.mean_score("business_model", "market", "gtm", "stage_scale"))


@query(f"WITH {_RANKED} SELECT query_id, candidate_id::BIGINT AS candidate_id, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, mean DESC) AS rn FROM ranked WHERE mean >= 4.03) WHERE rn <= 3")
def min_similarity_topn(spark, d):
    return ranked.top_by_similarity(_ranked(spark, d), 4.03, 3).select("query_id", "candidate_id", F.round("mean", 6).alias("mean"))


@query(f"WITH {_RANKED} SELECT query_id, count(*) FILTER (mean >= 4.03)::BIGINT AS kept, count(*) FILTER (mean < 4.03)::BIGINT AS dropped FROM ranked GROUP BY 1")
def min_similarity_drop(spark, d):
    return ranked.dropped_counts(_ranked(spark, d), 4.03)


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS pos, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0")
def join_rank_order(spark, d):
    """A ranking joined with what was retrieved: unknown ids drop out, positions stay."""
    have = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return corpus.in_ranked_order(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("pos")), have, "l_orderkey")


@query("SELECT * FROM (SELECT l_orderkey AS query_id, count(*) FILTER (l_tax > 0.01)::BIGINT AS have, least(count(*), 4)::BIGINT AS want FROM lineitem GROUP BY 1) WHERE have <> want")
def rerank_length(spark, d):
    c = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "query_id")
    return ranked.length_errors(c.where("l_tax > 0.01"), c, 4)


@query("""SELECT conv_id, turn, sha256(text) AS text_sha FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(regexp_replace(CASE WHEN turn % 3 = 2 THEN role ELSE text END, '^\\s+|\\s+$', '', 'g')) ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def lesson_dedup(spark, d):
    """Whole texts as lessons; every third one is the role alone, so that there are equal ones."""
    lesson = F.concat(F.lit(" "), F.when(F.col("turn") % 3 == 2, F.upper("role")).otherwise(F.col("text")), F.lit("\t"))
    return ranked.distinct_lessons(table(spark, d, "conversations").withColumn("lesson", lesson), ["conv_id"], "lesson", "turn").select("conv_id", "turn", hashing.sha256(F.col("text")).alias("text_sha"))


_RISKS = """risks AS (SELECT o_custkey AS query_id, o_orderkey AS pos, o_orderpriority AS summary, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'low' END AS severity, o_orderkey % 4 AS n_raised FROM orders)"""


def _risks(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("summary"), F.when(price > 100000, "high").when(price > 50000, "medium").otherwise("low").alias("severity"), (F.col("o_orderkey") % 4).alias("n_raised"))


_CAPPED = "capped AS (SELECT query_id, pos, summary, n_raised, CASE WHEN severity = 'high' AND row_number() OVER (PARTITION BY query_id, severity ORDER BY n_raised, pos) <= count(*) OVER (PARTITION BY query_id, severity) - 4 THEN 'medium' ELSE severity END AS severity FROM {of})"


@query(f"WITH {_RISKS}, {_CAPPED.format(of='risks')} SELECT query_id, pos, severity FROM capped")
def severity_cap(spark, d):
    return ranked.cap_severity(_risks(spark, d)).select("query_id", "pos", "severity")


@query(f"""WITH {_RISKS}, good AS (SELECT * FROM risks WHERE n_raised > 0 AND query_id % 10 <> 3), {_CAPPED.format(of='good')}
SELECT query_id, pos, summary, severity, n_raised, row_number() OVER (PARTITION BY query_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n_raised DESC, pos)::BIGINT AS rank FROM capped""")
def risk_consolidate(spark, d):
    """Risks name candidates c0, c1, ... of which those over c9 are no candidates."""
    rows = _risks(spark, d)
    ids = F.when(F.col("n_raised") > 0, F.transform(F.sequence(F.lit(1), F.col("n_raised").cast("int")), lambda i: F.concat(F.lit("c"), i))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("raised_by", F.concat(ids, F.array(F.lit("c99")))).drop("n_raised")
    valid = rows.select("query_id").distinct().withColumn("ids", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("c"), i)))
    return ranked.consolidate(rows, valid, rows.where("query_id % 10 = 3")).drop("raised_by")


# responses, prompts and reports


@query("SELECT conv_id, turn, 'answer to ' || substr(sha256(role || chr(31) || text), 1, 16) AS answer FROM conversations WHERE role = 'user'")
def response_join(spark, d):
    """Calls joined with recorded answers (of all turns, keyed by system and prompt); a call without one ends the query with an error."""
    turns = table(spark, d, "conversations")
    key = hashing.response_key(F.col("role"), F.col("text"))
    answers = turns.select(key.alias("key")).distinct().withColumn("text", F.concat(F.lit("answer to "), "key"))
    calls = turns.where("role = 'user'").withColumn("key", key)
    return calls.join(models.Recorded(answers).complete(calls.select("key")).select("key", F.col("text").alias("answer")), "key").select("conv_id", "turn", "answer")


_PROMPT = prompts.TEMPLATES["synthesize"][1].replace("'", "''").replace("\n", "' || chr(10) || '")
for _name, _sql in (("pitch", "p_name"), ("description", "p_brand"), ("candidate_id", "p_partkey"), ("founding_date", "CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE '2001-02-0' || (1 + p_partkey % 9) END"), ("failure_date", "'unknown'"), ("body", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END")):
    _PROMPT = _PROMPT.replace("{{ " + _name + " }}", f"' || ({_sql}) || '")


@query(f"SELECT p_partkey, '{_PROMPT}' AS prompt FROM part")
def prompt_render(spark, d):
    """The synthesis prompt of each row; unknown dates and bodies have their defaults."""
    founded = F.when(F.col("p_partkey") % 5 != 0, F.make_date(F.lit(2001), F.lit(2), (1 + F.col("p_partkey") % 9).cast("int")))
    body = F.when(F.col("p_partkey") % 4 != 0, F.col("p_type"))
    values = prompts.synthesis_values(F.col("p_name"), F.col("p_brand"), F.col("p_partkey"), founded, F.lit(None).cast("date"), body)
    return table(spark, d, "part").select("p_partkey", prompts.rendered(prompts.TEMPLATES["synthesize"][1], values).alias("prompt"))


@query("SELECT o_orderkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE CAST(o_custkey AS VARCHAR) END AS shown FROM orders JOIN customer ON o_custkey = c_custkey")
def render_join(spark, d):
    """Names for ids in a report, the id itself where there is none."""
    names = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("shown"))


_TABLE = "'| Perspective | Score | Rationale |' || chr(10) || '| --- | --- | --- |'" + "".join(f" || chr(10) || '| {p} | 5.0 | see r |'" for p in reports.PERSPECTIVES)
_NL = " || chr(10) || chr(10) || "
_SECTION = _NL.join(["'## O' || o_orderkey", "'a text'", "'Failure date: ' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE 'unknown' END || chr(10) || 'Lifespan: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE '7 months' END",
                     "'Similarity:'", _TABLE, "'Why similar:'", "'w'", "'Where diverged:'", "'d'", "'Failure causes:'", "'- c1' || chr(10) || '- c2'", "'Lessons:'", "'- l'", "'Sources:'", "'https://a.example/' || o_orderkey"])


@query(f"SELECT o_orderkey, {_SECTION} AS section FROM orders")
def render_report(spark, d):
    """The section of each candidate; links keep their text only.  (Whole reports: ``query_pipeline``.)"""
    score = F.struct(F.lit(5.0).alias("score"), F.lit("see [r](https://x.example)").alias("rationale"))
    answer = F.struct(
        F.concat(F.lit("O"), "o_orderkey").alias("name"), F.lit("a ![text](y)").alias("one_liner"), F.struct(*(score.alias(p) for p in reports.PERSPECTIVES)).alias("similarity"),
        F.lit("w").alias("why_similar"), F.lit("[d][1]").alias("where_diverged"), F.array(F.lit("c1"), F.lit("[c2](u)")).alias("failure_causes"), F.array(F.lit("l")).alias("lessons"),
    )
    rows = table(spark, d, "orders").select("o_orderkey", answer.alias("answer"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date")).alias("failure_date"), F.when(F.col("o_orderkey") % 3 != 0, 7).alias("lifespan_months"), F.array(F.concat(F.lit("https://a.example/"), "o_orderkey")).alias("sources"))
    return rows.select("o_orderkey", reports.candidate_section().alias("section"))


# budgets and counters


@query("""SELECT user_id, min(event_id) AS breach, arg_min(spent, event_id) AS spent FROM (SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS spent FROM events) WHERE spent > 500 GROUP BY 1""")
def budget_running(spark, d):
    return ranked.running_budget(table(spark, d, "events"), "user_id", "event_id", "value", 500.0)


@query("SELECT event_type, round(sum(value) / 1e6 * CASE event_type WHEN 'click' THEN 0.8 WHEN 'purchase' THEN 4.0 ELSE 0.02 END, 9) AS cost, count(*)::BIGINT AS calls FROM events GROUP BY 1")
def cost_rollup(spark, d):
    prices = spark.createDataFrame([("click", 0.8), ("purchase", 4.0)], "event_type string, rate double")
    return budget.costs(table(spark, d, "events"), prices, "event_type", "value")


@query("""SELECT user_id, round(sum(r) / nullif(sum(r) + sum(c), 0), 9) AS ratio FROM (SELECT user_id, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS r, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY 1""")
def cache_ratio(spark, d):
    """Cache reads among reads and creations of the first five calls; null where there are neither."""
    of = lambda k: F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)
    rows = table(spark, d, "events").select("user_id", "event_id", of("view").alias("read"), of("click").alias("created"))
    return budget.cache_ratio(rows, "user_id", "event_id", "read", "created", 5)


@query("""WITH e AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'click' THEN 'reserve' ELSE 'settle' END AS kind, CASE WHEN event_type = 'click' THEN event_id ELSE event_id - 1 END AS number, value AS amount FROM events),
o AS (SELECT user_id, number, amount AS opened FROM e WHERE kind = 'reserve'),
r AS (SELECT e.*, coalesce(opened, 0) AS opened FROM e LEFT JOIN o USING (user_id, number)),
s AS (SELECT user_id, seq, kind, round(sum(CASE WHEN kind = 'settle' THEN amount ELSE 0 END) OVER w, 6) AS spent, round(sum(CASE WHEN kind = 'reserve' THEN amount ELSE -opened END) OVER w, 6) AS reserved FROM r WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, seq, spent, reserved, CASE WHEN kind = 'reserve' THEN round(500 - spent - reserved, 6) >= 0 ELSE spent <= 500 END AS ok FROM s""")
def budget_ledger(spark, d):
    """Reservations and settlements of each user in order; a settlement is recorded even where it goes over the cap."""
    kind = F.when(F.col("event_type") == "click", "reserve").otherwise("settle")
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "reserve", F.col("event_id")).otherwise(F.col("event_id") - 1).alias("number"), F.col("value").alias("amount"))
    return budget.ledger(rows, "user_id", "seq", 500.0).select("user_id", "seq", "spent", "reserved", "ok")


# evaluation


@query("SELECT row_id, count(*)::BIGINT AS n FROM (SELECT CASE WHEN item_id % 2 = 0 THEN CAST(item_id // 4 AS VARCHAR) ELSE substr(sha1(text), 1, 8) END AS row_id FROM benchmark) GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, d):
    name = F.when(F.col("item_id") % 2 == 0, F.floor(F.col("item_id") / 4).cast("string")).otherwise("")
    return corpus.duplicate_ids(table(spark, d, "benchmark").withColumn("row_id", hashing.row_id(name, F.col("text"))), "row_id")


@query("""SELECT *, where_diverged_nonempty AND sources_allowed AND lifespan_positive AND claims_grounded AS all_ok FROM (SELECT o_custkey AS row_id, CAST(o_orderkey AS VARCHAR) AS candidate_id, o_totalprice > 50000 AS where_diverged_nonempty, o_orderstatus <> 'P' AS sources_allowed,
  o_orderkey % 3 = 0 OR o_orderkey % 5 > 0 AS lifespan_positive, o_custkey % 4 <> 1 OR o_orderkey % 7 <> 0 AS claims_grounded FROM orders)""")
def eval_assertions(spark, d):
    """The four assertions on syntheses, with texts, hosts and lifespans from the test rows."""
    orders = table(spark, d, "orders")
    syntheses = orders.select(
        F.col("o_custkey").alias("row_id"), F.col("o_orderkey").cast("string").alias("candidate_id"), F.when(F.col("o_totalprice") > 50000, "there").otherwise("\t ").alias("where_diverged"),
        F.array(F.concat(F.lit("https://"), F.lower("o_orderstatus"), F.lit(".example/x"))).alias("sources"), F.when(F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderkey") % 5 > 0, 4).otherwise(0)).alias("lifespan_months"),
        F.when(F.col("o_custkey") % 4 != 1, "no numbers").otherwise("had 12 million users").alias("why_similar"), F.array(F.lit("plain"), F.lit(None).cast("string")).alias("rationales"),
    )
    bodies = orders.select(F.col("o_orderkey").cast("string").alias("candidate_id"), F.when(F.col("o_orderkey") % 7 != 0, "they had 12 million users").otherwise("they had 12 users").alias("body"))
    return evaluate.assertions(syntheses, bodies, F.array(F.lit("f.example"), F.lit("o.example")))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity > 10 AS was FROM lineitem WHERE l_orderkey % 5 <> 0), c AS (SELECT l_orderkey, l_linenumber, l_quantity > 12 OR l_tax > 0.06 AS now FROM lineitem WHERE l_orderkey % 7 <> 0)
SELECT * FROM (SELECT l_orderkey, l_linenumber, was, now, CASE WHEN was AND NOT coalesce(now, false) THEN 'regression' WHEN was IS NULL THEN 'warning' WHEN NOT was AND now THEN 'improvement' END AS change FROM b FULL JOIN c USING (l_orderkey, l_linenumber)) WHERE change IS NOT NULL""")
def baseline_diff(spark, d):
    li = table(spark, d, "lineitem")
    was = li.where("l_orderkey % 5 <> 0").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 10).alias("ok"))
    now = li.where("l_orderkey % 7 <> 0").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") > 12) | (F.col("l_tax") > 0.06)).alias("ok"))
    return ranked.baseline_diff(was, now, ["l_orderkey", "l_linenumber"], "ok")


_SCORED = "SELECT CAST(l_orderkey AS VARCHAR) AS row_id, CAST(l_linenumber AS VARCHAR) AS candidate_id, '{name}' AS assertion, {ok} AS ok FROM lineitem WHERE {where}"


def _scored(name: str, ok: str, where: str) -> str:
    return _SCORED.format(name=name, ok=ok, where=where)


_WAS = " UNION ALL ".join([_scored("big", "l_quantity > 10", "l_orderkey % 5 <> 0"), _scored("taxed", "l_tax > 0.04", "l_orderkey % 5 <> 0")])
_NOW = " UNION ALL ".join([_scored("big", "l_quantity > 12", "l_orderkey % 7 <> 0"), _scored("taxed", "l_tax > 0.05", "l_orderkey % 7 <> 0"), _scored("extra", "true", "l_orderkey % 7 <> 0 AND l_linenumber = 2")])


@query(f"""WITH was AS ({_WAS}), now AS ({_NOW}), w AS (SELECT row_id, candidate_id, bool_or(ok) AS any_true FROM was GROUP BY 1, 2), n AS (SELECT DISTINCT row_id, candidate_id FROM now),
one AS (SELECT row_id, candidate_id, assertion, was.ok AS b, now.ok AS c FROM was FULL JOIN now USING (row_id, candidate_id, assertion))
SELECT row_id, candidate_id, NULL::VARCHAR AS assertion, 'regression' AS change FROM w ANTI JOIN n USING (row_id, candidate_id) WHERE any_true
UNION ALL SELECT row_id, candidate_id, NULL, 'warning' FROM n ANTI JOIN w USING (row_id, candidate_id)
UNION ALL SELECT * FROM (SELECT row_id, candidate_id, assertion, CASE WHEN b AND NOT coalesce(c, false) THEN 'regression' WHEN b IS NULL THEN 'warning' WHEN NOT b AND c THEN 'improvement' END AS change
  FROM one SEMI JOIN w USING (row_id, candidate_id) SEMI JOIN n USING (row_id, candidate_id)) WHERE change IS NOT NULL""")
def baseline_levels(spark, d):
    """Assertions of candidates against a baseline, and candidates that are gone or new."""
    li = table(spark, d, "lineitem")

    def scored(rows, name, ok):
        return rows.select(F.col("l_orderkey").cast("string").alias("row_id"), F.col("l_linenumber").cast("string").alias("candidate_id"), F.lit(name).alias("assertion"), F.expr(ok).alias("ok"))

    before, after = li.where("l_orderkey % 5 <> 0"), li.where("l_orderkey % 7 <> 0")
    was = scored(before, "big", "l_quantity > 10").unionByName(scored(before, "taxed", "l_tax > 0.04"))
    now = scored(after, "big", "l_quantity > 12").unionByName(scored(after, "taxed", "l_tax > 0.05")).unionByName(scored(after.where("l_linenumber = 2"), "extra", "true"))
    return evaluate.diff(was, now)


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::VARCHAR AS bucket, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    """Hourly counts, as the streaming form's final state (beyond the reference)."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n")
