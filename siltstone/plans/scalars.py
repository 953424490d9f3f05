"""Queries of the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import dates, hashing, html, jsonx, text, urls, vectors
from siltstone.operators import budget, tools
from siltstone.operators import corpus as ops
from siltstone.operators.chunks import heading_windows, windows
from siltstone.plans.bindings import AS_OF, DATED_SQL, dated, table
from siltstone.sources import files

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NAME = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' Inc.' WHEN 1 THEN '  LLC' WHEN 2 THEN ' Holdings Group' WHEN 3 THEN ' gmbh' WHEN 4 THEN '' ELSE ' Inc Labs' END"
_RE = "\\s+(holdings|group|corp|corporation|ltd|limited|llc|inc|incorporated|co|company|plc|gmbh|ag|sa|sas)\\b\\.?$"


@query(f"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(nm, '{_RE}', '', 'i')), '\\s+', ' ', 'g')) AS normalized,
  nullif(lower(regexp_extract(nm, '{_RE}', 1, 'i')), '') AS suffix FROM (SELECT p_partkey, {_NAME} AS nm FROM part)""")
def normalize_name(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr(_NAME).alias("nm"))
    return df.select("p_partkey", text.normalize_name(F.col("nm")).alias("normalized"), text.corporate_suffix(F.col("nm")).alias("suffix"))


@query("""SELECT p_partkey, nm || '::' || lower(p_brand) AS tier2, NOT contains(nm || '::' || p_brand, '::') AS looks_tier1, NOT contains(nm, '::') AS name_tier1
  FROM (SELECT *, lower(regexp_replace(p_name, '\\s+', ' ', 'g')) AS nm FROM part)""")
def tier_ids(spark, d):
    nm = text.normalize_name(F.col("p_name"))
    t2 = ops.tier2_id(F.col("p_name"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", t2.alias("tier2"), ops.looks_tier1(t2).alias("looks_tier1"), ops.looks_tier1(nm).alias("name_tier1"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN 'run' ELSE s END AS slug, sha256(regexp_replace(text, '[^A-Za-z0-9._-]', '_', 'g')) AS model_slug_sha FROM (
  SELECT doc_id, text, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS s FROM documents)""")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"), hashing.sha256(text.model_slug(F.col("text"))).alias("model_slug_sha"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '!\\[([^\\]]*)\\]\\([^)]+\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\[[^\\]]+\\]', '\\1', 'g') AS stripped
  FROM (SELECT page_id, 'a ![i](' || url || ') b [text ' || page_id || '](' || url || ') c [r][' || page_id || '] d' AS t FROM pages)""")
def strip_links(spark, d):
    t = F.format_string("a ![i](%s) b [text %s](%s) c [r][%s] d", F.col("url"), F.col("page_id"), F.col("url"), F.col("page_id"))
    return table(spark, d, "pages").select("page_id", text.strip_links(t).alias("stripped"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10) || chr(10) || '[...truncated; full body is ' || length(text) || ' chars...]' ELSE text END AS shown FROM documents")
def truncate_marker(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_with_marker(F.col("text"), 300).alias("shown"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:50], ' ') AS head FROM documents")
def truncate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_tokens(F.col("text"), 50).alias("head"))


def _scrub_sql(c: str) -> str:
    for pattern in text.SECRET_PATTERNS:
        c = f"regexp_replace({c}, '{pattern}', 'SCRUBBED', 'g')"
    return c


@query(f"SELECT doc_id, sha256({_scrub_sql('text')}) AS scrubbed_sha FROM documents")
def secret_scrub(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.sha256(text.scrub_secrets(F.col("text"))).alias("scrubbed_sha"))


_SUFFIXES = ", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)
_PLATFORMS = ", ".join(f"'{x}'" for x in urls.PLATFORMS)


@query(f"""SELECT *, domain IN ({_PLATFORMS}) AS platform FROM (SELECT page_id, host, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
  WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(string_split(host, '.')[-3:], '.')
  ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages))""")
def registrable_domain(spark, d):
    rows = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.registrable_domain(F.col("url")).alias("domain"))
    return rows.withColumn("platform", urls.is_platform(F.col("domain")))


_URL = """CASE page_id % 13 WHEN 0 THEN url WHEN 1 THEN 'ftp://x.example.com/a' WHEN 2 THEN 'http://10.0.0.' || (page_id % 255) || '/a' WHEN 3 THEN 'http://172.' || (page_id % 40) || '.1.1/'
  WHEN 4 THEN 'http://169.254.169.254/latest' WHEN 5 THEN 'http://8.8.' || (page_id % 9) || '.8/x' WHEN 6 THEN 'http://[fe80::' || page_id || ']/x' WHEN 7 THEN 'http://100.' || (page_id % 130) || '.1.1/'
  WHEN 8 THEN 'http://2130706433/' WHEN 9 THEN 'http://[2606:4700::' || (page_id % 9) || ']:8080/' WHEN 10 THEN 'https://metadata.azure.com/x' WHEN 11 THEN 'http://u:p@127.0.0.1/' ELSE 'https://localhost:8080/' END"""


@query(f"""SELECT page_id, u AS url FROM (SELECT page_id, {_URL} AS u FROM pages) WHERE page_id % 13 IN (0, 5, 9) OR (page_id % 13 = 3 AND page_id % 40 NOT BETWEEN 16 AND 31) OR (page_id % 13 = 7 AND page_id % 130 NOT BETWEEN 64 AND 127)""")
def url_policy_filter(spark, d):
    return table(spark, d, "pages").select("page_id", F.expr(_URL).alias("url")).where(urls.url_allowed(F.col("url")))


@query("""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages), many AS (SELECT host FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN true WHEN page_id % 4 = 3 THEN false WHEN page_id % 4 = 1 THEN true ELSE host IN (SELECT host FROM many) END AS allowed FROM h WHERE page_id % 4 <> 1 OR host IN (SELECT host FROM many)""")
def host_allowlist(spark, d):
    """Citations against the hosts of two pages or more: none, one without a host, one twice of an allowed host, the page's own."""
    pages = table(spark, d, "pages").withColumn("host", urls.host(F.col("url")))
    allowed = pages.groupBy("host").agg(F.count("*").alias("n")).where("n > 1")
    kind = F.col("page_id") % 4
    cited = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 3, F.array("url", F.lit("no host"))).when(kind == 1, F.array("url", F.concat(F.lit("https://"), F.col("host"), F.lit("/x")))).otherwise(F.array("url"))
    rows = pages.withColumn("cited", cited)
    out = ops.cited_hosts_allowed(rows, "page_id", "cited", allowed)
    return out.where((F.col("page_id") % 4 != 1) | F.col("allowed"))


_SUFFIXED = """CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN 'https://www.ck/a' WHEN 2 THEN 'https://x.y' || page_id || '.ck/' WHEN 3 THEN 'https://a.city.kawasaki.jp/' WHEN 4 THEN 'https://a.b' || page_id || '.Co.uk/x'
  WHEN 5 THEN 'https://co.uk/' WHEN 6 THEN 'http://10.0.0.' || (page_id % 250) || '/' WHEN 7 THEN 'https://u.foo' || page_id || '.kawasaki.jp:80/' ELSE 'https://w.x.example' || page_id || '.zz/' END"""
_RULES = ", ".join(f"('{r}')" for r in urls.SUFFIX_RULES)


@query(f"""WITH p AS (SELECT page_id, lower(regexp_extract({_SUFFIXED}, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
rule AS (SELECT regexp_replace(r, '^(\\*\\.|!)', '') AS key, r LIKE '!%' AS exception, len(string_split(regexp_replace(r, '^(\\*\\.|!)', ''), '.')) + CASE WHEN r LIKE '!%' THEN -1 WHEN r LIKE '*.%' THEN 1 ELSE 0 END AS n FROM (VALUES {_RULES}) v(r)),
cut AS (SELECT DISTINCT host, len(string_split(host, '.')) AS labels, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p),
met AS (SELECT host, exception, n FROM cut JOIN rule ON key = array_to_string(string_split(host, '.')[labels - k + 1 :], '.') WHERE n <= labels),
best AS (SELECT host, n FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY exception DESC, n DESC) AS rn FROM met) WHERE rn = 1)
SELECT page_id, CASE WHEN regexp_matches(host, '^[0-9.]+$') OR len(string_split(host, '.')) <= coalesce(n, 1) + 1 THEN host ELSE array_to_string(string_split(host, '.')[-(coalesce(n, 1) + 1) :], '.') END AS domain FROM p LEFT JOIN best USING (host)""")
def suffix_rules(spark, d):
    """Registered names under rules, wildcards and exceptions."""
    rules = spark.createDataFrame([(r,) for r in urls.SUFFIX_RULES], "rule string")
    pages = table(spark, d, "pages").select("page_id", F.expr(_SUFFIXED).alias("url"))
    return urls.registrable_domains(pages, "url", rules).select("page_id", "domain")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS text_id, sha256(text) AS content_sha256, sha256(doc_id || '|' || lang || '||' || n_chars) AS skip_key FROM documents")
def hash_ids(spark, d):
    key = hashing.joined_key(F.col("doc_id"), F.col("lang"), F.lit(None), F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", hashing.short_sha256(F.col("text")).alias("text_id"), hashing.sha256(F.col("text")).alias("content_sha256"), key.alias("skip_key"))


@query("SELECT l_orderkey, l_linenumber, least('s' || l_suppkey, 'p' || l_partkey) || chr(1) || greatest('s' || l_suppkey, 'p' || l_partkey) AS pair_key FROM lineitem")
def pair_key(spark, d):
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hashing.pair_key(s, p).alias("pair_key"))


@query("SELECT conv_id, turn, substr(sha256(CASE WHEN role = 'system' THEN '' ELSE role END || chr(31) || text), 1, 16) AS response_key FROM conversations")
def response_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", hashing.response_key(F.nullif("role", F.lit("system")), F.col("text")).alias("response_key"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE substr(sha1(text), 1, 8) END AS row_id FROM documents""")
def row_id(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, "")
    return table(spark, d, "documents").select("doc_id", hashing.row_id(name, F.col("text")).alias("row_id"))


@query(f"""SELECT doc_id, CAST(CASE WHEN m >= 0 THEN m END AS BIGINT) AS months FROM (
  SELECT doc_id, (year(failure_date) - year(founding_date)) * 12 + month(failure_date) - month(founding_date) AS m FROM (SELECT doc_id, {DATED_SQL} FROM documents))""")
def lifespan_months(spark, d):
    return dated(table(spark, d, "documents")).select("doc_id", dates.whole_months(F.col("founding_date"), F.col("failure_date")).alias("months"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(DATE '{AS_OF}' - to_years(CAST(doc_id % 30 AS INTEGER)) AS DATE)::VARCHAR END AS cutoff FROM documents")
def cutoff_dates(spark, d):
    years = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 30)
    return table(spark, d, "documents").select("doc_id", dates.cutoff_date(F.lit(AS_OF).cast("date"), years).cast("string").alias("cutoff"))


_RECENT = "(NOT failure_unknown AND failure_date >= DATE '2018-06-01')"


@query(f"""SELECT doc_id FROM (SELECT doc_id, {DATED_SQL} FROM documents) WHERE {_RECENT}
  OR (failure_unknown AND NOT founding_unknown AND founding_date >= DATE '2018-06-01') OR (failure_unknown AND founding_unknown)""")
def recency_filter(spark, d):
    return dated(table(spark, d, "documents")).where(dates.recent(F.lit("2018-06-01").cast("date"))).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {DATED_SQL} FROM documents) WHERE {_RECENT}")
def recency_strict(spark, d):
    return dated(table(spark, d, "documents")).where(dates.recent(F.lit("2018-06-01").cast("date"), strict=True)).select("doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN (1990 + doc_id % 30) || '-01-01' END AS founding_date, doc_id % 3 = 0 AS founding_unknown,
  source || ':' || doc_id AS provenance_id, CASE WHEN source IN ('src0', 'src1') THEN 'curated_real' ELSE 'scraped' END AS provenance, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS text_id FROM documents""")
def payload_build(spark, d):
    year = F.when(F.col("doc_id") % 3 != 0, 1990 + F.col("doc_id") % 30)
    return table(spark, d, "documents").select("doc_id", *ops.payload_columns(year, F.col("source"), F.col("doc_id"), ["src0", "src1"]))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 100 = 0""")
def cosine_pairs(spark, d):
    """Every query vector (ids divisible by 100) against every other row, in blocks of queries."""
    e = table(spark, d, "embeddings")
    return vectors.cosines(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("""SELECT vec_id, round(list_sum(u), 6) AS total, round(u[1], 6) AS first FROM (
  SELECT vec_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM (SELECT vec_id, [x * (1 + vec_id % 5) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings))""")
def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))
    u = vectors.l2_normalize(scaled)
    return table(spark, d, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("u")[0], 6).alias("first"))


_ANSWER = """CASE event_id % 5 WHEN 0 THEN '{"decision": "same"}' WHEN 1 THEN '{"decision": "different"}' WHEN 2 THEN '{"decision": "maybe"}' WHEN 3 THEN 'not json' ELSE '[1]' END"""


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'same' ELSE 'different' END AS decision FROM events")
def json_tiebreak(spark, d):
    return table(spark, d, "events").select("event_id", jsonx.tiebreak_decision(F.expr(_ANSWER)).alias("decision"))


_JUDGE = """CASE event_id % 6 WHEN 0 THEN '{"is_dead_company": true}' WHEN 1 THEN '{"is_dead_company": false}' WHEN 2 THEN '{"other": 1}' WHEN 3 THEN 'no {json' WHEN 4 THEN '[true]' ELSE '{"is_dead_company": "true"}' END"""


@query("SELECT event_id, CASE WHEN event_id % 6 IN (0, 3) THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM events")
def json_slop(spark, d):
    return table(spark, d, "events").select("event_id", jsonx.slop_score(F.expr(_JUDGE)).cast("double").alias("score"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 3 THEN false ELSE event_id % 4 = 1 END AS grounded FROM events""")
def claims_grounded(spark, d):
    claim = F.when(F.col("event_id") % 4 == 0, "no numbers").when(F.col("event_id") % 4 == 2, F.concat(F.lit("lost "), (F.col("user_id") + 1000000).cast("string"))).otherwise(F.concat(F.lit("had "), F.col("user_id").cast("string"), F.lit(" users.")))
    body = F.when(F.col("event_id") % 4 != 3, F.concat("props", F.lit(" with "), F.col("user_id"), F.lit(" users")))
    return table(spark, d, "events").select("event_id", text.claims_grounded(claim, body).alias("grounded"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS flagged FROM conversations")
def injection_flag(spark, d):
    said = F.when(F.col("turn") % 3 == 0, F.lit("\tprompt_injection_attempted\n")).when(F.col("turn") % 3 == 1, F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.injection_flag(said).alias("flagged"))


@query("""SELECT event_id, CASE WHEN s = 429 OR (s BETWEEN 500 AND 599 AND s <> 503) THEN 'transient' WHEN s = 402 THEN 'budget' WHEN s >= 400 THEN 'fatal' ELSE 'ok' END AS class, 0.5 * pow(2, event_id % 4) AS backoff
  FROM (SELECT event_id, CAST(200 + (event_id * 7) % 350 AS BIGINT) AS s FROM events)""")
def retry_class(spark, d):
    rows = table(spark, d, "events").withColumn("s", 200 + (F.col("event_id") * 7) % 350)
    return rows.select("event_id", budget.retry_class(F.col("s")).alias("class"), budget.backoff(F.col("event_id") % 4, 0.5).alias("backoff"))


@query("""SELECT conv_id, string_agg('- turn ' || turn || ' — https://x.example/' || conv_id || chr(10) || '  ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS listing FROM conversations GROUP BY 1""")
def format_hits(spark, d):
    hit = F.struct("turn", F.concat(F.lit("turn "), "turn").alias("title"), F.concat(F.lit("https://x.example/"), "conv_id").alias("url"), F.col("text").alias("snippet"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(text.format_hits(F.array_sort(F.collect_list(hit))).alias("listing"))


_PATH = "CASE WHEN doc_id % 5 = 0 THEN '../etc' WHEN doc_id % 5 = 1 THEN upper(substr(sha256(text), 1, 16)) ELSE substr(sha256(text), 1, 16) END"


@query("SELECT doc_id, 'raw/' || source || '/' || substr(sha256(text), 1, 16) || '.md' AS path FROM documents WHERE doc_id % 5 > 1 OR (doc_id % 5 = 1 AND NOT regexp_matches(substr(sha256(text), 1, 16), '[a-f]'))")
def path_validate(spark, d):
    rows = table(spark, d, "documents").withColumn("text_id", F.expr(_PATH.replace("sha256(text)", "sha2(text, 256)")))
    return rows.select("doc_id", files.path_column("raw", F.col("text_id"), F.col("source")).alias("path")).where("path is not null")


_TAGS = "(?is)\\s(?:aria-label|alt|title)=(?:\"[^\"]*\"|''[^'']*'')"


def _sanitize_sql(c: str) -> str:
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    for t in ("script", "style", "noscript"):
        c = f"regexp_replace({c}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    for t in ("div", "span", "p", "section"):
        c = f"regexp_replace({c}, '(?is)<{t}\\b[^>]*(?:\\shidden\\b|display\\s*:\\s*none|visibility\\s*:\\s*hidden)[^>]*>.*?</{t}\\s*>', '', 'g')"
    return f"regexp_replace({c}, '{_TAGS}', '', 'g')"


@query(f"SELECT page_id, sha256({_sanitize_sql('html')}) AS clean_sha FROM pages")
def html_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", hashing.sha256(html.sanitize(F.col("html"))).alias("clean_sha"))


def visible_sql() -> str:
    c = _sanitize_sql("html")
    for t in ("nav", "header", "footer", "aside"):
        c = f"regexp_replace({c}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{mark}')"
    return f"regexp_replace(regexp_replace({c}, '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT page_id, CASE WHEN length(t) < 500 THEN '' ELSE t END AS body FROM (SELECT page_id, {visible_sql()} AS t FROM pages)")
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", html.extract(F.col("html")).alias("body"))


@query("""SELECT doc_id, CAST(p // 640 AS BIGINT) AS chunk_idx, p AS start, least(p + 768, n) AS stop FROM (
  SELECT doc_id, n, unnest(range(0, n + 1, 640)) AS p FROM (SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents WHERE text <> '')) WHERE p = 0 OR p + 128 < n""")
def chunk_windows(spark, d):
    return windows(table(spark, d, "documents"), "doc_id")


_HEADINGS = """WITH RECURSIVE tok AS (SELECT doc_id, string_split(regexp_replace(text, '\\n', chr(10) || '# ', 'g'), ' ') AS t FROM documents WHERE text <> ''),
n AS (SELECT doc_id, len(t)::BIGINT AS n, [i // 32 * 32 FOR i IN range(0, len(t)) IF contains(t[i + 1], chr(10) || '#')] AS heads FROM tok),
w AS (SELECT doc_id, n, heads, 0::BIGINT AS chunk_idx, 0::BIGINT AS start FROM n
  UNION ALL SELECT doc_id, n, heads, chunk_idx + 1, coalesce(list_min([h FOR h IN heads IF h > start + 640 AND h <= start + 736 AND h < n]), start + 640) FROM w WHERE start + 768 < n)
SELECT doc_id, chunk_idx, start, least(start + 768, n) AS stop FROM w"""


@query(_HEADINGS)
def chunk_headings(spark, d):
    docs = table(spark, d, "documents")
    return heading_windows(docs.withColumn("text", F.regexp_replace("text", "\n", "\n# ")), "doc_id")


@query(_HEADINGS)
def lateral_chunks(spark, d):
    """The same windows by a table function in SQL."""
    docs = table(spark, d, "documents")
    tools.register(spark, docs.select(F.col("doc_id").cast("string").alias("canonical_id"), F.col("text").alias("body")))
    docs.withColumn("text", F.regexp_replace("text", "\n", "\n# ")).createOrReplaceTempView("lateral_documents")
    return spark.sql("SELECT doc_id, c.chunk_idx, c.start, c.stop FROM lateral_documents, LATERAL heading_windows(text) c")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'search_corpus' WHEN turn % 7 = 3 THEN 'other_tool' ELSE 'get_post_mortem' END AS tool, conv_id * 13 + turn AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n > 4 THEN 'refused' WHEN tool = 'other_tool' THEN 'unknown' WHEN tool = 'search_corpus' OR doc_id IS NOT NULL THEN 'answered' ELSE 'not_found' END AS outcome,
  CASE WHEN n > 4 OR tool = 'other_tool' THEN NULL WHEN tool = 'search_corpus' THEN '[]' WHEN length(text) > 8000 THEN sha256(substr(text, 1, 8000) || chr(10) || chr(10) || '[...truncated; full body is ' || length(text) || ' chars...]') ELSE sha256(text) END AS result
FROM c LEFT JOIN documents ON doc_id = doc AND tool = 'get_post_mortem' AND n <= 4""")
def tool_quota(spark, d):
    """Each turn is a call; a conversation's calls share a quota of four."""
    tool = F.when(F.col("turn") % 3 == 2, "search_corpus").when(F.col("turn") % 7 == 3, "other_tool").otherwise("get_post_mortem")
    calls = table(spark, d, "conversations").select(F.col("conv_id").alias("synthesis_id"), F.col("turn").alias("seq"), tool.alias("tool"), (F.col("conv_id") * 13 + F.col("turn")).cast("string").alias("argument"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("canonical_id"), F.col("text").alias("body"))
    out = tools.answered(calls, docs, quota=4)
    return out.select(F.col("synthesis_id").alias("conv_id"), F.col("seq").alias("turn"), "outcome", F.when(F.col("result") == "[]", "[]").otherwise(F.sha2("result", 256)).alias("result"))
