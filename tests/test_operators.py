"""Small hand-made cases of operators that SQL does not cover."""

import datetime
import random

import pytest

from pyspark.sql import functions as F

from siltstone.functions import dates, html, jsonx, text, urls, vectors
from siltstone.operators import chunks, graph, ranked, resolve, retrieval, tables
from siltstone.operators.repair import drift, repairs
from siltstone.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strings(spark):
    assert one(spark, text.normalize_name(F.lit("  Acme   Group Holdings Inc. "))) == "acme group holdings inc."
    assert one(spark, text.normalize_name(F.lit("Acme Group Inc."))) == "acme group"
    assert one(spark, text.corporate_suffix(F.lit("Incorporated"))) is None
    assert one(spark, text.slugify(F.lit("!!"))) == "run"
    assert one(spark, text.first_present(F.lit("\t"), F.lit(None).cast("string"), F.lit(" b "))) == "b"
    assert one(spark, text.claims_grounded(F.lit("cut 40% of 1,200"), F.lit("1,200 and cut 40% of it"))) is True
    assert one(spark, text.claims_grounded(F.lit("cut 41%"), F.lit("40%"))) is False
    assert one(spark, text.claims_grounded(F.lit("cut 41%"), F.lit(None).cast("string"))) is False
    assert one(spark, text.strip_links(F.lit("![a](b)[c](d)[e][f]"))) == "ace"


def test_json_and_urls(spark):
    for raw, want in (("{bad", 0.0), ("[1]", 1.0), ('{"is_dead_company": true}', 0.0), ('{"is_dead_company": "true"}', 1.0), ("{}", 1.0)):
        assert one(spark, jsonx.slop_score(F.lit(raw))) == want
    assert one(spark, jsonx.tiebreak_decision(F.lit("nope"))) == "different"
    for url, ok in (("http://10.1.1.1/", False), ("https://a.example/", True), ("http://169.254.169.254/", False), ("ftp://a.b/", False), (None, False)):
        assert one(spark, urls.url_allowed(F.lit(url).cast("string"))) is ok
    assert one(spark, urls.hosts_allowed(F.array().cast("array<string>"), F.array(F.lit("a")))) is True
    assert one(spark, urls.registrable_domain(F.lit("https://www.shop.co.uk/x"))) == "shop.co.uk"


def test_dates(spark):
    assert one(spark, dates.cutoff_date(F.lit("2024-02-29").cast("date"), F.lit(1))) == datetime.date(2023, 2, 28)
    assert one(spark, dates.cutoff_date(F.lit("2024-02-29").cast("date"), F.lit(None))) is None
    assert one(spark, dates.whole_months(F.lit("2020-05-01").cast("date"), F.lit("2020-04-30").cast("date"))) is None
    row = "failure_date date, founding_date date, failure_unknown boolean, founding_unknown boolean"
    day = datetime.date
    data = [(day(2020, 1, 1), None, False, True), (day(2010, 1, 1), day(2009, 1, 1), False, False), (None, day(2021, 1, 1), True, False), (None, day(2001, 1, 1), True, False), (None, None, True, True)]
    df = spark.createDataFrame(data, row)
    cut = F.lit("2018-01-01").cast("date")
    assert [r.x for r in df.select(dates.recent(cut).alias("x")).collect()] == [True, False, True, False, True]
    assert [r.x for r in df.select(dates.recent(cut, strict=True).alias("x")).collect()] == [True, False, False, False, False]
    assert df.where(dates.recent(F.lit(None).cast("date"))).count() == 5


def test_html(spark):
    page = '<body><!-- gone --><script>x</script><div hidden>no</div><p style="a">kept <img alt="secret">word</p>' + "w " * 300 + "</body>"
    got = one(spark, html.extract(F.lit(page)))
    assert "kept" in got and all(x not in got for x in ("gone", "secret", "no ", "x</"))
    assert one(spark, html.extract(F.lit("<p>" + "a" * 499 + "</p>"))) == ""
    assert one(spark, html.extract(F.lit("<p>" + "a" * 500 + "</p>"))) == "a" * 500


def test_vectors(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vectors.cosine(arr(1, 0), arr(0, 0))) == 0.0
    assert one(spark, vectors.cosine(arr(1, 0), arr(1))) == 0.0
    assert one(spark, vectors.l2_normalize(arr(0, 0))) == [0.0, 0.0]


def _union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_random(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in _union_find(edges).items() if k in got}
    assert got == want and {x for e in edges for x in e if e[0] != e[1]} == set(got)


def test_alias_collapse(spark):
    c = spark.createDataFrame([(1, 1, 0.9, [7]), (1, 2, 0.5, []), (1, 3, 0.95, []), (1, 4, 0.1, [])], "query_id long, canonical_id long, score double, alias_canonicals array<long>")
    e = spark.createDataFrame([(1, 2), (2, 1), (4, 99)], "canonical_id long, target long")
    got = {r.canonical_id: r.alias_canonicals for r in graph.collapse_aliases(c, e).collect()}
    assert got == {1: [7, 2], 3: [], 4: []}


def test_tables(spark):
    ch = spark.createDataFrame([("a", 1, "x"), ("a", 2, "del"), ("b", 1, "y")], "k string, seq long, v string")
    assert [r.k for r in tables.latest(ch, ["k"], "seq", F.col("v") == "del").collect()] == ["b"]
    j = spark.createDataFrame([("old", "s", "1", "complete")], "canonical_id string, source string, source_id string, merge_state string")
    f = spark.createDataFrame([("new", "s", "1")], "canonical_id string, source string, source_id string")
    r = tables.upsert_flipped(j, f).collect()
    assert [(x.canonical_id, x.merge_state, x.prior_canonical_id) for x in r] == [("new", "resolver_flipped", "old")]


def test_heading_windows(spark):
    words = ["w"] * 1500
    words[700] = "w\n#"
    df = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "a b")], "id long, text string")
    got = sorted((r.id, r.chunk_idx, r.start, r.stop) for r in chunks.heading_windows(df, "id").collect())
    assert got == [(1, 0, 0, 768), (1, 1, 672, 1440), (1, 2, 1312, 1500), (4, 0, 0, 2)]
    plain = sorted((r.id, r.start, r.stop) for r in chunks.windows(df, "id").collect())
    assert plain == [(1, 0, 768), (1, 640, 1408), (1, 1280, 1500), (4, 0, 2)]


def test_resolution_against_a_sequential_model(spark):
    rng = random.Random(3)
    rows = [(i, f"d{rng.randrange(6)}" if rng.random() > 0.1 else "", rng.random() < 0.1, rng.choice([None, 2000, 2005, 2012, 2020]), rng.random() < 0.4) for i in range(300)]
    anchor, present, want = {}, set(), {}
    for seq, domain, platform, year, suffixed in rows:
        if platform or domain == "":
            want[seq] = 2
        elif year is not None and domain in anchor and abs(year - anchor[domain]) > 10:
            want[seq] = 2
        elif domain in present and suffixed:
            want[seq] = 2
        else:
            want[seq] = 1
            present.add(domain)
            if year is not None:
                anchor.setdefault(domain, year)
    df = spark.createDataFrame(rows, "seq long, domain string, platform boolean, year int, suffixed boolean")
    assert {r.seq: r.tier for r in resolve.by_domain(df).collect()} == want


def test_siblings(spark):
    rows = [(0, "s", "m"), (1, "s", "b"), (2, "s", "ba"), (3, "s", "b"), (4, "t", "z"), (5, "s", "a")]
    similar = lambda x, y: x[0] == y[0]
    got = {r.seq: r.resolved for r in resolve.siblings(spark.createDataFrame(rows, "seq long, sector string, id string"), similar).collect()}
    assert got == {0: "m", 1: "b", 2: "b", 3: "b", 4: "z", 5: "a"}
    band = lambda s, d=None: one(spark, resolve.band(F.lit(s), F.lit(d).cast("string")))
    assert [band(0.85), band(0.65), band(0.7), band(0.7, "same"), band(0.6, "same")] == ["same", "different", "different", "same", "different"]


def test_retrieval_boost_is_all_or_nothing(spark):
    df = spark.createDataFrame([("a", "b", "a", "b"), ("a", "x", "a", "b"), ("other", "other", "a", "b"), ("a", "other", "a", "b")], "qs string, qg string, s string, g string")
    got = [r.m for r in df.select(retrieval.facet_match({"s": "qs", "g": "qg"}, {"s": "s", "g": "g"}).alias("m")).collect()]
    assert got == [True, False, False, True]


def test_severity_and_lengths(spark):
    rows = [(1, i, "r", "high", ["c"] * (1 + i % 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id long, pos long, summary string, severity string, raised_by array<string>")
    valid = spark.createDataFrame([(1, ["c"])], "query_id long, ids array<string>")
    none = spark.createDataFrame([], "query_id long")
    got = {r.pos: r.severity for r in ranked.consolidate(df, valid, none).collect()}
    assert sorted(p for p, s in got.items() if s == "medium") == [0, 3]
    assert ranked.consolidate(df, valid, valid.select("query_id")).count() == 0


def test_drift_and_repairs(spark):
    j = spark.createDataFrame([("1", "complete", "h"), ("2", "pending", None), ("4", "resolver_flipped", "h")], "id string, merge_state string, content_hash string")
    tree = spark.createDataFrame([("1", "x"), ("2", "h"), ("4", "h")], "id string, combined_hash string")
    raw = spark.createDataFrame([("1",), ("9",)], "id string")
    found = drift(j, tree, raw, spark.createDataFrame([("2",), ("4",)], "id string"), spark.createDataFrame([("t",)], "id string"))
    assert sorted((r.drift, r.id) for r in repairs(found).collect()) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "9"), ("e", "t"), ("f", "4")]


def test_readers(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('uuid,name,website,status\n1,A,https://a,closed\n,B,,operating\n,,x,closed\n')
    rows = readers.read_csv(spark, str(p))
    assert [(r.source_id, r.name) for r in readers.company_entries(rows).orderBy("source_id").collect()] == [("1", "A"), ("B", "B")]
    assert readers.closed_companies(rows).count() == 2
    m = tmp_path / "d.md"
    m.write_text("---\ncanonical_id: a.example\nnote: x: y\n---\nbody\n")
    r = readers.read_markdown(spark, str(m)).first()
    assert r.meta == {"canonical_id": "a.example", "note": "x: y"} and r.body == "body\n"
    q = tmp_path / "q.jsonl"
    q.write_text('{"name": "a"}\n\n{"name": "b"}\n')
    assert readers.read_jsonl(spark, str(q), "name string").count() == 2


def test_full_resolution(spark):
    """Hints, domains, tier-2 ids, siblings by band, memo and answers, flips against a journal."""
    schema = "seq long, source string, source_id string, name string, sector string, domain string, platform boolean, year int, suffixed boolean, alias_hint string"
    rows = [(1, "hn", "1", "Acme Inc.", "Fin", "medium.com", True, 2010, True, None), (2, "hn", "2", "Acmee", "fin", "", False, None, False, None), (3, "hn", "3", "Zed", "fin", "medium.com", True, None, False, None),
            (4, "hn", "4", "B", "fin", "b.example", False, 2001, False, None), (5, "hn", "5", "B", "fin", "b.example", False, 2015, False, None), (6, "hn", "6", "C", "fin", "c.example", False, 2001, False, "b.example"), (7, "hn", "7", "D", "fin", "d.example", False, 2001, False, None)]
    entries = spark.createDataFrame(rows, schema)
    prior = spark.createDataFrame([("hn", "7", "old.example", "complete"), ("csv", "9", "b.example", "complete"), ("csv", "8", "aaa::fin", "complete"), ("csv", "5", "aa::fin", "alias_blocked")], "source string, source_id string, canonical_id string, merge_state string")
    near = {("acme::fin", "aaa::fin"): 0.1, ("acmee::fin", "aaa::fin"): 0.9, ("zed::fin", "aaa::fin"): 0.7, ("b::fin", "aaa::fin"): 0.7}
    table = spark.createDataFrame([(*k, v) for k, v in near.items()], "a string, b string, similarity double")
    similarity = lambda pairs: pairs.join(table, ["a", "b"], "left").fillna(0.1, ["similarity"])
    memo = spark.createDataFrame([("aaa::fin\x01b::fin", "m", "t1", "same"), ("aaa::fin\x01b::fin", "m", "t0", "different")], "pair_key string, model string, template_sha string, decision string")
    answers = spark.createDataFrame([("aaa::fin\x01zed::fin", "same"), ("aaa::fin\x01b::fin", "different")], "pair_key string, decision string")
    out, review = resolve.resolve_entities(entries, prior, memo, similarity, answers, model="m", template="t1")
    got = {r.seq: (r.canonical_id, r.reason, r.action) for r in out.collect()}
    assert got[1] == ("acme::fin", "platform", "create") and got[2] == ("aaa::fin", "platform", "merge") and got[3] == ("aaa::fin", "platform", "merge")
    assert got[4] == ("b.example", "domain", "merge") and got[5] == ("aaa::fin", "recycled", "merge") and got[6] == ("b.example", "alias_hint", "merge") and got[7] == ("d.example", "domain", "flip")
    assert {(r.pair_key, r.decision) for r in review.collect()} == {("aaa::fin\x01zed::fin", "same")}  # the memo's answer is not new
    _, review = resolve.resolve_entities(entries, prior, memo, similarity, answers, model="m", template="t2")
    assert {(r.pair_key, r.decision) for r in review.collect()} == {("aaa::fin\x01zed::fin", "same"), ("aaa::fin\x01b::fin", "different")}


def test_siblings_in_arrival_order(spark):
    """Random sectors, one of which holds most entries, against the fold one by one; the first entry is never folded onto a later one."""
    rng = random.Random(21)
    words = [a + b for a in "abcdefgh" for b in "xyz"]
    rows = []
    for i in range(700):
        rows.append((i, "hot" if rng.random() < 0.6 else f"s{rng.randrange(6)}", rng.choice(words), rng.random() < 0.1))
    there = [("hot", "gy::hot", "complete"), ("hot", "ax::hot", "alias_blocked"), ("s1", "bx::s1", "pending")]
    score = lambda a, b: 0.9 if (ord(a[0]) + ord(a[1]) * 3 + ord(b[0]) * 5 + ord(b[1])) % 4 == 0 else 0.3
    state, want = {}, {}
    for sector, cid, merge in there:
        if merge != "alias_blocked":
            state.setdefault(sector, set()).add(cid)
    for seq, sector, name, flips in rows:
        cid = f"{name}::{sector}"
        sibling = min((x for x in state.get(sector, ()) if x != cid), default=None)
        if sibling is not None and score(cid, sibling) >= 0.85:
            want[seq] = sibling
        else:
            want[seq] = cid
            if not flips:
                state.setdefault(sector, set()).add(cid)
    entries = spark.createDataFrame([(i, "src", str(i), n, s, "", True, None, False, None) for i, s, n, _ in rows], "seq long, source string, source_id string, name string, sector string, domain string, platform boolean, year int, suffixed boolean, alias_hint string")
    prior = spark.createDataFrame([("old", str(k), c, m) for k, (_, c, m) in enumerate(there)] + [("src", str(i), "gone", "complete") for i, _, _, f in rows if f], "source string, source_id string, canonical_id string, merge_state string")
    at = lambda c, k: F.ascii(F.substring(c, k, 1))
    similarity = lambda r: r.withColumn("similarity", F.when((at("a", 1) + at("a", 2) * 3 + at("b", 1) * 5 + at("b", 2)) % 4 == 0, 0.9).otherwise(0.3))
    memo = spark.createDataFrame([], "pair_key string, model string, template_sha string, decision string")
    out, review = resolve.resolve_entities(entries, prior, memo, similarity)
    assert {r.seq: r.canonical_id for r in out.collect()} == want and review.count() == 0
    two = spark.createDataFrame([(1, "x", "1", "b", "fin", "", True, None, False, None), (2, "x", "2", "a", "fin", "", True, None, False, None)], entries.schema)
    out, _ = resolve.resolve_entities(two, prior.limit(0), memo, lambda r: r.withColumn("similarity", F.lit(0.9)))
    assert {r.seq: r.canonical_id for r in out.collect()} == {1: "b::fin", 2: "b::fin"}


def test_zipped_and_moves(spark):
    from siltstone.operators import corpus

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string")
    assert [(r.l, r.r) for r in corpus.zipped(a, a.withColumnRenamed("l", "r"), ["k"]).orderBy("k").collect()] == [("x", "x"), ("y", "y")]
    with pytest.raises(Exception, match="no partner for"):
        corpus.zipped(a, a.withColumnRenamed("l", "r").where("k = 1"), ["k"]).collect()
    judged = spark.createDataFrame([(1, 0.7), (2, 0.1)], "k int, judged double")
    back, stay = corpus.reclassify_moves(corpus.reclassified(a.unionByName(spark.createDataFrame([(3, "z")], "k int, l string")), judged, "k"), "k")
    assert [(r.k, r.merge_state) for r in back.collect()] == [(2, "pending")] and sorted(r.k for r in stay.collect()) == [1, 3]
    found, failed = corpus.gathered_resilient({"good": lambda: a, "bad": lambda: spark.read.parquet("/nowhere/at/all")}, "k", 1)
    assert found.count() == 1 and list(failed) == ["bad"] and "PATH_NOT_FOUND" in failed["bad"]
    assert corpus.trace(a.withColumn("score", F.lit(1.0))).columns == ["score"]
