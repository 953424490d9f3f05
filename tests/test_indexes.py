"""The indexes against brute force: same rows as looking at every chunk, and most chunks not looked at."""

import math
import random
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest

from siltstone.operators import corpus, postings, retrieval, vectorindex
from siltstone.operators.hits import best_of
from pyspark.sql import functions as F

DATES = "failure_date date, founding_date date, failure_unknown boolean, founding_unknown boolean"


def dates(rng):
    day = lambda: date(2000, 1, 1) + timedelta(days=rng.randrange(5000))
    failure, founding = (day() if rng.random() < 0.7 else None for _ in range(2))
    return failure, founding, failure is None, founding is None


def admits(cutoff, row):
    failure, founding, no_failure, no_founding = row
    if cutoff is None or (no_failure and no_founding):
        return True
    return founding >= cutoff if no_failure else failure >= cutoff


def ranked(scores, k):
    """{query: {chunk: score}} -> rows"""
    return {(q, c, s, r) for q, of in scores.items() for r, (c, s) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}


@pytest.fixture(scope="module")
def vectors():
    """Clusters, one vector that a third of the chunks have, vectors that are null, zero, short, or hold a null."""
    rng, g = random.Random(6), np.random.default_rng(6)
    centres = g.normal(size=(12, 16)) * 4
    rows = []
    for i in range(900):
        v = centres[0] if i % 3 == 0 else centres[i % 12] + g.normal(size=16)
        v = None if i == 40 else [0.0] * 16 if i == 41 else v[:5].tolist() if i == 42 else [None] + v[1:].tolist() if i == 43 else v.tolist()
        rows.append((i * 7 % 900, v, *dates(rng)))
    return rows


def test_vector_index(spark, vectors, monkeypatch):
    monkeypatch.setattr(vectorindex, "PART", 20)
    points = spark.createDataFrame(vectors, f"chunk_id long, embedding array<double>, {DATES}").repartition(5)
    asked = [(q, v, date(2005, 6, 1) if q % 2 else None) for q, v, *_ in vectors if q % 30 == 0 or q in (40 * 7 % 900, 42 * 7 % 900)]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>, cutoff date")
    unit = {c: np.array(v) / np.linalg.norm(v) for c, v, *_ in vectors if v and None not in v and len(v) == 16 and any(v)}
    when = {c: d for c, _, *d in vectors}
    want = ranked({q: {c: round(float(unit[q] @ u), 9) for c, u in unit.items() if admits(cut, when[c])} for q, _, cut in asked if q in unit}, 8)
    index = vectorindex.build(points, str(spark.conf.get("spark.checkpoint.dir")) + f"/vectors-test-{random.random()}", lists=12)
    got = {(r.query_id, r.chunk_id, r.score, r.rank) for r in index.search(queries, 8).collect()}
    near = lambda rows: {(q, c, round(s, 7), r) for q, c, s, r in rows}
    assert {x[:2] for x in got} == {x[:2] for x in want} and near(got) == near(want) and len({q for q, *_ in got}) > 25
    # every vector is in the index once, no part is too large, and parts that hold nothing better are skipped
    parts = index.parts().collect()
    assert sorted(i for p in parts for i in p.ids) == sorted(unit) and max(p.n for p in parts) <= 20 and min(p.low <= p.high for p in parts)
    asked_all = queries.withColumns({"theta": F.lit(-2.0), "group": F.lit(0)}).where("query_id not in (280, 294)").select("query_id", "cutoff", "embedding", "theta", "group")
    theta = spark.createDataFrame([(q, s) for q, _, s, r in want if r == 8], "query_id int, theta double")
    known = asked_all.drop("theta").join(theta, "query_id")
    every, seen = (index.wanted(index._pairs(rows, 8, False)).select("query_id", "part").distinct().count() for rows in (asked_all, known.select(*asked_all.columns)))
    assert seen < 0.3 * every


def test_vector_index_odd(spark):
    none = spark.createDataFrame([], f"chunk_id long, embedding array<float>, {DATES}")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [1.0])], "query_id long, embedding array<float>")
    assert retrieval.dense_leg(none, q, 3).count() == 0
    assert [tuple(r) for r in retrieval.dense_leg(some, q, 3).orderBy("rank").collect()] == [(1, 1, 1.0, 1), (1, 2, 0.0, 2)]
    assert {tuple(r) for r in vectorindex.faults(some, 2).collect()} == {(3, "missing"), (4, "width 1")}
    assert vectorindex.verified(some.where("chunk_id < 4"), 2).count() == 3
    with pytest.raises(Exception, match="that of 4 has 1"):
        vectorindex.verified(some, 2).collect()
    with pytest.raises(Exception, match="needs an index with dates"):
        retrieval.dense_leg(some, q.withColumn("cutoff", F.lit("2020-01-01").cast("date")), 3).collect()


def bm25(docs, asked, k, admit=lambda cut, c: True):
    found = {c: Counter(postings.words(t)) for c, t in docs}
    n, lengths = len(docs), [sum(f.values()) for f in found.values() if f]
    mean, df, scores = sum(lengths) / len(lengths), Counter(t for f in found.values() for t in f), {}
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    for q, text, cut in asked:
        of = Counter(postings.words(text))
        scores[q] = {
            c: round(sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * part(f[t], sum(f.values())) * part(m, sum(of.values())) for t, m in of.items() if t in f), 6)
            for c, f in found.items() if f.keys() & of.keys() and admit(cut, c)
        }
    return ranked(scores, k)


@pytest.fixture(scope="module")
def texts():
    """Common and rare words; topics that stand together; empty, null and long chunks."""
    rng = random.Random(11)
    rows = []
    for i in range(700):
        topic = [f"t{i // 50}x{j}" for j in range(30)]
        text = " ".join(rng.choice(topic) if rng.random() < 0.5 else f"The w{int(rng.paretovariate(0.6)) % 500}," for _ in range(rng.randrange(1, 60)))
        rows.append((i, None if i == 5 else "" if i == 6 else "... !" if i == 7 else text * 200 if i == 8 else text))
    return rows


def test_posting_index(spark, texts, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 25)
    rng = random.Random(12)
    when = {i: dates(rng) for i, _ in texts}
    points = spark.createDataFrame([(i, t, *when[i]) for i, t in texts], f"chunk_id long, text string, {DATES}").repartitionByRange(4, "chunk_id")
    asked = [(i, t, date(2006, 1, 1) if i % 3 == 0 else None) for i, t in texts if i % 20 == 0 or i in (5, 6, 8)] + [(9999, "nowhere", None), (9998, "the", None)]
    queries = spark.createDataFrame(asked, "query_id int, text string, cutoff date")
    want = bm25(texts, asked, 9, lambda cut, c: admits(cut, when[c]))
    root = f"{spark.conf.get('spark.checkpoint.dir')}/postings-test-{random.random()}"
    # in two additions, the second of which is written twice
    postings.append(points.where("chunk_id < 300"), root, "a")
    postings.append(points.where("chunk_id >= 100"), root, "b")
    index = postings.append(points.where("chunk_id >= 300"), root, "b")
    got = {(r.query_id, r.chunk_id, r.score, r.rank) for r in index.search(queries, 9).collect()}
    near = lambda rows: {(q, c, round(s, 4)) for q, c, s, _ in rows}
    assert near(got) == near(want) and len(got) == len(want) > 250
    df = Counter(t for _, x in texts for t in set(postings.words(x)))
    assert {r.term: r.df for r in index.terms().collect()} == df and index.statistics[0] == len(texts)
    # bounds hold, and skip most blocks of words that few blocks have
    n, mean = index.statistics
    bounds = index.bounds(index._asked(queries, mean, n, 1.2, 0.75), mean)
    block_of = {c: r.block for r in index.blocks().collect() for c in r.ids}
    limit = {(r.query_id, r.block): r.bound for r in bounds.collect()}
    assert all(s <= limit[q, block_of[c]] + 1e-5 for q, c, s, _ in want)
    theta = spark.createDataFrame([(q, s) for q, _, s, r in want if r == 9], "query_id int, theta double")
    assert index.remaining(bounds, theta).count() < 0.6 * bounds.count()


def test_a_task_writes_one_shard(spark, texts):
    """And sorts no other: what a task holds does not depend on which hashes meet."""
    index = postings.temporary(spark.createDataFrame(texts, "chunk_id long, text string"))
    files = spark.read.parquet(f"{index.path}/index").where("kind = 'posting'").select("shard", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task"))
    assert files.groupBy("task").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1
    assert files.agg(F.count_distinct("shard")).first()[0] == postings.SHARDS


def test_word_search_reads_its_terms_only(spark, texts):
    points = spark.createDataFrame(texts, "chunk_id long, text string")
    index = postings.temporary(points)
    for asked in (["the"], ["the", "t3x1"], ["t3x1", "t4x1"], ["nowhere", "the"]):
        assert sorted(r.chunk_id for r in index.holding(asked).collect()) == [i for i, t in texts if set(asked) <= set(postings.words(t))]
    plan = index.holding(["the", "t3x1"])._jdf.queryExecution().toString()

    shards = sorted({postings.shard_of("the"), postings.shard_of("t3x1")})
    assert f"IN ({','.join(map(str, shards))})" in plan and "PushedFilters: [In(term" in plan
    hits = corpus.text_hits(points.withColumn("lang", F.lit("en")), "chunk_id", index.holding(["the"]), F.col("lang") == "en", 3).collect()
    assert [r.chunk_id for r in hits] == [i for i, t in texts if "the" in postings.words(t)][:3] and hits[0].snippet == texts[hits[0].chunk_id][1][:500]


def test_posting_index_odd(spark):
    none = spark.createDataFrame([], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, text string")
    assert retrieval.sparse_leg(none, q, 3).count() == 0
    some = spark.createDataFrame([(4, None), (5, ""), (6, "A, a c")], "chunk_id long, text string")
    assert [tuple(r)[:2] for r in retrieval.sparse_leg(some, q, 3).collect()] == [(1, 6)]


def test_best_of_strings():
    import pyarrow as pa

    ids, q = pa.array(["d", "a", "c", "b"]), pa.array([1, 2])
    got = best_of(q, ids, np.array([[1.0, 2.0, 2.0, 1.0], [0.0, 0.0, 0.0, 0.0]]), np.array([[True] * 4, [True, False, True, True]]), 3)
    assert got.to_pylist()[:3] == [{"query_id": 1, "chunk_id": c, "score": s} for c, s in (("a", 2.0), ("c", 2.0), ("b", 1.0))] and {r["chunk_id"] for r in got.to_pylist()[3:]} == {"b", "c", "d"}


def test_long_query(spark):
    """A text is not copied for each of its terms: 40 GB for this one."""
    words = [f"word{i:06d}" for i in range(60_000)]
    points = spark.createDataFrame([(0, " ".join(words)), (1, words[7]), (2, "other")], "chunk_id long, text string")
    found = postings.temporary(points).search(points.where("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), "text"), 3).collect()
    assert {r.chunk_id for r in found} == {0, 1}


def test_posting_groups_and_strips(spark, texts, monkeypatch):
    """Groups that are scored in several strips, several products and several runs of pairs: the same rows."""
    for name, value in (("BLOCK", 60), ("ASKED", 25), ("GROUP", 4), ("QUERIES", 3), ("TERMS", 5), ("PAIRS", 40)):
        monkeypatch.setattr(postings, name, value)
    points = spark.createDataFrame(texts, "chunk_id long, text string").repartitionByRange(3, "chunk_id")
    asked = [(i, t, None) for i, t in texts if i % 15 == 0]
    queries = spark.createDataFrame([x[:2] for x in asked], "query_id int, text string")
    got = [tuple(r) for r in postings.temporary(points).search(queries, 7).collect()]
    near = lambda rows: {(q, c, round(s, 4)) for q, c, s, _ in rows}
    assert near(got) == near(bm25(texts, asked, 7)) and len(got) > 300


def test_a_block_meets_its_own_queries_first(spark):
    """Queries whose first block is the same are in groups of their own: no block goes to every group."""
    n, blocks = 6000, 40
    rows = spark.range(n).select(F.lit(0).alias("group"), F.col("id").cast("int").alias("place"), F.col("id").alias("query_id"), F.lit(None).cast("date").alias("cutoff"))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    bounds = rows.withColumn("block", block).withColumn("bound", -F.pmod(F.col("block") - F.when(F.col("query_id") < 3000, 7).otherwise(F.pmod("query_id", F.lit(blocks))), F.lit(blocks)).cast("double"))
    homes = postings.PostingIndex.homes(bounds.withColumn("block", F.format_string("b%02d", "block"))).toPandas()
    assert sorted(homes.query_id) == list(range(n)) and set(homes.block[homes.query_id < 3000]) == {"b07"}
    sizes = homes.groupby(["group", "block"]).place.agg(["size", "nunique", "max"])
    assert len(sizes) <= blocks + n // postings.GROUP and (sizes["size"] == sizes["nunique"]).all() and (sizes["max"] + 1 == sizes["size"]).all()
    assert sizes["size"].max() < 1.5 * postings.GROUP


def test_memory_of_scores():
    """A strip of queries against a full block, with words in common and rare ones: some matrices, however many terms there are."""
    import tracemalloc

    rng, n, m, terms = np.random.default_rng(3), 512, 4096, 3000
    count = np.where(np.arange(terms) < 300, 2000, 40)
    begin, chunk = np.cumsum(count) - count, np.concatenate([rng.choice(m, c, replace=False) for c in count]).astype(np.int32)
    impact, asks = rng.random(len(chunk)), rng.random((terms, n)) < np.where(np.arange(terms) < 300, 0.3, 0.02)[:, None]
    term, row = (x.astype(np.int32) for x in np.nonzero(asks))
    w = rng.random(len(term))
    tracemalloc.start()
    got = postings.products(row, term, w, begin, count, chunk, impact, (n, m))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    q, c = np.zeros((terms, n)), np.zeros((terms, m))
    q[term, row], c[np.repeat(np.arange(terms), count), chunk] = w, impact
    assert np.abs(got - q.T @ c).max() < 1e-6
    assert peak < 3 * got.nbytes


def test_a_part_comes_once(spark, vectors, monkeypatch):
    """However many queries ask for a part, its vectors are in one row, before theirs."""
    monkeypatch.setattr(vectorindex, "PART", 50)
    monkeypatch.setattr(vectorindex, "GROUP", 16)
    points = spark.createDataFrame([r[:2] for r in vectors], "chunk_id long, embedding array<double>").repartition(3)
    index = vectorindex.temporary(points)
    queries = points.where("size(embedding) = 16").select(F.col("chunk_id").alias("query_id"), F.lit(None).cast("date").alias("cutoff"), "embedding", F.lit(-2.0).alias("theta"))
    parts = index.parts().count()
    rows = [[r.vectors is not None for r in p] for p in index.met(index._pairs(queries, 10**6, True)).rdd.glom().collect()]
    assert sum(map(sum, rows)) == parts and all(p[0] for p in rows if p) and sum(len(p) - sum(p) for p in rows) > 800 * parts
    got = {(r.query_id, r.chunk_id, r.rank) for r in index.search(queries.drop("theta"), 3).collect()}
    unit = {c: np.array(v) / np.linalg.norm(v) for c, v in (r[:2] for r in vectors) if v and None not in v and len(v) == 16 and any(v)}
    ids = sorted(unit)
    scores = np.round(np.array([unit[i] for i in ids]) @ np.array([unit[i] for i in ids]).T, 9)
    want = {(ids[q], ids[c], r) for q in range(len(ids)) for r, c in enumerate(np.lexsort((np.arange(len(ids)), -scores[q]))[:3], 1)}
    assert len(got) == len(want) and len(got & want) > 0.99 * len(want)


def test_no_row_is_a_pair_of_a_query_and_a_block(spark, texts, monkeypatch):
    """A search makes no table of bounds by query and block; a strip comes once for each tray, a block once for each group."""
    for name, value in (("BLOCK", 10), ("ASKED", 30), ("GROUP", 8), ("TRAY", 4), ("FIRST", 5), ("MORE", 3)):
        monkeypatch.setattr(postings, name, value)
    points = spark.createDataFrame(texts, "chunk_id long, text string").repartitionByRange(3, "chunk_id")
    asked = [(i, t, None) for i, t in texts if i % 8 == 0]
    queries = spark.createDataFrame([x[:2] for x in asked], "query_id int, text string")
    seen = []

    def pair_by_pair(*_):
        raise AssertionError("a row for each query and block")

    def met(strips, blocks, groups, trays, made=postings.PostingIndex.met):
        rows = made(strips, blocks, groups, trays)
        parts = [[r.block for r in p] for p in rows.select("block").rdd.glom().collect()]
        n = blocks.count()
        seen.append(n)
        assert sum(map(len, parts)) == strips.count() * trays + n * groups and groups > 1
        assert all(p == sorted(p, key=lambda b: b is not None) for p in parts)
        return rows

    monkeypatch.setattr(postings.PostingIndex, "bounds", pair_by_pair)
    monkeypatch.setattr(postings.PostingIndex, "met", staticmethod(met))
    index = postings.temporary(points)
    got = [tuple(r) for r in index.search(queries, 7).collect()]
    near = lambda rows: {(q, c, round(s, 4)) for q, c, s, _ in rows}
    assert near(got) == near(bm25(texts, asked, 7)) and len(got) > 500
    assert len(seen) > 2 and sum(seen) == index.blocks().count() >= 70  # all blocks, each in one wave


def test_scores_in_the_order_of_queries():
    """Pairs are added query by query, whatever runs and strips they fall in."""
    rng, n, m, terms = np.random.default_rng(4), 130, 90, 400
    count = rng.integers(1, 30, terms)
    begin, chunk = np.cumsum(count) - count, np.concatenate([rng.choice(m, c, replace=False) for c in count]).astype(np.uint16)
    impact, asks = rng.random(len(chunk)), rng.random((terms, n)) < 0.05
    term, row = (x.astype(np.int32) for x in np.nonzero(asks))
    w = rng.random(len(term))
    q, c = np.zeros((terms, n)), np.zeros((terms, m))
    q[term, row], c[np.repeat(np.arange(terms), count), chunk] = w, impact
    for pairs, sparse in ((50, 0), (10**6, 0), (1000, 100)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(postings, "PAIRS", pairs)
            patch.setattr(postings, "SPARSE", sparse)
            assert np.abs(postings.products(row, term, w, begin, count, chunk, impact, (n, m)) - q.T @ c).max() < 1e-6


def test_a_ranked_search_needs_no_postings_by_term(spark, texts):
    """They are written for the first word search, of all additions."""
    import os

    points = spark.createDataFrame(texts, "chunk_id long, text string")
    root = f"{spark.conf.get('spark.checkpoint.dir')}/postings-lazy-{random.random()}"
    postings.append(points.where("chunk_id < 300"), root, "a", sharded=False)
    index = postings.append(points.where("chunk_id >= 300"), root, "b", sharded=False)
    asked = [(i, t, None) for i, t in texts if i % 50 == 0]
    got = [tuple(r) for r in index.search(spark.createDataFrame([x[:2] for x in asked], "query_id int, text string"), 5).collect()]
    assert {x[:2] for x in got} == {x[:2] for x in bm25(texts, asked, 5)}
    assert not os.path.exists(f"{root.removeprefix('file://')}/index")
    for words in (["the"], ["t3x1", "t4x1"], ["t9x2", "the"]):
        assert sorted(r.chunk_id for r in index.holding(words).collect()) == [i for i, t in texts if set(words) <= set(postings.words(t))]


def test_texts_are_not_shuffled_for_their_index(spark, sf, tmp_path):
    """No join with the vectors, unless one of their ids repeats: then a text counts as often as it does in ``points``."""
    from siltstone.plans import bindings

    rows = bindings.texts(spark, sf)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    of = lambda df, c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert of(rows, rows.columns) == of(bindings.points(spark, sf), rows.columns)
    vectors = bindings.table(spark, sf, "embeddings")
    vectors.unionByName(vectors.where("vec_id = 3")).write.parquet(f"{tmp_path}/embeddings.parquet")
    bindings.table(spark, sf, "documents").write.parquet(f"{tmp_path}/documents.parquet")
    assert bindings.texts(spark, str(tmp_path)).where("chunk_id = 3").count() == 2
