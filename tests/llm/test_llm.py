"""The ten operators against brute force, the library, exact round trips and held-out labels, and on odd tables."""

import hashlib
import math
import random
import shutil
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from siltstone.llm import bpe, components, idstore, jpeg, mixing, neardup, quality, queries, rules, substrings, toxicity, unigram

PASSAGE = "".join(random.Random(9).choice("abcdefghij klmnop qrst") for _ in range(700))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, component_id int, row string, rate double, items string, h string, id string"


def odd_rows():
    """Nulls, empties, ties, repeated rows, long and strange texts, columns whose names the operators use inside."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(30_000))
    near = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n\t ", "one", "One", "two words", "a" * 5000, "x" + PASSAGE + "left", "right" + PASSAGE + "y", long, " ".join(near), " ".join(near[:58] + ["other", "end"]),
             " ".join(near), "  runs   of \n \n white　space ", "<|endoftext|> in <|endoftext|>", "naïve 日本語 😀 ​\u0085", "tail\n", "!!! *** ### |||"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src0", len(t or ""), "x", i, "r", 0.5, "i", "h", "d") for i, t in enumerate(texts)]
    return [*rows, rows[10], rows[7], (None, "no id", None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(18)] + [(3, None, 1), (None, 1, 1), (4, 0, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_unigram_brute_force():
    scores = unigram.piece_scores(unigram.Vocabulary(bpe.tokenizer_bytes()))
    forward, trie = unigram.Forward(scores), unigram.Trie(scores)
    words = sorted({w.encode() for w in ["the", " there", " therefore", "zzzz", " naïve", "日本", "a" * 40, " international", " internationally"]})
    for w in words:
        alpha, best, count = [0.0], [0.0], [0]
        for j in range(1, len(w) + 1):
            found = [(i, scores[w[i:j]]) for i in range(j) if w[i:j] in scores]
            alpha.append(math.log(sum(math.exp(alpha[i] + s) for i, s in found)))
            top = max(best[i] + s for i, s in found)
            count.append(min(count[i] + 1 for i, s in found if best[i] + s == top))
            best.append(top)
        for n, log in (forward.visit(w), next(zip(*trie.walk([w]), strict=True))):
            assert n == count[-1] and abs(log - alpha[-1]) < 1e-9 * abs(alpha[-1]) + 1e-9
    tokens, logs = trie.walk(words)  # all in one trie: the same as alone
    assert [(n, x) for n, x in zip(tokens, logs, strict=True)] == [next(zip(*trie.walk([w]), strict=True)) for w in words]


def test_unigram_long_pieces():
    """Every piece of the vocabulary is in the model, however long; the search is over all starts."""
    vocabulary = unigram.Vocabulary(bpe.tokenizer_bytes())
    scores = unigram.piece_scores(vocabulary)
    assert set(scores) == {s for i, s in enumerate(vocabulary.strings) if s and i not in vocabulary.special.values()}
    long = sorted(s for s in scores if len(s) > 16)
    assert b" responsibilities" in long and b"-" * 64 in long
    forward, trie = unigram.Forward(scores), unigram.Trie(scores)
    for w in sorted([*long, *(s + b"s" for s in long)]):
        alpha, best, count = [0.0], [0.0], [0]
        for j in range(1, len(w) + 1):
            found = [(i, scores[w[i:j]]) for i in range(j) if w[i:j] in scores]
            high = max(alpha[i] + s for i, s in found)
            alpha.append(high + math.log(sum(math.exp(alpha[i] + s - high) for i, s in found)))
            top = max(best[i] + s for i, s in found)
            count.append(min(count[i] + 1 for i, s in found if best[i] + s == top))
            best.append(top)
        for n, log in (forward.visit(w), next(zip(*trie.walk([w]), strict=True))):
            assert n == count[-1] and abs(log - alpha[-1]) < 1e-9 * abs(alpha[-1])
    assert forward.visit(b" responsibilities")[0] == 1 and forward.visit(b"-" * 64)[0] == 1


def test_token_counts_odd(spark, odd, empty):
    got = by_id(unigram.token_counts(spark, odd))
    assert unigram.token_counts(spark, odd).count() == odd.count() and unigram.token_counts(spark, empty).count() == 0
    assert (got[0].n_tokens, got[0].log_forward) == (0, 0.0) and got[1].n_pretokens == 0
    assert got[10] == got[12].__class__(10, *got[12][1:])
    scores = unigram.Scores(unigram.tokenizer_bytes(), limit=5)  # a memo that is emptied all the time changes nothing
    walk = unigram.Forward(unigram.piece_scores(unigram.Vocabulary(unigram.tokenizer_bytes())))
    for doc_id, text, *_ in odd_rows()[:-1]:
        [pretokens], [tokens], [log] = scores.totals([text or ""])
        assert (pretokens, tokens) == (got[doc_id].n_pretokens, got[doc_id].n_tokens) and math.isclose(log, got[doc_id].log_forward, rel_tol=1e-12)
        words = unigram.PATTERN.findall(text or "")
        each = {w: walk.visit(w.encode()) for w in sorted(set(words))}
        assert pretokens == len(words) and tokens == sum(each[w][0] for w in words) and math.isclose(log, sum(each[w][1] for w in words), rel_tol=1e-9)


def test_terminal_counts(spark, odd, empty):
    rows = unigram.terminal_counts(spark, odd).collect()
    want = Counter(w for _, t, *_ in odd_rows() for w in unigram.PATTERN.findall(t or ""))
    assert {r.pretoken: r.occurrences for r in rows} == want and unigram.terminal_counts(spark, empty).count() == 0
    totals = unigram.token_counts(spark, odd).agg(F.sum("n_tokens"), F.sum("log_forward")).first()
    assert totals[0] == sum(r.occurrences * r.n_tokens for r in rows) and math.isclose(totals[1], sum(r.occurrences * r.log_forward for r in rows), rel_tol=1e-9)


# 2


def test_rules_odd(spark, odd, empty):
    rows = rules.apply_policy(rules.ledger(odd))
    got = by_id(rows)
    assert rows.count() == odd.count() and rules.ledger(empty).count() == 0
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and not got[0].kept and got[9].n_words == 30_000 and got[9].kept
    raw = b"a b c d e f a b c d e g\nl\nl\n\nl"
    spans = rules.measure(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert spans["n_repeat_words"][0] == 10 and spans["n_dup_lines"][0] == 2
    kept = rules.kept_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v.kept}
    table = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(rows).collect()}
    assert table["few_words"][0] == sum(1 for r in rows.collect() if r.failures & 1)
    assert rules.apply_policy(rules.ledger(odd), "base").where("kept").count() >= rows.where("kept").count()


# 3


def test_mixing_meets_targets(spark, sf):
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = {"1": 0.8, "0": 0.2}
    rates = mixing.mixing_rates(spark, docs, lab, want)
    stats, names = mixing.posteriors(mixing.statistics(docs), lab)
    p = {r.doc_id: np.array(r.p) for r in stats.collect()}
    rows = rates.collect()
    total = sum(r.rate * r.n_tokens * p[r.doc_id] for r in rows)
    tokens = sum(r.n_tokens for r in rows)
    assert np.allclose(total / tokens, [want[n] for n in names], atol=1e-4) and min(r.rate for r in rows) >= 0
    # the same projected steps in numpy
    n, a = np.array([r.n_tokens for r in rows], float), np.stack([p[r.doc_id] for r in rows])
    g, r, t = (a * n[:, None]).T @ a + np.eye(2) * tokens * mixing.RIDGE, np.ones(len(rows)), np.array([want[x] for x in names]) * tokens
    for _ in range(mixing.STEPS):
        r = np.maximum(0, r - a @ np.linalg.solve(g, (a * (n * r)[:, None]).sum(0) - t))
    assert np.allclose(r, [x.rate for x in rows], atol=1e-5)


def test_mixing_rare_domain(spark):
    """A domain of two short documents in 2,000 gets its whole target; one without labelled documents is left out."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join("###$$$" if i < 2 else word() for _ in range(5 if i < 2 else rng.randrange(30, 90)))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i >= 2)) for i in range(200)], "doc_id long, quality int")
    for keep in (None, "1"):
        for r in mixing.misses(spark, docs, lab, keep=keep).collect():
            assert abs(r.have - r.want) <= 1e-5 * r.want
    rates = mixing.mixing_rates(spark, docs, lab, keep="1").collect()
    dirty = sum(r.rate * r.n_tokens * (r.posterior if r.domain == "0" else 1 - r.posterior) for r in rates)
    assert abs(dirty / sum(r.rate * r.n_tokens for r in rates) - 0.03) < 1e-5
    got = {r.domain: r for r in mixing.misses(spark, docs.where("doc_id >= 2"), lab, {"1": 0.5, "0": 0.5}).collect()}
    assert set(got) == {"1"} and abs(got["1"].have - got["1"].want) <= 1e-5 * got["1"].want


def test_mixing_under_a_bound(spark):
    """A domain that is too large is lowered to its target; one that is too small stays whole, and takes nothing from the others."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    for dirty in (20, 400):  # of 1,000; the target is 3 %
        rows = [(i, " ".join("###$$$" if i < dirty else word() for _ in range(rng.randrange(30, 90)))) for i in range(1000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        lab = spark.createDataFrame([(i, int(i >= dirty)) for i in range(0, 1000, 5)], "doc_id long, quality int")
        rates = {r.doc_id: r.rate for r in mixing.mixing_rates(spark, docs, lab, keep="1", most=1.0).collect()}
        got = [r.doc_id for r in mixing.mixed(spark, docs, lab, keep="1", most=1.0).collect()]
        missed = {r.domain: (r.want, r.have) for r in mixing.misses(spark, docs, lab, keep="1", most=1.0).collect()}
        assert max(rates.values()) <= 1 and len(got) == len(set(got)) and set(range(dirty, 1000)) <= set(got)
        want, have = missed["0"]
        if dirty == 20:
            assert set(rates.values()) == {1.0} and len(got) == 1000 and have < want
        else:
            assert abs(have - want) < 0.01 * want and len(set(got) & set(range(dirty))) < 0.3 * dirty


def test_mixing_odd(spark, odd, empty, labels):
    rates = mixing.mixing_rates(spark, odd, labels)
    assert rates.count() == odd.count() and rates.where("rate is null or rate < 0").count() == 0
    assert mixing.mixing_rates(spark, empty, labels).count() == 0
    none = labels.limit(0)
    assert {r.rate for r in mixing.mixing_rates(spark, odd, none).collect()} == {1.0}
    assert mixing.mixed(spark, odd, none).count() == odd.count() and mixing.mixed(spark, odd, labels).columns == odd.columns
    plan = mixing.mixing_rates(spark, odd, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 4


def brute_components(rows, size, threshold=80):
    def shingle(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
        return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()

    ids = [(i, shingle(t)) for i, t in rows]
    parent = {i: i for i, _ in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(ids):
        for b, y in ids[k + 1 :]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, sf, size):
    rng = random.Random(size)
    base = [f"t{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(120):  # one large group of near copies, of many degrees
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(80)] = f"z{rng.randrange(9)}"
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150).collect()]
    got = by_id(neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), size=size))
    want = brute_components(rows, size)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


@pytest.mark.parametrize("cell", [neardup.CELL, 700])
def test_near_duplicates_family(spark, monkeypatch, cell):
    """3,000 texts of one template, 0.78 alike, of which 100 pairs are 0.816 alike."""
    monkeypatch.setattr(neardup, "CELL", cell)
    rows = []
    for i in range(3000):
        own = [f"o{i}x{k}" for k in range(11)]
        if 200 > i >= 100:
            own[:2] = [f"o{i - 100}x{k}" for k in range(2)]
        rows.append((i, " ".join([f"t{k}" for k in range(78)] + own)))
    random.Random(1).shuffle(rows)
    got = by_id(neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), size=1))
    assert {k: r.component_id for k, r in got.items()} == {i: i - 100 if 200 > i >= 100 else i for i in range(3000)}


def test_near_duplicates_odd(spark, odd, empty):
    out = neardup.near_duplicates(spark, odd, size=2)
    assert out.count() == odd.where("doc_id is not null").count() and neardup.near_duplicates(spark, empty).count() == 0
    got = by_id(out)
    assert got[0].n_shingles == got[2].n_shingles == 0 and got[0].kept and got[2].component_id == 2
    assert got[4].component_id == 3 and got[12].component_id == 10 and got[11].component_id == 10 and got[5].kept


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 7), (5, 5), (9, 7)]
    got = {r.id: r.component for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 7: 5, 9: 5}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# 5 and 8


@pytest.mark.parametrize("score,column,least", [(quality.quality_scores, "quality", 0.97), (toxicity.toxicity_scores, "toxic", 0.9)])
def test_held_out_accuracy(spark, score, column, least):
    d = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    out = score(spark, spark.read.parquet(f"{d}/documents.parquet"), lab).cache()
    rows = out.join(lab, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[column] for r in rows) / len(rows) >= least
    bad = out.where(f"held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0) or score < 0 or score > 1")
    assert bad.count() == 0


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_odd(spark, odd, empty, labels, score):
    for lab in (labels, labels.limit(0), labels.where("quality = 1 and toxic = 0")):
        rows = score(spark, odd, lab).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert score(spark, empty, labels).count() == 0


def test_quality_brute_force(spark, sf):
    """The fitted map, weights, steps and scores against one dense solve over the training rows."""
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    y = {r.doc_id: r.quality for r in lab.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    stats = {i: quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for i, t in texts.items()}
    ids = sorted(set(y) & set(texts))
    x, want = np.stack([stats[i] for i in ids]), np.array([float(y[i]) for i in ids])
    model = quality.Model(x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0))
    f = model.features(x)
    model.weights = np.linalg.solve(f.T @ f + quality.RIDGE * len(ids) * np.eye(f.shape[1]) / f.shape[1], f.T @ want)
    raw = model.raw(x)
    bins = np.minimum(((raw + 0.5) / 2 * quality.BINS).astype(int), quality.BINS - 1)
    groups = [np.flatnonzero(bins == b) for b in sorted(set(bins.tolist()))]
    model.knots, model.levels = quality.isotonic(np.array([raw[g].mean() for g in groups]), np.array([(want[g].sum() + want.mean() * 0.02) / (len(g) + 0.02) for g in groups]), np.array([float(len(g)) for g in groups]))
    got = by_id(quality.quality_scores(spark, docs, lab))
    assert max(abs(got[i].score - float(model.score(stats[i][None, :])[0])) for i in texts) < 1e-6


def test_toxicity_brute_force(spark):
    """Counts, ratios, features and scores against dictionaries of n-grams and a dense matrix; held-out labels have no effect."""
    rng = random.Random(6)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randrange(3, 7)))
    rows = [(i, " ".join([word("abcde") for _ in range(12)] + [rng.choice(["vile grub", "nasty worm"])] * (3 * (i % 3 == 0))).title()) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    grams = {i: [t.lower().encode()[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)] for i, t in rows}

    def bucket(g):
        return int([b for b, _ in toxicity.buckets(np.frombuffer(g, np.uint8), np.array([0, len(g)]))][-1][0])

    number = {g: bucket(g) for g in {g for x in grams.values() for g in x}}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    count = np.zeros((2, toxicity.BUCKETS))
    for i in train:
        for g in grams[i]:
            count[int(i % 3 == 0), number[g]] += 1
    r, kept = toxicity.ratios(count[1], count[0])
    p, q = count[1] + 1, count[0] + 1
    assert len(kept) > 5 and np.allclose(r, np.log(p / p.sum()) - np.log(q / q.sum()))
    dense = np.array([[float(k in {number[g] for g in grams[i]}) for k in kept] for i, _ in rows]) * r[kept]
    y = np.array([float(i % 3 == 0) for i in train])
    at_, feature = np.nonzero(dense[train])
    w, b = toxicity.logistic(at_, feature, dense[train][at_, feature], y, np.ones(len(train)), len(kept))
    want = 1 / (1 + np.exp(-(dense @ w + b)))
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for labels in (lab, flipped):
        got = by_id(toxicity.toxicity_scores(spark, docs, labels))
        assert max(abs(got[i].score - want[i]) for i, _ in rows) < 1e-6


def test_isotonic():
    knots, levels = quality.isotonic(np.arange(6.0), np.array([0.1, 0.4, 0.2, 0.2, 0.9, 0.8]), np.ones(6))
    assert (np.diff(levels) > 0).all() and np.allclose(levels, [0.1, 0.8 / 3, 0.85]) and np.allclose(knots, [0, 2, 4.5])


# 6


def test_store_round_trip(spark, odd, empty, library, tmp_path):
    path = f"file://{tmp_path}/store"
    manifest = idstore.write_store(spark, odd, path)
    rows = sorted(idstore.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))] and all(r.verified for r in rows)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in rows] == sorted(-1 if x[0] is None else x[0] for x in odd_rows())
    texts = {x[0]: x[1] or "" for x in odd_rows()}
    for r in rows:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, idstore.END_ID]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    chunks = spark.read.parquet(f"{path}/objects/kind=chunk")
    assert chunks.count() == chunks.select("address").distinct().count() and sum(m.n_docs for m in manifest.collect()) == len(rows)
    idstore.write_store(spark, empty, f"{path}-empty")
    assert idstore.read_store(spark, f"{path}-empty").count() == 0


def test_store_roots(spark, odd, tmp_path):
    """Chunks in another order, and another root in the manifest, are not verified."""
    path = f"{tmp_path}/store"
    idstore.write_store(spark, odd, f"file://{path}")
    swapped = spark.read.parquet(f"file://{path}/recipes").withColumn("body", F.expr("if(doc_id = 9, concat(substring(body, 37, 36), substring(body, 1, 36), substring(body, 73)), body)"))
    shutil.copytree(path, f"{path}-swapped")
    swapped.write.mode("overwrite").parquet(f"file://{path}-swapped/recipes")
    assert not by_id(idstore.read_store(spark, f"file://{path}-swapped"))[9].verified
    shutil.copytree(path, f"{path}-root")
    spark.read.parquet(f"file://{path}/manifest").withColumn("root", F.reverse("root")).write.mode("overwrite").parquet(f"file://{path}-root/manifest")
    rows = idstore.read_store(spark, f"file://{path}-root").collect()
    assert len(rows) == len(odd_rows()) and not any(r.verified for r in rows)


def test_shard_roots(spark):
    """The tree against a loop over levels; the order of documents counts."""
    sizes = {0: 1, 1: 512, 2: 513, 3: 1300}
    leaves = {s: [hashlib.sha256(f"{s}.{i}".encode()).hexdigest().upper() for i in range(n)] for s, n in sizes.items()}
    rows = [(s, (s << 33) + i, bytes.fromhex(x)) for s, xs in leaves.items() for i, x in enumerate(xs)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "shard int, pos long, root binary").repartition(5)

    def tree(level):
        for _ in range(idstore.LEVELS):
            level = [hashlib.sha256("".join(level[i : i + 512]).encode()).hexdigest() for i in range(0, len(level), 512)]
        return level

    assert sorted((r.shard, [r.tree]) for r in idstore.shard_roots(df).collect()) == [(s, tree(x)) for s, x in leaves.items()]
    swapped = df.withColumn("pos", F.expr("if(shard = 3 and pos & 8589934591 < 2, pos ^ 1, pos)"))
    assert {r.shard: r.tree for r in idstore.shard_roots(swapped).collect()}[3] != tree(leaves[3])[0]


def test_chunks_and_crc():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(0, 50_000, 20_000), rng.integers(0, 50_000, 777), rng.integers(0, 50_000, 333)
    cut = lambda x: idstore.cuts(idstore.marks_of(x).tolist(), len(x))
    parts = lambda x: {x[i:j].tobytes() for i, j in zip([0, *cut(x)], cut(x), strict=False)}
    assert len(parts(np.concatenate([b, a])) & parts(np.concatenate([c, a]))) > 20
    assert cut(np.zeros(10_000, np.int64))[-1] == 10_000
    x, y = b"some bytes", b"and some more of them"
    t = idstore._shift_tables()
    assert int(idstore.shift_crc(np.array([zlib.crc32(x)]), np.array([len(y)]), t)[0]) ^ zlib.crc32(y) == zlib.crc32(x + y)
    wide = np.array([1, 70_000], np.uint32)
    assert (idstore.unpack(idstore.pack(wide)) == wide).all()


# 7


def brute_substrings(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("small", [8192, 8, 1])
def test_substrings(spark, monkeypatch, small):
    monkeypatch.setattr(substrings, "SMALL", small)
    rng = random.Random(small)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(30, 120))) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(0, 60))) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[: rng.randrange(120)] + parts[2])
    texts += ["a" * 300, "ab" * 90, "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(substrings.repeated_substrings(spark, df, length=50, passage=37))
    want = brute_substrings([t.encode() for t in texts], 50)
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == want
    assert [got[i].n_passage_bytes for i in range(len(texts))] == [x[1] for x in brute_substrings([t.encode() for t in texts], 37)]


def test_refined_is_a_suffix_sort():
    rng = random.Random(5)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 90))) for _ in range(60)] + [b"a" * 70, b"a" * 45]
    for length in (1, 7, 32, 40):
        seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        owner, inner = substrings.refined(bodies, length)
        want = {(k, i) for k, b in enumerate(bodies) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1}
        assert set(zip(owner.tolist(), inner.tolist(), strict=True)) == want


def test_substrings_odd(spark, odd, empty):
    out = substrings.repeated_substrings(spark, odd, keep_rows=True)
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and substrings.repeated_substrings(spark, empty).count() == 0
    want = dict(zip([x[0] for x in odd_rows()], brute_substrings([(x[1] or "").encode() for x in odd_rows()], 400), strict=True))
    assert all(tuple(r)[1:5] == want[r.doc_id] and len(r.row.text.encode()) == r.n_bytes - r.n_removed for r in rows)


# 9


def test_bpe_is_the_library(spark, odd, empty, library):
    out = bpe.bpe_encode(spark, odd, keep_ids=True)
    texts = {x[0]: x[1] or "" for x in odd_rows()}
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and bpe.bpe_encode(spark, empty).count() == 0
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_bpe_random(library):
    codec, encoder, rng = bpe.Codec(bpe.tokenizer_bytes(), limit=50), idstore.LibraryIds(bpe.tokenizer_bytes(), limit=50), random.Random(2)
    for _ in range(150):
        texts = ["".join(rng.choice(" \n\t ab'sé1.!$　 日<|​XY") for _ in range(rng.randrange(50))) for _ in range(10)]
        texts[3] += "<|endoftext|> x"
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        for maker in (codec, encoder):
            flat, ends = maker.encode(texts)
            assert [flat[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)] == want
        assert [codec.decode(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]


# 10


def test_jpeg_round_trip(spark, odd, empty):
    rows = jpeg.media_columns(odd, keep_media=True).collect()
    texts = {x[0]: (x[1] or "").encode() for x in odd_rows()}
    assert len(rows) == len(odd_rows()) and jpeg.media_columns(empty).count() == 0
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b"\0" * (max(-(-len(raw) // 64), 1) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media[:2] == b"\xff\xd8" and r.media[-2:] == b"\xff\xd9"
        assert len(r.thumbnail) == (r.width // 8) * (r.height // 8)


def test_jpeg_general_codes():
    """A scan with variable lengths, runs, ends of block and no restart interval."""
    dc = jpeg._segment(0xC4, bytes([0x00]) + bytes([0, 2] + [0] * 14) + bytes([0, 3]))  # 00: 0, 01: 3
    ac = jpeg._segment(0xC4, bytes([0x10]) + bytes([0, 3] + [0] * 14) + bytes([0x00, 0x02, 0x23]))  # 00: end, 01: size 2, 10: run 2 size 3
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([8] * 64)) + dc + ac + jpeg._segment(0xC0, struct.pack(">BHHB", 8, 8, 16, 1) + b"\x01\x11\x00") + jpeg._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    bits = "01" + "101" + "01" + "10" + "10" + "011" + "00" + "01" + "010" + "00"  # dc 5, ac 2, skip 2, ac -4, end; dc 5-5, end
    bits += "1" * (-len(bits) % 8)
    raw = head + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"
    [(frame, c)] = jpeg.decode_batch([raw])
    assert c[0, :6].tolist() == [5, 2, 0, 0, -4, 0] and c[1].tolist() == [0] * 64
    assert jpeg.thumbnail(frame, c).tolist() == [[133, 128]]


# pipeline and registry


def test_pipeline_odd(spark, odd, empty, labels, tmp_path):
    d = f"file://{tmp_path}"
    labels.write.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, d)
            rows = out.collect()
            assert name == "bpe" or out.columns == odd.columns
            assert docs is odd or not rows
    deduped = [r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, d).collect()]
    assert len(deduped) == len(set(deduped)) and 10 in deduped and 12 not in deduped
    mixed = [r.doc_id for r in corpus_pipeline.mixing(spark, odd.where("doc_id is not null").dropDuplicates(["doc_id"]), d).collect()]
    assert len(mixed) == len(set(mixed))


def test_pipeline_row_of_a_clashing_id(spark):
    """Always the same one: the smallest text, then the smallest rest."""
    rows = [(7, "b b b b b b", "en", 1), (7, "a a a a a a", "de", 2), (7, "a a a a a a", "de", 1), (8, "c", None, 0), (8, None, "en", 3)]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(order, "doc_id long, text string, lang string, n_chars long").repartition(3), "")
        assert sorted(map(tuple, got.collect())) == [(7, "a a a a a a", "de", 1), (8, None, "en", 3)]


def test_pipeline_substrings(spark):
    """Passages of 51 to 60 words that documents share go; what is between them, and other documents, stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    run = lambda n: " ".join(word() for _ in range(n))
    passages = [run(51 + k) for k in range(10)]
    shared = [f"{run(80)} {passages[i % 10]} {run(70)}" for i in range(30)]
    clean = [run(rng.randrange(20, 200)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(shared + clean)], "doc_id long, text string, n_chars long")
    got = by_id(corpus_pipeline.substrings(spark, docs, ""))
    for i, t in enumerate(shared + clean):
        left = got[i].text
        assert got[i].n_chars == len(left)
        assert left == t if i >= 30 else len(t) - len(left) >= len(passages[i % 10]) and not any(p[20:-20] in left for p in passages) and left[:300] == t[:300]


def test_pipeline_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.rules(spark, docs, sf).collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(docs, "doc_id").where("size(split(text, ' ')) > 20").collect()}
    assert len(clean - kept) <= 0.02 * len(clean)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)  # no document stands twice
    deduped = corpus_pipeline.near_dedup(spark, corpus_pipeline.rules(spark, docs, sf), sf)
    assert len(rows) >= 0.97 * deduped.count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want.select(*cols).fetchall(), key=str)
