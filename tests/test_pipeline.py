"""Prompts, models, the query pipeline, ingest, evaluation, files and settings."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import __main__ as cli
from siltstone.config import Config
from siltstone.functions import prompts
from siltstone.functions.hashing import response_key
from siltstone.operators import evaluate, models, reports
from siltstone.operators.budget import Budget, BudgetExceeded, backoff, ledger, reserve_ceiling, retry_class
from siltstone.operators.chunks import spans
from siltstone.operators.commits import Commits
from siltstone.operators.ingest import TABLES, Corpus, MemoryCorpus, chunked, ingest, ingest_counts, observed, summarized
from siltstone.sources import files

CONFIG = Config(k_retrieve=6, n_synthesize=2, min_similarity=4.0, taxonomy={"sector": ("fin", "food")}, models={"facet": "f", "rerank": "r", "synthesize": "s", "consolidate": "c"})


def test_prompts(spark):
    df = spark.createDataFrame([("x", 1), ("y", None)], "a string, b int")
    assert df.where("b = 1").select(prompts.rendered("{{ a }}-{{b}}.", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "x-1."
    with pytest.raises(KeyError):
        prompts.rendered("{{ c }}", {"a": F.col("a")})
    with pytest.raises(Exception, match="undefined in template: b"):
        df.select(prompts.rendered("{{ b }}", {"b": F.col("b")})).collect()
    assert len({prompts.template_sha(n) for n in prompts.TEMPLATES}) == 7
    schema = prompts.strict_schema(T.StructType.fromDDL("a string, b array<struct<c: double>>"))
    assert schema["required"] == ["a", "b"] and schema["properties"]["b"]["items"]["additionalProperties"] is False


def test_models(spark, tmp_path):
    calls = spark.createDataFrame([("k1", "f", "m1", "", "p1"), ("k2", "f", "m2", "", "p2")], "key string, stage string, model string, system string, prompt string")
    table = spark.createDataFrame([("k1", "t1")], "key string, text string")
    assert models.Recorded(table).complete(calls.where("key = 'k1'")).first().text == "t1"
    with pytest.raises(Exception, match="no recorded answer for key k2"):
        models.Recorded(table).complete(calls).collect()
    say = models.Heuristic(lambda: F.upper("prompt"), 0.5)
    routed = models.Routed({"m1": say, "m2": models.Heuristic(lambda: F.lit("two"))})
    assert {r.key: r.text for r in routed.complete(calls).collect()} == {"k1": "P1", "k2": "two"}
    with pytest.raises(Exception, match="no completer for model m2"):
        models.Routed({"m1": say}).complete(calls).collect()
    record = models.Recording(routed, f"file://{tmp_path}/answers")
    for _ in range(2):
        assert record.complete(calls).count() == 2
    kept = spark.read.parquet(f"file://{tmp_path}/answers")
    assert kept.count() == 2 and models.Recorded(kept).complete(calls).count() == 2
    v = models.HashEmbedder(40).embed(spark.createDataFrame([("a",), (None,)], "text string")).collect()
    raw = hashlib.sha256(b"0:a").digest() + hashlib.sha256(b"1:a").digest()
    assert v[0].embedding == [b / 127.5 - 1.0 for b in raw[:40]] and len(v[1].embedding) == 40
    vectors = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(), [1.0])], "text_sha string, embedding array<double>")
    assert models.TableEmbedder(vectors).embed(spark.createDataFrame([("a",)], "text string")).first().embedding == [1.0]
    with pytest.raises(Exception, match="no vector for text"):
        models.TableEmbedder(vectors).embed(spark.createDataFrame([("b",)], "text string")).collect()


def _score(x, why="fits"):
    return {p: {"score": float(x), "rationale": f"[{why}](http://x)"} for p in reports.PERSPECTIVES}


def _world(spark):
    documents = spark.createDataFrame(
        [(i, f"Co{i}", f"sum{i}", f"body {i} had 10 users", "2015-03-01" if i % 2 else None, "2017-05-09" if i != 3 else None, [f"https://ok.example/{i}"]) for i in range(5)],
        "canonical_id long, name string, summary string, body string, founding string, failure string, sources array<string>",
    ).selectExpr("canonical_id", "name", "summary", "body", "to_date(founding) founding_date", "to_date(failure) failure_date", "sources")
    points = spark.createDataFrame([(i * 10, i, 0, f"text number{i} shop", [1.0, float(i)], "food", "eu") for i in range(5)], "chunk_id long, canonical_id long, chunk_idx long, text string, embedding array<double>, sector string, geography string")
    pitches = spark.createDataFrame([(1, "Pitch", "a ![i](u) shop", "shop number2", [1.0, 2.0]), (2, "Nothing", "else", "shop", [1.0, 0.5])], "query_id long, name string, description string, text string, embedding array<double>")
    return documents, points, pitches


class Fake:
    """Answers by stage from functions of the prompt, collected here: the batch is small."""

    def __init__(self, spark, by_model):
        self.spark, self.by_model = spark, by_model

    def complete(self, calls):
        rows = [(r.key, self.by_model[r.model](r.prompt), 0.01, None) for r in calls.dropDuplicates(["key"]).collect()]
        return self.spark.createDataFrame(rows, models.ANSWER)


def _fake(spark, least=0):
    def rank(prompt):
        ids = [x.split(":")[0] for x in prompt.split("Candidates:\n")[1].split("\n")]
        return json.dumps({"ranked": [{"candidate_id": i, **_score(5 if "shop\n" in prompt and int(i) > least else 1)} for i in ids[:2]]})

    def synth(prompt):
        i = prompt.split("Company ")[1].split(",")[0]
        if i == "4":
            return "not json"
        return json.dumps({"name": f"Co{i}", "one_liner": "one", "similarity": _score(6), "why_similar": "had 10 users", "where_diverged": "there", "failure_causes": ["x", "y"], "lessons": ["Do", " do ", "Not"]})

    risks = json.dumps({"risks": [{"summary": "low one", "applies_because": "b", "raised_by": ["1", "zz"], "severity": "low"}, {"summary": "high one", "applies_because": "b", "raised_by": ["2", "1", "3"], "severity": "high"}, {"summary": "gone", "applies_because": "b", "raised_by": ["zz"], "severity": "high"}], "injection": False})
    return Fake(spark, {"f": lambda p: json.dumps({"sector": "food", "geography": None}), "r": rank, "s": synth, "c": lambda p: risks})


def test_query_pipeline(spark):
    documents, points, pitches = _world(spark)
    out = reports.run_queries(pitches, points, documents, _fake(spark), CONFIG, "2024-01-01T00:00:00")
    counts = {r.query_id: r for r in out["counts"].collect()}
    found = {r.query_id: r.report for r in out["reports"].collect()}
    kept = [(r.query_id, r.candidate_id, r.lifespan_months) for r in out["syntheses"].orderBy("pos").collect()]
    assert len(kept) == len([k for k in kept if k[0] == 1]) and 1 <= len(kept) <= 2 and counts[2].filtered_pre == 2 and counts[1].filtered_pre == 0
    assert "# Report for Pitch\n\nPitch: a i shop\n\nGenerated: 2024-01-01" in found[1] and f"## Co{kept[0][1]}\n\none" in found[1] and "| market | 6.0 | fits |" in found[1]
    assert "No comparables passed similarity threshold 4.0. 2 candidate(s)" in found[2] and "## Top risks" not in found[2] and "http://x" not in found[1]
    risks = out["risks"].orderBy("rank").collect()
    ids = {k[1] for k in kept}
    assert all(set(r.raised_by) <= ids for r in risks) and all(r.summary != "gone" for r in risks)
    assert "- budget_exceeded: False" in found[1] and found[1].endswith("- synthesize: s")
    assert reports.debug_text(spark.createDataFrame([(1, 5, 0.5, 1), (1, 6, 0.25, 2)], "query_id long, canonical_id long, score double, rank long")).first().listing == "1. 5 0.500000\n2. 6 0.250000"


def test_pipeline_errors(spark):
    documents, points, pitches = _world(spark)
    short = _fake(spark)
    short.by_model["r"] = lambda p: json.dumps({"ranked": []})
    with pytest.raises(Exception, match="ranking of 0 for 2"):
        reports.run_queries(pitches, points, documents, short, CONFIG, "x")["syntheses"].collect()
    short.by_model["r"] = lambda p: json.dumps({"ranked": [{"candidate_id": i, **_score(5)} for i in ("1", "2", "3")]})
    with pytest.raises(Exception, match="ranking of 3 for 2"):  # no more than that, either
        reports.run_queries(pitches, points, documents, short, CONFIG, "x")["syntheses"].collect()
    foreign = _fake(spark)
    foreign.by_model["r"] = lambda p: json.dumps({"ranked": [{"candidate_id": i, **_score(5)} for i in ("77", "2")]})
    assert {r.candidate_id for r in reports.run_queries(pitches, points, documents, foreign, CONFIG, "x")["syntheses"].collect()} <= {"2", 2}
    facets = reports.extract_facets(pitches, ("sector", "geography"), _fake(spark), CONFIG).collect()
    assert {(r.sector, r.geography) for r in facets} == {("food", "other")}
    injected = _fake(spark)
    synth = injected.by_model["s"]
    injected.by_model["s"] = lambda p: synth(p).replace('"there"', '" prompt_injection_attempted "')
    out = reports.run_queries(pitches, points, documents, injected, CONFIG, "x")
    assert out["risks"].count() == 0 and out["syntheses"].where("injection").count() > 0


def test_ingest(spark, tmp_path):
    store = Corpus(spark, f"file://{tmp_path}/corpus")
    schema = "source string, source_id string, text string, canonical_id string"
    entries = spark.createDataFrame([("hn", "1", "first text", "a.example"), ("csv", "2", "second " + "word " * 900, "a.example"), ("hn", "3", "", "b.example"), ("hn", "4", "spam", "c.example"), ("cur", "5", "spam too", "d.example"), ("hn", "6", "lost", None)], schema)
    judged = spark.createDataFrame([("hn\x1f4", 0.9), ("cur\x1f5", 0.9)], "_key string, judged double")
    known = entries.select("source", "source_id", "canonical_id")
    run = lambda e, seq, **k: {(r.source, r.source_id): r.outcome for r in ingest(store, e, models.LabelClassifier(judged, "judged"), models.HashEmbedder(8), lambda d: d.drop("canonical_id").join(known, ["source", "source_id"], "left"), seq, "2024", ("cur",), **k).collect()}
    want = {("hn", "1"): "processed", ("csv", "2"): "processed", ("hn", "3"): "skipped_empty", ("hn", "4"): "quarantined", ("cur", "5"): "processed", ("hn", "6"): "failed"}
    assert run(entries, 1, dry_run=True) == want and store.table("journal").count() == 0
    assert run(entries, 1) == want
    assert run(entries, 1) == want  # the same batch again replaces itself
    assert store.table("journal").where("merge_state = 'complete'").count() == 3 and store.pending().count() == 0
    chunks = store.table("chunks").collect()
    assert sorted((c.canonical_id, c.chunk_idx) for c in chunks) == [("a.example", 0), ("a.example", 1), ("d.example", 0)] and len({c.point_id for c in chunks}) == 3
    assert store.table("canonical").where("canonical_id = 'a.example'").first().merged.startswith("## hn:1\n\nfirst text\n\n---\n\n## csv:2\n\nsecond")
    again = run(entries, 2)
    assert again[("hn", "1")] == "skipped" and again[("hn", "4")] == "quarantined" and run(entries, 3, force=True)[("hn", "1")] == "processed"
    shorter = entries.withColumn("text", F.when(F.col("source_id") == "2", "second now").otherwise(F.col("text")))
    assert run(shorter, 4)[("csv", "2")] == "processed" and store.table("chunks").where("canonical_id = 'a.example'").count() == 1
    assert [r.canonical_id for r in store.has_chunks(spark.createDataFrame([("a.example",), ("z",)], "canonical_id string")).collect()] == ["a.example"]
    store.delete_chunks(spark.createDataFrame([("a.example",), ("z",)], "canonical_id string"), 5)
    assert {r.canonical_id for r in store.table("chunks").collect()} == {"d.example"} and store.quarantined().count() == 1
    store.block_alias(spark.createDataFrame([("e.example", "hn", "9", "parent", "a.example", "x", 0.5)], "canonical_id string, source string, source_id string, alias_kind string, target string, evidence string, confidence double"), 6)
    store.stage("aliases", spark.createDataFrame([("f", "parent", "g")], "canonical_id string, alias_kind string, target string"), 7)  # its commit never came
    assert [r.target for r in store.aliases().collect()] == ["a.example"] and store.by_key("hn", "9").first().merge_state == "alias_blocked"
    for seq, pair in ((8, "b"), (9, "a"), (10, "b")):
        store.append("review", spark.createDataFrame([(pair, 0.7, "different")], "pair_key string, similarity double, decision string"), seq)
    assert [r.pair_key for r in store.pending_review().collect()] == ["b", "a"]
    # a batch of another writer with a number that ingest has used stands beside it
    before = {r.canonical_id: r.merge_state for r in store.table("journal").collect()}
    store.block_alias(spark.createDataFrame([("x.example", "hn", "10", "parent", "y.example", "x", 0.5)], "canonical_id string, source string, source_id string, alias_kind string, target string, evidence string, confidence double"), 4)
    after = {r.canonical_id: r.merge_state for r in store.table("journal").collect()}
    assert after == before | {"x.example": "alias_blocked"} and before["a.example"] == "complete"
    # compaction changes no table, and later batches go on from it
    state = lambda: {n: sorted(map(str, store.table(n).collect())) for n in TABLES}
    whole = state()
    store.compact()
    store.compact()
    assert state() == whole and [r.pair_key for r in store.pending_review().collect()] == ["b", "a"] and store.commits.snapshot()[1] == []
    with pytest.raises(ValueError, match="last one in the base"):
        store.append("review", spark.createDataFrame([("z", 0.7, "different")], "pair_key string, similarity double, decision string"), 4)
    assert run(shorter, 11)[("csv", "2")] == "skipped" and run(entries, 12)[("csv", "2")] == "processed" and store.table("chunks").where("canonical_id = 'a.example'").count() == 2
    store.delete_chunks(spark.createDataFrame([("a.example",)], "canonical_id string"), 13)
    whole = state()
    store.compact()
    assert state() == whole and {r.canonical_id for r in store.table("chunks").collect()} == {"d.example"}
    rows, watch = observed(spark.createDataFrame([("failed",), ("processed",)], "outcome string"), "n")
    rows.collect()
    assert watch.get["seen"] == 2 and watch.get["failed"] == 1 and ingest_counts(rows).first().processed == 1
    out = summarized(spark.createDataFrame([("1",), ("x",)], "t string"), lambda t: str(1 / int(t)), "t", "s").collect()
    assert (out[0].s, out[0].error) == ("1.0", None) and out[1].s is None and out[1].error.startswith("ValueError")
    memory = MemoryCorpus(spark)
    memory.append(("a", 0, "t"), ("b", 0, "t"))
    memory.delete_chunks("a")
    memory.delete_chunks("a")
    assert not memory.has_chunks("a") and memory.has_chunks("b") and memory.table().count() == 1


def test_ingest_stopped_anywhere(spark, tmp_path, monkeypatch):
    """After each write of a batch the tables are those before it, but for pending rows; run again, it is whole."""
    schema = "source string, source_id string, text string, canonical_id string"
    one = spark.createDataFrame([("hn", "1", "first text", "a.example")], schema)
    two = spark.createDataFrame([("hn", "1", "another text", "a.example"), ("csv", "2", "more", "a.example"), ("hn", "9", "spam", "c.example")], schema)
    judged = spark.createDataFrame([("hn\x1f9", 0.9)], "_key string, judged double")
    store = Corpus(spark, f"file://{tmp_path}/corpus")
    run = lambda e, seq: ingest(store, e, models.LabelClassifier(judged, "judged"), models.HashEmbedder(4), lambda d: d, seq, "2024")
    run(one, 1)
    state = lambda names: {n: sorted(map(str, store.table(n).collect())) for n in names}
    rest = [n for n in TABLES if n != "journal"]
    before, writes = state(rest), []
    original = Commits.stage

    class Stop(Exception):
        pass

    def stage(self, table, rows):
        out = original(self, table, rows)
        writes.append(table)
        if len(writes) == limit:
            raise Stop
        return out

    monkeypatch.setattr(Commits, "stage", stage)
    for limit in range(1, 7):
        writes.clear()
        with pytest.raises(Stop):
            run(two, 2)
        assert state(rest) == before and store.pending().count() == (0 if limit == 1 else 2)
    limit = 99
    run(two, 2)
    assert store.pending().count() == 0 and store.table("raw").count() == 2 and store.quarantined().count() == 1
    assert store.table("canonical").first().merged == "## hn:1\n\nanother text\n\n---\n\n## csv:2\n\nmore"


def test_evaluation(spark, tmp_path, capsys):
    syn = spark.createDataFrame([("r", "1", "there", "had 10 users", ["x"], 5, ["https://ok.example/1"]), ("r", "2", " \t", "had 99 users", [], -1, ["bad"]), ("r", "3", "x", None, None, None, [])], "row_id string, candidate_id string, where_diverged string, why_similar string, rationales array<string>, lifespan_months int, sources array<string>")
    bodies = spark.createDataFrame([("1", "it had 10 users"), ("2", "it had 10 users")], "candidate_id string, body string")
    checked = evaluate.assertions(syn, bodies, F.array(F.lit("ok.example")))
    got = {r.candidate_id: tuple(r)[2:] for r in checked.collect()}
    assert got == {"1": (True,) * 5, "2": (False,) * 5, "3": (True,) * 5} and evaluate.candidate_counts(checked).first().candidates_count == 3
    now = evaluate.results(checked)
    text = evaluate.baseline_json(now)
    assert json.loads(text)["rows"]["r"]["candidates_count"] == 3 and evaluate.read_baseline(spark, text).count() == 12 and evaluate.read_baseline(spark, "").count() == 0
    was = spark.createDataFrame([("r", "1", "lifespan_positive", False), ("r", "2", "sources_allowed", True), ("r", "8", "a", True), ("r", "8", "b", False), ("r", "9", "a", False)], "row_id string, candidate_id string, assertion string, ok boolean")
    changes = {(r.candidate_id, r.assertion): r.change for r in evaluate.diff(was, now).collect()}
    assert changes[("1", "lifespan_positive")] == "improvement" and changes[("2", "sources_allowed")] == "regression" and changes[("8", None)] == "regression" and changes[("3", None)] == "warning"
    assert ("9", None) not in changes and changes[("1", "claims_grounded")] == "warning" and evaluate.exit_code(evaluate.diff(now, now)) == 0
    with pytest.raises(ValueError, match="twice: r"):
        evaluate.check_dataset(syn)
    with pytest.raises(ValueError, match="no row q"):
        evaluate.check_dataset(syn.limit(1), scope="q")
    now.write.parquet(f"file://{tmp_path}/results")
    args = ["replay", "--results", f"file://{tmp_path}/results", "--baseline", str(tmp_path / "b.json")]
    assert cli.main([*args, "--write-baseline"]) == 0 and cli.main(args) == 0
    worse = json.loads((tmp_path / "b.json").read_text())
    worse["rows"]["r"]["assertions"]["2"]["sources_allowed"] = True
    (tmp_path / "b.json").write_text(json.dumps(worse))
    assert cli.main(args) == 1 and "REGRESSION r 2 sources_allowed" in capsys.readouterr().out and cli.main([*args, "--scope", "none"]) == 2


def test_cli_ingest(spark, tmp_path, capsys):
    spark.createDataFrame([("hn", "1", "some text", "a"), ("hn", "2", "", "b")], "source string, source_id string, text string, canonical_id string").write.parquet(f"file://{tmp_path}/e")
    assert cli.main(["ingest", "--entries", f"file://{tmp_path}/e", "--corpus", f"file://{tmp_path}/c", "--batch", "1", "--merged-at", "2024"]) == 0
    assert "'processed': 1" in capsys.readouterr().out
    spark.createDataFrame([("some text",), ("new",)], "text string").write.parquet(f"file://{tmp_path}/t")
    spark.createDataFrame([(hashlib.sha256(b"new").hexdigest(),)], "text_sha string").write.parquet(f"file://{tmp_path}/v")
    assert cli.main(["embed-prefetch", "--texts", f"file://{tmp_path}/t", "--vectors", f"file://{tmp_path}/v", "--out", f"file://{tmp_path}/o"]) == 0
    assert [r.text for r in spark.read.parquet(f"file://{tmp_path}/o").collect()] == ["some text"]


def test_budget(spark):
    b = Budget(1.0)
    n = b.reserve(0.7)
    with pytest.raises(BudgetExceeded):
        b.reserve(0.4)
    b.settle(n, 0.2)
    m = b.reserve(0.8)
    with pytest.raises(BudgetExceeded):
        b.settle(m, 0.9)
    assert b.spent == pytest.approx(1.1) and b.reserved == {}
    rows = spark.createDataFrame([("u", 1, "reserve", 1, 0.7), ("u", 2, "settle", 1, 0.2), ("u", 3, "reserve", 2, 0.8), ("u", 4, "settle", 2, 0.9)], "user string, seq int, kind string, number int, amount double")
    assert [(r.spent, r.reserved, r.ok) for r in ledger(rows, "user", "seq", 1.0).orderBy("seq").collect()] == [(0.0, 0.7, True), (0.2, 0.0, True), (0.2, 0.8, True), (1.1, 0.0, False)]
    calls = spark.createDataFrame([(429, None), (503, None), (None, "APITimeoutError"), (None, "ValueError"), (402, None), (200, None), (500, "RateLimitError")], "s int, e string")
    assert [r[0] for r in calls.select(retry_class(F.col("s"), F.col("e"))).collect()] == ["transient", "fatal", "transient", "fatal", "budget", "ok", "transient"]
    assert spark.range(1).select(backoff(F.lit(2), 0.5, F.lit(0.5)), reserve_ceiling(F.lit(0), F.lit(2.0))).first()[:] == (2.25, 0.002)


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    points = spark.createDataFrame([("b", 0, "x"), ("a", 1, "y"), ("a", 0, "z")], "canonical_id string, chunk_idx long, text string")
    files.dump_points(points, f"{root}/dump")
    back = files.restore_points(spark, f"{root}/dump", "canonical_id string, chunk_idx long, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, points.collect()))
    files.dump_points(points.repartition(3), f"{root}/dump2")
    files.dump_points(points.limit(1), f"{root}/other")
    assert files.fixture_sha256(spark, f"{root}/dump") == files.fixture_sha256(spark, f"{root}/dump2") != files.fixture_sha256(spark, f"{root}/other")
    files.write_atomic(tmp_path / "d/x.md", files.front_matter({"a": "1"}, "body"))
    assert (tmp_path / "d/x.md").read_text() == "---\na: 1\n---\nbody" and [p.name for p in (tmp_path / "d").iterdir()] == ["x.md"]
    assert files.safe_path(tmp_path, "raw", "0" * 16, "hn").parts[-3:] == ("raw", "hn", "0" * 16 + ".md") and files.safe_path(tmp_path, "quarantine", "a" * 64).name == "a" * 64 + ".md"
    for bad in (("raw", "../x", "hn"), ("raw", "0" * 16, "../hn"), ("canonical", "0" * 64, None), ("other", "0" * 16, None)):
        with pytest.raises(ValueError):
            files.safe_path(tmp_path, *bad)
    (tmp_path / "p.yml").write_text("version: '1'\ndomains:\n  - Medium.com\noverrides:\n  - domain: Sub.example\n    parent: p\nsector:\n  - fin\nm1:\n  input: 2.5\n")
    p = str(tmp_path / "p.yml")
    assert [r.domain for r in files.platforms(spark, p).collect()] == ["medium.com"] and files.overrides(spark, p).first().domain == "sub.example"
    assert ("sector", "fin") in {tuple(r) for r in files.taxonomy(spark, p).collect()} and files.prices(spark, p).first().rate == 2.5
    assert files.seeds([{"name": "A", "url": "u", "x": 1}]) == [{"startup_name": "A", "url": "u", "x": 1}]
    with pytest.raises(ValueError):
        files.seeds([{"name": "A"}])


def test_recorded(spark, tmp_path):
    rec = tmp_path / "rec"
    files.write_recorded(rec, "synthesize", {"template_sha": "t", "model": "a/b", "prompt_hash": "h1"}, {"text": "x", "cost_usd": 0.5})
    files.write_recorded(rec, "embed", {"model": "m", "text_hash": "h2"}, {"vector": [1.0, 2.0]})
    files.write_recorded(rec, "embed", {"model": "m", "text_hash": "h3"}, {"indices": [1], "values": [2.0]})
    got = files.read_recorded(spark, f"file://{rec}")
    assert (rec / "synthesize__a_b__h1.json").exists() and got["llm"].first().stop_reason == "stop" and got["dense"].first().embedding == [1.0, 2.0] and got["sparse"].first().indices == [1]
    (rec / "embed__copy.json").write_text((rec / "embed__m__h2.json").read_text())
    with pytest.raises(ValueError, match="dense: a recorded key stands twice"):
        files.read_recorded(spark, f"file://{rec}")
    (rec / "embed__copy.json").write_text(json.dumps({"schema_version": "2.0", "key": {}, "response": {}}))
    with pytest.raises(ValueError, match="embed__copy.json: version '2.0'"):
        files.read_recorded(spark, f"file://{rec}")
    new = tmp_path / "x.recording"
    files.write_recorded(new, "s", {"model": "m", "prompt_hash": "n"}, {"text": "y"})
    assert files.sweep_stale(tmp_path) == [] and files.sweep_stale(tmp_path, older_than=-1) == ["x.recording"]
    files.write_recorded(new, "s", {"model": "m", "prompt_hash": "n"}, {"text": "y"})
    files.swap_folder(new, rec)
    assert [p.name for p in rec.iterdir()] == ["s__m__n.json"] and not new.exists()


def test_config():
    for wrong in ({"k_retrieve": 3}, {"tier3_band": (0.9, 0.1)}, {"tier3_band": (0.1, 1.1)}, {"enable_search": True}, {"embedding_provider": "remote"}, {"n_synthesize": 0}):
        with pytest.raises(ValueError):
            Config(**wrong)
    assert response_key(F.lit(None), F.lit("x")) is not None


def test_ingest_leaves_no_copies(spark, tmp_path):
    """The batch's own copy of the texts goes, shuffle files go with the writes, and chunks are cut without a shuffle; the setting is as before."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    entries = spark.createDataFrame([("s", str(i), f"text {i} " * 400, f"c{i // 2}") for i in range(6)], "source string, source_id string, text string, canonical_id string")
    judged = entries.select(F.concat_ws("\x1f", "source", "source_id").alias("_key"), (F.col("source_id") == "5").cast("double").alias("judged"))
    store = Corpus(spark, str(tmp_path / "corpus"))
    out = ingest(store, entries, models.LabelClassifier(judged, "judged"), models.HashEmbedder(4), lambda rows: rows, 1, "2024")
    assert sorted((r.source_id, r.outcome) for r in out.collect()) == [(str(i), "quarantined" if i == 5 else "processed") for i in range(6)]
    store.compact()
    assert not list((tmp_path / "corpus" / "work").glob("*")) and spark.conf.get(setting) == before
    texts = store.table("canonical")
    assert "Exchange" not in chunked(texts)._jdf.queryExecution().executedPlan().toString()
    got = {(r.canonical_id, r.chunk_idx): r.text for r in store.table("chunks").collect()}
    whole = {r.canonical_id: r.merged.split(" ") for r in texts.collect()}
    assert got == {(c, i): " ".join(t[start:stop]) for c, t in whole.items() for i, start, stop in spans(" ".join(t))}
