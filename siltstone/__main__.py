"""python -m siltstone: ingest, query, replay, embed-prefetch, and run for the test queries."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators import evaluate, reports
from siltstone.operators.ingest import Corpus, ingest, ingest_counts
from siltstone.operators.models import HashEmbedder, LabelClassifier, Recorded
from siltstone.session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltstone")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="a batch of entries (source, source_id, text, canonical_id) into a corpus")
    p.add_argument("--entries", required=True)
    p.add_argument("--corpus", required=True)
    p.add_argument("--batch", type=int, required=True)
    p.add_argument("--merged-at", required=True, help="time stamp of the batch")
    p.add_argument("--judged", help="parquet of (_key, judged): slop scores by source and source_id")
    p.add_argument("--vetted", default="", help="comma-separated sources that are not judged")
    p.add_argument("--limit", type=int)
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--threshold", type=float, default=0.7)
    p.add_argument("--dim", type=int, default=64)
    p = sub.add_parser("query", help="reports for pitches, with recorded answers and vectors")
    p.add_argument("--pitches", required=True)
    p.add_argument("--points", required=True)
    p.add_argument("--documents", required=True)
    p.add_argument("--answers", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--generated-at", required=True)
    p.add_argument("-k", type=int, default=30)
    p.add_argument("-n", type=int, default=5)
    p.add_argument("--min-similarity", type=float, default=4.0)
    p = sub.add_parser("replay", help="compares results of an evaluation with a baseline; exit 1 if something got worse")
    p.add_argument("--results", required=True, help="parquet of (row_id, candidate_id, assertion, ok)")
    p.add_argument("--baseline", required=True, help="JSON; a missing or empty file has no rows")
    p.add_argument("--scope")
    p.add_argument("--write-baseline", action="store_true")
    p = sub.add_parser("embed-prefetch", help="texts that have no vector yet")
    p.add_argument("--texts", required=True)
    p.add_argument("--vectors", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("run", help="a registered test query")
    p.add_argument("name")
    p.add_argument("--dir", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    read = spark.read.parquet
    if a.command == "ingest":
        entries = read(a.entries)
        entries = entries if a.limit is None else entries.orderBy("source", "source_id").limit(a.limit)
        judged = read(a.judged) if a.judged else spark.createDataFrame([], "_key string, judged double")
        known = entries.select("source", "source_id", "canonical_id")
        resolve = lambda df: df.drop("canonical_id").join(known, ["source", "source_id"], "left")
        out = ingest(Corpus(spark, a.corpus), entries, LabelClassifier(judged, "judged"), HashEmbedder(a.dim), resolve, a.batch, a.merged_at, tuple(filter(None, a.vetted.split(","))), a.force, a.threshold, a.dry_run)
        print(ingest_counts(out).first().asDict())
        return 0
    if a.command == "query":
        config = Config(k_retrieve=a.k, n_synthesize=a.n, min_similarity=a.min_similarity)
        out = reports.run_queries(read(a.pitches), read(a.points), read(a.documents), Recorded(read(a.answers)), config, a.generated_at, extracted="sector" in read(a.pitches).columns)
        out["reports"].write.mode("overwrite").parquet(a.out)
        return 0
    if a.command == "replay":
        from pathlib import Path

        current = read(a.results).where(F.lit(True) if a.scope is None else F.col("row_id") == a.scope)
        path = Path(a.baseline)
        if a.write_baseline:
            path.write_text(evaluate.baseline_json(current))
            return evaluate.GOOD
        baseline = evaluate.read_baseline(spark, path.read_text() if path.exists() else "")
        if a.scope is not None:
            baseline = baseline.where(F.col("row_id") == a.scope)
        if current.isEmpty():
            print("no results", file=sys.stderr)
            return evaluate.UNUSABLE
        changes = evaluate.diff(baseline, current)
        for r in changes.orderBy("change", "row_id", "candidate_id", "assertion").collect():
            print(r.change.upper(), r.row_id, r.candidate_id, r.assertion or "")
        return evaluate.exit_code(changes)
    if a.command == "embed-prefetch":
        texts = read(a.texts).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), "text").dropDuplicates(["text_sha"])
        texts.join(read(a.vectors).select("text_sha"), "text_sha", "left_anti").write.mode("overwrite").parquet(a.out)
        return 0
    from siltstone.catalog import QUERIES

    QUERIES[a.name](spark, a.dir).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
