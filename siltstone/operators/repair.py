"""Drift between the journal, the document trees and the chunk store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graph import written
from siltstone.operators.ingest import Corpus, rebuilt
from siltstone.operators.models import Embedder


def drift(journal: DataFrame, tree: DataFrame, raw: DataFrame, chunks: DataFrame, leftovers: DataFrame | None = None) -> DataFrame:
    """Findings (drift, id); ``journal``: id, merge_state, content_hash, seq (its order, if it has one; the first hash that is not null counts).

    a: canonical document without chunks; b: journal row still pending; c: canonical whose merged text is not
    what the journal last hashed; d: raw document without a journal row, or without its canonical; e: leftover
    temporary file; f: row of a flipped resolution.  All joins are on ids.
    """
    say = lambda df, k: df.select(F.lit(k).alias("drift"), "id")
    journal = journal if "seq" in journal.columns else journal.withColumn("seq", F.lit(0))
    hashed = journal.where("content_hash is not null").groupBy("id").agg(F.min_by("content_hash", "seq").alias("content_hash"))
    known = raw.join(journal.select("id").distinct(), "id", "left_semi")
    parts = [
        say(tree.join(chunks.select("id").distinct(), "id", "left_anti"), "a"),
        say(journal.where("merge_state = 'pending'"), "b"),
        say(tree.join(hashed, "id").where("content_hash <> combined_hash"), "c"),
        say(raw.join(journal.select("id").distinct(), "id", "left_anti"), "d"),
        say(known.join(tree.select("id").distinct(), "id", "left_anti"), "d"),
        say(journal.where("merge_state = 'resolver_flipped'"), "f"),
    ]
    if leftovers is not None:
        parts.append(say(leftovers, "e"))
    return reduce(DataFrame.unionByName, parts)


def repairs(findings: DataFrame) -> DataFrame:
    """The action of each finding."""
    actions = {"a": "rechunk", "b": "reprocess", "c": "remerge", "d": "reingest", "e": "delete_file", "f": "delete_prior_chunks"}
    return findings.withColumn("action", F.element_at(F.create_map(*(F.lit(x) for kv in actions.items() for x in kv)), F.col("drift")))


def corpus_drift(store: Corpus, before: int | None = None) -> DataFrame:
    """Findings (drift, id) in the tables of a corpus, by canonical id, for d of a raw text without an owner by ``source:source_id``.

    a: a canonical text without chunks; b: a pending row; c: a canonical text that is not what its rows last hashed, or not there though rows are
    complete; d: a raw text without a journal row; e: chunks without a live row of their canonical; f: a flipped row whose canonical still has chunks.
    """
    journal, texts, chunks = store.table("journal", before), store.table("canonical", before), store.table("chunks", before).select("canonical_id").distinct()
    live = journal.where("merge_state in ('pending', 'complete')").select("canonical_id").distinct()
    say = lambda df, k, of="canonical_id": df.select(F.lit(k).alias("drift"), F.col(of).alias("id"))
    done = journal.where("merge_state = 'complete'")
    hashed = done.join(texts.select("canonical_id", F.col("content_hash").alias("_is")), "canonical_id", "left").where("_is is null or content_hash is not null and _is <> content_hash")
    # a row keeps the hash of its own merge: it is the last one of a canonical that counts
    last = done.where("content_hash is not null").groupBy("canonical_id").agg(F.max_by("content_hash", "seq").alias("_last"))
    wrong = hashed.join(last, "canonical_id", "left").where("_is is null or _is <> _last")
    unowned = store.table("raw", before).join(journal.select("source", "source_id"), ["source", "source_id"], "left_anti").withColumn("id", F.concat_ws(":", "source", "source_id"))
    parts = [
        say(texts.join(live, "canonical_id", "left_semi").join(chunks, "canonical_id", "left_anti"), "a"),
        say(journal.where("merge_state = 'pending'"), "b"),
        say(wrong, "c"),
        say(unowned, "d", "id"),
        say(chunks.join(live, "canonical_id", "left_anti").join(journal.where("merge_state = 'resolver_flipped'").select("canonical_id"), "canonical_id", "left_anti"), "e"),
        say(chunks.join(live, "canonical_id", "left_anti").join(journal.where("merge_state = 'resolver_flipped'").select("canonical_id").distinct(), "canonical_id", "left_semi"), "f"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def repair(store: Corpus, seq: int, embedder: Embedder, merged_at: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """Finds drift and mends it in one commit: (drift, id, action).  A second run finds what no repair can mend (d), and commits nothing.

    Texts of a, b and c are merged and chunked anew from their raw sections, and pending rows whose raw text is there are
    completed; those without are told and left.  Chunks of e and f go.  A raw text without an owner is reingested by whoever has its entry.
    """
    actions = {"a": "rechunk", "b": "reprocess", "c": "remerge", "d": "reingest", "e": "delete_chunks", "f": "delete_prior_chunks"}
    action = F.element_at(F.create_map(*(F.lit(x) for kv in actions.items() for x in kv)), F.col("drift"))
    found = written(corpus_drift(store, before=seq).withColumn("action", action), "drift")
    key = ["source", "source_id"]
    ids = found.where("drift in ('a', 'b', 'c')").select(F.col("id").alias("canonical_id")).distinct()
    rows = store.table("journal", before=seq).where("merge_state in ('pending', 'complete')").join(ids, "canonical_id", "left_semi").join(store.table("raw", before=seq).select(*key), key, "left_semi")
    rows = written(rows.drop("seq", "content_hash", "merged_at"), "repaired")
    gone = written(found.where("drift in ('e', 'f')").select(F.col("id").alias("canonical_id")).distinct(), "orphans")
    if rows.isEmpty() and gone.isEmpty():
        return found
    staged, texts = rebuilt(store, rows.select("canonical_id").distinct(), seq, {}, embedder, ranks)
    orphans = store.table("chunks", before=seq).join(gone, "canonical_id", "left_semi").withColumn("deleted", F.lit(True))
    staged["chunks"] = [*staged["chunks"], *store.stage("chunks", orphans, seq)["chunks"]]
    hashed = rows.join(texts.select("canonical_id", "content_hash"), "canonical_id")
    staged |= store.stage("journal", hashed.withColumn("merge_state", F.lit("complete")).withColumn("merged_at", F.lit(merged_at)), 2 * seq + 1)
    store.commits.publish(seq, "repair", staged)
    return found
