"""Gathering, gating, merging and looking up of entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.dates import year_start
from siltstone.functions.hashing import short_sha256
from siltstone.functions.text import normalize_name
from siltstone.functions.urls import host

#: Rank of sections of sources that have no rank.
UNRANKED = 9
SLOP_THRESHOLD = 0.7
MARKER_SEPARATOR = "\n\n---\n\n"


def gathered(sources: list[DataFrame], order: str, limit: int | None = None) -> DataFrame:
    """Rows of the sources, in the sources' order and then by ``order``, up to a limit over all; ``src_ord`` numbers the sources."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("src_ord", F.lit(i)) for i, s in enumerate(sources)])
    return rows if limit is None else rows.orderBy("src_ord", order).limit(limit)


def gathered_resilient(makers: dict, order: str, limit: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The same of sources that are made here (name -> function); one that fails leaves its message and not its rows."""
    good, failed = [], {}
    for name, make in makers.items():
        try:
            df = make()
            df.schema  # noqa: B018  a source that cannot be read fails here
            good.append(df.withColumn("source", F.lit(name)))
        except Exception as error:  # noqa: BLE001
            failed[name] = f"{type(error).__name__}: {error}".splitlines()[0]
    return (gathered(good, order, limit) if good else None), failed


def archived_page(answer: Column) -> Column:
    """The snapshot's URL in an archive's answer, null where none is available."""
    return F.when(F.get_json_object(answer, "$.archived_snapshots.closest.available") == "true", F.get_json_object(answer, "$.archived_snapshots.closest.url"))


def extracted_page(answer: Column) -> Column:
    """The first raw content in an extraction service's answer."""
    return F.get_json_object(answer, "$.results[0].raw_content")


def enricher(answers: DataFrame, key: str, value: Column, target: str = "body", needs: tuple[str, ...] = ()):
    """A step that fills ``target`` from recorded answers where it and all other bodies (``needs``) are still missing."""
    found = answers.select(key, value.alias("_found"))

    def step(df: DataFrame) -> DataFrame:
        missing = F.lit(True)
        for c in (target, *needs):
            missing = missing & (F.coalesce(F.col(c), F.lit("")) == "")
        kind = df.columns
        return df.join(found, key, "left").withColumn(target, F.when(missing, F.col("_found")).otherwise(F.col(target))).select(*kind)

    return step


def enriched(entries: DataFrame, steps: list) -> DataFrame:
    return reduce(DataFrame.transform, steps, entries)


def throttled(requests: DataFrame, host: str, arrival: str, gap: int, tie: str) -> DataFrame:
    """``at``: when each request may go, in the unit of ``arrival``, a host's requests ``gap`` apart: max(arrival, previous + gap) in closed form."""
    order = Window.partitionBy(host).orderBy(arrival, tie)
    rows = requests.withColumn("_n", F.row_number().over(order))
    late = F.max(F.col(arrival) - gap * F.col("_n")).over(Window.partitionBy(host).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("at", (gap * F.col("_n") + late).cast("long")).drop("_n")


def slop_scores(entries: DataFrame, judged: DataFrame, key: str, vetted: list[str], threshold: float = SLOP_THRESHOLD) -> DataFrame:
    """``score`` and ``outcome`` (kept, quarantined, skipped_empty): vetted sources and failed judgements score 0, over the threshold is quarantined.

    ``judged``: key, judged (null where the classifier failed).
    """
    rows = entries.withColumn("_empty", F.coalesce("text", F.lit("")) == "").join(judged.select(key, "judged"), key, "left")
    score = F.when(F.col("source").isin(*vetted), 0.0).otherwise(F.coalesce("judged", F.lit(0.0))).cast("double")
    outcome = F.when(F.col("_empty"), "skipped_empty").when(score > threshold, "quarantined").otherwise("kept")
    return rows.withColumn("score", score).withColumn("outcome", outcome).drop("judged", "_empty")


def reclassified(quarantined: DataFrame, judged: DataFrame, key: str, threshold: float = SLOP_THRESHOLD) -> DataFrame:
    """Quarantined rows with ``decision``: error without a judgement, still_slop from the threshold on, else declassified."""
    rows = quarantined.join(judged.select(key, "judged"), key, "left")
    return rows.withColumn("decision", F.when(F.col("judged").isNull(), "error").when(F.col("judged") >= threshold, "still_slop").otherwise("declassified")).drop("judged")


def reclassify_moves(decided: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that go back as pending, rows that stay in quarantine)."""
    return decided.where("decision = 'declassified'").drop("decision").withColumn("merge_state", F.lit("pending")), decided.where("decision <> 'declassified'").drop("decision")


def payloads(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose payload is a JSON object, as ``payload``; rows of other payloads go."""
    v = F.try_parse_json(F.col(column))
    return df.where(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))).withColumn("payload", F.from_json(column, schema))


def not_in_taxonomy(values: DataFrame, facet: str, taxonomy: DataFrame) -> DataFrame:
    """Distinct values of a facet that the taxonomy (facet, value) does not list."""
    allowed = taxonomy.where(F.col("facet") == facet).select("value")
    return values.select(F.col(facet).alias("value")).distinct().join(allowed, "value", "left_anti")


def text_hits(df: DataFrame, key: str, found: DataFrame, where: Column, limit: int = 10, snippet: int = 500) -> DataFrame:
    """The first rows by key that were ``found`` (chunk_id, as ``PostingIndex.holding`` gives them) and meet ``where``: key, snippet of
    summary or text, score 0 where there is none."""
    body = F.coalesce(F.nullif("summary", F.lit("")), "text") if "summary" in df.columns else F.col("text")
    score = F.coalesce("score", F.lit(0.0)) if "score" in df.columns else F.lit(0.0)
    rows = df.where(where).join(found.select(F.col("chunk_id").alias(key)), key, "left_semi")
    return rows.orderBy(key).limit(limit).select(key, F.substring(body, 1, snippet).alias("snippet"), score.alias("score"))


def cited_hosts_allowed(rows: DataFrame, key: str, urls: str, allowed: DataFrame) -> DataFrame:
    """(key, allowed): whether the host of every URL of a row is in the allow-list (host), which may be of any size; true without URLs, false where one has no host."""
    cited = rows.select(key, F.explode(urls).alias("_url")).select(key, host(F.col("_url")).alias("host"))
    known = allowed.select("host").where("host <> ''").distinct().withColumn("_known", F.lit(True))
    bad = cited.join(known, "host", "left").where("_known is null").select(key).distinct().withColumn("_bad", F.lit(True))
    return rows.select(key).join(bad, key, "left").select(key, F.col("_bad").isNull().alias("allowed"))


def having(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key ``other`` has."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def in_ranked_order(ranked: DataFrame, retrieved: DataFrame, key: str | list[str]) -> DataFrame:
    """A ranking with what was retrieved: positions stay, ids that were not retrieved go."""
    return ranked.join(retrieved, key)


def owners(journal: DataFrame) -> DataFrame:
    """The canonical of each (source, source_id): complete before pending before the rest, then the smaller id."""
    order = F.when(F.col("merge_state") == "complete", 0).when(F.col("merge_state") == "pending", 1).otherwise(2)
    best = journal.groupBy("source", "source_id").agg(F.min(F.struct(order.alias("o"), "canonical_id")).alias("b"))
    return best.select("source", "source_id", F.col("b.canonical_id").alias("canonical_id"))


def siblings_of(rows: DataFrame, sector: str, id: str) -> DataFrame:  # noqa: A002
    """``sibling``: the smallest other id of the sector, from the sector's two smallest, without a self join of its rows."""
    low = rows.groupBy(sector).agg(F.min(id).alias("_m1"))
    second = rows.join(low, sector).where(F.col(id) != F.col("_m1")).groupBy(sector).agg(F.min(id).alias("_m2"))
    joined = rows.join(low, sector).join(second, sector, "left")
    return joined.withColumn("sibling", F.when(F.col(id) == F.col("_m1"), F.col("_m2")).otherwise(F.col("_m1"))).drop("_m1", "_m2")


def section_rank(source: Column, ranks: dict[str, int]) -> Column:
    if not ranks:
        return F.lit(UNRANKED)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), source), F.lit(UNRANKED))


def merged_sections(sections: DataFrame, key: str, ranks: dict[str, int]) -> DataFrame:
    """(key, merged, content_hash): sections (source, source_id, text) under their heads, by reliability and source id.

    A key's sections are one text in the end, so they meet in one row.
    """
    section = F.struct(section_rank(F.col("source"), ranks).alias("rank"), "source_id", "source", "text")
    head = lambda s: F.concat(F.lit("## "), s["source"], F.lit(":"), s["source_id"], F.lit("\n\n"), F.coalesce(s["text"], F.lit("")))
    rows = sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), head), MARKER_SEPARATOR).alias("merged"))
    return rows.withColumn("content_hash", short_sha256(F.col("merged")))


def counters(rows: DataFrame, outcome: str, names: dict[str, str]) -> DataFrame:
    """One row: ``seen`` and a count for each named outcome."""
    return rows.agg(F.count("*").alias("seen"), *(F.count_if(F.col(outcome) == value).alias(name) for name, value in names.items()))


def first_known(rows: DataFrame, key: str, seq: str, value: str, name: str) -> DataFrame:
    """``name``: the key's first known value before each row: one value for a key, so a partial minimum and a join give it."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))).alias("_f"))
    return rows.join(first, key, "left").withColumn(name, F.when(F.col("_f.s") < F.col(seq), F.col("_f.v"))).drop("_f")


def first_events(rows: DataFrame, key: str, seq: str, most: int = 50) -> DataFrame:
    """(key, shown, more): the first ``most`` values of ``seq`` in order, and how many more there are.

    Each task keeps ``most`` of a key before the shuffle, so a hot key sends that many rows from each.
    """
    w = Window.partitionBy(key).orderBy(seq)
    head = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy(key).agg(F.array_sort(F.collect_list(seq)).alias("shown"))
    return head.join(rows.groupBy(key).agg(F.count("*").alias("_c")), key).select(key, "shown", F.greatest(F.col("_c") - most, F.lit(0)).alias("more"))


def duplicate_ids(rows: DataFrame, id: str) -> DataFrame:  # noqa: A002
    return rows.groupBy(id).agg(F.count("*").alias("n")).where("n > 1")


def tier2_id(name: Column, sector: Column) -> Column:
    return F.concat(normalize_name(name), F.lit("::"), F.lower(sector))


def looks_tier1(id: Column) -> Column:  # noqa: A002
    return ~F.contains(id, F.lit("::"))


def payload_columns(year: Column, source: Column, source_id: Column, vetted: list[str]) -> list[Column]:
    """founding_date (1 January, text), founding_unknown, provenance_id, provenance and text_id of an entry."""
    vetted_source = source.isin(*vetted)
    return [
        year_start(year).cast("string").alias("founding_date"), year.isNull().alias("founding_unknown"), F.concat_ws(":", source, source_id).alias("provenance_id"),
        F.when(vetted_source, "curated_real").otherwise("scraped").alias("provenance"), short_sha256(source_id.cast("string")).alias("text_id"),
    ]


def trace(df: DataFrame, columns: tuple[str, ...] = ("query_id", "canonical_id", "chunk_idx", "score", "rank")) -> DataFrame:
    """What may be logged of hits: ids and scores, never texts."""
    return df.select(*(c for c in columns if c in df.columns))


def zipped(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Two tables that belong together row by row, joined on a key and not on position; a row without its partner is an error."""
    marked = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full")
    whole = F.when(F.col("_l") & F.col("_r"), True).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.to_json(F.struct(*key)))).cast("boolean"))
    return marked.where(whole).drop("_l", "_r")
