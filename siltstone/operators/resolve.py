"""Entity resolution: domains first, then siblings within a sector."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.hashing import pair_key
from siltstone.operators.corpus import tier2_id
from siltstone.operators.graph import written

RECYCLED_YEARS = 10
LOW, HIGH = 0.65, 0.85


def by_domain(entries: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Tier 1 (the domain is the entity) or 2 (name and sector are), with the reason.

    ``entries``: seq, domain, platform, year, suffixed.  In arrival order, an entry of a known domain is demoted
    if its year is over RECYCLED_YEARS from the domain's anchor (the first year of an entry that stayed), or if
    its name has a corporate suffix and the domain is present.  The first entry of a domain always stays, so
    presence and anchor follow from two partial aggregates; no window holds a domain.
    """
    plain = entries.where("not platform and domain <> ''")
    first = plain.groupBy("domain").agg(F.min("seq").alias("first_seq"))
    with_first = plain.join(first, "domain")
    anchor = with_first.where("year is not null and (seq = first_seq or not suffixed)").groupBy("domain").agg(F.min(F.struct("seq", "year")).alias("a"))
    rows = entries.join(first, "domain", "left").join(anchor, "domain", "left")
    listed = F.lit(False)
    if overrides is not None:
        rows = rows.join(F.broadcast(overrides.select("domain", F.lit(True).alias("listed"))), "domain", "left")
        listed = F.coalesce("listed", F.lit(False))
    recycled = F.coalesce((F.col("a.seq") < F.col("seq")) & (F.abs(F.col("year") - F.col("a.year")) > RECYCLED_YEARS), F.lit(False))
    reason = F.when(F.col("platform") | (F.col("domain") == ""), "platform").when(recycled, "recycled").when(listed | F.col("suffixed") & (F.col("seq") > F.col("first_seq")), "subsidiary").otherwise("domain")
    return rows.select(*entries.columns, F.when(reason == "domain", 1).otherwise(2).cast("long").alias("tier"), reason.alias("reason"))


def band(similarity: Column, decided: Column | None = None, low: float = LOW, high: float = HIGH) -> Column:
    """same from ``high`` on, different to ``low``; between them what was decided, different by default."""
    between = F.coalesce(decided, F.lit("different")) if decided is not None else F.lit("different")
    return F.when(similarity >= high, "same").when(similarity <= low, "different").otherwise(between)


def siblings(entries: DataFrame, similar) -> DataFrame:
    """(seq, sector, id, resolved): the fold over a sector's tier-2 ids in arrival order.

    An entry is compared with the smallest other id present in its sector; if ``similar(id, sibling)`` it takes
    that id and adds none.  The state is the two smallest ids, so a sector streams through its task.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sector, low = None, []
        for batch in batches:
            out = []
            for s, x in zip(batch["sector"], batch["id"], strict=True):
                if s != sector:
                    sector, low = s, []
                other = next((y for y in low if y != x), None)
                if other is not None and similar(x, other):
                    out.append(other)
                    continue
                out.append(x)
                if x not in low:
                    low = sorted([*low, x])[:2]
            yield batch.assign(resolved=out)

    ordered = entries.select("seq", "sector", "id").repartition("sector").sortWithinPartitions("sector", "seq")
    return ordered.mapInPandas(fold, "seq long, sector string, id string, resolved string")


def outcomes(resolved: DataFrame, prior: DataFrame) -> DataFrame:
    """create, merge (the id was there before), or flip (the source row had another id); prior: source, source_id, canonical_id."""
    first = resolved.groupBy("canonical_id").agg(F.min("seq").alias("first_seq"))
    before = prior.select("source", "source_id", F.col("canonical_id").alias("prior_canonical_id"))
    known = prior.select("canonical_id").distinct().withColumn("known", F.lit(True))
    rows = resolved.join(first, "canonical_id").join(known, "canonical_id", "left").join(before, ["source", "source_id"], "left")
    flip = F.coalesce(F.col("prior_canonical_id") != F.col("canonical_id"), F.lit(False))
    merge = F.coalesce("known", F.lit(False)) | (F.col("seq") > F.col("first_seq"))
    return rows.select("seq", "canonical_id", F.when(flip, "flip").when(merge, "merge").otherwise("create").alias("action"))


def entity_ids(entries: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``entries`` with tier, reason and canonical_id: an alias hint, else the domain, else normalized name and sector.

    ``entries``: seq, domain, platform, year, suffixed, name, sector, alias_hint (null for most); hinted rows take
    no part in the domains' presence.
    """
    hinted = F.col("alias_hint").isNotNull() & (F.col("alias_hint") != "")
    rows = by_domain(entries.where(F.coalesce(~hinted, F.lit(True))), overrides)
    hints = entries.where(F.coalesce(hinted, F.lit(False))).withColumn("tier", F.lit(0).cast("long")).withColumn("reason", F.lit("alias_hint"))
    every = rows.unionByName(hints)
    return every.withColumn("canonical_id", F.when(F.col("tier") == 0, F.col("alias_hint")).when(F.col("tier") == 1, F.col("domain")).otherwise(tier2_id(F.col("name"), F.col("sector"))))


def decided(rows: DataFrame, memo: DataFrame, answers: DataFrame | None = None, model: str = "", template: str = "", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``rows`` (a, b, similarity) with pair_key, decision, and ``fresh``: the pair is in the band and a new answer decided it.

    ``memo`` (pair_key, model, template_sha, decision) holds for its own model and template only and goes before ``answers``
    (pair_key, decision); a pair of the band without either is different.
    """
    mine = memo.where((F.col("model") == model) & (F.col("template_sha") == template)).groupBy("pair_key").agg(F.min("decision").alias("_m"))
    out = rows.withColumn("pair_key", pair_key(F.col("a"), F.col("b"))).join(mine, "pair_key", "left")
    new = answers.groupBy("pair_key").agg(F.min("decision").alias("_a")) if answers is not None else None
    out = out.join(new, "pair_key", "left") if new is not None else out.withColumn("_a", F.lit(None).cast("string"))
    within = (F.col("similarity") > low) & (F.col("similarity") < high)
    fresh = F.coalesce(within & F.col("_m").isNull() & F.col("_a").isNotNull(), F.lit(False))
    return out.withColumn("decision", band(F.col("similarity"), F.coalesce("_m", "_a"), low, high)).withColumn("fresh", fresh).drop("_m", "_a")


def sibling_states(entries: DataFrame, present: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(sector, since, m1, m2): the two smallest ids present in a sector after the entry ``since``, until the next row's.

    ``entries``: seq, sector, id, adds (whether the id is present from then on), and what ``decide`` needs; ``present``: sector, id before all entries.
    ``decide`` adds ``decision`` to rows with ``a`` (the entry's id) and ``b``, its sibling.

    An entry is compared with the smallest other id present; unless they are the same its own id is added.  So only
    an entry whose id is below the two smallest changes what later ones see.  Each round finds, for all sectors at once and
    by a partial minimum, the first such entry after the last change: no sector is ever in one task, and rounds are as
    many as the changes of the sector that has most (for ids in random order the logarithm of their number).
    """
    m1 = present.groupBy("sector").agg(F.min("id").alias("m1"))
    m2 = present.join(m1, "sector").where("id <> m1").groupBy("sector").agg(F.min("id").alias("m2"))
    state = entries.select("sector").distinct().join(m1, "sector", "left").join(m2, "sector", "left").select("sector", F.lit(-(2**63)).cast("long").alias("since"), "m1", "m2")
    found = [state := written(state, "states")]
    able = entries.where("adds")
    while True:
        below = (F.col("seq") > F.col("since")) & (F.col("m2").isNull() | (F.col("id") < F.col("m2"))) & (F.col("m1").isNull() | (F.col("id") != F.col("m1")))
        open_ = able.join(state, "sector").where(below)
        alone = open_.where("m1 is null").select("sector", "seq", "id", "m1", "m2")
        judged = decide(open_.where("m1 is not null").withColumn("a", F.col("id")).withColumn("b", F.col("m1"))).where("decision <> 'same'")
        first = alone.unionByName(judged.select("sector", "seq", "id", "m1", "m2")).groupBy("sector").agg(F.min(F.struct("seq", "id", "m1", "m2")).alias("e"))
        after = F.when(F.col("e.m1").isNull(), None).when(F.col("e.id") < F.col("e.m1"), F.col("e.m1")).otherwise(F.least("e.id", "e.m2"))
        state = written(first.select("sector", F.col("e.seq").alias("since"), F.least("e.m1", "e.id").alias("m1"), after.alias("m2")), "states")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(state)


def with_sibling(entries: DataFrame, states: DataFrame) -> DataFrame:
    """``entries`` with ``sibling``, the smallest other id present when they came: an as-of join with a sector's few states."""
    history = states.groupBy("sector").agg(F.sort_array(F.collect_list(F.struct("since", "m1", "m2"))).alias("_h"))
    rows = entries.join(history, "sector", "left")
    then = F.element_at(F.filter("_h", lambda s: s["since"] < F.col("seq")), -1)
    return rows.withColumn("_s", then).withColumn("sibling", F.when(F.col("_s.m1") != F.col("id"), F.col("_s.m1")).otherwise(F.col("_s.m2"))).drop("_h", "_s")


def resolve_entities(entries: DataFrame, prior: DataFrame, memo: DataFrame, similarity: Callable[[DataFrame], DataFrame], answers: DataFrame | None = None, overrides: DataFrame | None = None, model: str = "", template: str = "") -> tuple[DataFrame, DataFrame]:
    """(outcomes, review) of a batch in arrival order: ids, tier-3 collapse of tier-2 ids, flips, create or merge.

    ``entries``: as for ``entity_ids``, with source and source_id.  ``prior`` (source, source_id, canonical_id, merge_state): the journal; ids
    of pending and complete rows are present as siblings, ids of any state are known to a merge.  ``similarity(rows)`` adds a
    similarity to rows of entries with ``a``, the entry's id, and ``b``, its sibling.  An entry that flips adds no
    sibling.  ``review`` (pair_key, similarity, decision): pairs of the band that a new answer decided, the first entry's similarity.
    """
    before = prior.groupBy("source", "source_id").agg(F.min("canonical_id").alias("_prior"))
    ids = written(entity_ids(entries, overrides).join(before, ["source", "source_id"], "left"), "resolution")
    tier2 = ids.where("tier = 2").withColumn("sector", F.lower("sector")).withColumnRenamed("canonical_id", "id").withColumn("adds", F.coalesce(F.col("_prior") == F.col("id"), F.lit(True)))
    there = prior.where("merge_state in ('pending', 'complete') and contains(canonical_id, '::')").select(F.element_at(F.split("canonical_id", "::"), -1).alias("sector"), F.col("canonical_id").alias("id")).distinct()
    decide = lambda rows: decided(similarity(rows), memo, answers, model, template)
    compared = with_sibling(tier2, sibling_states(tier2, there, decide)).where("sibling is not null")
    judged = written(decide(compared.withColumn("a", F.col("id")).withColumn("b", F.col("sibling"))), "siblings")
    taken = judged.where("decision = 'same'").select("seq", "sibling")
    out = written(ids.join(taken, "seq", "left").withColumn("canonical_id", F.coalesce("sibling", "canonical_id")).drop("sibling", "_prior"), "resolved")
    first = judged.where("fresh").groupBy("pair_key").agg(F.min(F.struct("seq", "similarity", "decision")).alias("f"))
    return outcomes(out, prior).join(out.select("seq", "reason"), "seq"), first.select("pair_key", "f.similarity", "f.decision")
