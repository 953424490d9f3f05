"""Resolution by domain as a stream with state: each domain keeps whether it is present and the year of its anchor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators.graph import shared_dir
from siltstone.operators.resolve import RECYCLED_YEARS

ENTRY = "seq long, domain string, platform boolean, year long, suffixed boolean"
RESULT = "seq long, domain string, tier long, reason string"
#: Where the state of a stream is held.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Anchors(StatefulProcessor):
    """State of a domain: the anchor's year, -1 as long as no entry that stayed had one.  No state: the domain is not present."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "year long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")  # the entries of one domain in one micro-batch
        present, anchor = self.anchor.exists(), self.anchor.get()[0] if self.anchor.exists() else -1
        reasons = []
        for year, suffixed in zip(batch["year"].tolist(), batch["suffixed"].tolist(), strict=True):
            known = year == year and year is not None
            if known and anchor >= 0 and abs(year - anchor) > RECYCLED_YEARS:
                reasons.append("recycled")
            elif present and suffixed:
                reasons.append("subsidiary")
            else:
                reasons.append("domain")
                present = True
                anchor = int(year) if known and anchor < 0 else anchor
        if present:
            self.anchor.update((anchor,))
        tiers = [1 if r == "domain" else 2 for r in reasons]
        yield pd.DataFrame({"seq": batch["seq"].to_numpy(), "domain": key[0], "tier": tiers, "reason": reasons})


def resolved_stream(entries: DataFrame) -> DataFrame:
    """A stream of ``entries`` (ENTRY) with tier and reason, in append mode; those without a domain of their own need no state.

    Within a micro-batch entries count in the order of seq, and micro-batches in theirs: the rows are those of ``resolve.by_domain``
    over the same entries if no later micro-batch holds a smaller seq of the same domain.
    """
    plain = F.coalesce(~F.col("platform") & (F.col("domain") != ""), F.lit(False))
    stateful = entries.where(plain).groupBy("domain").transformWithStateInPandas(Anchors(), RESULT, "Append", "None")
    rest = entries.where(~plain).select("seq", "domain", F.lit(2).cast("long").alias("tier"), F.lit("platform").alias("reason"))
    return stateful.unionByName(rest)


def run_available(spark: SparkSession, source: str, schema: str, shape, root: str, files: int | None = None) -> None:
    """Reads what has come to ``source`` since the last run, resolves it and appends the rows to ``root``/rows; the checkpoint beside it keeps offsets and state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)
    run = resolved_stream(shape(stream)).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/rows")
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def event_entries(events: DataFrame) -> DataFrame:
    """Events as entries: the user is the domain."""
    domain = F.when(F.col("user_id") % 11 == 0, "").otherwise(F.concat(F.lit("d"), "user_id", F.lit(".example")))
    year = F.when(F.col("event_id") % 4 != 0, 1995 + F.col("event_id") * 7 % 25).cast("long")
    return events.select(F.col("event_id").alias("seq"), domain.alias("domain"), (F.col("user_id") % 9 == 0).alias("platform"), year.alias("year"), (F.col("event_id") % 3 == 0).alias("suffixed"))


def resolved_events(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "stream-domains")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    run_available(spark, f"{d}/events.parquet*", schema, event_entries, root)
    return spark.read.schema(RESULT).parquet(f"{root}/rows").select("seq", "reason")
