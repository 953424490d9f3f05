"""Streams against the batch operators over the same rows, restarted from their checkpoints."""

import random
import uuid

from pyspark.sql import functions as F

from siltstone.operators import resolve
from siltstone.streaming.resolve import ENTRY, RESULT, run_available


def test_domains_in_two_runs(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, f"d{rng.randrange(8)}" if rng.random() > 0.1 else "", rng.random() < 0.1, rng.choice([None, 2000, 2005, 2012, 2020]), rng.random() < 0.4) for i in range(400)]
    entries = spark.createDataFrame(rows, ENTRY)
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for low, high in ((0, 150), (150, 400)):  # the second run starts from the checkpoint of the first
        entries.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.parquet(f"{source}/{uuid.uuid4().hex}")
        run_available(spark, f"{source}/*", ENTRY, lambda s: s, root)
    run_available(spark, f"{source}/*", ENTRY, lambda s: s, root)  # nothing has come
    got = sorted((r.seq, r.tier, r.reason) for r in spark.read.schema(RESULT).parquet(f"{root}/rows").collect())
    assert got == sorted((r.seq, r.tier, r.reason) for r in resolve.by_domain(entries).collect())
