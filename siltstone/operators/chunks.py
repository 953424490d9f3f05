"""Token windows of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, OVERLAP, SNAP, STRIDE = 768, 128, 96, 32


def windows(df: DataFrame, key: str, text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_idx, start, stop) in blank-separated tokens, in closed form: for texts without headings."""
    n = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(F.split(F.col(text), " ")))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)), F.lit(window - overlap)), lambda p: (n > 0) & ((p == 0) | (p + overlap < n)))
    rows = df.select(key, n.cast("long").alias("n"), F.posexplode(starts).alias("chunk_idx", "start"))
    return rows.select(key, F.col("chunk_idx").cast("long"), F.col("start").cast("long"), F.least(F.col("start") + window, F.col("n")).cast("long").alias("stop"))


def spans(body: str | None, window: int = WINDOW, overlap: int = OVERLAP, snap: int = SNAP) -> Iterator[tuple[int, int, int]]:
    """(chunk_idx, start, stop) of one text: where one window starts depends on where the one before ended, so a text is walked in order."""
    tokens = body.split(" ") if body else []
    heads = [i // STRIDE * STRIDE for i, t in enumerate(tokens) if "\n#" in t]
    start, idx = 0, 0
    while tokens:
        stop = min(start + window, len(tokens))
        yield idx, start, stop
        if stop >= len(tokens):
            break
        following = start + window - overlap
        ahead = next((h for h in heads if following < h <= following + snap and h < len(tokens)), None)
        start, idx = following if ahead is None else ahead, idx + 1


def heading_windows(df: DataFrame, key: str, text: str = "text", window: int = WINDOW, overlap: int = OVERLAP, snap: int = SNAP) -> DataFrame:
    """The same with later windows moved forward to the first heading (a line that starts with #) within ``snap`` tokens."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *span) for k, body in zip(batch[key], batch[text], strict=True) for span in spans(body, window, overlap, snap)]
            yield pd.DataFrame(out, columns=[key, "chunk_idx", "start", "stop"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(walk, f"{key} {kind}, chunk_idx long, start long, stop long")
