"""Temporal thinning of a stream: a state for each category holds the time of the last row kept.

An extension; rows must come in time order within a category, or later ones within the spacing of a kept row go. A state
goes when the watermark is past the time from which on any row would be kept. Rows without a time are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thin_stream(rows: DataFrame, category: str, time: str, location: str, spacing: int, late: str = "1 hour") -> DataFrame:
    """Rows of a streaming table that are kept: category, time, location. A category's rows of one batch are sorted in memory."""
    gap = spacing * 1_000_000
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def walk(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(["t", "l"])
        t = pdf["t"].to_numpy()
        last = state.get[0] if state.exists else None
        at = 0 if last is None else int(np.searchsorted(t, last + gap))
        keep = []
        while at < len(t):
            keep.append(at)
            last = int(t[at])
            at = max(at + 1, int(np.searchsorted(t, last + gap)))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"g": [key[0]] * len(keep), "t": t[keep], "l": pdf["l"].to_numpy()[keep]})

    # The time itself stays beside its number: it is the column that carries the watermark.
    narrow = rows.where(F.col(time).isNotNull()).withWatermark(time, late)
    narrow = narrow.select(F.col(category).alias("g"), F.col(time).alias("w"), F.unix_micros(F.col(time)).alias("t"), F.col(location).alias("l"))
    kept = narrow.groupBy("g").applyInPandasWithState(walk, f"g {kinds[category]}, t long, l {kinds[location]}", "last long", "append", "EventTimeTimeout")
    return kept.select(F.col("g").alias(category), F.timestamp_micros("t").alias(time), F.col("l").alias(location))
