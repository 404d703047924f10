"""Thinning: a least spacing in time within a category, and one observation for each cell of a grid."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.functions.geometry import cell_centre, cell_id, haversine_km

#: Spacings to a block of time: at a resolution of a second and a spacing of half an hour, 115,200 times at most.
BLOCK = 64


def seconds(duration: str) -> int:
    """Of an ISO duration of days, hours, minutes and seconds: PT30M, PT06M, P1DT2H."""
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", duration)
    if not m or duration in ("P", "PT"):
        raise ValueError(f"not a duration: {duration!r}")
    return sum(int(g or 0) * k for g, k in zip(m.groups(), (86400, 3600, 60, 1)))


def temporal(df: DataFrame, time: str, spacing: int, category: str | None, location: str = "Location", seed: str | None = None, usable: Column | None = None) -> DataFrame:
    """With `_kept`: whether a row stays so that those kept in a category are at least `spacing` seconds apart.

    Without a seed, the earliest is kept and then whatever is far enough from the last one kept; with one, the row nearest
    to it (the earlier on a tie) is kept first, and the walk goes both ways from there. Rows that aren't usable or have no
    time are neither kept nor counted. Ties go to the smallest location. A spacing of 0 keeps every row.

    Of rows of one time in a category only the smallest location can stay, so those are summed up before the shuffle; what
    is left is walked in blocks of time (see `kept_rows`), so that no task holds a category, or a table without one.
    """
    t, usable = F.unix_micros(F.col(f"`{time}`").cast("timestamp")), F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    use = usable & t.isNotNull()
    if spacing == 0:
        return df.withColumn("_kept", use)
    group = F.col(f"`{category}`").cast("string") if category else F.lit("")
    gap = spacing * 1_000_000
    walked = df.where(use).select(F.coalesce(group, F.lit("")).alias("_g"), t.alias("_t"), F.col(f"`{location}`").alias("_l"))
    if seed is not None:
        zero = F.unix_micros(F.lit(seed).cast("timestamp"))
        nearest = walked.groupBy("_g").agg(F.min(F.struct(F.abs(F.col("_t") - zero).alias("d"), "_t", "_l")).alias("n")).select("_g", F.col("n._t").alias("_zt"), F.col("n._l").alias("_zl"))
        walked = walked.join(nearest, "_g")
        before = (F.col("_t") < F.col("_zt")) | ((F.col("_t") == F.col("_zt")) & (F.col("_l") < F.col("_zl")))
        here = (F.col("_t") == F.col("_zt")) & (F.col("_l") == F.col("_zl"))
        # Both walks begin at the seed's row, which so stands in both; time runs away from it.
        forth = walked.where(~before).select(F.concat("_g", F.lit("+")).alias("_g"), (F.col("_t") - F.col("_zt")).alias("_t"), "_l")
        rear = walked.where(before | here).select(F.concat("_g", F.lit("-")).alias("_g"), (F.col("_zt") - F.col("_t")).alias("_t"), "_l")
        walked = forth.union(rear)
    kept = kept_rows(walked, gap)
    flagged = df.join(kept.select(F.col("_l").alias(location)).distinct().withColumn("_kept", F.lit(True)), location, "left")
    return flagged.withColumn("_kept", F.coalesce("_kept", F.lit(False)))


def kept_rows(rows: DataFrame, gap: int, width: int = BLOCK) -> DataFrame:
    """`_l` of the rows (_g, _t, _l) that the walk of each _g keeps: the first, then the first that is `gap` after the last kept.

    Time is cut into blocks of `width` gaps. A block doesn't know where the walk comes in, but it comes in at one of the
    times of its first gap (or at the next one after that), and where it goes out rises with where it comes in: each block
    states this as steps (entries up to a time leave at a time), many entries to a step, as walks run together. One pass over the steps of a
    _g, not its rows, finds the real entries; each block is then walked from its own. A block's task holds its distinct
    times.
    """

    @F.pandas_udf("array<bigint>")
    def steps(times: pd.Series, block: pd.Series) -> pd.Series:
        """Ends of the steps' entries, then as many times from which on the next block may keep a row."""
        out = []
        for t, b in zip(times, block):
            follow = np.searchsorted(t, t + gap)
            at = np.arange(len(t))
            last = np.where(follow == len(t), at, np.minimum(follow, len(t) - 1))
            while not np.array_equal(last, last[last]):  # doubles the jumps each time
                last = last[last]
            entries = min(int(np.searchsorted(t, b * width * gap + gap)) + 1, len(t))
            leave = t[last[:entries]] + gap
            ends = np.append(leave[1:] != leave[:-1], True)
            out.append(np.concatenate([t[:entries][ends], leave[ends]]))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<bigint>")
    def enter(blocks: pd.Series) -> pd.Series:
        """From when on each of a _g's blocks may keep a row; blocks come in order."""
        out = []
        for every in blocks:
            now, entries = -(1 << 63), []
            for s in every:
                entries.append(now)
                half = len(s) // 2
                i = int(np.searchsorted(s[:half], now))
                now = now if i == half else int(s[half + i])
            out.append(np.array(entries, dtype=np.int64))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<int>")
    def walk(times: pd.Series, start: pd.Series) -> pd.Series:
        """Places of the rows kept in a block."""
        out = []
        for t, now in zip(times, start):
            keep, at = [], int(np.searchsorted(t, now))
            while at < len(t):
                keep.append(at)
                at = int(np.searchsorted(t, t[at] + gap))
            out.append(np.array(keep, dtype=np.int32))
        return pd.Series(out, dtype=object)

    first = rows.groupBy("_g", "_t").agg(F.min("_l").alias("_l"))
    block = F.expr(f"(_t - pmod(_t, {gap * width}L)) div {gap * width}L").alias("_b")
    blocks = first.groupBy("_g", block).agg(F.sort_array(F.collect_list(F.struct("_t", "_l"))).alias("_rows"))
    stated = blocks.select("_g", F.struct("_b", steps("_rows._t", "_b").alias("s")).alias("x")).groupBy("_g").agg(F.sort_array(F.collect_list("x")).alias("_x"))
    entries = stated.select("_g", F.explode(F.arrays_zip(F.col("_x._b").alias("b"), enter("_x.s").alias("f"))).alias("e")).select("_g", F.col("e.b").alias("_b"), F.col("e.f").alias("_from"))
    places = blocks.join(entries, ["_g", "_b"]).select("_rows._l", walk("_rows._t", "_from").alias("_at"))
    return places.select(F.explode(F.transform("_at", lambda i: F.get("_l", i))).alias("_l"))


def nearest_in_cell(df: DataFrame, lon: Column, lat: Column, mesh_km: float, location: str = "Location", usable: Column | None = None) -> DataFrame:
    """With `_kept`: the usable row nearest to the centre of its cell; the smallest location on a tie.

    The nearest of each cell is a minimum, summed up before the shuffle, so a crowded cell needs no task of its own.
    """
    usable = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    x, y = cell_centre(lon, lat, mesh_km)
    use = usable & lon.isNotNull() & lat.isNotNull()
    best = df.where(use).groupBy(cell_id(lon, lat, mesh_km).alias("_cell")).agg(F.min(F.struct(F.round(haversine_km(lon, lat, x, y), 6).alias("d"), F.col(f"`{location}`").alias("l"))).alias("m"))
    kept = best.select(F.col("m.l").alias(location), F.lit(True).alias("_kept"))
    return df.join(kept, location, "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
