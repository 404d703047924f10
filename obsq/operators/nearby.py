"""Points with the observations near them, and analyses that use those alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.functions.geometry import EARTH_KM

#: Cells are wider than the radius by this factor, so that rounding loses no pair.
SLACK = 1 + 1e-9
#: Observations whose weight is under this part of a whole one don't count.
LEAST_WEIGHT = 1e-6
#: Cosines of angles that differ by more than this are told apart surely.
SURE = 1e-12
#: Points and observations of a cell that are compared in one task.
BLOCK = 2048


def _cells(band: Column, reach: float) -> Column:
    """How many cells a band of latitude is cut into: each as wide as the radius reaches in longitude from any place there."""
    south = band * (reach * SLACK) - 90.0
    edge = F.greatest(F.abs(south), F.abs(south + reach * SLACK))
    wide = F.degrees(F.asin(math.sin(math.radians(reach)) / F.cos(F.radians(edge)))) * SLACK
    return F.when(edge + reach < 90.0, F.greatest(F.floor(360.0 / wide), F.lit(1))).otherwise(F.lit(1)).cast("long")


def _cell(lon: Column, cells: Column) -> Column:
    return F.least(F.floor(F.pmod(lon, F.lit(360.0)) * cells / 360.0), cells - 1).cast("long")


def _own(reach: float) -> tuple[Column, Column]:
    """Band and cell of a row's place."""
    band = F.floor((F.col("lat") + 90.0) / (reach * SLACK))
    return band, _cell(F.col("lon"), _cells(band, reach))


def _around(reach: float) -> Column:
    """Bands and cells (b, c) in which all that is within reach of a row's place lies: nine at most."""
    band = F.floor((F.col("lat") + 90.0) / (reach * SLACK))

    def around(b: Column) -> Column:
        cells = _cells(b, reach)
        here = _cell(F.col("lon"), cells)
        return F.transform(F.array_distinct(F.array(*(F.pmod(here + e, cells) for e in (-1, 0, 1)))), lambda c: F.struct(b.alias("b"), c.alias("c")))

    return F.concat(*(around(band + d) for d in (-1, 0, 1)))


def within_radius(points: DataFrame, obs: DataFrame, key: str, ob_key: str, radius_km: float) -> DataFrame:
    """key, ob_key, distance_km of every pair at most `radius_km` apart; both tables have lon and lat, in degrees.

    Each observation lies in one cell, and each point looks in the cells around its own, nine at most, so pairs come from an
    equal join on cells. The points should be the smaller side. The cosine of the angle decides on a pair, the distance itself
    only where the cosine is too near the radius' own. Places that are null are near nothing; rows that repeat give
    their pairs again; the poles and the date line need no care.
    """
    if not radius_km > 0:
        raise ValueError("the radius must be above 0")
    reach = math.degrees(radius_km / EARTH_KM)

    def place(side: str) -> list[Column]:
        lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
        wide = F.cos(F.radians(lat))
        made = {"lon": lon, "lat": lat, "wide": wide, "x": wide * F.cos(F.radians(lon)), "y": wide * F.sin(F.radians(lon)), "z": F.sin(F.radians(lat))}
        return [v.alias(f"_{side}{k}") for k, v in made.items()]

    band, cell = _own(reach)
    placed = obs.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col(ob_key).alias("_o"), *place("o"), band.alias("_b"), cell.alias("_c"))
    looked = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col(key).alias("_p"), *place("p"), F.explode(_around(reach)).alias("_at"))
    looked = looked.select("*", F.col("_at.b").alias("_b"), F.col("_at.c").alias("_c"))

    def half(what: str) -> Column:
        return F.pow(F.sin(F.radians(F.col(f"_o{what}") - F.col(f"_p{what}")) / 2), 2)

    # As haversine_km() has it, with the cosines of the latitudes from before the join; no place is null here.
    far = 2 * EARTH_KM * F.asin(F.sqrt(F.least(half("lat") + F.col("_pwide") * F.col("_owide") * half("lon"), F.lit(1.0))))
    cosine = F.col("_px") * F.col("_ox") + F.col("_py") * F.col("_oy") + F.col("_pz") * F.col("_oz")
    least = math.cos(min(radius_km / EARTH_KM, math.pi))
    near = (cosine > least + SURE) | ((cosine > least - SURE) & (far <= radius_km))
    return placed.join(looked, ["_b", "_c"]).where(near).select(F.col("_p").alias(key), F.col("_o").alias(ob_key), far.alias("distance_km"))


def local_analysis(points: DataFrame, members: DataFrame, obs: DataFrame, simulated: DataFrame, key: str, radius_km: float, inflation: float = 1.0) -> DataFrame:
    """key, member, analysis of each point from the observations within the radius, whose errors grow with the distance.

    points: key, lon, lat. members: key, member, value. obs: obs_id, lon, lat, observed, variance. simulated: obs_id, member,
    simulated. The taper falls to 0 at the radius (Hunt et al. 2007 for its use on errors). Points without observations
    keep their members.

    The transform needs of the observations only sums of products of their members, so no pair becomes a row: blocks of points
    and observations that share a cell are multiplied as matrices, and a point's sums are added up and solved. Observations that
    lack one of a point's members, a value or a variance above 0 don't count for it; rows of obs that repeat count once. A key
    has one place, the smallest of several.
    """
    if not radius_km > 0:
        raise ValueError("the radius must be above 0")
    reach, block, least, earth = math.degrees(radius_km / EARTH_KM), BLOCK, LEAST_WEIGHT, EARTH_KM
    band, cell = _own(reach)
    at = ["_b", "_c"]

    def lists(df: DataFrame, by: str, value: str) -> DataFrame:
        both = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("member", F.col(value).cast("double").alias("v")))).alias("_l"))
        return both.select(by, F.col("_l.member").alias("_members"), F.col("_l.v").alias("_values"))

    def known(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) < math.inf)
        return out

    ensemble = lists(members, key, "value")
    placed = points.where(known("lon", "lat")).groupBy(key).agg(F.min(F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))).alias("_at")).select(key, "_at.*")
    placed = placed.join(ensemble.select(key, "_members"), key).select("*", band.alias("_b"), cell.alias("_c"))
    means = simulated.where(known("simulated")).groupBy("obs_id", "member").agg(F.avg("simulated").alias("s"))
    seen = obs.where(known("lon", "lat", "observed", "variance") & (F.col("variance") > 0)).select("obs_id", *(F.col(c).cast("double").alias(c) for c in ("lon", "lat", "observed", "variance"))).distinct()
    seen = seen.join(lists(means, "obs_id", "s"), "obs_id").withColumn("_at", F.explode(_around(reach))).select("*", F.col("_at.b").alias("_b"), F.col("_at.c").alias("_c")).drop("_at")
    parts = [df.groupBy(*at).agg(F.ceil(F.count("*") / block).alias(n)) for df, n in ((placed, "_points"), (seen, "_seen"))]
    cells = parts[0].join(parts[1], at)

    def dealt(df: DataFrame, by: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64(by), F.col(own))
        return df.join(cells, at).select(*df.columns, mine.alias(names[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(names[1])).groupBy(*at, "_i", "_j")

    def halves(df: pd.DataFrame) -> list[np.ndarray]:
        lon, lat = (np.radians(df[c].to_numpy(float)) for c in ("lon", "lat"))
        return [np.sin(lat / 2), np.cos(lat / 2), np.sin(lon / 2), np.cos(lon / 2), np.cos(lat)]

    def tapered(p: list[np.ndarray], o: list[np.ndarray]) -> np.ndarray:
        """Weights of points by observations, 0 where they don't count: gaspari_cohn() of haversine_km()."""
        a = (np.outer(p[0], o[1]) - np.outer(p[1], o[0])) ** 2 + np.outer(p[4], o[4]) * (np.outer(p[2], o[3]) - np.outer(p[3], o[2])) ** 2
        out = np.zeros(a.shape)
        hit = np.flatnonzero(a <= (math.sin(radius_km / earth / 2) ** 2 * (1 + 1e-9) if radius_km < math.pi * earth else math.inf))
        far = 2 * earth * np.arcsin(np.sqrt(np.minimum(a.ravel()[hit], 1.0)))
        z = far / (radius_km / 2.0)
        weight = np.empty(len(z))
        close = z <= 1
        x = z[close]
        weight[close] = (((-x / 4 + 0.5) * x + 0.625) * x - 5 / 3) * x * x + 1
        x = z[~close]
        weight[~close] = ((((x / 12 - 0.5) * x + 0.625) * x + 5 / 3) * x - 5) * x + 4 - 2.0 / (3 * x)
        weight[(far > radius_km) | ~(weight > least)] = 0.0
        out.ravel()[hit] = weight
        return out

    def add(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        keys, sums = [], []
        if len(p) and len(o):
            lens = o["_members"].map(len).to_numpy()
            flat, value, row = np.concatenate(o["_members"].to_list()), np.concatenate(o["_values"].to_list()), np.repeat(np.arange(len(o)), lens)
            kinds, sign = np.unique(p["_members"].map(lambda m: repr(list(m))).to_numpy(str), return_inverse=True)
            for s in range(len(kinds)):
                of = np.flatnonzero(sign == s)
                mine = np.asarray(p["_members"].iat[of[0]])
                k = len(mine)
                if k < 2 or pd.isna(mine).any():
                    continue
                names, place = np.unique(mine, return_inverse=True)
                use = np.flatnonzero(np.isin(flat, names))
                y = np.full((len(o), len(names)), np.nan)
                y[row[use], np.searchsorted(names, flat[use])] = value[use]
                whole = np.flatnonzero(~np.isnan(y).any(1))
                if not len(whole):
                    continue
                y = y[whole][:, place]
                ym = y.mean(1)
                yp, off = y - ym[:, None], o["observed"].to_numpy(float)[whole] - ym
                i, j = np.triu_indices(k)
                each = np.hstack((yp[:, i] * yp[:, j], yp * off[:, None])) / o["variance"].to_numpy(float)[whole, None]
                left, right = halves(p.iloc[of]), halves(o.iloc[whole])
                for lo in range(0, len(of), 256):
                    weight = tapered([x[lo : lo + 256] for x in left], right)
                    has = np.flatnonzero(weight.any(1))
                    keys.append(p[key].iloc[of[lo : lo + 256][has]])
                    sums += list(weight[has] @ each)
        return pd.DataFrame({key: pd.concat(keys) if keys else p[key].iloc[:0], "_sums": pd.Series(sums, index=pd.concat(keys).index if keys else p.index[:0], dtype=object)})

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    sums = dealt(placed, key, "_points", "_seen", ("_i", "_j")).cogroup(dealt(seen, "obs_id", "_seen", "_points", ("_j", "_i"))).applyInPandas(add, f"{key} {dict(placed.dtypes)[key]}, _sums array<double>")
    rows = ensemble.join(sums.groupBy(key).agg(F.array_sort(F.collect_list("_sums")).alias("_sums")), key, "left").select(key, "_members", "_values", "_sums")

    def solve(batches):
        for b in batches:
            of, names = b.column(0), b.column(1).flatten()
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
            parts = b.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            inner = b.column(3).flatten()
            long = inner.value_lengths().to_numpy(zero_copy_only=False)
            start, value = np.cumsum(long) - long, inner.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), parts)
            for k in np.unique(size[parts > 0]).tolist():
                mine = np.flatnonzero((size == k) & (parts > 0))
                i, j = np.triu_indices(k)
                taken = np.flatnonzero(size[owner] == k)
                total = np.add.reduceat(value[start[taken][:, None] + np.arange(len(i) + k)], np.searchsorted(owner[taken], mine), axis=0)
                a = np.zeros((len(mine), k, k))
                a[:, i, j] = a[:, j, i] = total[:, : len(i)]
                values, vectors = np.linalg.eigh((k - 1) / inflation * np.eye(k) + a)
                back = vectors.transpose(0, 2, 1)
                mean = vectors @ ((back @ total[:, len(i) :, None]) / values[:, :, None])
                weights = (vectors * np.sqrt((k - 1) / values)[:, None, :]) @ back
                cells_ = first[mine][:, None] + np.arange(k)
                old = x[cells_]
                xm = old.mean(1, keepdims=True)
                x[cells_] = xm + ((old - xm)[:, None, :] @ (mean + weights))[:, 0, :]
            yield pa.RecordBatch.from_arrays([of.take(pa.array(np.repeat(np.arange(b.num_rows), size))), names, pa.array(x)], names=[key, "member", "analysis"])

    return rows.mapInArrow(solve, f"{key} {kinds[key]}, member {kinds['member']}, analysis double")
