"""Ensembles in long form: mean, spread, relaxation, and the local transform filter for small groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, by: Sequence[str], x: Column, digits: int = 6) -> DataFrame:
    """members, mean and population variance; nulls are skipped."""
    return df.groupBy(*by).agg(F.count(x).alias("members"), F.round(F.avg(x), digits).alias("mean"), F.round(F.var_pop(x), digits).alias("variance"))


def rtps(analysis: Column, background_spread: Column, analysis_spread: Column, alpha: float) -> Column:
    """A perturbation relaxed to the prior spread (Whitaker and Hamill 2012); left alone where its own spread is 0."""
    return F.when(analysis_spread == 0, analysis).otherwise(analysis * (1 + alpha * (background_spread - analysis_spread) / analysis_spread))


def rtpp(analysis: Column, background: Column, alpha: float) -> Column:
    """A perturbation relaxed to the prior's (Zhang et al. 2004)."""
    return (1 - alpha) * analysis + alpha * background


def hybrid_variance(static: Column, ensemble: Column, static_weight: float) -> Column:
    return static_weight * static + (1 - static_weight) * ensemble


def transform(x: np.ndarray, y: np.ndarray, obs: np.ndarray, variance: np.ndarray, inflation: float = 1.0) -> np.ndarray:
    """The analysis ensemble of one point (Hunt et al. 2007). x: members; y: observations by members."""
    k = len(x)
    if not len(obs) or k < 2:
        return x.astype(float)
    xm, ym = x.mean(), y.mean(1)
    xp, yp = x - xm, y - ym[:, None]
    c = yp.T / variance
    values, vectors = np.linalg.eigh((k - 1) / inflation * np.eye(k) + c @ yp)
    mean = vectors @ (vectors.T @ (c @ (obs - ym)) / values)
    weights = vectors @ (np.sqrt((k - 1) / values)[:, None] * vectors.T)
    return xm + xp @ (mean[:, None] + weights)


def letkf(points: DataFrame, obs: DataFrame, key: str, inflation: float = 1.0) -> DataFrame:
    """key, member, analysis: one small solve for each point.

    points: key, member, value. obs: key, obs_id, member, simulated, observed, variance, those near the point only, so a
    group is as large as the localisation lets it be.
    """

    def solve(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("member")
        x = p["value"].to_numpy(float)
        if len(o):
            # Rows: observations; columns: members, in the order of the points'. One that lacks a member doesn't count.
            known, place = np.unique(p["member"].to_numpy(), return_inverse=True)
            o = o[o["simulated"].notna() & o["member"].isin(known)]
            ids, first, row = np.unique(o["obs_id"].to_numpy(), return_index=True, return_inverse=True)
            cell = row * len(known) + np.searchsorted(known, o["member"].to_numpy())
            size = (len(ids), len(known))
            times = np.bincount(cell, minlength=len(ids) * len(known)).reshape(size)
            sums = np.bincount(cell, o["simulated"].to_numpy(float), len(ids) * len(known)).reshape(size)
            whole = (times > 0).all(1)
            y, at = (sums[whole] / times[whole])[:, place], first[whole]
            x = transform(x, y, o["observed"].to_numpy(float)[at], o["variance"].to_numpy(float)[at], inflation)
        return pd.DataFrame({key: p[key].to_numpy(), "member": p["member"].to_numpy(), "analysis": x})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.groupBy(key).cogroup(obs.groupBy(key)).applyInPandas(solve, f"{key} {kinds[key]}, member {kinds['member']}, analysis double")
