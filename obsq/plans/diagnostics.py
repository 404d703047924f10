"""Diagnostics as tables: the layers that figures would show, their limits, and configurations that are written back."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.operators import stats

LAYERS = {"Scatter": ("x", "y"), "Histogram": ("data",), "MapScatter": ("longitude", "latitude", "data")}


def layer(df: DataFrame, spec: Mapping) -> DataFrame:
    """The rows that a layer shows: those with all its variables, or the bins of a histogram with `bins` and `range`."""
    kind = spec.get("type")
    if kind not in LAYERS:
        raise KeyError(f"unknown layer {kind!r}; there are {sorted(LAYERS)}")
    parts = [F.col(f"`{spec[p]['variable']}`").alias(p) for p in LAYERS[kind]]
    shown = df.select(*parts).dropna()
    if kind != "Histogram":
        return shown
    low, high = spec["range"]
    return stats.histogram(shown, F.col("data"), low, high, spec.get("bins", 100))


def limits(df: DataFrame, x: str) -> DataFrame:
    """vmin and vmax of what is shown: from end to end, or as far to either side of 0 where the values have both signs."""
    low, high = F.min(f"`{x}`"), F.max(f"`{x}`")
    most = F.greatest(F.abs(low), F.abs(high))
    both = (low < 0) & (high > 0)
    return df.agg(F.when(both, -most).otherwise(low).alias("vmin"), F.when(both, most).otherwise(high).alias("vmax"))


def revised(config, files: Mapping[str, str], ranges: Mapping[str, tuple[float, float]]):
    """A configuration with other file names, and with vmin and vmax in each mapping that shows a variable with a range."""
    if isinstance(config, Mapping):
        out = {k: revised(v, files, ranges) for k, v in config.items()}
        shown = out.get("data")
        name = shown.get("variable") if isinstance(shown, Mapping) else None
        if name in ranges:
            out["vmin"], out["vmax"] = ranges[name]
        return out
    if isinstance(config, list):
        return [revised(v, files, ranges) for v in config]
    return files.get(config, config) if isinstance(config, str) else config


def write_config(tree, path: str | Path) -> None:
    """The tree as JSON or YAML, by the ending of the path; keys stay in order."""
    path = Path(path)
    if path.suffix == ".json":
        path.write_text(json.dumps(tree, indent=2) + "\n")
    elif path.suffix in (".yaml", ".yml"):
        import yaml

        path.write_text(yaml.safe_dump(tree, sort_keys=False))
    else:
        raise ValueError(f"neither JSON nor YAML: {path}")
