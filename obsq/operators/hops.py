"""Observation operators: what a model would have observed, from columns with its profiles and fields."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOPS: dict = {}


def hop(name: str):
    def put(f):
        HOPS[name] = f
        return f

    return put


@hop("Identity")
def identity(field: Column, scaling: Column | None = None) -> Column:
    return field if scaling is None else field * scaling


@hop("VertInterp")
def vert_interp(values: Column, levels: Column, at: Column, method: str = "linear") -> Column:
    """A profile at a coordinate: linear, or linear in the logarithm; constant beyond its ends. Levels rise or fall."""
    log = (lambda c: F.log(c)) if method == "log-linear" else (lambda c: c)
    if method not in ("linear", "log-linear"):
        raise ValueError(f"interpolation method {method!r}")
    pairs = F.array_sort(F.filter(F.arrays_zip(levels.alias("l"), values.alias("v")), lambda p: p["l"].isNotNull() & p["v"].isNotNull()))

    def ends(ps: Column) -> Column:
        lo, hi = F.try_element_at(F.filter(ps, lambda p: p["l"] <= at), F.lit(-1)), F.try_element_at(F.filter(ps, lambda p: p["l"] > at), F.lit(1))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    def between(x: Column) -> Column:
        lo, hi = x["lo"], x["hi"]
        weight = (log(at) - log(lo["l"])) / (log(hi["l"]) - log(lo["l"]))
        return F.when(at.isNull(), None).when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(lo["v"] + weight * (hi["v"] - lo["v"]))

    return bound(bound(pairs, ends), between)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


@hop("AtmVertInterpLay")
def layer_sum(values: Column, thickness: Column, coefficient: float = 1.0) -> Column:
    """The sum over layers of value times thickness, times a coefficient."""
    return F.aggregate(F.zip_with(values, thickness, lambda v, t: v * t), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) * coefficient


@hop("Composite")
def composite(df: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """`HofX/<v>` for each variable, from its own operator."""
    return df.select("*", *(c.alias(f"HofX/{v}") for v, c in parts.items()))


@hop("SfcCorrected")
def surface_corrected(field: Column, height: Column, station: Column, lapse: float = 0.0065) -> Column:
    """A surface field carried from the model's height to the station's along a lapse rate for each metre."""
    return field + (height - station) * lapse


@hop("SfcPCorrected")
def surface_pressure_corrected(pressure: Column, temperature: Column, height: Column, station: Column, lapse: float = 0.0065) -> Column:
    """Surface pressure carried to the station's height through a layer of constant lapse rate (hypsometric equation)."""
    g, r = 9.80665, 287.05
    return pressure * F.pow((temperature + (height - station) * lapse) / temperature, F.lit(g / (r * lapse)))


def operator_of(spec: Mapping, simulated: Sequence[str]) -> dict[str, Column]:
    """What an observation operator's configuration simulates: a column for each variable.

    Fields of the model are columns `GeoVaLs/<v>`; profiles are arrays, and so are their levels. A variable's field has
    its own name, or that of `alias`. Composite has operators, each for its own variables.
    """
    name = spec["name"]
    if name == "Composite":
        out: dict[str, Column] = {}
        for part in spec["components"]:
            out |= operator_of(part, [v["name"] if isinstance(v, Mapping) else v for v in part.get("variables", simulated)])
        return out
    if name not in HOPS:
        raise KeyError(f"unknown observation operator {name!r}; there are {sorted(HOPS)}")
    alias, made = spec.get("alias", {}), {}
    for v in simulated:
        field = F.col(f"`GeoVaLs/{alias.get(v, v)}`")
        if name == "Identity":
            made[v] = identity(field)
        elif name == "VertInterp":
            levels, at = (F.col(f"`{x}`") for x in (f"GeoVaLs/{spec.get('vertical coordinate', 'air_pressure')}", f"{spec.get('observation vertical coordinate group', 'MetaData')}/{spec.get('observation vertical coordinate', 'pressure')}"))
            made[v] = vert_interp(field, levels, at, spec.get("interpolation method", "linear"))
        elif name == "AtmVertInterpLay":
            made[v] = layer_sum(field, F.col(f"`GeoVaLs/{spec['thickness']}`"), float(spec.get("coefficient", 1.0)))
        elif name == "SfcPCorrected":
            made[v] = surface_pressure_corrected(field, *(F.col(f"`{c}`") for c in ("GeoVaLs/surface_temperature", "GeoVaLs/surface_height", "MetaData/stationElevation")))
        else:
            made[v] = surface_corrected(field, F.col("`GeoVaLs/surface_height`"), F.col("`MetaData/stationElevation`"), float(spec.get("lapse rate", 0.0065)))
        if factor := spec.get("hofx scaling field"):
            made[v] = made[v] * F.col(f"`{spec.get('hofx scaling field group', 'MetaData')}/{factor}`")
    return made


def bias(predictors: Sequence[Column], coefficients: Sequence[Column | float]) -> Column:
    """The sum of coefficient times predictor."""
    if len(predictors) != len(coefficients):
        raise ValueError("a coefficient for each predictor")
    return reduce(operator.add, (p * c for p, c in zip(predictors, coefficients)), F.lit(0.0))


def scan_angle(position: Column, step: float, start: float, order: int) -> Column:
    """A power of the scan angle in radians."""
    return F.pow(F.radians(position * step + start), F.lit(order))
