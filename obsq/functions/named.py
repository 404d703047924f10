"""Functions that a configuration names: `fn(options) -> Column`, nestable in each other's options.

A variable in options is a column's name, {name: column}, or {name: "ObsFunction/<name>", options: {...}}. Functions whose
factors come from models that aren't here are columns of the input: `Factor` reads one by name.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsq.functions import geometry
from obsq.functions.predicates import column, int_set, normal_name

FUNCTIONS: dict[str, Callable[[Mapping], Column]] = {}


def function(name: str):
    """Register under a name."""

    def put(f):
        FUNCTIONS[name] = f
        return f

    return put


def resolve(spec: object) -> Column:
    """A Column for a name, a number, a function with options, or {name: ...}."""
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, (int, float)):
        return F.lit(float(spec))
    name = normal_name(spec["name"] if isinstance(spec, Mapping) else str(spec))
    if name.startswith("ObsFunction/"):
        key = name.split("/", 1)[1]
        if key not in FUNCTIONS:
            raise KeyError(f"unknown function {key}; there are {sorted(FUNCTIONS)}")
        return FUNCTIONS[key](spec.get("options", {}) if isinstance(spec, Mapping) else {})
    return column(name)


def stepwise_linear(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), constant beyond the ends; xs rise or fall."""
    points = sorted(zip(map(float, xs), map(float, ys)))
    if len(points) != len(xs) or len(xs) != len(ys) or not points:
        raise ValueError("as many values as places, and at least one")
    out = F.when(x <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), points[-1][1])


def ramp(x: Column, x0, x1, err0, err1) -> Column:
    """err0 up to x0, err1 from x1 on, a straight line between."""
    x0, x1, err0, err1 = (resolve(v) for v in (x0, x1, err0, err1))
    return F.when(x <= x0, err0).when(x >= x1, err1).when(x.isNotNull(), err0 + (err1 - err0) * (x - x0) / (x1 - x0))


@function("ObsErrorModelStepwiseLinear")
def _stepwise(o: Mapping) -> Column:
    y = stepwise_linear(resolve(o["xvar"]), o["xvals"], o["errors"])
    return y * resolve(o["scale_factor_var"]) if "scale_factor_var" in o else y


@function("ObsErrorModelRamp")
def _ramp(o: Mapping) -> Column:
    def one(v):
        return v[0] if isinstance(v, (list, tuple)) and len(v) == 1 else v

    args = [one(o[k]) for k in ("x0", "x1", "err0", "err1")]
    if any(isinstance(a, (list, tuple)) for a in args):  # one for each channel
        n = max(len(a) for a in args if isinstance(a, (list, tuple)))
        rows = [[a[i] if isinstance(a, (list, tuple)) else a for a in args] for i in range(n)]
        return F.array(*(ramp(resolve(o["xvar"]), *r) for r in rows))
    return ramp(resolve(o["xvar"]), *args)


@function("Arithmetic")
def _arithmetic(o: Mapping) -> Column:
    terms = [resolve(v) for v in o["variables"]]
    coefs = o.get("coefs", [1.0] * len(terms))
    if len(coefs) != len(terms):
        raise ValueError("as many coefficients as variables")
    powers = o.get("exponents", [1] * len(terms))
    total = reduce(operator.add, (F.lit(float(c)) * (t if p == 1 else F.pow(t, F.lit(p))) for c, t, p in zip(coefs, terms, powers)))
    return total * F.lit(float(o.get("total coefficient", 1.0))) + F.lit(float(o.get("intercept", 0.0)))


#: The columns that wind functions read unless others are named.
WIND = {"u": "ObsValue/windEastward", "v": "ObsValue/windNorthward", "hofx_u": "HofX/windEastward", "hofx_v": "HofX/windNorthward"}


def wind(o: Mapping, *keys: str) -> list[Column]:
    return [resolve(o.get(k, WIND[k])) for k in keys]


@function("Velocity")
def _velocity(o: Mapping) -> Column:
    return F.hypot(resolve(o.get("eastward", WIND["u"])), resolve(o.get("northward", WIND["v"])))


def direction(u: Column, v: Column) -> Column:
    """Degrees in [0, 360) from which a wind blows."""
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Of two directions, in [0, 180]."""
    d = F.abs(F.pmod(a - b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


@function("WindDirAngleDiff")
def _angle(o: Mapping) -> Column:
    """0 where either wind is slower than minimum_uv."""
    u, v, p, q = wind(o, *WIND)
    slow = F.least(F.hypot(u, v), F.hypot(p, q)) < float(o.get("minimum_uv", 1e-4))
    return F.when(slow, 0.0).otherwise(angle_between(direction(u, v), direction(p, q)))


@function("SatWindsErrnormCheck")
def _errnorm(o: Mapping) -> Column:
    """(10 - 0.1 * expected error) / speed; 100 for speeds under 0.1."""
    speed = F.hypot(*wind(o, "u", "v"))
    return F.when(speed < 0.1, 100.0).otherwise((10.0 - 0.1 * resolve(o.get("expected error", "MetaData/expectedError"))) / speed)


@function("ScatWindsAmbiguityCheck")
def _ambiguity(o: Mapping) -> Column:
    """How much farther the wind is from the simulated one than its opposite is; 0 where it is slower than minimum_uv."""
    u, v, p, q = wind(o, *WIND)
    farther = F.hypot(u - p, v - q) - F.hypot(u + p, v + q)
    return F.when(F.hypot(u, v) < float(o.get("minimum_uv", 1e-4)), 0.0).otherwise(farther)


@function("WindsSPDBCheck")
def _spdb(o: Mapping) -> Column:
    """cgross times the error, held between error_min and error_max, by observation type.

    With `variable` alone, type and error are that variable's columns, and the threshold is SLOW times as large where the
    wind is slower than the simulated one.
    """
    name = o.get("variable")
    kind, err = resolve(o.get("type", f"ObsType/{name}")), resolve(o.get("error", f"Err/{name}"))
    out = F.lit(None).cast("double")
    rows = list(zip(int_set(o["wndtype"]), o["cgross"], o["error_min"], o["error_max"], strict=True))
    for k, cgross, low, high in reversed(rows):
        out = F.when(kind == k, float(cgross) * F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), err))).otherwise(out)
    if name is None:
        return out
    u, v, p, q = wind(o, *WIND)
    return out * F.when(F.hypot(u, v) < F.hypot(p, q), float(o.get("speed bias factor", SLOW))).otherwise(1.0)


#: A decision of ours: how much tighter the speed check is for winds that are too slow.
SLOW = 0.7

# Functions whose values come from profiles, retrievals or coefficients that aren't here: the input has them as columns,
# `Factor/<function>`, followed by `_<variable>` or `_<type>` where one is named; `column` names another. With each, the
# options that it may have.
SUPPLIED = {
    "ObsErrorFactorPressureCheck": "variable, inflation factor, surface_obs, SetSfcWndObsHeight, AddObsHeightToStationElevation, AssumedSfcWndObsHeight, request_saturation_specific_humidity_geovals, geovar_sfc_geomz, adjusted_error_name, original_obserr",
    "ObsErrorFactorSfcPressure": "geovar_geomz, geovar_sfc_geomz, station_altitude, error_min, error_max, original_obserr",
    "ObsErrorFactorConventional": "inflate variables, pressure, test QCflag, test QCthreshold, distance threshold",
    "ObsErrorFactorDuplicateCheck": "use_air_pressure, variable",
    "CLWRetMW": "clwret_ch238, clwret_ch314, clwret_ch37v, clwret_ch37h, clwret_types, bias_application, test_bias",
    "SCATRetMW": "scatret_ch238, scatret_ch314, scatret_ch890, scatret_types, bias_application, test_bias",
    "HydrometeorCheckATMS": "channels, obserr_clearsky, clwret_function, obserr_function",
    "HydrometeorCheckAMSUA": "channels, obserr_clearsky, clwret_function, obserr_function",
    "ObsErrorFactorTopoRad": "channels, sensor",
    "ObsErrorFactorTransmitTopRad": "channels, sensor",
    "ObsErrorFactorSurfJacobianRad": "channels, sensor, obserr_demisf, obserr_dtempf, use_biasterm, test_biasterm",
    "ObsErrorFactorSituDependMW": "channels, sensor, clwbkg_function, clwobs_function, scatobs_function, clwmatchidx_function, obserr_function, obserr_clearsky",
    "ObsErrorFactorLatRad": "latitude_parameters",
    "ObsErrorBoundMW": "channels, sensor, obserr_bound_latitude, obserr_bound_transmittop, obserr_bound_topo, obserr_function, threhold, threshold, obserr_bound_max",
    "InterChannelConsistencyCheck": "channels, sensor, use passive_bc, use_flag",
}


def _supplied(name: str, keys: frozenset[str]) -> Callable[[Mapping], Column]:
    def read(o: Mapping) -> Column:
        if unknown := set(o) - keys:
            raise KeyError(f"{name}: unknown options {sorted(unknown)}")
        types = next((o[k] for k in ("clwret_types", "scatret_types") if k in o), None)
        part = o.get("variable", types[0] if types else None)
        return resolve(o.get("column", f"Factor/{name}" + (f"_{part}" if part else "")))

    return read


for _name, _keys in SUPPLIED.items():
    FUNCTIONS[_name] = _supplied(_name, frozenset(_keys.split(", ")) | {"column"})


@function("CLWRetSymmetricMW")
def _symmetric(o: Mapping) -> Column:
    """The mean of what is retrieved from what was observed and from what was simulated."""
    if "clwret_types" in o:
        pair = [FUNCTIONS["CLWRetMW"](dict(o) | {"clwret_types": [t]}) for t in o["clwret_types"]]
        if len(pair) != 2:
            raise ValueError("CLWRetSymmetricMW: two types, observed and simulated")
        return 0.5 * (pair[0] + pair[1])
    return 0.5 * (resolve(o["observed"]) + resolve(o["simulated"]))


@function("CLWMatchIndexMW")
def _match(o: Mapping) -> Column:
    """1 where both lie on the same side of the clear-sky threshold, for each channel's threshold."""
    a, b = (resolve(o[k] if k in o else o[f]) for k, f in (("observed", "clwobs_function"), ("simulated", "clwbkg_function")))
    return F.array(*(F.when((a > t) == (b > t), 1.0).otherwise(0.0) for t in map(float, o["clwret_clearsky"])))


@function("ChannelUseflagCheckRad")
def _use(o: Mapping) -> Column:
    return F.array(*(F.lit(1.0 if int(f) > 0 else 0.0) for f in o["use_flag"]))


@function("LAMDomainCheck")
def _domain(o: Mapping) -> Column:
    return geometry.in_circle(resolve(o.get("longitude", "MetaData/longitude")), resolve(o.get("latitude", "MetaData/latitude")), (float(o["cenlon"]), float(o["cenlat"])), float(o["radius"])).cast("double")


@function("Factor")
def _factor(o: Mapping) -> Column:
    """A factor that the input has as a column."""
    return resolve(o["column"])
