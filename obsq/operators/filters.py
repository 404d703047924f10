"""Quality-control filters: each takes a space and a specification, and gives the space with new state columns.

A filter says for each variable which rows it flags; its actions (reject unless others are named) then change the state
where its `where` holds. All of one filter is one projection, so a chain of filters is one stage without a shuffle;
only thinning deals rows out.
"""

from __future__ import annotations

import difflib
import operator
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsq.functions.named import resolve
from obsq.functions.predicates import int_set, where
from obsq.operators import thinning
from obsq.operators.space import CODES, ObsSpace, col

Flags = Callable[[ObsSpace, Mapping, str], Column]
FILTERS: dict[str, tuple[Flags, str, frozenset[str]]] = {}
COMMON = frozenset({"filter", "filter variables", "where", "where operator", "action", "actions", "defer to post", "apply at iterations"})
WHOLE: dict[str, tuple[Callable[[ObsSpace, Mapping], ObsSpace], frozenset[str]]] = {}


def qc_filter(name: str, code: str, *keys: str):
    """Register what a filter flags, the code it rejects with, and its own keys."""

    def put(f: Flags) -> Flags:
        FILTERS[name] = (f, code, frozenset(keys))
        return f

    return put


def whole(name: str, *keys: str):
    """Register a filter that changes a space as a whole."""

    def put(f):
        WHOLE[name] = (f, frozenset(keys))
        return f

    return put


def check_keys(spec: Mapping, allowed: frozenset[str], what: str) -> None:
    for k in spec:
        if k not in allowed:
            near = difflib.get_close_matches(k, allowed, 1)
            raise KeyError(f"{what}: unknown key {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))


def _bounds(x: Column, spec: Mapping) -> Column:
    tests = []
    if spec.get("minvalue") is not None:
        tests.append(x < spec["minvalue"])
    if spec.get("maxvalue") is not None:
        tests.append(x > spec["maxvalue"])
    return reduce(operator.or_, tests, F.lit(False))


@qc_filter("Perform Action", "perform")
def _perform(space: ObsSpace, spec: Mapping, v: str) -> Column:
    return F.lit(True)


FILTERS["BlackList"] = FILTERS["RejectList"] = (_perform, "list", frozenset())


@qc_filter("Bounds Check", "bounds", "minvalue", "maxvalue", "test variables", "flag all filter variables if any test variable is out of bounds", "treat missing as out of bounds")
def _bounds_check(space: ObsSpace, spec: Mapping, v: str) -> Column:
    """Outside [minvalue, maxvalue], of the variable or of test variables; a value at a bound passes."""
    tests = spec.get("test variables")
    if not tests:
        return _bounds(col(f"ObsValue/{v}"), spec)
    out = [_bounds(resolve(t), spec) for t in tests]
    names = [*spec.get("filter variables", space.variables)]
    if spec.get("flag all filter variables if any test variable is out of bounds") or len(out) != len(names):
        return reduce(operator.or_, (F.coalesce(o, F.lit(False)) for o in out))
    return out[[n["name"] if isinstance(n, Mapping) else n for n in names].index(v)]


@qc_filter("Background Check", "background", "threshold", "absolute threshold", "function absolute threshold", "bias correction parameter")
def _background(space: ObsSpace, spec: Mapping, v: str) -> Column:
    """Farther from what was simulated than the least of the thresholds that are given."""
    most = []
    if spec.get("threshold") is not None:
        most.append(resolve(spec["threshold"]) * col(f"Err/{v}"))
    if spec.get("absolute threshold") is not None:
        most.append(resolve(spec["absolute threshold"]))
    if f := spec.get("function absolute threshold"):
        most.append(resolve(f[0] if isinstance(f, list) else f))
    if not most:
        raise KeyError("Background Check: a threshold is needed")
    return F.abs(space.departure(v)) > (F.least(*most) if len(most) > 1 else most[0])


@qc_filter("Difference Check", "difference", "reference", "value", "minvalue", "maxvalue", "threshold")
def _difference(space: ObsSpace, spec: Mapping, v: str) -> Column:
    d = resolve(spec["value"]) - resolve(spec["reference"])
    return F.abs(d) > spec["threshold"] if spec.get("threshold") is not None else _bounds(d, spec)


@qc_filter("PreQC", "preqc", "minvalue", "maxvalue")
def _preqc(space: ObsSpace, spec: Mapping, v: str) -> Column:
    """Marks of the source over maxvalue, 3 by default."""
    return _bounds(col(f"QualityMarker/{v}"), {"maxvalue": 3} | dict(spec))


def _act(space: ObsSpace, spec: Mapping, action: Mapping, flagged: Mapping[str, Column], code: int) -> ObsSpace:
    name, new = action["name"], {}
    for v, f in flagged.items():
        qc, err = col(f"QC/{v}"), col(f"Err/{v}")
        if name == "reject":
            new[f"QC/{v}"] = F.when(f & (qc == 0), code).otherwise(qc)
        elif name == "accept":
            new[f"QC/{v}"] = F.when(f & (qc != CODES["missing"]), 0).otherwise(qc)
        elif name in ("assign error", "inflate error"):
            what = next((action[k] for k in ("error parameter", "error function", "inflation factor", "inflation variable") if k in action), None)
            if what is None:
                raise KeyError(f"{name}: a parameter, function, factor or variable is needed")
            x = resolve(what)
            if name == "inflate error":
                x = err * F.when(x == 0, 1.0).otherwise(x)  # a factor of 0 adds no term
            new[f"Err/{v}"] = F.when(f, x).otherwise(err)
        elif name in ("set", "unset"):
            flag = f"Diag/{action['flag']}/{v}"
            on = f & (qc == 0) if action.get("ignore") == "rejected observations" else f
            new[flag] = F.when(on, F.lit(name == "set")).otherwise(col(flag) if flag in space.df.columns else F.lit(False))
        else:
            raise KeyError(f"unknown action {name!r}")
    return space.with_columns(new)


@whole("Domain Check")
def _domain(space: ObsSpace, spec: Mapping) -> ObsSpace:
    """Keeps where the conditions hold."""
    outside = ~where(spec.get("where"), spec.get("where operator", "and"), resolve)
    flagged = {v: outside for v in _variables(space, spec)}
    for a in _actions(spec):
        space = _act(space, spec, a, flagged, CODES["domain"])
    return space


@whole("AcceptList")
def _accept(space: ObsSpace, spec: Mapping) -> ObsSpace:
    on = where(spec.get("where"), spec.get("where operator", "and"), resolve)
    return _act(space, spec, {"name": "accept"}, {v: on for v in _variables(space, spec)}, 0)


@whole("Variable Assignment", "assignments")
def _assign(space: ObsSpace, spec: Mapping) -> ObsSpace:
    on, new = where(spec.get("where"), spec.get("where operator", "and"), resolve), {}
    kinds = {"float": "float", "int": "int", "string": "string", "datetime": "timestamp", "bool": "boolean", "double": "double", None: "double"}
    for a in spec["assignments"]:
        check_keys(a, frozenset({"name", "value", "function", "type", "source variable"}), "Variable Assignment")
        name = a["name"].split("@")
        name = f"{name[1]}/{name[0]}" if len(name) == 2 else name[0]
        value = F.lit(a["value"]) if "value" in a else resolve(a.get("function", a.get("source variable")))
        kind = kinds[a.get("type")]
        old = col(name) if name in space.df.columns else F.lit(None).cast(kind)
        new[name] = F.when(on, value.cast(kind)).otherwise(old)
    return space.with_columns(new)


@whole("Create Diagnostic Flags", "flags")
def _flags(space: ObsSpace, spec: Mapping) -> ObsSpace:
    new = {}
    for f in spec["flags"]:
        for v in _variables(space, spec):
            name = f"Diag/{f['name']}/{v}"
            if name not in space.df.columns or f.get("force reinitialization"):
                new[name] = F.lit(bool(f.get("initial value", False)))
    return space.with_columns(new)


@whole("Print Filter Data", "message", "variables", "summary")
def _print(space: ObsSpace, spec: Mapping) -> ObsSpace:
    """The space as it is; what would be printed is a table of filter_data()."""
    return space


def filter_data(space: ObsSpace, spec: Mapping):
    """Location and the named variables of the rows where the filter's condition holds."""
    names = [v["variable"] if isinstance(v, Mapping) else v for v in spec["variables"]]
    on = where(spec.get("where"), spec.get("where operator", "and"), resolve)
    return space.df.where(on).select(space.location, *(resolve(n).alias(n) for n in names))


@whole("Variable Transforms", "Transform", "SkipWhenNoObs", "source", "name")
def _transform(space: ObsSpace, spec: Mapping) -> ObsSpace:
    """The registered transform's column; those that need a model's factors read them as a column."""
    return space.with_columns({spec["name"]: resolve(spec["source"])})


@whole("Temporal Thinning", "min_spacing", "seed_time", "category_variable", "time variable")
def _temporal(space: ObsSpace, spec: Mapping) -> ObsSpace:
    on = where(spec.get("where"), spec.get("where operator", "and"), resolve)
    time = spec.get("time variable", "MetaData/dateTime")
    category = (spec.get("category_variable") or {}).get("name")
    names = _variables(space, spec)
    usable = on & reduce(operator.or_, (space.passed(v) for v in names))
    kept = thinning.temporal(space.df, time, thinning.seconds(spec["min_spacing"]), category, space.location, spec.get("seed_time"), usable)
    thinned = ObsSpace(kept, space.variables, space.location)
    flagged = {v: on & ~F.coalesce(F.col("_kept"), F.lit(False)) for v in names}
    for a in _actions(spec):
        thinned = _act(thinned, spec, a, flagged, CODES["thinned"])
    return ObsSpace(thinned.df.drop("_kept"), space.variables, space.location)


@whole("Gaussian Thinning", "horizontal_mesh", "use_reduced_horizontal_grid", "distance_norm", "round_horizontal_bin_count_to_nearest")
def _gaussian(space: ObsSpace, spec: Mapping) -> ObsSpace:
    on = where(spec.get("where"), spec.get("where operator", "and"), resolve)
    names = _variables(space, spec)
    usable = on & reduce(operator.or_, (space.passed(v) for v in names))
    kept = thinning.nearest_in_cell(space.df, col("MetaData/longitude"), col("MetaData/latitude"), float(spec["horizontal_mesh"]), space.location, usable)
    thinned = ObsSpace(kept, space.variables, space.location)
    for a in _actions(spec):
        thinned = _act(thinned, spec, a, {v: on & ~F.col("_kept") for v in names}, CODES["thinned"])
    return ObsSpace(thinned.df.drop("_kept"), space.variables, space.location)


def _variables(space: ObsSpace, spec: Mapping) -> list[str]:
    """Those of the filter, or all simulated ones."""
    return [n["name"] if isinstance(n, Mapping) else n for n in spec.get("filter variables") or space.variables]


def _actions(spec: Mapping) -> list[Mapping]:
    return spec.get("actions") or [spec.get("action") or {"name": "reject"}]


def due(spec: Mapping, iteration: int) -> bool:
    return "apply at iterations" not in spec or iteration in int_set(spec["apply at iterations"])


def apply(space: ObsSpace, spec: Mapping, iteration: int = 0) -> ObsSpace:
    """One filter, if it is due at this iteration."""
    name = spec["filter"]
    if name not in FILTERS and name not in WHOLE:
        raise KeyError(f"unknown filter {name!r}" + "".join(f"; did you mean {n!r}?" for n in difflib.get_close_matches(name, [*FILTERS, *WHOLE], 1)))
    keys = FILTERS[name][2] if name in FILTERS else WHOLE[name][1]
    check_keys(spec, COMMON | keys, name)
    if not due(spec, iteration):
        return space
    if name in WHOLE:
        return WHOLE[name][0](space, spec)
    flags, code, _ = FILTERS[name]
    on = where(spec.get("where"), spec.get("where operator", "and"), resolve)
    for a in _actions(spec):
        flagged = {v: on & F.coalesce(flags(space, spec, v), F.lit(False)) for v in _variables(space, spec)}
        space = _act(space, spec, a, flagged, CODES[code])
    return space
