"""Mappings from nested messages to flat columns: path queries, casts, transforms and times, compiled to one select."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"float": "float", "double": "double", "int": "int", "int32": "int", "int64": "bigint", "string": "string"}
_PART = re.compile(r"([A-Za-z_]\w*)(?:\[(\d+)\])?(?:\{(\d+)\})?")


def _steps(query: str) -> list[tuple[str, int | None]]:
    parts = query.split("/")
    if parts[0] == "*" or parts[0] == "":
        parts = parts[1:]
    out = []
    for p in parts:
        m = _PART.fullmatch(p)
        if not m:
            raise ValueError(f"not a path query: {query!r}")
        out.append((m[1] + (f"_{m[2]}" if m[2] else ""), int(m[3]) if m[3] else None))
    return out


def path(schema: T.StructType, query: str) -> Column | None:
    """`*/A/B{1}/C`: {n} takes the nth repetition, [n] the nth sibling of that name. None if there is no such path."""
    c: Column | None = None
    kind: T.DataType = schema
    for name, nth in _steps(query):
        if isinstance(kind, T.ArrayType):  # every repetition
            if not isinstance(kind.elementType, T.StructType) or name not in kind.elementType.fieldNames():
                return None
            c, kind = c.getField(name), T.ArrayType(kind.elementType[name].dataType)
        else:
            if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                return None
            c, kind = (F.col(f"`{name}`") if c is None else c.getField(name)), kind[name].dataType
        if nth is not None:
            if not isinstance(kind, T.ArrayType):
                return None
            c, kind = F.try_element_at(c, F.lit(nth)), kind.elementType
    return c


def first_of(schema: T.StructType, queries: str | Sequence[str]) -> Column:
    """The first alternative that is there and not null."""
    queries = [queries] if isinstance(queries, str) else list(queries)
    found = [c for q in queries if (c := path(schema, q)) is not None]
    if not found:
        raise KeyError(f"none of {queries} is in the messages")
    return F.coalesce(*found) if len(found) > 1 else found[0]


def flatten(df: DataFrame, by: str) -> DataFrame:
    """A row for each repetition of the struct that holds the named field; the rest of the message with each."""
    steps = _steps(by)
    return df.withColumn(steps[0][0], F.explode_outer(steps[0][0])) if isinstance(df.schema[steps[0][0]].dataType, T.ArrayType) else df


def variable(schema: T.StructType, spec: Mapping) -> Column:
    """A column for {query, type, transforms} or {timestamp: {datetime | timeoffset}}."""
    if unknown := set(spec) - {"query", "type", "transforms", "timestamp", "group_by"}:
        raise KeyError(f"unknown keys in a mapping: {sorted(unknown)}")
    if "timestamp" in spec:
        t = spec["timestamp"]
        if "datetime" in t:
            part = {k: first_of(schema, q) for k, q in t["datetime"].items()}
            return F.make_timestamp(part["year"], part["month"], part["day"], part["hour"], part["minute"], part.get("second", F.lit(0)))
        o = t["timeoffset"]
        off = transformed(first_of(schema, o["timeOffset"] if "timeOffset" in o else o["query"]), o.get("transforms"))
        return F.timestamp_seconds(F.unix_timestamp(F.lit(o["referenceTime"]).cast("timestamp")) + off.cast("bigint"))
    c = first_of(schema, spec["query"])
    if spec.get("type"):
        c = c.cast(TYPES[spec["type"]])
    return transformed(c, spec.get("transforms"))


def transformed(c: Column, steps: Sequence[Mapping] | None) -> Column:
    for s in steps or ():
        (name, k), = s.items()
        if name not in ("scale", "offset"):
            raise KeyError(f"unknown transform {name!r}")
        c = c * k if name == "scale" else c + k
    return c


TOP = {"exports", "outputs", "subsets", "dimensions"}


def dimensions(df: DataFrame, spec: Mapping) -> DataFrame:
    """dimension and size, a row for each of the mapping's dimensions: Location, and the length of those with a path."""
    made = [df.agg(F.lit("Location").alias("dimension"), F.count("*").alias("size"))]
    for d in spec.get("dimensions") or ():
        made.append(df.agg(F.lit(d["name"]).alias("dimension"), F.coalesce(F.max(F.size(first_of(df.schema, d["path"]))), F.lit(0)).cast("long").alias("size")))
    return reduce(DataFrame.unionAll, made)


def compile_mapping(df: DataFrame, spec: Mapping) -> DataFrame:
    """The output columns of a mapping: exports by name, then columns with their names, units and ranges as metadata."""
    export = spec["exports"]
    for part, allowed in ((spec, TOP), (export, {"group_by_variable", "subsets", "variables"})):
        if unknown := set(part) - allowed:
            raise KeyError(f"unknown keys in a mapping: {sorted(unknown)}; there are {sorted(allowed)}")
    if keep := [*(export.get("subsets") or ()), *(spec.get("subsets") or ())]:
        df = df.where(F.col("subset").isin(list(keep)))
    if by := export.get("group_by_variable"):
        df = flatten(df, export["variables"][by]["query"])
    made = df.select("*", *(variable(df.schema, v).alias(f"__{n}") for n, v in export["variables"].items()))
    return made.select(
        *(
            F.col(f"`__{o['source'].removeprefix('variables/')}`").alias(o["name"], metadata={k: o[k] for k in ("units", "longName", "range", "coordinates") if k in o})
            for o in spec["outputs"]
        )
    )
