"""The where language: a list of conditions on columns, compiled to one boolean Column that is never null."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Resolve = Callable[[object], Column]
KEYS = {"variable", "minvalue", "maxvalue", "is_in", "is_not_in", "any_bit_set_of", "value", "min_exclusive", "max_exclusive"}


def normal_name(name: str) -> str:
    """`Group/variable`, also for the older spelling `variable@Group`."""
    if "@" in name:
        v, g = name.split("@", 1)
        return f"{g}/{v}"
    return name


def column(name: object) -> Column:
    """The column of a name, or of {name: ...}."""
    if isinstance(name, Mapping):
        name = name["name"]
    return F.col(f"`{normal_name(str(name))}`")


def int_ranges(text: object) -> list[tuple[int, int]]:
    """`1-7, 16, 20-22` as inclusive ranges; numbers and lists of either too."""
    if isinstance(text, int):
        return [(text, text)]
    if isinstance(text, (list, tuple)):
        return [r for x in text for r in int_ranges(x)]
    out = []
    for part in str(text).split(","):
        m = re.fullmatch(r"\s*(-?\d+)\s*(?:-\s*(-?\d+)\s*)?", part)
        if not m:
            raise ValueError(f"not a range of whole numbers: {part!r}")
        lo, hi = int(m[1]), int(m[2] or m[1])
        if hi < lo:
            raise ValueError(f"an empty range: {part!r}")
        out.append((lo, hi))
    return out


def int_set(text: object) -> list[int]:
    return [i for lo, hi in int_ranges(text) for i in range(lo, hi + 1)]


def is_in(c: Column, values: object) -> Column:
    """Membership in ranges of whole numbers, or in a list of strings."""
    if isinstance(values, (list, tuple)) and any(isinstance(v, str) and not re.fullmatch(r"[\s\d,-]+", v) for v in values):
        return c.isin([str(v) for v in values])
    ranges = int_ranges(values)
    single = [lo for lo, hi in ranges if lo == hi]
    tests = [c.between(lo, hi) for lo, hi in ranges if lo != hi] + ([c.isin(single)] if single else [])
    return reduce(operator.or_, tests)


def condition(spec: Mapping, resolve: Resolve = column) -> Column:
    """One entry. Bounds are inclusive; a null variable fulfils nothing but `value: is_not_valid`."""
    if unknown := set(spec) - KEYS:
        raise KeyError(f"unknown keys in where: {sorted(unknown)}")
    if "variable" not in spec:
        raise KeyError("a condition needs a variable")
    c = resolve(spec["variable"])
    tests: list[Column] = []
    if spec.get("minvalue") is not None:
        tests.append(c >= spec["minvalue"])
    if spec.get("maxvalue") is not None:
        tests.append(c <= spec["maxvalue"])
    if spec.get("min_exclusive") is not None:
        tests.append(c > spec["min_exclusive"])
    if spec.get("max_exclusive") is not None:
        tests.append(c < spec["max_exclusive"])
    if "is_in" in spec:
        tests.append(is_in(c, spec["is_in"]))
    if "is_not_in" in spec:
        tests.append(~is_in(c, spec["is_not_in"]))
    if "any_bit_set_of" in spec:
        mask = sum(1 << b for b in int_set(spec["any_bit_set_of"]))
        tests.append(c.cast("long").bitwiseAND(F.lit(mask).cast("long")) != 0)
    if (v := spec.get("value")) is not None:
        if v not in ("is_valid", "is_not_valid"):
            raise ValueError(f"unknown value test {v!r}")
        tests.append(c.isNotNull() if v == "is_valid" else c.isNull())
    return F.coalesce(reduce(operator.and_, tests, F.lit(True)), F.lit(False))


def where(specs: Iterable[Mapping] | None, how: str = "and", resolve: Resolve = column) -> Column:
    """All of the conditions (or any, with how="or"); an absent or empty list selects everything."""
    tests = [condition(s, resolve) for s in specs or ()]
    if how not in ("and", "or"):
        raise ValueError(f"where operator {how!r}")
    return reduce(operator.and_ if how == "and" else operator.or_, tests) if tests else F.lit(True)
