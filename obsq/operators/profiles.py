"""Records of a space: rows grouped and sorted as its `obsgrouping` says."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

_KEYS = ("group variables", "sort variable", "sort order")


def grouping(spec: Mapping, location: str = "Location") -> WindowSpec:
    """The window of a grouping. Nulls come last, ties go by location; without group variables there are no records."""
    if extra := set(spec) - set(_KEYS):
        raise KeyError(f"unknown keys of a grouping: {sorted(extra)}")
    if not spec.get("group variables"):
        raise KeyError("a grouping needs group variables")
    order = spec.get("sort order", "ascending")
    if order not in ("ascending", "descending"):
        raise ValueError(f"not an order: {order!r}")
    by = []
    if "sort variable" in spec:
        x = F.col(f"`{spec['sort variable']}`")
        by = [x.asc_nulls_last() if order == "ascending" else x.desc_nulls_last()]
    return W.partitionBy(*(f"`{g}`" for g in spec["group variables"])).orderBy(*by, f"`{location}`")


def levels(df: DataFrame, spec: Mapping, location: str = "Location", into: str = "_level") -> DataFrame:
    """With the place of each row in its record, from 1."""
    return df.withColumn(into, F.row_number().over(grouping(spec, location)).cast("long"))


def spacing(x: Column, spec: Mapping, location: str = "Location") -> tuple[Column, Column]:
    """How far x falls from the row before, and to the row after; null at the ends of a record."""
    w = grouping(spec, location)
    return F.lag(x).over(w) - x, x - F.lead(x).over(w)
