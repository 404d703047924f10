"""Grouped statistics: all are single aggregations with partial sums before the shuffle."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, by: Sequence[str], x: Column, digits: int = 6) -> DataFrame:
    """n, min, mean, max and population std of a value."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.min(x), digits).alias("min"), F.round(F.avg(x), digits).alias("mean"), F.round(F.max(x), digits).alias("max"), F.round(F.stddev_pop(x), digits).alias("std"))


def rms(df: DataFrame, by: Sequence[str], x: Column, digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.min(x), digits).alias("min"), F.round(F.max(x), digits).alias("max"), F.round(F.sqrt(F.avg(x * x)), digits).alias("rms"))


def norm(x: Column) -> Column:
    """Euclidean, as an aggregate."""
    return F.sqrt(F.sum(x * x))


def jo(df: DataFrame, by: Sequence[str], y: Column, h: Column, err: Column, passed: Column, digits: int = 6) -> DataFrame:
    """nobs, jo = sum of ((y-h)/err)^2, jo/nobs and root mean square error, over what passed."""
    used = passed & y.isNotNull() & h.isNotNull() & err.isNotNull()
    n, total = F.count(F.when(used, 1)), F.coalesce(F.sum(F.when(used, F.pow((y - h) / err, 2))), F.lit(0.0))
    return df.groupBy(*by).agg(n.alias("nobs"), F.round(total, digits).alias("jo"), F.round(F.when(n > 0, total / n), digits).alias("jo_per_n"), F.round(F.sqrt(F.avg(F.when(used, err * err))), digits).alias("err"))


def with_empty(found: DataFrame, spaces: DataFrame, key: str) -> DataFrame:
    """A row for each space, with nobs and jo 0 where nothing was found."""
    return spaces.join(found, key, "left").withColumns({"nobs": F.coalesce("nobs", F.lit(0)), "jo": F.coalesce("jo", F.lit(0.0))})


def by_channel(df: DataFrame, values: str, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each channel, from 1, of an array column."""
    return df.select(*keep, F.posexplode(values).alias("_c", "value")).withColumn("channel", F.col("_c") + 1).drop("_c")


def channel_stats(df: DataFrame, values: str, name: str, digits: int = 6) -> DataFrame:
    """<name>Count, Mean, Min, Max and Std for each channel."""
    v = F.col("value").cast("double")
    return by_channel(df, values).groupBy("channel").agg(F.count(v).alias(f"{name}Count"), F.round(F.avg(v), digits).alias(f"{name}Mean"), F.round(F.min(v), digits).alias(f"{name}Min"), F.round(F.max(v), digits).alias(f"{name}Max"), F.round(F.stddev_pop(v), digits).alias(f"{name}Std"))


def histogram(df: DataFrame, x: Column, low: float, high: float, bins: int = 100) -> DataFrame:
    """bin (1 to bins, equally wide, the last with its upper end) and count of values in [low, high]."""
    b = F.when(x == high, bins).otherwise(F.floor((x - low) / ((high - low) / bins)) + 1).cast("int")
    return df.where((x >= low) & (x <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))


def regression(df: DataFrame, by: Sequence[str], x: Column, y: Column, digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.regr_slope(y, x), digits).alias("slope"), F.round(F.regr_intercept(y, x), digits).alias("intercept"))


def arithmetic(df: DataFrame, new: str, expression: str, names: dict[str, str]) -> DataFrame:
    """A column from an expression over other columns, each by a name of its own: "a - b" with names of a and b."""
    inner = df.select("*", *(F.col(f"`{c}`").alias(n) for n, c in names.items()))
    return inner.select("*", F.expr(expression).alias(new)).drop(*names)


def accept_where(df: DataFrame, new: str, source: str, conditions: list[str]) -> DataFrame:
    """A column with the source's values where every condition holds, and null elsewhere. Conditions name columns in backquotes."""
    on = reduce(operator.and_, (F.expr(c) for c in conditions))
    return df.withColumn(new, F.when(on, F.col(f"`{source}`")))


def for_each(df: DataFrame, transform, **lists) -> DataFrame:
    """A transform once for each element of lists of equal length, one column after another."""
    for values in zip(*lists.values(), strict=True):
        df = transform(df, **dict(zip(lists, values)))
    return df
