"""States of models in long form (cell, level, field, value), side inputs of bias correction, and tables handed on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("cell", "level")


def long_form(df: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """key, field, value: a row for each field of each row."""
    return df.select(*key, *(F.col(f"`{f}`").cast("double").alias(f) for f in fields)).unpivot(list(key), list(fields), "field", "value")


def wide_form(state: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """A column for each named field; null where the state lacks it."""
    return state.groupBy(*key).pivot("field", list(fields)).agg(F.first("value"))


def read_restart(spark: SparkSession, files: Mapping[str, str], fields: Mapping[str, Sequence[str]], key: Sequence[str] = KEY) -> DataFrame:
    """One state from the files of its kinds (core, tracers, surface, ...), each read for its own fields alone."""
    if unknown := set(fields) - set(files):
        raise KeyError(f"no file for {sorted(unknown)}")
    return reduce(DataFrame.unionAll, (long_form(spark.read.parquet(files[k]), names, key) for k, names in fields.items()))


def write_restart(state: DataFrame, files: Mapping[str, str], fields: Mapping[str, Sequence[str]], key: Sequence[str] = KEY, overwrite: bool = False) -> None:
    """The state's fields in the file of each kind, as columns."""
    for kind, names in fields.items():
        wide_form(state.where(F.col("field").isin(list(names))), names, key).write.mode("overwrite" if overwrite else "errorifexists").parquet(files[kind])


def stream_variables(text: str) -> list[str]:
    """The names of a stream list, one to a line; what follows a # doesn't count."""
    return list(dict.fromkeys(n for line in text.splitlines() if (n := line.split("#")[0].strip())))


def stream_file(template: str, at: datetime) -> str:
    """A stream's file at a time: $Y, $M, $D, $h, $m and $s stand for its parts."""
    for sign, form in (("$Y", "%Y"), ("$M", "%m"), ("$D", "%d"), ("$h", "%H"), ("$m", "%M"), ("$s", "%S")):
        template = template.replace(sign, at.strftime(form))
    return template


def read_stream(spark: SparkSession, template: str, at: datetime, variables: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The stream's variables at a time; no other column is read."""
    return spark.read.parquet(stream_file(template, at)).select(*key, *(f"`{v}`" for v in variables))


def write_stream(df: DataFrame, template: str, at: datetime, variables: Sequence[str], key: Sequence[str] = KEY, overwrite: bool = False) -> None:
    df.select(*key, *(f"`{v}`" for v in variables)).write.mode("overwrite" if overwrite else "errorifexists").parquet(stream_file(template, at))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """sensor, channel, value from lines of text with these three words; other lines are left out."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(words) == 3).select(words[0].alias("sensor"), words[1].try_cast("int").alias("channel"), words[2].try_cast("double").alias("value"))
    return rows.where("channel IS NOT NULL AND value IS NOT NULL")


def with_bias(df: DataFrame, coefficients: DataFrame, predictors: Mapping[str, Column], channel: str = "channel", into: str = "bias") -> DataFrame:
    """The sum of predictors times the coefficients (predictor, channel, value) of a row's channel; those that aren't there are 0."""
    by_channel = coefficients.groupBy(F.col("channel").alias("_channel")).pivot("predictor", list(predictors)).agg(F.sum("value"))
    by_channel = by_channel.select("_channel", *(F.col(f"`{p}`").alias(f"_bias_{i}") for i, p in enumerate(predictors)))
    joined = df.join(by_channel, F.col(f"`{channel}`") == F.col("_channel"), "left")
    total = reduce(Column.__add__, (F.coalesce(F.col(f"_bias_{i}"), F.lit(0.0)) * x for i, x in enumerate(predictors.values())))
    return joined.withColumn(into, total).drop("_channel", *(f"_bias_{i}" for i in range(len(predictors))))


def hand_on(df: DataFrame, path: str) -> DataFrame:
    """A table that one application writes and the next reads; an existing one is an error."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def simulated_fields(df: DataFrame, location: str = "Location") -> DataFrame:
    """Location and every `GeoVaLs/` column, as it is saved beside a run."""
    return df.select(location, *(f"`{c}`" for c in df.columns if c.startswith("GeoVaLs/")))
