"""Readers and writers of observation tables, states and ensembles. Parquet is the canonical format."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows of the declared schema where the file is missing."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_space(spark: SparkSession, path: str, columns: Sequence[str] | None = None, subsets: Sequence[str] | None = None) -> DataFrame:
    """Named columns of named message subsets; both reach the scan."""
    df = spark.read.parquet(path)
    if subsets is not None:
        df = df.where(F.col("subset").isin(list(subsets)))
    return df if columns is None else df.select(*(f"`{c}`" for c in columns))


def write_space(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def split_by(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key the configuration has, with its columns; other rows are left out."""
    return df.join(dim, key, "inner")


def write_split(df: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(key).parquet(path)


def subset(df: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Selected rows with every column, and counts of included, excluded and all rows."""
    n = df.agg(F.count(F.when(inside, 1)).alias("included"), F.count(F.when(~inside, 1)).alias("excluded"), F.count("*").alias("total"))
    return df.where(inside), n


def grid(df: DataFrame) -> DataFrame:
    """lon and lat in degrees, of either kind of grid table."""
    have = set(df.columns)
    if {"grid_lon", "grid_lat"} <= have:
        return df.withColumns({"lon": F.col("grid_lon"), "lat": F.col("grid_lat")})
    if {"lonCell", "latCell"} <= have:
        return df.withColumns({"lon": F.degrees("lonCell"), "lat": F.degrees("latCell")})
    raise ValueError("neither kind of grid")


def member_paths(pattern: str, members: int, padding: int = 3, start: int = 1) -> list[str]:
    return [pattern.replace("%iMember%", str(i).zfill(padding)) for i in range(start, start + members)]


def read_ensemble(spark: SparkSession, pattern: str, members: int, padding: int = 3, start: int = 1) -> DataFrame:
    """All members, with their number; shorter padding is tried where the named files are missing."""
    for pad in dict.fromkeys((padding, *range(padding - 1, 0, -1))):
        paths = member_paths(pattern, members, pad, start)
        if exists(spark, paths[0]):
            at = re.escape(pattern.split("%iMember%")[0].rsplit("/", 1)[-1]) + r"0*(\d+)"
            return spark.read.parquet(*paths).withColumn("member", F.regexp_extract(F.input_file_name(), at, 1).cast("int"))
    raise FileNotFoundError(pattern)


def differences(a: DataFrame, b: DataFrame, key: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows of either table that the other lacks or has with values farther apart than the tolerance; schemas must agree."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise ValueError("the schemas differ")
    rest = [c for c in a.columns if c not in key]
    both = a.alias("a").join(b.alias("b"), list(key), "full_outer")
    numeric = {f.name for f in a.schema if isinstance(f.dataType, T.NumericType)}
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance if c in numeric else F.lit(False)) for c in rest]
    wrong = F.lit(False)
    for s in same:
        wrong = wrong | ~F.coalesce(s, F.lit(False))
    return both.where(wrong).select(*key)


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows there are of each combination that is there more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def with_attributes(df: DataFrame, attributes: Mapping[str, Mapping]) -> DataFrame:
    """Columns with units, names and ranges as metadata."""
    return df.select(*(F.col(f"`{c}`").alias(c, metadata=dict(attributes[c])) if c in attributes else F.col(f"`{c}`") for c in df.columns))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; a temporary one only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='obsq-shared-')}"
    return f"{base.rstrip('/')}/obsq-{name}-{uuid.uuid4().hex[:12]}"
