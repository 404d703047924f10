"""Linear observation operators as tables of weights, the cost of a state, and its minimum by conjugate gradients.

cells: cell, background, variance. obs: obs_id, observed, variance. weights: obs_id, cell, weight, a row for each part that
a cell has in an observation. The background's errors are uncorrelated here. Only sums come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.sources.files import shared_folder


def applied(weights: DataFrame, field: DataFrame, x: str = "x") -> DataFrame:
    """obs_id, y: the operator on a field (cell, x). Observations without a cell of the field are left out."""
    return weights.join(field.select("cell", F.col(x).alias("_x")), "cell").groupBy("obs_id").agg(F.sum(F.col("weight") * F.col("_x")).alias("y"))


def adjoint(weights: DataFrame, values: DataFrame, y: str = "y") -> DataFrame:
    """cell, x: the transpose of the operator on values (obs_id, y)."""
    return weights.join(values.select("obs_id", F.col(y).alias("_y")), "obs_id").groupBy("cell").agg(F.sum(F.col("weight") * F.col("_y")).alias("x"))


def cost(cells: DataFrame, obs: DataFrame, weights: DataFrame, state: DataFrame) -> DataFrame:
    """jb, jo, j of a state (cell, x): halves of the squared distances from background and observations, by their errors."""
    jb = cells.join(state, "cell").select((F.pow(F.col("x") - F.col("background"), 2) / F.col("variance") / 2).alias("jb"), F.lit(0.0).alias("jo"))
    jo = obs.join(applied(weights, state), "obs_id").select(F.lit(0.0).alias("jb"), (F.pow(F.col("observed") - F.col("y"), 2) / F.col("variance") / 2).alias("jo"))
    both = jb.unionAll(jo).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("jb", "jo")))
    return both.withColumn("j", F.col("jb") + F.col("jo"))


@dataclass(frozen=True)
class Analysis:
    """cell, background, analysis; with how many iterations it took and how far the gradient's norm fell."""

    state: DataFrame
    iterations: int
    reduction: float


def minimise(cells: DataFrame, obs: DataFrame, weights: DataFrame, ninner: int = 50, reduction: float = 1e-3) -> Analysis:
    """The state of least cost, by conjugate gradients in units of the background's errors.

    It ends after `ninner` iterations, or once the gradient's norm has fallen by `reduction`. Every iteration is one table in
    the shared folder, so its plan doesn't grow and a lost executor costs that iteration alone. Null observations, those
    without cells and those whose cells aren't all there don't count; cells that nothing observes keep their background.
    """
    spark = cells.sparkSession
    top = shared_folder(spark, "minimise")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.parquet(f"{top}/{name}")

    def total(x: Column, df: DataFrame) -> float:
        return df.agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("s")).first()["s"]

    known = cells.where("background IS NOT NULL AND variance > 0")
    seen = obs.where("observed IS NOT NULL AND variance > 0").select("obs_id", "observed", F.sqrt("variance").alias("error"))
    parts = weights.join(known.select("cell", "background", F.sqrt("variance").alias("spread")), "cell", "left")
    short = parts.where("spread IS NULL").select("obs_id").distinct()
    parts = parts.join(seen, "obs_id").join(short, "obs_id", "left_anti")
    scaled = written(parts.select("obs_id", "cell", (F.col("weight") * F.col("spread") / F.col("error")).alias("weight"), (F.col("weight") * F.col("background") / F.col("error")).alias("part"), (F.col("observed") / F.col("error")).alias("seen")), "operator")
    departures = scaled.groupBy("obs_id").agg((F.first("seen") - F.sum("part")).alias("y"))
    steps = adjoint(scaled, departures).select("cell", F.lit(0.0).alias("v"), F.col("x").alias("r"), F.col("x").alias("p"))
    now = written(steps, "start")
    first = left = total(F.col("r") * F.col("r"), now)
    done = 0
    while done < ninner and left > reduction * reduction * first:
        curved = adjoint(scaled, applied(scaled, now, "p")).withColumnRenamed("x", "q")
        with_q = written(now.join(curved, "cell").select("cell", "v", "r", "p", (F.col("q") + F.col("p")).alias("q")), f"iteration_{done}")
        alpha = left / total(F.col("p") * F.col("q"), with_q)
        rest = F.col("r") - alpha * F.col("q")
        after = total(rest * rest, with_q)
        now = with_q.select("cell", (F.col("v") + alpha * F.col("p")).alias("v"), rest.alias("r"), (rest + (after / left) * F.col("p")).alias("p"))
        left, done = after, done + 1
    moved = cells.join(now.select("cell", "v"), "cell", "left").select("cell", "background", (F.col("background") + F.coalesce(F.sqrt("variance") * F.col("v"), F.lit(0.0))).alias("analysis"))
    return Analysis(moved, done, (left / first) ** 0.5 if first else 0.0)
