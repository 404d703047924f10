"""Two tables side by side: two systems' results, an analysis and its background, positions that should agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.functions.geometry import EARTH_KM


def paired(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The key and `<name>/<column>` of both tables, where both have the key."""
    left, right = (df.select(*key, *(F.col(f"`{c}`").alias(f"{n}/{c}") for c in columns)) for df, n in zip((a, b), names))
    return left.join(right, list(key))


def increment(analysis: DataFrame, background: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Analysis less background where both have the key."""
    both = paired(analysis, background, key, [value])
    return both.select(*key, (F.col(f"`a/{value}`") - F.col(f"`b/{value}`")).alias("increment"))


def apart(a: DataFrame, b: DataFrame, key: Sequence[str], lon: str, lat: str) -> DataFrame:
    """The rows that both tables have whose positions differ, or are null in one of them; none where they agree."""
    both = paired(a, b, key, [lon, lat])
    return both.where(~(F.col(f"`a/{lon}`").eqNullSafe(F.col(f"`b/{lon}`")) & F.col(f"`a/{lat}`").eqNullSafe(F.col(f"`b/{lat}`"))))


def round_robin(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out evenly, whatever they hold."""
    return df.repartition(parts)


def halo(df: DataFrame, lon: str, lat: str, tile: float, radius_km: float) -> DataFrame:
    """Each row in its own tile of `tile` degrees, and again, with `ghost`, in each tile that it may be within the radius of.

    tile_x counts from longitude 0 eastwards, tile_y from the south pole. A tile so holds whatever is within the radius of a row of its
    own, and can be worked through alone. Rows without a place are left out. 360 must be a multiple of `tile`.
    """
    if 360 % tile or radius_km < 0:
        raise ValueError("360 must be a multiple of the tile, and the radius no less than 0")
    wide, reach = int(360 / tile), F.degrees(F.lit(radius_km / EARTH_KM))
    high = -int(-180 // tile)
    x, y = F.pmod(F.col(f"`{lon}`").cast("double"), F.lit(360.0)), F.col(f"`{lat}`").cast("double")
    placed = df.where(x.isNotNull() & y.isNotNull())
    polar = F.abs(y) + reach >= 90
    aside = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(y))))))

    def row_of(at):
        return F.least(F.greatest(F.floor((at + 90) / tile), F.lit(0)), F.lit(high - 1)).cast("int")

    columns = F.when(polar | (aside * 2 + tile >= 360), F.sequence(F.lit(0), F.lit(wide - 1))).otherwise(
        F.transform(F.sequence(F.floor((x - aside) / tile).cast("int"), F.floor((x + aside) / tile).cast("int")), lambda c: F.pmod(c, F.lit(wide)))
    )
    out = placed.select("*", F.explode(F.array_distinct(columns)).alias("tile_x")).select("*", F.explode(F.sequence(row_of(y - reach), row_of(y + reach))).alias("tile_y"))
    own = (F.col("tile_x") == F.floor(x / tile)) & (F.col("tile_y") == row_of(y))
    return out.withColumn("ghost", ~own)
