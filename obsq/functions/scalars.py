"""Scalar functions on Columns. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def hpa_to_pa(p: Column) -> Column:
    return p * 100.0


def celsius_to_kelvin(t: Column) -> Column:
    return t + 273.15


def mg_per_kg(q: Column) -> Column:
    return q * 1e-6


def wind_u(speed: Column, direction: Column) -> Column:
    """Eastward component of a wind from `direction` degrees, as float."""
    return (-speed * F.sin(F.radians(direction))).cast("float")


def wind_v(speed: Column, direction: Column) -> Column:
    return (-speed * F.cos(F.radians(direction))).cast("float")


def date_time(offset_seconds: Column, cycle_epoch: int) -> Column:
    """Epoch seconds: the cycle's plus an offset cut off towards zero."""
    return offset_seconds.cast("long") + F.lit(cycle_epoch).cast("long")


def type_where_valid(value: Column, kind: Column) -> Column:
    """The type where there is a value."""
    return F.when(value.isNotNull(), kind)


def scan_position(x: Column) -> Column:
    """One more than x rounded to whole numbers, halves down."""
    return (F.when(x % 1 > 0.5, F.ceil(x)).otherwise(F.floor(x)) + 1).cast("int")


def cloud_amount(clear: Column) -> Column:
    return F.lit(100.0) - clear


def gate_range(n: Column) -> Column:
    return n * 125.0


def longitude_360(lon: Column) -> Column:
    """In [0, 360), for any longitude."""
    return F.pmod(lon, F.lit(360.0))


def longitude_180(lon: Column) -> Column:
    """Longitudes over 180 less 360."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def temperature(theta: Column, pressure_hpa: Column) -> Column:
    """Of a potential temperature."""
    return theta / F.pow(F.lit(1000.0) / pressure_hpa, F.lit(0.286))


def simulated(obs: Column, omf: Column) -> Column:
    """What was simulated, from the observation and their difference."""
    return -omf + obs


def percent_difference(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(100.0 * (a - b), b)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def type_code(code: Column, name: Column) -> Column:
    """Codes under 100 get 200 more for winds and 100 more for the rest."""
    return F.when(code < 100, code + F.when(name.startswith("wind"), 200).otherwise(100)).otherwise(code)


def magnitude_floor(v: Column) -> Column:
    """Down to a multiple of the power of ten of the value's magnitude; 0 stays."""
    m = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).otherwise(F.floor(v / m) * m)


def magnitude_ceil(v: Column) -> Column:
    m = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).otherwise(F.ceil(v / m) * m)


def mask_large(x: Column, most: float = 999.0) -> Column:
    """Null over `most`."""
    return F.when(x <= most, x)


def channel_slice(values: Column, first: int, last: int) -> Column:
    """Channels first to last of an array that begins with channel 1."""
    return F.slice(values, first, last - first + 1)


def file_cycle(path: Column) -> Column:
    """The part of a file name before its ending."""
    return F.split_part(path, F.lit("."), F.lit(-2))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def contour_levels(c: float, step: float) -> list[float]:
    """From -c up to c, in steps of a part of c."""
    n = round(2 * c / (step * c)) if c else 0
    return [-c + i * step * c for i in range(n + 1)]


# Dates of cycles, on the driver.
def cycle(text: str) -> datetime:
    """`YYYYMMDDHH`"""
    return datetime.strptime(text, "%Y%m%d%H")


def cycle_window(text: str, hours: int) -> tuple[datetime, datetime]:
    """Of `hours` hours with the cycle in its middle."""
    t, half = cycle(text), timedelta(hours=hours / 2)
    return t - half, t + half


def to_ymdh(t: datetime) -> str:
    return t.strftime("%Y%m%d%H")


def to_isotime(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def to_model_time(t: datetime) -> str:
    return t.strftime("%Y%m%d.%H%M%S")


def radians(degrees: Column) -> Column:
    return F.radians(degrees)


def filled(value, kind: str = "float") -> Column:
    """A constant of a kind in every row."""
    return F.lit(value).cast(kind)
