"""Places on the globe as expressions: geohash cells, distances, and the cells of a circle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the digits of a geohash.
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Kilometres of the earth's radius.
EARTH = 6371.0


def _steps(length: int) -> tuple[int, int]:
    """Columns and rows of the globe's grid at a length of geohash: longitude has the odd bit."""
    bits = 5 * length
    return 1 << (bits + 1) // 2, 1 << bits // 2


def _place(value: Column, low: float, span: float, n: int) -> Column:
    """The row or column of a coordinate; the last one holds the upper end."""
    return F.least(F.greatest(F.floor((value - low) / span * n), F.lit(0)), F.lit(n - 1))


def cell_of(column: Column, row: Column, length: int) -> Column:
    """The geohash of a cell of the grid: bits of column and row in turn, five to a digit."""
    bits = 5 * length
    wide, high = (bits + 1) // 2, bits // 2
    bit = lambda k: F.shiftright(column, wide - 1 - k // 2).bitwiseAND(1) if k % 2 == 0 else F.shiftright(row, high - 1 - k // 2).bitwiseAND(1)
    digit = lambda d: sum((bit(5 * d + j) * (1 << (4 - j)) for j in range(1, 5)), bit(5 * d) * 16)
    return F.concat(*(F.substring(F.lit(DIGITS), (digit(d) + 1).cast("int"), F.lit(1)) for d in range(length)))


def geohash(lat: Column, lon: Column, length: int = 4) -> Column:
    """The geohash of a place; null without a coordinate or beyond the globe."""
    wide, high = _steps(length)
    on_globe = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(on_globe, cell_of(_place(lon, -180, 360, wide), _place(lat, -90, 180, high), length))


def distance(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres of the great circle between two places."""
    h = F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cover(circles: DataFrame, length: int = 4) -> DataFrame:
    """``circles`` (lat, lon, radius in km, ...) with ``cell``: a row for each cell that can hold a place of the circle.

    Rows of the grid within the radius, and in each the columns within the circle's greatest half-width; near a pole all
    columns. The antimeridian is no end. A circle without coordinates has no cell.
    """
    wide, high = _steps(length)
    angle = F.col("radius") / EARTH
    degrees = F.degrees(angle) + 1e-9
    low, top = F.col("lat") - degrees, F.col("lat") + degrees
    # The meridians that touch the circle: sin(half width) = sin(angle) / cos(latitude), unless it holds a pole.
    polar = (low <= -90) | (top >= 90) | (angle >= math.pi / 2)
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(F.col("lat")))))) + 1e-9)
    rows = F.sequence(_place(low, -90, 180, high), _place(top, -90, 180, high))
    first, last = F.floor((F.col("lon") - half + 180) / 360 * wide), F.floor((F.col("lon") + half + 180) / 360 * wide)
    columns = F.sequence(first, F.least(last, first + wide - 1))
    out = circles.where("lat is not null and lon is not null and radius >= 0").select("*", F.explode(rows).alias("_row"), columns.alias("_columns")).select("*", F.explode("_columns").alias("_column"))
    return out.select(*circles.columns, cell_of(F.pmod("_column", F.lit(wide)), F.col("_row"), length).alias("cell"))


def within(places: DataFrame, circles: DataFrame, length: int = 4) -> DataFrame:
    """``places`` (lat, lon, ...) within each of ``circles`` (circle, lat, lon, radius), with circle and km: by cells first, then exactly."""
    asked = cover(circles.select("circle", "lat", "lon", "radius"), length).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    at = places.withColumn("cell", geohash(F.col("lat"), F.col("lon"), length))
    # A circle has up to thousands of cells, which no estimate of its size knows: both sides are dealt, none is sent to all.
    near = at.join(asked.hint("merge"), "cell").withColumn("km", distance(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return near.where("km <= radius").select(*places.columns, "circle", "km")
