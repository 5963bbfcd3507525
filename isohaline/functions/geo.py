"""Column expressions for positions on the sphere and the 2-degree grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohaline.vocabulary import (
    CELL_DEGREES,
    EARTH_RADIUS_KM,
    ENVELOPE_EAST,
    ENVELOPE_NORTH,
    ENVELOPE_SOUTH,
    ENVELOPE_WEST,
)


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180); +180 becomes -180."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; stays inside whole-stage codegen."""
    half_dlat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_dlon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0))))


def half_height(radius_km: Column) -> Column:
    """Degrees of latitude covered by a radius."""
    return radius_km / F.lit(110.574)


def half_width(lat: Column, radius_km: Column) -> Column:
    """Degrees of longitude covered by a radius at the anchor's latitude, floored near the poles."""
    return radius_km / (F.lit(111.320) * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.2)))


def cell_index(x: Column) -> Column:
    """Index of the grid cell that holds ``x``."""
    return F.floor(x / F.lit(float(CELL_DEGREES))).cast("int")


def _spread(x: Column) -> Column:
    """The low eight bits of ``x``, moved to the even places."""
    for shift, mask in ((4, 0x0F0F), (2, 0x3333), (1, 0x5555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve_cell(cy: Column, cx: Column) -> Column:
    """Place of a grid cell on the Z-order curve: near cells mostly have near numbers, 0 to 65535."""
    rows, columns = 90 // CELL_DEGREES, 180 // CELL_DEGREES
    return F.shiftleft(_spread(cy + F.lit(rows)), 1).bitwiseOR(_spread(cx + F.lit(columns)))


def curve_block(cell: Column) -> Column:
    """The stretch of 64 cells (8 by 8) of the curve that holds a cell."""
    return F.shiftright(cell, 6)


def cell_edge(x: Column) -> Column:
    """Lower edge of the grid cell that holds ``x``, in degrees."""
    return (F.floor(x / F.lit(float(CELL_DEGREES))) * F.lit(CELL_DEGREES)).cast("double")


def grid_id(lat_edge: Column, lon_edge: Column) -> Column:
    return F.concat(
        F.lit("grid-"), lat_edge.cast("int").cast("string"), F.lit("-"), lon_edge.cast("int").cast("string")
    )


def cell_bounds(lat_edge: Column, lon_edge: Column) -> Column:
    size = F.lit(float(CELL_DEGREES))
    return F.struct(
        lat_edge.alias("south"), lon_edge.alias("west"),
        (lat_edge + size).alias("north"), (lon_edge + size).alias("east"),
    )


def in_box(lat: Column, lon: Column, south, north, west, east) -> Column:
    """Inclusive rectangle; with literal bounds it is pushed into the Parquet scan."""
    return (lat >= south) & (lat <= north) & (lon >= west) & (lon <= east)


def in_envelope(lat: Column, lon: Column) -> Column:
    return in_box(
        lat, lon, F.lit(ENVELOPE_SOUTH), F.lit(ENVELOPE_NORTH), F.lit(ENVELOPE_WEST), F.lit(ENVELOPE_EAST)
    )
