"""Distances and areas over [longitude, latitude] pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6371008.8


def lon_lat(point: Column) -> tuple[Column, Column]:
    return F.get(point, 0).cast("double"), F.get(point, 1).cast("double")


def radians_between(point: Column, lon: float, lat: float) -> Column:
    x, y = lon_lat(point)
    dy, dx = F.radians(y - lat) / 2, F.radians(x - lon) / 2
    a = F.pow(F.sin(dy), 2) + F.cos(F.radians(y)) * F.cos(F.radians(F.lit(lat))) * F.pow(F.sin(dx), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def metres_between(point: Column, lon: float, lat: float) -> Column:
    return radians_between(point, lon, lat) * EARTH_METRES


def in_box(point: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    x, y = lon_lat(point)
    across = (x >= low[0]) & (x <= high[0]) if low[0] <= high[0] else (x >= low[0]) | (x <= high[0])
    return across & (y >= low[1]) & (y <= high[1])


def in_circle(point: Column, centre: Sequence[float], radius: float) -> Column:
    x, y = lon_lat(point)
    return F.sqrt(F.pow(x - centre[0], 2) + F.pow(y - centre[1], 2)) <= radius


def in_polygon(point: Column, ring: Sequence[Sequence[float]], edges: bool) -> Column:
    """Even-odd rule over the edges of a ring, which need not repeat its first vertex. Points on an edge or vertex are in if edges is true, else out."""
    x, y = lon_lat(point)
    odd, on = F.lit(0), F.lit(0)
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        (ax, ay), (bx, by) = sorted((a, b), key=lambda vertex: vertex[1])
        across, along = (x - ax) * (by - ay), (y - ay) * (bx - ax)  # less: left of the edge; equal: on its line
        on = on + F.when((across == along) & y.between(ay, by) & x.between(min(ax, bx), max(ax, bx)), 1).otherwise(0)
        if ay != by:
            odd = odd + F.when((y >= ay) & (y < by) & (across < along), 1).otherwise(0)
    return (odd % 2 == 1) | (on > 0) if edges else (odd % 2 == 1) & (on == 0)


def compile_within(point: Column, shape: dict, edges: bool = False) -> Column:
    """The edges of polygons, with those of their holes, are not within them, but intersect them (edges is true)."""
    if "$box" in shape:
        return in_box(point, *shape["$box"])
    if "$center" in shape:
        return in_circle(point, *shape["$center"])
    if "$centerSphere" in shape:
        (lon, lat), radius = shape["$centerSphere"]
        return radians_between(point, lon, lat) <= radius
    if "$polygon" in shape:
        return in_polygon(point, shape["$polygon"], edges)
    geometry = shape.get("$geometry", shape)
    if geometry.get("type") == "Polygon":
        outer, *holes = geometry["coordinates"]
        found = in_polygon(point, outer[:-1] if outer[0] == outer[-1] else outer, edges)
        for hole in holes:
            found = found & ~in_polygon(point, hole[:-1] if hole[0] == hole[-1] else hole, not edges)
        return found
    if geometry.get("type") == "Point":
        x, y = lon_lat(point)
        lon, lat = geometry["coordinates"]
        return (x == lon) & (y == lat)
    raise ValueError(f"unknown shape {sorted(shape)}")
