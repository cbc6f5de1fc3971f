"""Filters by boxes: plain comparisons, so that they reach the scan and prune its row groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Box = tuple[float, float, float, float]  # west, south, east, north


def inside(lon: Column, lat: Column, box: Box) -> Column:
    west, south, east, north = box
    return (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)


def region(rows: DataFrame, box: Box, without: list[Box] = (), lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows in ``box``, borders included, and in none of the boxes ``without``."""
    x, y = F.col(lon), F.col(lat)
    return rows.where(reduce(lambda c, b: c & ~inside(x, y, b), without, inside(x, y, box)))


def of_countries(rows: DataFrame, boxes: dict[str, Box], country: str = "country", bbox: str = "bbox") -> DataFrame:
    """Rows of each named country whose own box (struct xmin, ymin, xmax, ymax) meets the country's: one scan for all."""
    b = F.col(bbox)

    def one(name: str, box: Box) -> Column:
        west, south, east, north = box
        return (F.upper(country) == name) & (b["xmin"] <= east) & (b["xmax"] >= west) & (b["ymin"] <= north) & (b["ymax"] >= south)

    return rows.where(reduce(Column.__or__, (one(n, x) for n, x in sorted(boxes.items())), F.lit(False)))
