"""Column expressions for places on the earth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KM = 6371.0
METRES = 6_371_000.0
CELL = 0.01
COLUMNS = 36_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = KM) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def flat_metres(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane, for points a few kilometres apart."""
    dy = (lat2 - lat) * 111_320.0
    dx = (lon2 - lon) * 111_320.0 * F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    return F.sqrt(dx * dx + dy * dy)


def squared(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Squared planar distance in degrees, longitude scaled by the latitude."""
    dx = (lon - lon2) * F.cos(F.radians(lat))
    return (lat - lat2) * (lat - lat2) + dx * dx


def cell_row(lat: Column) -> Column:
    return F.floor((lat + 90.0) / CELL).cast("long")


def cell_column(lon: Column) -> Column:
    return F.floor((lon + 180.0) / CELL).cast("long")


def cell(row: Column, column: Column) -> Column:
    clamp = lambda x, most: F.greatest(F.lit(0), F.least(x, F.lit(most)))
    return (clamp(row, 17_999) * COLUMNS + clamp(column, COLUMNS - 1)).cast("long")


def cell_of(lat: Column, lon: Column) -> Column:
    return cell(cell_row(lat), cell_column(lon))


def cells_around(lat: Column, lon: Column, ring: int) -> Column:
    """The distinct cells of the square of ``ring`` cells around a point, with the ring of each."""
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    row, column = cell_row(lat), cell_column(lon)

    def line(d: Column) -> Column:
        return F.transform(
            steps, lambda e: F.struct(cell(row + d, column + e).alias("cell"), F.greatest(F.abs(d), F.abs(e)).cast("int").alias("ring"))
        )

    return F.flatten(F.transform(steps, line))


def valid(lat: Column, lon: Column) -> Column:
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def inside_rings(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd rule: is the point (whole numbers) inside ``rings``, arrays of (lat, lon) structs?"""

    def crossings(ring: Column) -> Column:
        size = F.size(ring)
        edges = F.transform(
            F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
            lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + size - 1, F.greatest(size, F.lit(1)))).alias("b")),
        )

        def crossed(e: Column) -> Column:
            a, b = e["a"], e["b"]
            spans = (a["lat"] > lat) != (b["lat"] > lat)
            at = (b["lon"] - a["lon"]).cast("double") * (lat - a["lat"]).cast("double") / (b["lat"] - a["lat"]).cast("double") + a["lon"]
            return F.when(spans, lon.cast("double") < at).otherwise(F.lit(False))

        return F.size(F.filter(edges, crossed))

    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1


def nearest_by_cells(left: DataFrame, right: DataFrame, key: str, scale: float, ring: int, score, ties: list[Column]) -> DataFrame:
    """For each ``key`` of ``left``, the row of ``right`` within ``ring`` grid cells with the least ``score(lat, lon, row)``.

    Both sides have lat and lon.  The neighbourhood is written out as cells on the smaller side, so that the join
    is on equal cells and never compares all rows with all rows.
    """
    from waymark.plans.grid import grid_join

    joined = grid_join(left, right, scale, ring)
    best = F.min_by(F.struct(*[F.col(f"r_{c}").alias(c) for c in right.columns]), F.struct(score, *ties))
    return joined.groupBy(key).agg(best.alias("nearest"))
