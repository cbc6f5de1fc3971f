"""From points to the nearest addresses.

Houses stay rows.  They are grouped by the grid cell of their street, which decides whether a point may see them, and by
finer tiles of their own position, in as many levels as the densest places need.  A point first meets the tiles around it,
as boxes with a count: the k-th address can be no farther than the far corners of the nearest boxes that hold k, so only
boxes that begin within that distance are opened, level by level, and only houses within it are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waymark.functions import geo
from waymark.operators.gazetteer import Gazetteer
from waymark.runtime import materialize

RINGS = (1, 2, 4)
ENOUGH = 3
MAX_K = 100
#: Tiles of a degree, by level.  A level is made while boxes of the one before hold more than FULL positions, as seen by a position.
TILES = (500, 2_000, 8_000, 32_000)
FULL = 8
#: Metres that rounding of distances may add.
SLACK = 0.001


@dataclass(frozen=True)
class Nearby:
    """cells (streets of a grid cell, counted), boxes by level (of each cell and tile, in the tile ``up`` of the level before) and houses.

    Houses have the cell of their street and the tile of the last level.  Of addresses at one point in a cell the first MAX_K
    are kept, in their ``turn``: k others there come before any address whose turn is beyond k.
    """

    cells: DataFrame
    boxes: list[DataFrame]
    houses: DataFrame


def _tile(level: int) -> Column:
    side = lambda c: F.floor(F.col(c) / F.lit(10_000_000 / TILES[level])).cast("long")
    return side("lat_e7") * F.lit(1 << 32) + side("lon_e7")


def nearby_of(gaz: Gazetteer) -> Nearby:
    """What points are looked up in, written once."""
    address = ["street_norm", "code", "numero", "rep"]
    houses = gaz.houses.select(*address, "lon_e7", "lat_e7", "postcode").join(gaz.streets.select("street_norm", "code", "cell"), ["street_norm", "code"])
    spots = houses.groupBy("cell", "lon_e7", "lat_e7", *address).agg(F.min("postcode").alias("postcode"))
    turn = F.row_number().over(W.partitionBy("cell", "lon_e7", "lat_e7").orderBy(*address))
    spots = materialize(spots.withColumn("turn", turn).where(F.col("turn") <= MAX_K), "nearby-houses")
    # an address with several positions counts in the tile of one of them: its nearest is no farther than that
    first = spots.groupBy("cell", *address).agg(F.min(F.struct("lon_e7", "lat_e7")).alias("p")).select("cell", "p.*")
    levels = []
    for level in range(len(TILES)):
        keys = ["cell", _tile(level - 1 if level else 0).alias("up"), _tile(level).alias("tile")]
        extent = lambda suffix: [f(c).alias(f"{n}_{c[:3]}{suffix}") for c in ("lat_e7", "lon_e7") for f, n in ((F.min, "least"), (F.max, "most"))]
        counted = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *extent(""))
        each = spots.groupBy(*keys, *address).agg(F.count_if(F.col("turn") == 1).alias("places"), *extent("_all"))
        widest = [f(f"{n}_{c}_all").alias(f"{n}_{c}_all") for c in ("lat", "lon") for f, n in ((F.min, "least"), (F.max, "most"))]
        every = each.groupBy(*keys[:1], "up", "tile").agg(F.count(F.lit(1)).alias("own"), F.sum("places").alias("places"), *widest)
        levels.append(materialize(every.join(counted, ["cell", "up", "tile"], "left").fillna(0, ["n"]), f"nearby-boxes-{level}"))
        full = levels[-1].agg((F.sum(F.col("places") * F.col("places")) / F.sum("places")).alias("full")).first()["full"]
        if full is None or full <= FULL:
            break
    spots = materialize(spots.withColumn("tile", _tile(len(levels) - 1)), "nearby-spots")
    return Nearby(materialize(gaz.streets.groupBy("cell").agg(F.count(F.lit(1)).alias("n_streets")), "nearby-cells"), levels, spots)


def _metres(dx: Column, dy: Column) -> Column:
    dx, dy = dx * 111_320.0 * F.greatest(F.cos(F.radians("lat")), F.lit(0.01)), dy * 111_320.0
    return F.sqrt(dx * dx + dy * dy)


def _deg(c: str) -> Column:
    return F.col(c) / 1e7


def _opened(seen: DataFrame, k: int) -> DataFrame:
    """Of the boxes that places see those that begin within ``bound``, which is lowered to the far corners of the nearest that hold k."""
    gap = lambda c: F.greatest(F.lit(0.0), _deg(f"least_{c}_all") - F.col(c), F.col(c) - _deg(f"most_{c}_all"))
    reach = lambda c, s="": F.greatest(F.abs(_deg(f"least_{c}{s}") - F.col(c)), F.abs(_deg(f"most_{c}{s}") - F.col(c)))
    seen = seen.select(
        "lat", "lon", "cell", "tile", "n", "bound", _metres(gap("lon"), gap("lat")).alias("from"),
        F.when(F.col("n") > 0, _metres(reach("lon"), reach("lat"))).alias("to"), F.when(F.col("own") >= k, _metres(reach("lon", "_all"), reach("lat", "_all"))).alias("alone"),
    ).where(F.col("from") <= F.col("bound"))
    nearest = W.partitionBy("lat", "lon").orderBy(F.asc_nulls_last("to"), "cell", "tile")
    so_far = F.sum("n").over(nearest.rowsBetween(W.unboundedPreceding, 0))
    # n counts an address once over all boxes; where it has positions in many, a box that holds k by itself says more
    own = F.min(F.least(F.when(F.col("so_far") >= k, F.col("to")), F.col("alone"))).over(W.partitionBy("lat", "lon"))
    seen = seen.withColumn("so_far", so_far).withColumn("own", F.coalesce(own, F.lit(float("inf"))) + SLACK)
    return seen.withColumn("bound", F.least("bound", "own")).where(F.col("from") <= F.col("bound")).select("lat", "lon", "cell", "tile", "bound")


def hoods(points: DataFrame, cells: DataFrame) -> DataFrame:
    """home, cell: the grid cells that points of each home cell see, in the smallest of RINGS with ENOUGH streets (else the largest)."""
    homes = points.groupBy("home").agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("p"))
    around = homes.select("home", F.explode(geo.cells_around(F.col("p.lat"), F.col("p.lon"), RINGS[-1])).alias("near"))
    around = around.groupBy("home", "near.cell").agg(F.min("near.ring").alias("ring")).join(cells, "cell")
    w = W.partitionBy("home")
    ring = F.lit(RINGS[-1])
    for r in reversed(RINGS[:-1]):
        ring = F.when(F.sum(F.when(F.col("ring") <= r, F.col("n_streets")).otherwise(0)).over(w) >= ENOUGH, r).otherwise(ring)
    return around.withColumn("most", ring).where(F.col("ring") <= F.col("most")).select("home", "cell")


def reverse(points: DataFrame, gaz: Gazetteer, k: int = 3, nearby: Nearby | None = None) -> DataFrame:
    """point_id and the k nearest addresses for points (point_id, lat, lon).

    Streets are those whose centroid lies in the cells around the point, in the smallest of RINGS that holds ENOUGH
    of them (else the largest).  Of rows with one number and suffix on a street the nearest counts.
    Distances count to the micrometre, and ties go to the smaller coordinates.  A point that isn't valid is an error.
    """
    k = min(k, MAX_K)
    nearby = nearby or nearby_of(gaz)
    ok = geo.valid(F.col("lat"), F.col("lon"))
    points = points.select("point_id", F.when(ok, F.col("lat")).otherwise(F.raise_error(F.lit("coordinates out of range"))).alias("lat"), "lon")
    # each place is looked up once, however many points are there
    at = ["lat", "lon"]
    asked = materialize(points.select(*at).distinct().withColumn("home", geo.cell_of(F.col("lat"), F.col("lon"))), "reverse-places")
    # distinct home cells and what they see
    hood = materialize(hoods(asked, nearby.cells), "reverse-hoods")

    opened = asked.join(hood, "home").select(*at, "cell", F.lit(float("inf")).alias("bound"))
    for level, boxes in enumerate(nearby.boxes):
        seen = opened.join(boxes, "cell") if level == 0 else opened.withColumnRenamed("tile", "up").join(boxes, ["cell", "up"])
        opened = _opened(seen, k)

    dist = _metres(_deg("lon_e7") - F.col("lon"), _deg("lat_e7") - F.col("lat"))
    houses = opened.join(nearby.houses.where(F.col("turn") <= k), ["cell", "tile"])
    # to the micrometre, without the decimals that round() goes through
    houses = houses.withColumn("dist", F.floor(dist * 1e6 + F.lit(0.5)) / 1e6).where(F.col("dist") <= F.col("bound"))
    spot = F.struct("dist", "lon_e7", "lat_e7", "postcode")
    near = houses.groupBy(*at, "street_norm", "code", "numero", "rep").agg(F.min(spot).alias("b"))
    order = W.partitionBy(*at).orderBy("b.dist", "b.lon_e7", "b.lat_e7", "street_norm", "code", "numero", "rep")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*at, "rank", "street_norm", "code", "numero", "rep", "b.*")
    info = gaz.streets.select("street_norm", "code", "street", "commune", "pc_ambiguous", F.col("postcode").alias("s_postcode"))
    out = points.join(near.join(info, ["street_norm", "code"]), at)
    precision = F.when(F.col("dist") <= 50, "house").when(F.col("dist") <= 250, "near").otherwise("approximate")
    return out.select(
        "point_id", "rank", precision.alias("precision"), F.greatest(F.least(F.lit(0.97) - F.col("dist") / 500.0, F.lit(0.95)), F.lit(0.1)).alias("confidence"),
        "street", F.concat(F.col("numero").cast("string"), "rep").alias("housenumber"), "commune",
        F.when(F.col("pc_ambiguous"), F.col("postcode")).otherwise(F.col("s_postcode")).alias("postcode"),
        (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"), F.col("dist").alias("distance_m"),
    )
