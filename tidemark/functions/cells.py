"""Places in cells: numbers along a space-filling curve, covers of circles and boxes by ranges of them, joins by distance.

A cell number interleaves the bits of longitude and latitude, so places near each other mostly have near numbers, and
rows written in the order of cells have narrow ranges of them in each file and row group: a range of cells in a filter
lets Parquet skip the others. A circle or box is covered by a few ranges; the exact test follows on what is left.

Joins by distance use bands of latitude, each at least as high as the distance, with as many columns as fit of that
width at the band's narrowest parallel. A place of the right side lies in one cell of them, one of the left looks into
the cells of three bands that a place so near can lie in, over the date line and round the poles too, so each pair
meets once. Only distinct places meet there; their rows follow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import RADIUS, haversine
from tidemark.session import new_path

#: Rows of either side that meet in a block of a join by distance, and the most tasks that blocks are dealt to.
_BLOCK, _MOST_PARTS = 1_000, 8192
BITS = 26  # of each coordinate: cells of about 0.6 by 0.3 m
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _grid(x: Column, low: float, wide: float) -> Column:
    at = F.floor((x - low) / wide * (1 << BITS))
    return F.least(F.greatest(at, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def _spread(x: Column) -> Column:
    steps = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m in _SPREAD))
    return F.aggregate(steps, x, lambda a, k: a.bitwiseOR(F.call_function("shiftleft", a, k["s"])).bitwiseAND(k["m"]))


def cell(lon: Column, lat: Column) -> Column:
    """Number of the cell that holds a place, below 2**52."""
    return _spread(_grid(lon, -180, 360)).bitwiseOR(F.shiftleft(_spread(_grid(lat, -90, 180)), 1))


def cover(west: float, south: float, east: float, north: float, most: int = 32) -> list[tuple[int, int]]:
    """At most so many ranges [first, last] of cells that hold the box, from larger squares to smaller ones."""
    n = 1 << BITS
    grid = lambda x, low, wide: min(max(math.floor((x - low) / wide * n), 0), n - 1)
    x0, x1, y0, y1 = grid(west, -180, 360), grid(east, -180, 360), grid(south, -90, 180), grid(north, -90, 180)
    squares = [(0, 0, BITS)]  # x, y in units of 2**level, and the level
    while True:
        finer, split = [], False
        for x, y, k in squares:
            ax, bx, ay, by = x << k, ((x + 1) << k) - 1, y << k, ((y + 1) << k) - 1
            if bx < x0 or ax > x1 or by < y0 or ay > y1:
                continue
            if k == 0 or (x0 <= ax and bx <= x1 and y0 <= ay and by <= y1):
                finer.append((x, y, k))
            else:
                split = True
                finer += [(2 * x + i, 2 * y + j, k - 1) for j in (0, 1) for i in (0, 1)]
        finer = [(x, y, k) for x, y, k in finer if not (((x + 1) << k) - 1 < x0 or x << k > x1 or ((y + 1) << k) - 1 < y0 or y << k > y1)]
        if len(_ranges(finer)) > most and len(_ranges(squares)) <= most:
            return _ranges(squares)
        squares = finer
        if not split:
            return _ranges(squares)


def _ranges(squares: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, size in sorted((_interleave(x << k, y << k), 1 << 2 * k) for x, y, k in squares):
        if out and out[-1][1] + 1 == first:
            out[-1][1] = first + size - 1
        else:
            out.append([first, first + size - 1])
    return [tuple(r) for r in out]


def _interleave(x: int, y: int) -> int:
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(BITS))


def _angle(metres: float) -> float:
    return min(math.pi, metres / RADIUS)


def boxes(lon: float, lat: float, metres: float) -> list[tuple[float, float, float, float]]:
    """One or two boxes (west, south, east, north) that hold the circle: two where it crosses the date line."""
    d = _angle(metres)
    high = math.degrees(d) * (1 + 1e-9) + 1e-9
    south, north = lat - high, lat + high
    if south <= -90 or north >= 90:
        return [(-180.0, max(south, -90.0), 180.0, min(north, 90.0))]
    wide = math.degrees(math.asin(min(1.0, math.sin(d) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
    west, east = lon - wide, lon + wide
    if west < -180:
        return [(-180.0, south, east, north), (west + 360, south, 180.0, north)]
    if east > 180:
        return [(west, south, 180.0, north), (-180.0, south, east - 360, north)]
    return [(west, south, east, north)]


def in_cells(column: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((column >= a) & (column <= b))
    return out


def within_by_cells(rows: DataFrame, cells: str, lon: Column, lat: Column, lon0: float, lat0: float, metres: float) -> DataFrame:
    """Rows at most so far from a place, of a table that has its cells in a column: ranges of cells come first."""
    ranges = [r for box in boxes(lon0, lat0, metres) for r in cover(*box)]
    return rows.where(in_cells(F.col(cells), ranges)).where(haversine(lon, lat, F.lit(lon0), F.lit(lat0)) <= metres)


def write_by_cells(rows: DataFrame, path: str, lon: Column, lat: Column, name: str = "cell", files: int | None = None) -> None:
    """Write rows in the order of their cells, with them as a column."""
    placed = rows.withColumn(name, cell(lon, lat))
    dealt = placed.repartitionByRange(files, name) if files else placed.repartitionByRange(name)
    dealt.sortWithinPartitions(name).write.parquet(path)


# joins -----------------------------------------------------------------------------------------------------


class Bands:
    """Bands of latitude and their columns for a distance, as expressions."""

    def __init__(self, metres: float):
        self.metres = metres
        self.step = _angle(metres)
        self.count = max(1, min(1 << 24, math.floor(math.pi / max(self.step * (1 + 1e-9), 1e-7))))
        self.high = 180.0 / self.count

    def of(self, lat: Column) -> Column:
        return F.least(F.greatest(F.floor((lat + 90) / self.high), F.lit(0)), F.lit(self.count - 1)).cast("long")

    def narrowest(self, band: Column) -> Column:
        """Cosine of the band's parallel next to a pole, nought at the poles."""
        edge = F.greatest(F.abs(band * self.high - 90), F.abs((band + 1) * self.high - 90))
        return F.greatest(F.cos(F.radians(edge)), F.lit(0.0))

    def columns(self, band: Column) -> Column:
        wide = F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(self.step, math.pi / 2))) / F.greatest(self.narrowest(band), F.lit(1e-12))))
        return F.greatest(F.lit(1), F.floor(2 * math.pi / F.greatest(wide, F.lit(1e-7)))).cast("long")

    def column(self, lon: Column, band: Column) -> Column:
        n = self.columns(band)
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)

    def reached(self, lon: Column, lat: Column) -> Column:
        """(band, column) of all cells that a place within the distance can lie in, each once."""
        own = self.of(lat)

        def cells(band: Column) -> Column:
            n = self.columns(band)
            # two places at an angle d and latitudes a, b differ in longitude by x with sin(x / 2)**2 <= sin(d / 2)**2 / (cos a * cos b)
            ratio = math.sin(self.step / 2) / F.sqrt(F.greatest(F.cos(F.radians(lat)) * self.narrowest(band), F.lit(1e-24)))
            wide = F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * (1 + 1e-9) + 1e-9
            first, last = (F.floor((lon + s * wide + 180) / 360 * n).cast("long") for s in (-1, 1))
            last = F.least(last, first + n - 1)  # round the world once
            return F.transform(F.sequence(first, last), lambda c: F.struct(band.alias("band"), F.pmod(c, n).alias("column")))

        near = F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.lit(self.count - 1)))
        return F.flatten(F.transform(near, cells))


def _on_earth(at: tuple[str, str]) -> Column:
    return F.col(at[0]).between(-180, 180) & F.col(at[1]).between(-90, 90)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """What is read more than once, written to the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _points(rows: DataFrame, at: tuple[str, str]) -> DataFrame:
    """(x, y, n): distinct places and how many rows lie there."""
    return rows.where(_on_earth(at)).groupBy(*(F.col(c).cast("double").alias(k) for c, k in zip(at, "xy"))).agg(F.count("*").alias("n"))


def _near_points(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(a, b, d): points of both sides that are at most so far apart, with their distance; a point of the left looks into
    the cells it reaches."""
    bands = Bands(metres)
    own = bands.of(F.col("y"))
    a = left.select(F.struct("*").alias("a"), F.explode(bands.reached(F.col("x"), F.col("y"))).alias("at"))
    b = right.select(F.struct("*").alias("b"), F.struct(own.alias("band"), bands.column(F.col("x"), own).alias("column")).alias("cell"))
    d = haversine(*(F.col(c) for c in ("a.x", "a.y", "b.x", "b.y")))
    return a.join(b, F.col("at") == F.col("cell")).where(d <= metres).select("a", "b", d.alias("d"))


def distance_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], metres: float, name: str = "metres") -> DataFrame:
    """Pairs of rows whose places (longitude, latitude in degrees) are at most so far apart on the sphere, with their
    distance; rows without a place, or with one outside of the degrees, have no pair.

    Cells and distances are worked out for distinct places. The rows there follow by blocks: rows near a place of the
    right meet the rows at it in pairs of blocks of both, so neither a crowded cell nor a crowded place makes a long task."""
    twice = set(left.columns) & set(right.columns) | {name} & {*left.columns, *right.columns}
    if twice:
        raise ValueError(f"both sides have {', '.join(sorted(twice))}")
    spark = left.sparkSession
    pairs = _kept(_near_points(_points(left, left_at), _points(right, right_at), metres), "near-points")
    crowd = pairs.groupBy(F.col("b.x").alias("u"), F.col("b.y").alias("v")).agg(F.sum("a.n").alias("lefts"), F.first("b.n").alias("rights"))
    blocks = lambda n: F.ceil(F.col(n) / _BLOCK).cast("int")
    crowd = _kept(crowd.select("u", "v", blocks("lefts").alias("lefts"), blocks("rights").alias("rights"), (F.col("lefts") * F.col("rights")).alias("n")), "crowds")
    parts = max(1, min(_MOST_PARTS, 2 * int(crowd.agg(F.sum("n")).first()[0] or 0) // _BLOCK**2))
    near = pairs.select("a.x", "a.y", F.col("b.x").alias("u"), F.col("b.y").alias("v"), "d").join(crowd, ["u", "v"])
    own = lambda row, n: F.pmod(F.xxhash64(row), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda at, names: (F.col(c).cast("double").alias(k) for c, k in zip(at, names))
    a = left.select(F.struct("*").alias("a"), *place(left_at, "xy")).join(near, ["x", "y"])
    a = a.select("a", "d", "u", "v", own("a", F.col("lefts")).alias("i"), each("rights").alias("j"))
    b = right.select(F.struct("*").alias("b"), *place(right_at, "uv")).join(crowd, ["u", "v"])
    b = b.select("b", "u", "v", own("b", F.col("rights")).alias("j"), each("lefts").alias("i"))
    on = ["u", "v", "i", "j"]
    return a.repartition(parts, *on).join(b.repartition(parts, *on), on).select("a.*", "b.*", F.col("d").alias(name))


def nearest_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_at: tuple[str, str], right_at: tuple[str, str], k: int, start: float | None = None) -> tuple[DataFrame, list[int]]:
    """(left_key, right_key, metres, rank) of the k nearest places of the right for each of the left, ties by right_key;
    and how many distinct places of the left were looked at in each round.

    Rows at one place of the left have the same answer, and of those at one place of the right only the k of smallest
    key can be in any, so distinct places and these keys are all that meets. A circle grows around each place until k
    rows lie in it: then the k nearest do, too. Each round joins the places that still have fewer, by a circle of twice
    the radius; the first one would hold k rows if the right's lay evenly over the box around them."""
    place = lambda at, names: (F.col(c).cast("double").alias(k) for c, k in zip(at, names))
    a = _kept(_points(left, left_at), "nearest-places")
    at_place = Window.partitionBy("u", "v").orderBy("key")
    keys = right.where(_on_earth(right_at)).select(F.col(right_key).alias("key"), *place(right_at, "uv"))
    keys = _kept(keys.withColumn("own", F.row_number().over(at_place)).where(F.col("own") <= k).drop("own"), "nearest-keys")
    b = _kept(_points(keys, ("u", "v")), "nearest-right")
    if start is None:
        n, west, east, south, north = b.agg(F.sum("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        area = max(1e-6, (east or 0) - (west or 0)) * max(1e-6, (north or 0) - (south or 0))
        start = math.sqrt(area * (k + 1) / max(n or 0, 1) / math.pi) * 111_195
    metres, found, rounds = max(start, 1.0), None, []
    by = Window.partitionBy("x", "y")
    while True:
        looked = a.count()
        if not looked:
            break
        rounds.append(looked)
        everything = metres >= math.pi * RADIUS
        near = _near_points(a, b, metres).select("a.x", "a.y", F.col("b.x").alias("u"), F.col("b.y").alias("v"), F.col("d").alias("metres")).join(keys, ["u", "v"])
        ranked = near.withColumn("rank", F.row_number().over(by.orderBy("metres", "key"))).where(F.col("rank") <= k)
        told = _kept(ranked.select("x", "y", "key", "metres", "rank"), "nearest")
        if everything:
            found = told if found is None else found.unionByName(told)
            break
        done = told.where(F.col("rank") == k).select("x", "y")
        whole = told.join(done, ["x", "y"], "left_semi")
        found = whole if found is None else found.unionByName(whole)
        a, metres = _kept(a.join(done, ["x", "y"], "left_anti"), "nearest-rest"), min(metres * 2, math.pi * RADIUS)
    if found is None:
        found = a.join(keys.limit(0)).select("x", "y", "key", F.lit(0.0).alias("metres"), F.lit(1).alias("rank"))
    rows = left.select(left_key, *place(left_at, "xy")).join(found, ["x", "y"])
    return rows.select(left_key, F.col("key").alias(right_key), "metres", "rank"), rounds
