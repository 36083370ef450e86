"""Points, distances and 52-bit geohashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The radius and the metres of each unit that indexes and geo commands use.
RADIUS = 6372797.560856
METRES = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
LAT, LON, STEPS = 85.05112878, 180.0, 26
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def point(text: Column) -> Column:
    """``"lon,lat"`` as a struct, null if malformed or out of range."""
    parts = F.split(text, ",")
    lon, lat = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.when((F.size(parts) == 2) & lon.between(-LON, LON) & lat.between(-90.0, 90.0), F.struct(lon.alias("lon"), lat.alias("lat")))


def lonlat(lon: float | Column, lat: float | Column) -> Column:
    return F.struct((F.lit(lon) if isinstance(lon, (int, float)) else lon).cast("double").alias("lon"), (F.lit(lat) if isinstance(lat, (int, float)) else lat).cast("double").alias("lat"))


def haversine(a: Column, b: Column, radius: float = RADIUS) -> Column:
    la, lb = F.radians(a["lat"]), F.radians(b["lat"])
    u, v = F.sin((lb - la) / 2), F.sin(F.radians(b["lon"] - a["lon"]) / 2)
    return 2.0 * radius * F.asin(F.sqrt(u * u + F.cos(la) * F.cos(lb) * v * v))


def near(p: Column, lon: float, lat: float, radius: float, unit: str = "m") -> Column:
    """Within a radius: a box first, which needs no trigonometry of the row, then the distance."""
    metres = radius * METRES[unit.lower()]
    dlat = math.degrees(metres / RADIUS)
    box = p["lat"].between(lat - dlat, lat + dlat)
    if abs(lat) + dlat < 89:
        dlon = math.degrees(2 * math.asin(min(1.0, math.sin(min(metres / RADIUS / 2, math.pi / 2)) / math.cos(math.radians(abs(lat) + dlat))))) if metres < 5e6 else 360.0
        if -180 <= lon - dlon and lon + dlon <= 180:
            box = box & p["lon"].between(lon - dlon, lon + dlon)
    return F.coalesce(p.isNotNull() & box & (haversine(p, lonlat(lon, lat)) <= metres), F.lit(False))


def by_member(points: DataFrame, key: str, member, radius: float, unit: str = "m") -> DataFrame:
    """GEORADIUSBYMEMBER, GEOSEARCH FROMMEMBER: the rows of (key, p) within a radius of one member's point, with ``distance``
    in the unit. The member's point is one row; a missing member gives none."""
    centre = F.broadcast(points.filter(F.col(key) == member).select(F.col("p").alias("__centre")).limit(1))
    found = points.crossJoin(centre).withColumn("distance", haversine(F.col("p"), F.col("__centre")) / METRES[unit.lower()])
    return found.filter(F.col("distance") <= radius).drop("__centre")


def in_box(p: Column, lon: float, lat: float, width: float, height: float, unit: str = "m") -> Column:
    """Within half a width, measured along the point's own latitude, and half a height."""
    metres = METRES[unit.lower()]
    dlat = haversine(p, F.struct(p["lon"].alias("lon"), F.lit(float(lat)).alias("lat")))
    dlon = haversine(p, F.struct(F.lit(float(lon)).alias("lon"), p["lat"].alias("lat")))
    return F.coalesce((dlat <= height * metres / 2) & (dlon <= width * metres / 2), F.lit(False))


def _spread(x: Column) -> Column:
    """Bits of a 32-bit number on the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gathered(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def geohash52(p: Column) -> Column:
    """The score of a point: latitude on even bits, longitude on odd ones, 26 of each."""
    cells = float(1 << STEPS)
    y = F.floor((p["lat"] + LAT) / (2 * LAT) * cells).cast("long")
    x = F.floor((p["lon"] + LON) / (2 * LON) * cells).cast("long")
    return _spread(y).bitwiseOR(F.shiftleft(_spread(x), 1))


def position(score: Column) -> Column:
    """The middle of a score's cell."""
    cells = float(1 << STEPS)
    y, x = _gathered(score.cast("long")), _gathered(F.shiftright(score.cast("long"), 1))
    return F.struct(((x + 0.5) / cells * (2 * LON) - LON).alias("lon"), ((y + 0.5) / cells * (2 * LAT) - LAT).alias("lat"))


def geohash_text(p: Column) -> Column:
    """The standard geohash of 11 letters (latitude from -90 to 90); the last letter has no bits left and is 0."""
    cells = float(1 << STEPS)
    y = F.floor((p["lat"] + 90.0) / 180.0 * cells).cast("long")
    x = F.floor((p["lon"] + 180.0) / 360.0 * cells).cast("long")
    bits = _spread(y).bitwiseOR(F.shiftleft(_spread(x), 1))
    letters = [F.substring(F.lit(_BASE32), (F.shiftright(bits, 52 - 5 * (k + 1)).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(10)]
    return F.concat(*letters, F.lit("0"))
