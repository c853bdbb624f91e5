"""Distances, scores and containment as column expressions.  A point is (lat, lon) in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radius, scale of the flat approximation, tiers.
EARTH_METERS = 6_371_000.0
METERS_PER_DEGREE = 111_320.0
SCORE_TIERS = [(200.0, 5), (500.0, 4), (1000.0, 3), (2000.0, 2), (10_000.0, 1)]
VAGUE_TIERS = [(3000.0, 2), (1000.0, 1)]
MAX_SCORE = 5
SAME_STREET_METERS = 5_000.0
DROP_METERS = 20_000.0
PATHS = "array<array<struct<lat:double,lon:double>>>"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_METERS) -> Column:
    """Great-circle distance in the unit of ``radius`` (metres)."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_METERS / 1000)


def segment_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a segment, on a plane around the point."""
    scale = F.cos(F.radians(lat)) * METERS_PER_DEGREE
    ax, ay = (lon1 - lon) * scale, (lat1 - lat) * METERS_PER_DEGREE
    dx, dy = (lon2 - lon1) * scale, (lat2 - lat1) * METERS_PER_DEGREE
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(length > 0, length)))).otherwise(F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def distance_range(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, shape: Column) -> Column:
    """struct(near, far): metres from a point to the nearest segment and the farthest vertex of a shape,
    the centre among both; a lone vertex is a segment of its own."""
    centre = haversine(lat, lon, centre_lat, centre_lon)
    vertices = F.flatten(shape)

    def near(path: Column) -> Column:
        ends = F.when(F.size(path) == 1, F.array(F.struct(F.get(path, F.lit(0)).alias("a"), F.get(path, F.lit(0)).alias("b")))).otherwise(
            F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        )
        return F.array_min(F.transform(ends, lambda s: segment_distance(lat, lon, s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"])))

    full = F.filter(F.coalesce(shape, F.array().cast(PATHS)), lambda p: F.size(p) > 0)
    nearest = F.array_min(F.transform(full, near))
    farthest = F.array_max(F.transform(F.coalesce(vertices, F.array().cast(PATHS[6:-1])), lambda v: haversine(lat, lon, v["lat"], v["lon"])))
    return F.struct(F.least(centre, nearest).alias("near"), F.greatest(centre, farthest).alias("far"))


def _tier(value: Column, tiers: list[tuple[float, int]], below: bool) -> Column:
    out = F.lit(0)
    for bound, result in reversed(tiers):
        out = F.when(value < bound if below else value > bound, F.lit(result)).otherwise(out)
    return out


def vagueness_penalty(near: Column, far: Column) -> Column:
    return _tier(far - near, VAGUE_TIERS, below=False)


def distance_score(meters: Column) -> Column:
    return _tier(meters, SCORE_TIERS, below=True)


def ring_contains(ring: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule on a ring of [lon, lat] positions; under three positions hold nothing.  A position
    that is none is passed over but ends the edges on both sides."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i - 1, F.size(ring)))
        ax, ay, bx, by = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        spans = (ay > lat) != (by > lat)
        return F.coalesce(F.when(spans, lon < (bx - ax) * (lat - ay) / F.when(spans, by - ay) + ax), F.lit(False))

    odd = F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(False), lambda inside, i: inside != crosses(i))
    return F.when(F.size(ring) >= 3, odd).otherwise(F.lit(False))


def polygon_contains(rings: Column, lat: Column, lon: Column) -> Column:
    """In the outer ring and in none of the holes."""
    outer = F.coalesce(ring_contains(F.get(rings, F.lit(0)), lat, lon), F.lit(False))
    holes = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: ring_contains(r, lat, lon))
    return F.when(F.size(rings) > 0, outer & ~F.coalesce(holes, F.lit(False))).otherwise(F.lit(False))


def geometry_contains(geojson: Column, lat: Column, lon: Column) -> Column:
    """A GeoJSON string of a polygon or several; other kinds hold nothing."""
    kind = F.get_json_object(geojson, "$.type")
    one = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<double>>>")
    many = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<array<double>>>>")
    return F.coalesce(F.when(kind == "Polygon", polygon_contains(one, lat, lon)).when(kind == "MultiPolygon", F.exists(many, lambda p: polygon_contains(p, lat, lon))), F.lit(False))


def geojson_paths(geojson: Column) -> Column:
    """Lines and rings of a GeoJSON string as paths of (lat, lon); other kinds have none."""
    kind, place = F.get_json_object(geojson, "$.type"), F.get_json_object(geojson, "$.coordinates")

    def path(line: Column) -> Column:
        return F.transform(F.filter(line, lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")))

    lines = F.from_json(place, "array<array<array<double>>>")
    out = (
        F.when(kind == "LineString", F.array(path(F.from_json(place, "array<array<double>>"))))
        .when(kind.isin("MultiLineString", "Polygon"), F.transform(lines, path))
        .when(kind == "MultiPolygon", F.transform(F.flatten(F.from_json(place, "array<array<array<array<double>>>>")), path))
    )
    return F.coalesce(out, F.array().cast(PATHS))
