import json

from pyspark.sql import functions as F

from vicinity.functions import geo

#: Metres of a degree on a sphere of 6371 km, by hand: 2 * pi * 6371000 / 360.
DEGREE = 111194.93


def origin():
    return F.lit(0.0), F.lit(0.0)


def test_scores_and_vagueness(value):
    assert [value(geo.distance_score(F.lit(m))) for m in (199.9, 200.0, 999.0, 1999.0, 9999.0, 10000.0)] == [5, 4, 3, 2, 1, 0]
    assert [value(geo.vagueness_penalty(F.lit(100.0), F.lit(100.0 + d))) for d in (1000.0, 1001.0, 3001.0)] == [0, 1, 2]


def test_a_line_is_measured_between_its_vertices(value):
    ladder = json.dumps({"type": "LineString", "coordinates": [[-0.03, 0.004], [0.05, 0.004]]})
    near, far = value(geo.distance_range(*origin(), F.lit(0.004), F.lit(-0.03), geo.geojson_paths(F.lit(ladder))))
    assert abs(near - 0.004 * DEGREE) < 1 and abs(far - (0.05**2 + 0.004**2) ** 0.5 * DEGREE) < 5


def test_shapes_without_and_with_one_vertex(value):
    none = value(geo.distance_range(*origin(), F.lit(0.0), F.lit(0.02), F.array().cast(geo.PATHS)))
    assert none[0] == none[1] and abs(none[0] - 0.02 * DEGREE) < 1
    one = value(geo.distance_range(*origin(), F.lit(0.0), F.lit(0.02), geo.geojson_paths(F.lit('{"type":"LineString","coordinates":[[0.007,0.0]]}'))))
    assert abs(one[0] - 0.007 * DEGREE) < 1 and one[1] == none[1]


def test_geometry_kinds(value):
    islands = {"type": "MultiPolygon", "coordinates": [[[[1, 7], [2, 7], [2, 8]], [[1.4, 7.1], [1.6, 7.1]]], [[[-3, 4]]]]}
    assert [len(p) for p in value(geo.geojson_paths(F.lit(json.dumps(islands))))] == [3, 2, 1]
    assert value(geo.geojson_paths(F.lit('{"type":"GeometryCollection","geometries":[]}'))) == []
    got = value(geo.geojson_paths(F.lit('{"type":"MultiLineString","coordinates":[[[8.5,-1.0],[8.75,-2.0]]]}')))
    assert [tuple(p) for p in got[0]] == [(-1.0, 8.5), (-2.0, 8.75)]


def test_point_in_polygon_with_hole(value):
    area = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10]], [[4, 4], [6, 4], [6, 6], [4, 6]]]}
    inside = lambda lat, lon, g=area: value(geo.geometry_contains(F.lit(json.dumps(g)), F.lit(lat), F.lit(lon)))
    assert inside(2.0, 3.0) and not inside(5.0, 5.0) and not inside(12.0, 3.0)
    assert inside(2.0, 3.0, {"type": "MultiPolygon", "coordinates": [[[[20, 20], [21, 20], [21, 21]]], area["coordinates"]]})
    assert not inside(2.0, 3.0, {"type": "Point", "coordinates": [3, 2]}) and not inside(2.0, 3.0, {"type": "Polygon", "coordinates": [[[0, 0], [9, 9]]]})
