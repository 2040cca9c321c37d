"""Registered queries on what tiles and tileset files hold, and on updates, each beside its DuckDB SQL."""

from __future__ import annotations

import math
import tempfile
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, PropertyRule, Source
from ..functions import geometry as G
from ..functions import shapes
from ..functions import tiles as T
from ..operators import encode as E
from ..operators import events as V
from ..operators.cover import features_in_bounds, tiles_of_features
from ..sources import layers as L
from ..sources import mbtiles, spatial
from ..sources.geojson import feature_json
from ..sources.tilesets import keys
from . import generate as P
from .oracles import _A, _AFFECTED, _BOUNDS, _BOX_ROWS, _COUNT_LINES, _EVENTS, _KEY, _LINE_MEETS, _LINE_ROWS, _MEETS, _PARSED, _POINT_ROWS, _R9, _lat, _lon, _px, _py, _segment, _tiled, _with, _x, _y, _zz
from .queries import BASE, CONFIG, NET, Query, _changed, _events, _features, _good, _numbers, _tables, _tileset_a, _view, affected_tiles

#: A box to fetch features from.
FETCHED = (-20.0, -10.0, 35.0, 40.0)
#: A bent line of so many vertices, its steps, the height of its bend and of its ripples, and the tolerance that tells them apart.
VERTICES, STEP, BEND, RIPPLE, TOLERANCE = 17, 0.01, 1.0, 0.001, 0.05


def _ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))


def _geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts")).cast(G.GEOMETRY)


def _corner_tile(rows: DataFrame, lon: str, lat: str, z: int) -> DataFrame:
    """Rows with the tile of one place."""
    z_ = F.lit(z)
    return rows.withColumns({"z": z_, "x": T.tile_x(F.col(lon), z_), "y": T.tile_y(F.col(lat), z_)})


def _drawn(rows: DataFrame) -> DataFrame:
    made = rows.withColumns({"layer": F.lit("l"), "props": F.create_map().cast("map<string, struct<kind: string, text: string>>")})
    return E.prepared(made).select("id", "class", F.col("z").cast("int").alias("z"), "x", "y", _numbers(F.col("commands")).alias("commands"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, "geo_boxes").where("min_lon IS NOT NULL")
    quarter = (F.col("max_lon") - F.col("min_lon")) / 4
    down = (F.col("max_lat") - F.col("min_lat")) / 4
    return rows.withColumns({"i0": F.col("min_lon") + quarter, "i1": F.col("max_lon") - quarter, "j0": F.col("min_lat") + down, "j1": F.col("max_lat") - down})


_OUTER = [("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat")]
_INNER = [("i0", "j0"), ("i0", "j1"), ("i1", "j1"), ("i1", "j0")]


def _named(points: list[tuple[str, str]]) -> list[tuple[Column, Column]]:
    return [(F.col(x), F.col(y)) for x, y in points]


def mvt_commands_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a hole, in the tile of their north-western corner: two closed rings."""
    rings = F.array(_ring(_named([*_OUTER, _OUTER[0]])), _ring(_named([*_INNER, _INNER[0]])))
    rows = _boxes(spark, sf_dir).withColumn("geometry", _geometry("Polygon", F.array(rings)))
    return _drawn(_corner_tile(rows, "min_lon", "max_lat", 5))


def mvt_commands_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-points of boxes' corners, multi-lines of two sides, multi-polygons of the box and the one inside it."""
    boxes = _boxes(spark, sf_dir)
    points = F.array(F.array(*(F.array(F.struct(x.alias("x"), y.alias("y"))) for x, y in _named(_OUTER))))
    lines = F.array(F.array(_ring(_named(_OUTER[:2])), _ring(_named(_INNER[:3]))))
    polygons = F.array(F.array(_ring(_named([*_OUTER, _OUTER[0]]))), F.array(_ring(_named([*_INNER, _INNER[0]]))))
    made = [boxes.withColumn("geometry", _geometry(k, p)) for k, p in (("MultiPoint", points), ("MultiLineString", lines), ("MultiPolygon", polygons))]
    return _drawn(_corner_tile(made[0].unionByName(made[1]).unionByName(made[2]), "min_lon", "max_lat", 6))


def _corner(points: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    return [f"p{x}" for x, _ in points], [f"q{y}" for _, y in points]


def _steps(points: list[tuple[str, str]], before: tuple[str, str] | None) -> list[str]:
    """SQL of the zigzag coded steps along points whose places in the tile are columns p.. and q..."""
    out, (px, py) = [], (f"p_{before[0]}", f"q_{before[1]}") if before else ("0", "0")
    for x, y in points:
        out += [_zz(f"p_{x} - {px}"), _zz(f"q_{y} - {py}")]
        px, py = f"p_{x}", f"q_{y}"
    return out


def _run(points: list[tuple[str, str]], before: tuple[str, str] | None, closed: bool) -> list[str]:
    steps = _steps(points, before)
    return ["'9'", *steps[:2], f"'{(len(points) - 1) * 8 + 2}'", *steps[2:], *(["'15'"] if closed else [])]


def _corner_sql(z: int) -> str:
    """Boxes with the places of all their corners, and those of the box inside, in the tile of the north-western corner."""
    quarter = "SELECT *, min_lon + (max_lon - min_lon) / 4 AS i0, max_lon - (max_lon - min_lon) / 4 AS i1, min_lat + (max_lat - min_lat) / 4 AS j0, max_lat - (max_lat - min_lat) / 4 AS j1 FROM geo_boxes WHERE min_lon IS NOT NULL"
    tile = f"SELECT *, {z} AS z, {_x('min_lon', str(z))} AS x, {_y('max_lat', str(z))} AS y FROM ({quarter})"
    edges = f"SELECT *, {_lon('x')} AS w, {_lon('(x + 1)')} AS e, {_lat('(y + 1)')} AS s, {_lat('y')} AS n FROM ({tile})"
    places = [f"{_px(c)} AS p_{c}" for c in ("min_lon", "max_lon", "i0", "i1")] + [f"{_py(c)} AS q_{c}" for c in ("min_lat", "max_lat", "j0", "j1")]
    return f"t AS (SELECT id, CAST(z AS INTEGER) AS z, x, y, {', '.join(places)} FROM ({edges}))"


def _commands_sql(kind: int, parts: list[str]) -> str:
    return f"SELECT id, {kind} AS class, z, x, y, concat_ws(',', {', '.join(parts)}) AS commands FROM t"


def encoded_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property of the base's features at zooms 2 to 5, read back from tile data with its type."""
    tiles = P.generate(replace(BASE, min_zoom=2, max_zoom=5), _tables(spark, sf_dir))
    return E.decoded_properties(tiles)


DERIVED = Source("derived", 3, 4, (replace(spatial.LAYERS["boxes"], generate_label_points=True, generate_boundary_lines=True, property_rules=(PropertyRule(4, ("name",)),)),))


def encoded_derived_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = E.decoded(P.generate(DERIVED, _tables(spark, sf_dir)), "z", "x", "y", "layer", "id", "class")
    return read.groupBy("z", "x", "y", "layer", "class").agg(F.count("*").alias("features"), F.sum("id").alias("sum_id"))


def encoded_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net over all its zooms, its lines simplified: vertices read back from the commands."""
    read = E.decoded(P.generate(NET, _tables(spark, sf_dir)), "z", "x", "y", "id", "commands")
    vertices = F.lit(1) + F.shiftright(F.col("commands")[3], 3).cast("int")
    return read.groupBy("z", "x", "y").agg(F.count("*").alias("features"), F.sum(vertices).alias("vertices"), F.sum("id").alias("sum_id"))


def simplify_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of many vertices, with ripples below the tolerance and every other one with a bend above it."""
    lines = _view(spark, sf_dir, "geo_lines").select("id", "x0", "y0")
    bend = F.when(F.col("id") % 2 == 0, BEND).otherwise(0.0)
    at = lambda i: F.struct((F.col("x0") + i * STEP).alias("x"), (F.col("y0") + F.when(i == VERTICES // 2, bend).otherwise((i % 2) * RIPPLE)).alias("y"))
    made = lines.withColumn("geometry", _geometry("LineString", F.array(F.array(F.transform(F.sequence(F.lit(0), F.lit(VERTICES - 1)), at)))))
    thin = made.withColumn("p", G.all_points(shapes.simplify(F.col("geometry"), F.lit(TOLERANCE))))
    total = lambda axis: F.round(F.aggregate("p", F.lit(0.0), lambda a, p: a + p[axis]), 6)
    return thin.select("id", F.size("p").alias("vertices"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in metres of the Web Mercator projection, brought to degrees."""
    radius = 6378137.0
    points = _view(spark, sf_dir, "geo_points")
    x, y = F.radians("lon") * radius, F.log(F.tan(F.lit(math.pi / 4) + F.radians("lat") / 2)) * radius
    at = G.to_degrees(G.point(x, y), 3857)["parts"][0][0][0]
    return points.select("id", F.round(at["x"], 6).alias("lon"), F.round(at["y"], 6).alias("lat"))


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exported GeoJSON texts hold."""
    rows = feature_json(_features(spark, sf_dir))
    part = lambda path: F.get_json_object("feature", path)
    box = G.bbox(G.from_geojson(part("$.geometry")))
    made = rows.select("layer", part("$.id").cast("bigint").alias("id"), part("$.geometry.type").alias("type"), F.coalesce(part("$.properties.kind"), part("$.properties.status")).alias("kind"), box.alias("b"))
    return made.select("layer", "id", "type", "kind", *(F.round(f"b.{c}", 9).alias(c) for c in _BOUNDS.split(", ")))


def _folder(spark: SparkSession) -> Path:
    """A new folder that the driver and the executors share: in spark.checkpoint.dir if that is named, else a temporary one (one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://")
    if named:
        Path(named).mkdir(parents=True, exist_ok=True)
    return Path(tempfile.mkdtemp(prefix="mbtiles-", dir=named or None))


def _file(spark: SparkSession, sf_dir: str) -> str:
    """Tileset A as an MBTiles file, with the bounds of its points."""
    points = spatial.features(spark, sf_dir, "points")
    path = str(_folder(spark) / "a.mbtiles")
    tiles = _tileset_a(spark, sf_dir).withColumn("tile_data", F.col("tile_data").cast("binary"))
    mbtiles.write_tiles(tiles, path, mbtiles.default_metadata("a", 0, 6, P.bounds_of(points)))
    return path


def mbtiles_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tileset written to a file and read again."""
    return mbtiles.read_tiles(spark, _file(spark, sf_dir)).select("z", "x", "y", F.col("tile_data").cast("string").alias("tile_data"))


def mbtiles_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a file's tiles as it stores them, rows counted from the south."""
    return keys(mbtiles.read_tiles(spark, _file(spark, sf_dir)))


def mbtiles_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbtiles.read_metadata(spark, _file(spark, sf_dir))


def features_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that meet a box, exactly."""
    return features_in_bounds(_features(spark, sf_dir), *FETCHED).select("layer", "id")


def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that changes name, and the names without one."""
    found = L.lookup(_features(spark, sf_dir), _good(spark, sf_dir))
    return found.select("layer", "id", F.col("geometry.type").alias("type"), F.round("bbox.min_lon", 9).alias("min_lon"))


def update_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events left where generations are turned off, as messages for subscribers."""
    kept = V.of_kinds(_events(spark, sf_dir), on_generate=False)
    return kept.select("seq", F.split(V.as_sse(kept), "\n")[0].alias("first_line"))


def regenerated_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base's tiles that changes touch, made from the features that meet them: what they hold, read back."""
    affected = affected_tiles(spark, sf_dir).where("source = 'base'").select("z", "x", "y").persist()  # counted first, then joined
    read = E.decoded(P.regenerate(BASE, _tables(spark, sf_dir), affected), "z", "x", "y", "layer", "id")
    return read.groupBy("z", "x", "y", "layer").agg(F.count("*").alias("features"), F.sum("id").alias("sum_id"))


def changed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For both sources, how many tiles an update writes and how many it deletes, by zoom."""
    out = None
    for name, made in P.update(spark, Config(CONFIG.sources), _tables(spark, sf_dir), _changed(spark, sf_dir)).items():
        one = made.changed.groupBy(F.lit(name).alias("source"), F.col("z").cast("int").alias("z")).agg(F.count(F.when(F.col("tile_data").isNotNull(), 1)).alias("written"), F.count(F.when(F.col("tile_data").isNull(), 1)).alias("deleted"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES: dict[str, Query] = {
    "mvt_commands_polygons": mvt_commands_polygons,
    "mvt_commands_multi": mvt_commands_multi,
    "encoded_properties": encoded_properties,
    "encoded_derived_layers": encoded_derived_layers,
    "encoded_net": encoded_net,
    "simplify_long_lines": simplify_long_lines,
    "web_mercator": web_mercator,
    "geojson_features": geojson_features,
    "mbtiles_round_trip": mbtiles_round_trip,
    "mbtiles_keys": mbtiles_keys,
    "mbtiles_metadata": mbtiles_metadata,
    "features_in_box": features_in_box,
    "feature_lookup": feature_lookup,
    "update_events": update_events,
    "regenerated_tiles": regenerated_tiles,
    "changed_tiles": changed_tiles,
}

_PLACED = f"points AS (SELECT {_KEY} FROM ({_tiled(_POINT_ROWS, 0, 6)}) WHERE {_MEETS}), boxes AS (SELECT {_KEY} FROM ({_tiled(_BOX_ROWS, 0, 6)}) WHERE {_MEETS}), lines AS (SELECT {_KEY} FROM ({_tiled(_LINE_ROWS, 2, 8)}) WHERE {_LINE_MEETS})"
_LOW_X, _LOW_Y, _HIGH_X, _HIGH_Y = FETCHED
_SIDES = f"{_LOW_X} AS w, {_HIGH_X} AS e, {_LOW_Y} AS s, {_HIGH_Y} AS n"
_MIDDLE = VERTICES // 2
_KEPT = [0, _MIDDLE - 1, _MIDDLE, _MIDDLE + 1, VERTICES - 1]
_ALL = "SELECT layer, id, {0} FROM (" + _POINT_ROWS + ") UNION ALL SELECT layer, id, {1} FROM (" + _BOX_ROWS + ") UNION ALL SELECT layer, id, {2} FROM (" + _LINE_ROWS + ")"

ORACLES: dict[str, str] = {
    "mvt_commands_polygons": f"WITH {_with('geo_boxes')}, {_corner_sql(5)} " + _commands_sql(3, _run(_OUTER, None, True) + _run(_INNER, _OUTER[-1], True)),
    "mvt_commands_multi": f"WITH {_with('geo_boxes')}, {_corner_sql(6)} "
    + " UNION ALL ".join([
        _commands_sql(1, ["'33'", *_steps(_OUTER, None)]),
        _commands_sql(2, _run(_OUTER[:2], None, False) + _run(_INNER[:3], _OUTER[1], False)),
        _commands_sql(3, _run(_OUTER, None, True) + _run(_INNER, _OUTER[-1], True)),
    ]),
    "encoded_properties": f"""
WITH {_with("geo_points", "geo_boxes")}, p AS (SELECT t.layer, t.id, CAST(t.z AS INTEGER) AS z, t.x, t.y, g.kind, g.value, g.user_id FROM ({_tiled(_POINT_ROWS, 2, 5)}) t JOIN geo_points g USING (id) WHERE {_MEETS}),
b AS (SELECT layer, id, CAST(z AS INTEGER) AS z, x, y, name, kind, size FROM ({_tiled(_BOX_ROWS, 2, 5)}) WHERE {_MEETS}), none AS (SELECT CAST(NULL AS DOUBLE) AS d)
SELECT z, x, y, layer, id, 'kind' AS key, 'string' AS type, kind AS text, d AS number FROM p, none
UNION ALL SELECT z, x, y, layer, id, 'user_id', 'int', NULL, CAST(user_id AS DOUBLE) FROM p WHERE z >= 3
UNION ALL SELECT z, x, y, layer, id, 'value', CASE WHEN value = floor(value) THEN 'int' ELSE 'double' END, NULL, value FROM p WHERE z >= 5
UNION ALL SELECT z, x, y, layer, id, 'kind', 'string', kind, d FROM b, none
UNION ALL SELECT z, x, y, layer, id, 'size', 'int', NULL, CAST(size AS DOUBLE) FROM b
UNION ALL SELECT z, x, y, layer, id, 'name', 'string', name, d FROM b, none WHERE z >= 4""",
    "encoded_derived_layers": f"""
WITH {_with("geo_boxes")}, b AS (SELECT {_KEY} FROM ({_tiled(_BOX_ROWS, 3, 4)}) WHERE {_MEETS}), k AS (SELECT * FROM (VALUES ('', 3), ('_labels', 1), ('_boundary', 2)) v(tail, class))
SELECT z, x, y, layer || tail AS layer, class, count(*) AS features, CAST(sum(id) AS BIGINT) AS sum_id FROM b, k GROUP BY ALL""",
    "encoded_net": _COUNT_LINES,
    "simplify_long_lines": f"""
WITH {_with("geo_lines")} SELECT id, CASE WHEN id % 2 = 0 THEN {len(_KEPT)} ELSE 2 END AS vertices,
  round(CASE WHEN id % 2 = 0 THEN {len(_KEPT)} * x0 + {sum(_KEPT) * STEP!r} ELSE 2 * x0 + {(VERTICES - 1) * STEP!r} END, 6) AS sum_x,
  round(CASE WHEN id % 2 = 0 THEN {len(_KEPT)} * y0 + {BEND + 2 * RIPPLE!r} ELSE 2 * y0 END, 6) AS sum_y FROM geo_lines""",
    "web_mercator": f"WITH {_with('geo_points')} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM geo_points",
    "geojson_features": f"""
WITH {_with("geo_points", "geo_boxes", "geo_lines")}, f AS (SELECT layer, id, 'Point' AS type, kind, {_BOUNDS} FROM ({_POINT_ROWS}) JOIN (SELECT id, kind FROM geo_points) USING (id)
  UNION ALL SELECT layer, id, 'Polygon', kind, {_BOUNDS} FROM ({_BOX_ROWS}) UNION ALL SELECT layer, id, 'LineString', status, {_BOUNDS} FROM ({_LINE_ROWS}) JOIN (SELECT id, status FROM geo_lines) USING (id))
SELECT layer, id, type, kind, {_R9} FROM f WHERE min_lon IS NOT NULL""",
    "mbtiles_round_trip": f"WITH {_with('geo_points')}, {_A} SELECT z, x, y, tile_data FROM a",
    "mbtiles_keys": f"WITH {_with('geo_points')}, {_A} SELECT z, x, CAST(pow(2, z) AS BIGINT) - 1 - y AS tile_row FROM a",
    "mbtiles_metadata": f"""
WITH {_with("geo_points")}, b AS (SELECT printf('%.6f,%.6f,%.6f,%.6f', min(lon), min(lat), max(lon), max(lat)) AS v FROM geo_points)
SELECT * FROM (VALUES ('name', 'a'), ('format', 'pbf'), ('type', 'overlay'), ('version', '2'), ('description', 'Vector tiles of a'), ('scheme', 'tms'), ('minzoom', '0'), ('maxzoom', '6')) t(name, value)
UNION ALL SELECT 'bounds', v FROM b""",
    "features_in_box": f"""
WITH {_with("geo_points", "geo_boxes", "geo_lines")}, b AS (SELECT {_SIDES})
SELECT layer, id FROM ({_POINT_ROWS}), b WHERE {_MEETS} UNION ALL SELECT layer, id FROM ({_BOX_ROWS}), b WHERE {_MEETS} UNION ALL SELECT layer, id FROM ({_LINE_ROWS}), b WHERE {_LINE_MEETS}""",
    "feature_lookup": f"""
WITH {_PARSED}, {_with("geo_points", "geo_boxes", "geo_lines")}, k AS (SELECT DISTINCT layer, id FROM parsed WHERE layer IS NOT NULL AND id IS NOT NULL),
f AS ({_ALL.format("'Point' AS type, min_lon", "'Polygon', min_lon", "'LineString', min_lon")})
SELECT k.layer, k.id, type, round(min_lon, 9) AS min_lon FROM k LEFT JOIN (SELECT * FROM f WHERE min_lon IS NOT NULL) f ON f.layer = k.layer AND f.id = k.id""",
    "update_events": f"WITH {_EVENTS} SELECT seq, 'event: update_complete' AS first_line FROM e WHERE NOT g",
    "regenerated_tiles": f"WITH {_AFFECTED}, {_PLACED}, h AS (SELECT * FROM points UNION ALL SELECT * FROM boxes) SELECT h.z, h.x, h.y, h.layer, count(*) AS features, CAST(sum(h.id) AS BIGINT) AS sum_id FROM h SEMI JOIN (SELECT z, x, y FROM affected WHERE source = 'base') k USING (z, x, y) GROUP BY ALL",
    "changed_tiles": f"""
WITH {_AFFECTED}, {_PLACED}, h AS (SELECT 'base' AS source, z, x, y FROM points UNION SELECT 'base', z, x, y FROM boxes UNION SELECT 'net', z, x, y FROM lines)
SELECT k.source, k.z, count(h.z) AS written, count(*) - count(h.z) AS deleted FROM affected k LEFT JOIN h ON h.source = k.source AND h.z = k.z AND h.x = k.x AND h.y = k.y GROUP BY k.source, k.z""",
}
