"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from ..sources.spatial import VIEWS
from .queries import COOLDOWN, NET_TOLERANCE, TOLERANCE


def _with(*names: str) -> str:
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def _x(lon: str, z: str = "z") -> str:
    return f"CAST(floor(({lon} + 180.0) / 360.0 * pow(2.0, {z})) AS BIGINT)"


def _y(lat: str, z: str = "z") -> str:
    return f"CAST(floor((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * pow(2.0, {z})) AS BIGINT)"


def _held(v: str, z: str = "z") -> str:
    return f"least(greatest({v}, 0), CAST(pow(2, {z}) AS BIGINT) - 1)"


def _lon(x: str, z: str = "z") -> str:
    return f"({x} / pow(2.0, {z}) * 360.0 - 180.0)"


def _lat(y: str, z: str = "z") -> str:
    return f"degrees(atan(sinh(pi() * (1.0 - 2.0 * {y} / pow(2.0, {z})))))"


def _tiled(rows: str, low: int, high: int, spare: int = 1) -> str:
    """Rows with bounds and the tiles of their cover, `spare` tiles wider on every side, with the tiles' bounds."""
    z = f"SELECT r.*, z FROM ({rows}) r, range({low}, {high} + 1) t(z) WHERE min_lon IS NOT NULL"
    x = f"SELECT q.*, x FROM ({z}) q, range({_held(_held(_x('min_lon')) + f' - {spare}')}, {_held(_held(_x('max_lon')) + f' + {spare}')} + 1) u(x)"
    xy = f"SELECT p.*, y FROM ({x}) p, range({_held(_held(_y('max_lat')) + f' - {spare}')}, {_held(_held(_y('min_lat')) + f' + {spare}')} + 1) v(y)"
    return f"SELECT *, {_lon('x')} AS w, {_lon('(x + 1)')} AS e, {_lat('(y + 1)')} AS s, {_lat('y')} AS n FROM ({xy})"


_MEETS = "min_lon <= e AND max_lon >= w AND min_lat <= n AND max_lat >= s"
_POINT_ROWS = "SELECT 'points' AS layer, id, lon AS min_lon, lat AS min_lat, lon AS max_lon, lat AS max_lat, lon, lat FROM geo_points"
_BOX_ROWS = "SELECT 'boxes' AS layer, id, min_lon, min_lat, max_lon, max_lat, name, kind, size FROM geo_boxes"
_LINE_ROWS = "SELECT 'lines' AS layer, id, least(x0, x1, x2) AS min_lon, least(y0, y1, y2) AS min_lat, greatest(x0, x1, x2) AS max_lon, greatest(y0, y1, y2) AS max_lat, x0, y0, x1, y1, x2, y2 FROM geo_lines"


def _segment(ax: str, ay: str, bx: str, by: str) -> str:
    side = lambda x, y: f"(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}))"
    corners = ", ".join(side(x, y) for x in "we" for y in "sn")
    return f"(least({ax}, {bx}) <= e AND greatest({ax}, {bx}) >= w AND least({ay}, {by}) <= n AND greatest({ay}, {by}) >= s AND least({corners}) <= 0 AND greatest({corners}) >= 0)"


_LINE_MEETS = f"({_segment('x0', 'y0', 'x1', 'y1')} OR {_segment('x1', 'y1', 'x2', 'y2')})"
_KEY = "layer, id, CAST(z AS INTEGER) AS z, x, y"
_POINTS_AND_BOXES = f"points AS (SELECT {_KEY} FROM ({_tiled(_POINT_ROWS, 0, 6)}) WHERE {_MEETS}), boxes AS (SELECT {_KEY} FROM ({_tiled(_BOX_ROWS, 0, 6)}) WHERE {_MEETS}), placed AS (SELECT * FROM points UNION ALL SELECT * FROM boxes)"


def _px(lon: str) -> str:
    return f"CAST(trunc(({lon} - w) / (e - w) * 4096.0) AS INTEGER)"


def _py(lat: str) -> str:
    return f"CAST(trunc((n - {lat}) / (n - s) * 4096.0) AS INTEGER)"


def _zz(n: str) -> str:
    return f"CAST(CASE WHEN ({n}) >= 0 THEN 2 * ({n}) ELSE -2 * ({n}) - 1 END AS VARCHAR)"


_XY = f"SELECT id, z, {_x('lon')} AS x, {_y('lat')} AS y, lon, lat FROM geo_points, range(0, {{}} + 1) t(z)"
_LINE_COMMANDS = f"""
WITH {_with("geo_lines")}, t AS (SELECT *, {_px("x0")} AS a0, {_py("y0")} AS b0, {_px("x1")} AS a1, {_py("y1")} AS b1, {_px("x2")} AS a2, {_py("y2")} AS b2
  FROM ({_tiled(_LINE_ROWS, 7, 7)}) WHERE {_LINE_MEETS})
SELECT id, CAST(z AS INTEGER) AS z, x, y, concat_ws(',', '9', {_zz("a0")}, {_zz("b0")}, '18', {_zz("a1 - a0")}, {_zz("b1 - b0")}, {_zz("a2 - a1")}, {_zz("b2 - b1")}) AS commands FROM t"""

_PARSED = f"""{_with("changes")}, parsed AS (SELECT event_id,
  CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.layer') WHEN contains(payload, ':') THEN split_part(payload, ':', 1) END AS layer,
  CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.id') AS BIGINT) ELSE TRY_CAST(nullif(split_part(payload, ':', 2), '') AS BIGINT) END AS id,
  CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.old_bounds.min_lon') AS DOUBLE) END AS min_lon,
  CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.old_bounds.min_lat') AS DOUBLE) END AS min_lat,
  CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.old_bounds.max_lon') AS DOUBLE) END AS max_lon,
  CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.old_bounds.max_lat') AS DOUBLE) END AS max_lat FROM changes)"""
_ROUTED = "shown AS (SELECT * FROM (VALUES ('base', 'points', 0, 6), ('base', 'boxes', 0, 6), ('net', 'lines', 2, 8)) v(source, layer, low, high)), routed AS (SELECT p.*, source, low, high FROM parsed p JOIN shown USING (layer) WHERE id IS NOT NULL)"
_BOUNDS = "min_lon, min_lat, max_lon, max_lat"
_AFFECTED = f"""{_PARSED}, {_with("geo_points", "geo_boxes", "geo_lines")}, {_ROUTED},
features AS (SELECT layer, id, {_BOUNDS} FROM ({_POINT_ROWS}) UNION ALL SELECT layer, id, {_BOUNDS} FROM ({_BOX_ROWS}) UNION ALL SELECT layer, id, {_BOUNDS} FROM ({_LINE_ROWS})),
places AS (SELECT source, low, high, {_BOUNDS} FROM routed UNION SELECT source, low, high, f.min_lon, f.min_lat, f.max_lon, f.max_lat FROM routed r JOIN features f ON r.layer = f.layer AND r.id = f.id),
affected AS (SELECT DISTINCT source, CAST(z AS INTEGER) AS z, x, y FROM ({_tiled("SELECT * FROM places", 0, 8, 0)}) WHERE z BETWEEN low AND high)"""


def _text_tiles(where: str) -> str:
    rows = f"SELECT id, z, {_x('lon')} AS x, {_y('lat')} AS y FROM geo_points, range(0, 7) t(z) WHERE {where}"
    return f"(SELECT CAST(z AS INTEGER) AS z, x, y, concat_ws('|', CAST(count(*) AS VARCHAR), CAST(min(id) AS VARCHAR), CAST(max(id) AS VARCHAR)) AS tile_data FROM ({rows}) GROUP BY z, x, y)"


_A = f"a AS {_text_tiles("ts < TIMESTAMP '2024-01-16 00:00:00'")}"
_B = f"b AS {_text_tiles("ts >= TIMESTAMP '2024-01-04 00:00:00'")}"
_ANY = f"a AS {_text_tiles('TRUE')}"
_COMPARED = f"""WITH {_with("geo_points")}, {_A}, {_B}, c AS (SELECT coalesce(a.z, b.z) AS z,
  CASE WHEN a.z IS NULL THEN 'added' WHEN b.z IS NULL THEN 'removed' WHEN sha256(a.tile_data) = sha256(b.tile_data) THEN 'unchanged' ELSE 'changed' END AS state
  FROM a FULL OUTER JOIN b ON a.z = b.z AND a.x = b.x AND a.y = b.y)"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ("added", "removed", "changed"))


def _bytes(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' WHEN {n} < 1048576 THEN printf('%.1f KB', {n} / 1024.0) WHEN {n} < 1073741824 THEN printf('%.1f MB', {n} / 1048576.0) ELSE printf('%.2f GB', {n} / 1073741824.0) END"


_EVENTS = """e AS (SELECT event_id AS seq, ts, 'u' || CAST(user_id AS VARCHAR) AS source, event_type = 'signup' AS g,
  CASE WHEN event_type = 'signup' THEN event_id * 3 END AS duration_ms,
  CASE WHEN event_type <> 'signup' THEN event_id % 50 + 1 END AS tiles_updated,
  CASE WHEN event_type <> 'signup' THEN [CAST(event_id % 15 AS INTEGER), CAST(user_id % 15 AS INTEGER)] END AS affected_zooms,
  CASE WHEN event_type <> 'signup' THEN 14 END AS max_zoom,
  CASE WHEN event_type <> 'signup' THEN [event_type] END AS layers_affected FROM events)"""


def _merged(rows: str, keys: str) -> str:
    unless = lambda c: f"CASE WHEN NOT bool_or(g) THEN {c} END"
    union = lambda c: f"array_to_string(list_sort(list_distinct(flatten(list({c}) FILTER (WHERE {c} IS NOT NULL)))), ',')"
    return f"""SELECT {keys}, CASE WHEN bool_or(g) THEN 'generate_complete' ELSE 'update_complete' END AS event,
  arg_max(duration_ms, seq) FILTER (WHERE g) AS duration_ms, CAST({unless("sum(tiles_updated)")} AS BIGINT) AS tiles_updated,
  {unless(union("affected_zooms"))} AS affected_zooms, {unless("arg_min(max_zoom, seq) FILTER (WHERE NOT g)")} AS max_zoom,
  {unless(union("layers_affected"))} AS layers_affected FROM {rows} GROUP BY {keys}"""


_WINDOWS = f"""{_EVENTS}, timed AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM e), opened(source, w) AS (
  SELECT source, min(s) FROM timed GROUP BY source
  UNION ALL
  SELECT o.source, (SELECT min(s) FROM timed t WHERE t.source = o.source AND t.s >= o.w + {COOLDOWN}) AS w FROM opened o WHERE o.w IS NOT NULL),
windowed AS (SELECT t.*, (SELECT max(w) FROM opened o WHERE o.source = t.source AND o.w <= t.s) AS window_start FROM timed t)"""
#: The key's two pads of the keyed digest, for the key that the query signs with.
_PADS = ["".join(f"{b ^ pad:02x}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_R9 = ", ".join(f"round({c}, 9) AS {c}" for c in _BOUNDS.split(", "))

#: The net's tiles: lines have their middle vertex where it lies farther from the chord than the zoom's tolerance.
_COUNT_LINES = f"""
WITH {_with("geo_lines")}, t AS (SELECT * FROM ({_tiled(_LINE_ROWS, 2, 8)}) WHERE {_LINE_MEETS}),
p AS (SELECT id, z, x, y, x1 - x0 AS px, y1 - y0 AS py, x2 - x0 AS dx, y2 - y0 AS dy FROM t),
q AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS f FROM p),
v AS (SELECT id, z, x, y, CASE WHEN sqrt(pow(px - f * dx, 2) + pow(py - f * dy, 2)) > {NET_TOLERANCE!r} * pow(2, 18 - z) THEN 3 ELSE 2 END AS n FROM q)
SELECT CAST(z AS INTEGER) AS z, x, y, count(*) AS features, CAST(sum(n) AS BIGINT) AS vertices, CAST(sum(id) AS BIGINT) AS sum_id FROM v GROUP BY z, x, y"""

ORACLES: dict[str, str] = {
    "layer_scan_filter": f"WITH {_with('geo_boxes')} SELECT id, layer, name, CAST(size AS BIGINT) AS size, {_R9} FROM geo_boxes WHERE min_lon IS NOT NULL AND size > 10 AND kind <> 'none'",
    "tile_xy_points": f"WITH {_with('geo_points')} SELECT id, CAST(z AS INTEGER) AS z, x, y FROM ({_XY.format(14)})",
    "tile_bounds": f"WITH {_with('geo_points')}, k AS (SELECT DISTINCT CAST(z AS INTEGER) AS z, x, y FROM ({_XY.format(10)})) SELECT z, x, y, round({_lon('x')}, 6) AS min_lon, round({_lat('(y + 1)')}, 6) AS min_lat, round({_lon('(x + 1)')}, 6) AS max_lon, round({_lat('y')}, 6) AS max_lat FROM k",
    "tile_cover_boxes": f"WITH {_with('geo_boxes')} SELECT {_KEY} FROM ({_tiled(_BOX_ROWS, 0, 8, 0)})",
    "tile_local_coords": f"WITH {_with('geo_points')} SELECT id, CAST(z AS INTEGER) AS z, {_px('lon')} AS px, {_py('lat')} AS py FROM (SELECT *, {_lon('x')} AS w, {_lon('(x + 1)')} AS e, {_lat('(y + 1)')} AS s, {_lat('y')} AS n FROM ({_XY.format(14)}))",
    "tms_flip": f"WITH {_with('geo_points')} SELECT DISTINCT CAST(z AS INTEGER) AS z, x, y, CAST(pow(2, z) AS BIGINT) - 1 - y AS tile_row FROM ({_XY.format(10)})",
    "spatial_join_points": f"WITH {_with('geo_points')} SELECT {_KEY} FROM ({_tiled(_POINT_ROWS, 0, 6)}) WHERE {_MEETS}",
    "spatial_join_boxes": f"WITH {_with('geo_boxes')} SELECT {_KEY} FROM ({_tiled(_BOX_ROWS, 0, 7)}) WHERE {_MEETS}",
    "spatial_join_lines": f"WITH {_with('geo_lines')} SELECT {_KEY} FROM ({_tiled(_LINE_ROWS, 6, 8)}) WHERE {_LINE_MEETS}",
    "features_per_tile_layer": f"WITH {_with('geo_points', 'geo_boxes')}, {_POINTS_AND_BOXES} SELECT z, x, y, layer, count(*) AS features, min(id) AS min_id, max(id) AS max_id FROM placed GROUP BY z, x, y, layer",
    "mvt_commands_points": f"WITH {_with('geo_points')} SELECT id, CAST(z AS INTEGER) AS z, x, y, concat_ws(',', '9', {_zz(_px('lon'))}, {_zz(_py('lat'))}) AS commands FROM ({_tiled(_POINT_ROWS, 5, 5)}) WHERE {_MEETS}",
    "mvt_commands_lines": _LINE_COMMANDS,
    "mvt_value_typing": """
SELECT c_custkey, 'name' AS property, 's' AS kind, c_name AS text FROM customer
UNION ALL SELECT c_custkey, 'nation', 'i', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'whole', 'i', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'solvent', CASE WHEN c_nationkey > 20 THEN 'o' ELSE 'b' END, CASE WHEN c_nationkey > 20 THEN 'null' WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END FROM customer""",
    "mvt_key_dictionary": f"WITH {_with('geo_boxes')}, t AS (SELECT * FROM ({_tiled(_BOX_ROWS, 0, 3)}) WHERE {_MEETS}), v AS (SELECT z, x, y, 'name' AS k, 's:' || name AS d FROM t UNION ALL SELECT z, x, y, 'kind', 's:' || kind FROM t UNION ALL SELECT z, x, y, 'size', 'n:' || CAST(size AS VARCHAR) FROM t) SELECT CAST(z AS INTEGER) AS z, x, y, count(DISTINCT k) AS keys, count(DISTINCT d) AS values FROM v GROUP BY ALL",
    "property_rules_by_zoom": "SELECT event_id AS id, CAST(z AS INTEGER) AS z, CASE WHEN z < 3 THEN 'kind' WHEN z < 5 THEN 'kind,user_id' ELSE 'kind,user_id,value' END AS kept FROM events, range(0, 7) t(z)",
    "simplify_tolerance_by_zoom": f"SELECT p_partkey, CAST(z AS INTEGER) AS z, round(p_size * CAST({TOLERANCE:f} AS DOUBLE) * pow(2.0, greatest(18 - z, 0)), 9) AS tolerance FROM part, range(0, 21) t(z)",
    "simplify_lines": f"""
WITH {_with("geo_lines")}, p AS (SELECT id, x1 - x0 AS px, y1 - y0 AS py, x2 - x0 AS dx, y2 - y0 AS dy FROM geo_lines),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS t FROM p)
SELECT id, CASE WHEN sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) > {TOLERANCE * 2**14!r} THEN 3 ELSE 2 END AS vertices FROM t""",
    "hmac_signature": f"WITH {_with('changes')} SELECT event_id, 'sha256=' || sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(payload)))) AS signature FROM changes",
    "label_points_boxes": f"WITH {_with('geo_boxes')} SELECT id, round((min_lon + max_lon) / 2, 6) AS lon, round((min_lat + max_lat) / 2, 6) AS lat FROM geo_boxes WHERE min_lon IS NOT NULL",
    "boundary_lines": f"WITH {_with('geo_boxes')} SELECT id, 'LineString' AS type, 5 AS vertices, round(2 * (max_lon - min_lon) + 2 * (max_lat - min_lat), 6) AS length FROM geo_boxes WHERE min_lon IS NOT NULL",
    "encode_tiles": f"WITH {_with('geo_points', 'geo_boxes')}, {_POINTS_AND_BOXES} SELECT z, x, y, count(*) AS n_features, count(DISTINCT layer) AS n_layers, CAST(sum(id) AS BIGINT) AS sum_id FROM placed GROUP BY z, x, y",
    "encoded_commands": _LINE_COMMANDS,
    "parse_notifications": f"WITH {_PARSED} SELECT event_id, layer, id, min_lon, max_lat, layer IS NULL OR id IS NULL AS rejected FROM parsed",
    "route_changes_to_source": f"WITH {_PARSED}, {_ROUTED} SELECT source, layer, count(*) AS changes, count(DISTINCT id) AS features FROM routed GROUP BY source, layer",
    "affected_tiles": f"WITH {_AFFECTED} SELECT source, z, x, y FROM affected",
    "incremental_merge": f"WITH {_AFFECTED}, {_A}, {_B}, k AS (SELECT z, x, y FROM affected WHERE source = 'base') SELECT a.* FROM a ANTI JOIN k USING (z, x, y) UNION ALL SELECT b.* FROM b SEMI JOIN k USING (z, x, y)",
    "tileset_inspect": f"WITH {_with('geo_points')}, {_ANY}, i AS (SELECT count(*) AS tiles, CAST(coalesce(sum(strlen(tile_data)), 0) AS BIGINT) AS bytes, CAST(floor(coalesce(avg(strlen(tile_data)), 0)) AS BIGINT) AS average_bytes, min(z) AS min_zoom, max(z) AS max_zoom FROM a) SELECT *, {_bytes('bytes')} AS size, {_bytes('average_bytes')} AS average_size FROM i",
    "tile_count_by_zoom": f"WITH {_with('geo_points')}, {_ANY} SELECT z, count(*) AS tiles FROM a GROUP BY z",
    "tile_size_stats": f"WITH {_with('geo_points')}, {_ANY} SELECT z, CAST(sum(strlen(tile_data)) AS BIGINT) AS bytes, round(avg(strlen(tile_data)), 6) AS average FROM a GROUP BY z",
    "tileset_diff_summary": f"{_COMPARED} SELECT count(*) FILTER (WHERE state <> 'added') AS tiles_a, count(*) FILTER (WHERE state <> 'removed') AS tiles_b, {_COUNTS}, count(*) FILTER (WHERE state = 'unchanged') AS unchanged FROM c",
    "tileset_diff_by_zoom": f"{_COMPARED} SELECT z, {_COUNTS} FROM c GROUP BY z HAVING count(*) FILTER (WHERE state <> 'unchanged') > 0",
    "tiles_only_in_a": f"WITH {_with('geo_points')}, {_A}, {_B} SELECT z, x, y FROM a EXCEPT SELECT z, x, y FROM b",
    "tiles_in_both": f"WITH {_with('geo_points')}, {_A}, {_B} SELECT z, x, y FROM a INTERSECT SELECT z, x, y FROM b",
    "metadata_diff": """
WITH a AS (SELECT CAST(s_nationkey AS VARCHAR) AS name, CAST(count(*) AS VARCHAR) AS value FROM supplier GROUP BY 1), b AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, CAST(count(*) AS VARCHAR) AS value FROM customer GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS state, a.value AS old, b.value AS new
FROM a FULL OUTER JOIN b ON a.name = b.name WHERE a.value IS DISTINCT FROM b.value""",
    "etag": f"""WITH {_with("geo_points")}, {_ANY} SELECT z, x, y, '"' || substr(sha256(tile_data), 1, 16) || '"' AS etag FROM a""",
    "format_bytes": f"WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * ([1, 64, 16384, 4194304])[o_orderkey % 4 + 1] AS bytes FROM orders) SELECT o_orderkey, bytes, {_bytes('bytes')} AS size FROM b",
    "merge_events": f"WITH {_EVENTS}, d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM e) {_merged('d', 'source, day')}",
    "cooldown_windows": f"WITH RECURSIVE {_WINDOWS} SELECT source, window_start, count(*) AS events FROM windowed GROUP BY source, window_start",
    "cooled_events": f"WITH RECURSIVE {_WINDOWS} {_merged('windowed', 'source, window_start')}",
    "event_json": f"WITH {_EVENTS} SELECT seq, CAST(CASE WHEN g THEN to_json({{'event': 'generate_complete', 'source': source, 'duration_ms': duration_ms}}) ELSE to_json({{'event': 'update_complete', 'source': source, 'tiles_updated': tiles_updated, 'affected_zooms': affected_zooms, 'max_zoom': max_zoom, 'layers_affected': layers_affected}}) END AS VARCHAR) AS json FROM e",
    "validate_layers": """
SELECT * FROM (VALUES ('odd', 'gone', 'Table "public"."nowhere" does not exist'), ('odd', 'bare', 'Geometry column "geom" does not exist in "public"."region"'),
  ('odd', 'bare', 'Property column "r_size" does not exist in "public"."region"'), ('good', 'fine', 'No tile_update trigger found on "public"."nation"')) v(source, layer, issue)""",
    "geometry_round_trip": f"WITH {_with('geo_points', 'geo_boxes', 'geo_lines')}, f AS (SELECT layer, id, {_BOUNDS} FROM ({_POINT_ROWS}) UNION ALL SELECT layer, id, {_BOUNDS} FROM ({_BOX_ROWS}) UNION ALL SELECT layer, id, {_BOUNDS} FROM ({_LINE_ROWS})) SELECT layer, id, {_R9} FROM f WHERE min_lon IS NOT NULL",
}
