"""The registered queries of the tile engine: each takes (spark, sf_dir) and runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Layer, PropertyRule, Source
from ..functions import geometry as G
from ..functions import mvt, shapes
from ..functions import tiles as T
from ..functions.text import etag, format_bytes, hmac_signature
from ..operators import encode as E
from ..operators import events as V
from ..operators import tilesets as S
from ..operators.cover import cover, tiles_of_features
from ..sources import spatial
from ..sources.geojson import feature_json
from ..streaming import changes as N
from . import generate as P
from .validate import validate

Query = Callable[[SparkSession, str], DataFrame]

#: Sources that the queries use; the net's layer is simplified and both have property rules.
BASE = Source("base", 0, 6, (
    replace(spatial.LAYERS["points"], property_rules=(PropertyRule(3, ("value", "user_id")), PropertyRule(5, ("value",)))),
    replace(spatial.LAYERS["boxes"], property_rules=(PropertyRule(4, ("name",)),)),
))
NET_TOLERANCE = 0.000002
NET = Source("net", 2, 8, (replace(spatial.LAYERS["lines"], simplify_tolerance=NET_TOLERANCE, property_rules=(PropertyRule(5, ("status",)),)),))
CONFIG = Config((BASE, NET))
TOLERANCE = 0.00001


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spatial.view(spark, sf_dir, name)


def _key(placed: DataFrame) -> DataFrame:
    return placed.select("layer", "id", F.col("z").cast("int").alias("z"), "x", "y")


def layer_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = replace(spatial.LAYERS["boxes"], filter="size > 10 AND kind != 'none'", properties=("name", "size"))
    found = spatial.L.scan(spatial.with_geometry(_view(spark, sf_dir, "geo_boxes"), "boxes"), layer)
    r = lambda c: F.round(f"bbox.{c}", 9).alias(c)
    return found.select("id", "layer", F.col("props")["name"]["text"].alias("name"), F.col("props")["size"]["text"].cast("bigint").alias("size"), r("min_lon"), r("min_lat"), r("max_lon"), r("max_lat"))


def tile_xy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _view(spark, sf_dir, "geo_points").select("id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("z"))
    return points.select("id", "z", T.tile_x(F.col("lon"), F.col("z")).alias("x"), T.tile_y(F.col("lat"), F.col("z")).alias("y"))


def _point_tiles(spark: SparkSession, sf_dir: str, zooms: tuple[int, int]) -> DataFrame:
    points = _view(spark, sf_dir, "geo_points").select("id", "lon", "lat", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))).alias("z"))
    return points.select("*", T.tile_x(F.col("lon"), F.col("z")).alias("x"), T.tile_y(F.col("lat"), F.col("z")).alias("y"))


def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _point_tiles(spark, sf_dir, (0, 10)).select("z", "x", "y").distinct()
    b = T.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return keys.select("z", "x", "y", *(F.round(b[c], 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "geo_boxes").where("min_lon IS NOT NULL").select("layer", "id", F.struct("min_lon", "min_lat", "max_lon", "max_lat").alias("bbox"))


def tile_cover_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(cover(_boxes(spark, sf_dir), "bbox", 0, 8))


def tile_local_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _point_tiles(spark, sf_dir, (0, 14))
    b = T.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return placed.select("id", "z", T.local_x(F.col("lon"), b).alias("px"), T.local_y(F.col("lat"), b).alias("py"))


def tms_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _point_tiles(spark, sf_dir, (0, 10)).select("z", "x", "y").distinct()
    return keys.select("z", "x", "y", T.tms_flip(F.col("y"), F.col("z")).alias("tile_row"))


def spatial_join_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(tiles_of_features(spatial.features(spark, sf_dir, "points"), 0, 6))


def spatial_join_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(tiles_of_features(spatial.features(spark, sf_dir, "boxes"), 0, 7))


def spatial_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(tiles_of_features(spatial.features(spark, sf_dir, "lines"), 6, 8))


def features_per_tile_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = spatial.features(spark, sf_dir, "points").unionByName(spatial.features(spark, sf_dir, "boxes"))
    return tiles_of_features(all_, 0, 6).groupBy(F.col("z").cast("int").alias("z"), "x", "y", "layer").agg(F.count("*").alias("features"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def _numbers(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda n: n.cast("string")), ",")


def mvt_commands_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tiles_of_features(spatial.features(spark, sf_dir, "points"), 5, 5)
    return E.prepared(placed).select("id", F.col("z").cast("int").alias("z"), "x", "y", _numbers(F.col("commands")).alias("commands"))


def mvt_commands_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tiles_of_features(spatial.features(spark, sf_dir, "lines"), 7, 7)
    return E.prepared(placed).select("id", F.col("z").cast("int").alias("z"), "x", "y", _numbers(F.col("commands")).alias("commands"))


def mvt_value_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kinds = dict(customers.dtypes)
    flag = F.when(F.col("c_nationkey") > 20, F.lit(None)).otherwise(F.col("c_acctbal") > 0)
    values = {"name": mvt.typed_value(F.col("c_name"), "string"), "nation": mvt.typed_value(F.col("c_nationkey"), kinds["c_nationkey"]), "whole": mvt.typed_value(F.floor("c_acctbal").cast("double"), "double"), "solvent": mvt.typed_value(flag, "boolean")}
    rows = customers.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("property"), v.alias("v")) for k, v in values.items()))).alias("e"))
    return rows.select("c_custkey", "e.property", F.col("e.v.kind").alias("kind"), F.col("e.v.text").alias("text"))


def mvt_key_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tiles_of_features(spatial.features(spark, sf_dir, "boxes"), 0, 3)
    spread = placed.select(F.col("z").cast("int").alias("z"), "x", "y", F.explode("props").alias("key", "value"))
    return spread.groupBy("z", "x", "y").agg(F.countDistinct("key").alias("keys"), F.countDistinct(mvt.dictionary_key(F.col("value"))).alias("values"))


def property_rules_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.features(spark, sf_dir, "points").withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(6))))
    kept = E.apply_property_rules(F.col("props"), F.col("layer"), F.col("z"), BASE.layers)
    return rows.select("id", "z", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


def simplify_tolerance_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * TOLERANCE).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("z"))
    return parts.select("p_partkey", "z", F.round(T.simplification_tolerance(F.col("base"), F.col("z")), 9).alias("tolerance"))


def simplify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spatial.features(spark, sf_dir, "lines")
    thin = shapes.simplify(F.col("geometry"), T.simplification_tolerance(F.lit(TOLERANCE), F.lit(4)))
    return lines.select("id", F.size(G.all_points(thin)).alias("vertices"))


def label_points_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spatial.features(spark, sf_dir, "boxes").withColumn("p", shapes.point_on_surface(F.col("geometry")))
    at = F.col("p.parts")[0][0][0]
    return boxes.select("id", F.round(at["x"], 6).alias("lon"), F.round(at["y"], 6).alias("lat"))


def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spatial.features(spark, sf_dir, "boxes").withColumn("b", G.boundary(F.col("geometry")))
    ring = F.col("b.parts")[0][0]
    length = F.aggregate(G.segments(ring), F.lit(0.0), lambda n, s: n + F.abs(s["b"]["x"] - s["a"]["x"]) + F.abs(s["b"]["y"] - s["a"]["y"]))
    return boxes.select("id", F.col("b.type").alias("type"), F.size(ring).alias("vertices"), F.round(length, 6).alias("length"))


def _tables(spark: SparkSession, sf_dir: str) -> Callable[[Layer], DataFrame]:
    return lambda layer: spatial.with_geometry(_view(spark, sf_dir, layer.table), layer.name)


def generate_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.generate(BASE, _tables(spark, sf_dir))


def encode_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read back from the encoded tiles."""
    read = E.decoded(generate_base(spark, sf_dir), "z", "x", "y", "layer", "id")
    return read.groupBy("z", "x", "y").agg(F.count("*").alias("n_features"), F.countDistinct("layer").alias("n_layers"), F.sum("id").alias("sum_id"))


def encoded_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines' commands as they are read back from encoded tiles."""
    plain = Source("plain", 7, 7, (spatial.LAYERS["lines"],))
    read = E.decoded(P.generate(plain, _tables(spark, sf_dir)), "z", "x", "y", "id", "commands")
    return read.select("id", "z", "x", "y", _numbers(F.col("commands")).alias("commands"))


def parse_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = N.parse(_view(spark, sf_dir, "changes"))
    return parsed.select("event_id", "layer", "id", F.col("old_bounds.min_lon").alias("min_lon"), F.col("old_bounds.max_lat").alias("max_lat"), F.col("problem").isNotNull().alias("rejected"))


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.good(N.parse(_view(spark, sf_dir, "changes")))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.distinct_changes(_view(spark, sf_dir, "changes"))


def route_changes_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = S.route(_good(spark, sf_dir), P.shown_layers(spark, CONFIG))
    return routed.groupBy("source", "layer").agg(F.count("*").alias("changes"), F.countDistinct("id").alias("features"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.features(spark, sf_dir, "points")
    for name in ("boxes", "lines"):
        out = out.unionByName(spatial.features(spark, sf_dir, name))
    return out


def affected_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = S.route(_changed(spark, sf_dir), P.shown_layers(spark, CONFIG))
    found = S.affected_tiles(routed, _features(spark, sf_dir))
    return found.select("source", F.col("z").cast("int").alias("z"), "x", "y")


def _text_tiles(points: DataFrame) -> DataFrame:
    """Tiles whose data is a text of what they hold, so that any engine makes the same bytes."""
    placed = points.select("id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("z")).select("id", "z", T.tile_x(F.col("lon"), F.col("z")).alias("x"), T.tile_y(F.col("lat"), F.col("z")).alias("y"))
    text = F.concat_ws("|", F.count("*").cast("string"), F.min("id").cast("string"), F.max("id").cast("string"))
    return placed.groupBy("z", "x", "y").agg(text.alias("tile_data"))


def _tileset_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_tiles(_view(spark, sf_dir, "geo_points").where("ts < TIMESTAMP '2024-01-16 00:00:00'"))


def _tileset_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_tiles(_view(spark, sf_dir, "geo_points").where("ts >= TIMESTAMP '2024-01-04 00:00:00'"))


def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tileset A after its tiles that the base's changes touch are replaced by those of B, or deleted."""
    affected = affected_tiles(spark, sf_dir).where("source = 'base'").select("z", "x", "y")
    fresh = _tileset_b(spark, sf_dir).join(affected, ["z", "x", "y"], "left_semi")
    return S.merge(_tileset_a(spark, sf_dir), affected, fresh).select(F.col("z").cast("int").alias("z"), "x", "y", "tile_data")


def _tileset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_tiles(_view(spark, sf_dir, "geo_points"))


def tileset_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inspect(_tileset(spark, sf_dir))


def tile_count_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.count_by_zoom(_tileset(spark, sf_dir)).select(F.col("z").cast("int").alias("z"), "tiles")


def tile_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size_stats(_tileset(spark, sf_dir)).select(F.col("z").cast("int").alias("z"), "bytes", F.round("average", 6).alias("average"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compare(_tileset_a(spark, sf_dir), _tileset_b(spark, sf_dir))


def tileset_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.diff_summary(_compared(spark, sf_dir))


def tileset_diff_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.diff_by_zoom(_compared(spark, sf_dir)).select(F.col("z").cast("int").alias("z"), "added", "removed", "changed")


def tiles_only_in_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.only_in(_tileset_a(spark, sf_dir), _tileset_b(spark, sf_dir)).select(F.col("z").cast("int").alias("z"), "x", "y")


def tiles_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.in_both(_tileset_a(spark, sf_dir), _tileset_b(spark, sf_dir)).select(F.col("z").cast("int").alias("z"), "x", "y")


def metadata_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and customers' nations as metadata: name is the nation, value its count."""
    entry = lambda table, key: spark.read.parquet(f"{sf_dir}/{table}.parquet").groupBy(F.col(key).cast("string").alias("name")).agg(F.count("*").cast("string").alias("value"))
    return S.metadata_diff(entry("supplier", "s_nationkey"), entry("customer", "c_nationkey"))


def etag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tileset(spark, sf_dir).select(F.col("z").cast("int").alias("z"), "x", "y", etag(F.col("tile_data")).alias("etag"))


def format_bytes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.floor(F.col("o_totalprice")).cast("bigint") * F.element_at(F.array(*(F.lit(1 << s).cast("bigint") for s in (0, 6, 14, 22))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return orders.select("o_orderkey", n.alias("bytes")).select("o_orderkey", "bytes", format_bytes(F.col("bytes")).alias("size"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and events as pipeline events: a source is a user, some event types are generations."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    update = F.col("event_type") != "signup"
    none = lambda c: F.when(update, c)
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
        F.when(update, V.UPDATE).otherwise(V.GENERATE).alias("event"),
        F.when(~update, F.col("event_id") * 3).alias("duration_ms"),
        none(F.col("event_id") % 50 + 1).alias("tiles_updated"),
        none(F.array((F.col("event_id") % 15).cast("int"), (F.col("user_id") % 15).cast("int"))).alias("affected_zooms"),
        none(F.lit(14)).alias("max_zoom"),
        none(F.array(F.col("event_type"))).alias("layers_affected"),
    )


def _event_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "event", "duration_ms", "tiles_updated", _numbers(F.col("affected_zooms")).alias("affected_zooms"), "max_zoom", F.array_join("layers_affected", ",").alias("layers_affected"))


def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return _event_columns(V.merged(days, ["source", "day"]), "source", "day")


COOLDOWN = 86_400


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cooldown_windows(_events(spark, sf_dir), "source", F.unix_timestamp("ts"), COOLDOWN)


def cooldown_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).groupBy("source", "window_start").agg(F.count("*").alias("events"))


def cooled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(V.merged(_windows(spark, sf_dir), ["source", "window_start"]), "source", "window_start")


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return events.select("seq", V.as_json(events).alias("json"))


def hmac_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "changes").select("event_id", hmac_signature(F.col("payload"), "secret").alias("signature"))


def validate_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = Source("odd", 0, 1, (Layer("gone", "nowhere"), Layer("bare", "region", geometry_column="geom", id_column="r_regionkey", properties=("r_name", "r_size"))))
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").columns for t in ("region", "nation")}
    fine = Layer("fine", "nation", geometry_column="n_name", id_column="n_nationkey", properties=("n_regionkey",))
    return validate(spark, Config((odd, Source("good", 0, 1, (fine,)))), names, {"region": ["tile_update_region"], "nation": ["other"]})


def geojson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_json(_features(spark, sf_dir))


def geometry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose geometry is written as GeoJSON and read again: bounds before and after."""
    rows = _features(spark, sf_dir).withColumn("again", G.bbox(G.from_geojson(G.to_geojson(F.col("geometry")))))
    return rows.select("layer", "id", *(F.round(f"again.{c}", 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


QUERIES: dict[str, Query] = {
    "layer_scan_filter": layer_scan_filter,
    "tile_xy_points": tile_xy_points,
    "tile_bounds": tile_bounds,
    "tile_cover_boxes": tile_cover_boxes,
    "tile_local_coords": tile_local_coords,
    "tms_flip": tms_flip,
    "spatial_join_points": spatial_join_points,
    "spatial_join_boxes": spatial_join_boxes,
    "spatial_join_lines": spatial_join_lines,
    "features_per_tile_layer": features_per_tile_layer,
    "mvt_commands_points": mvt_commands_points,
    "mvt_commands_lines": mvt_commands_lines,
    "mvt_value_typing": mvt_value_typing,
    "mvt_key_dictionary": mvt_key_dictionary,
    "property_rules_by_zoom": property_rules_by_zoom,
    "simplify_tolerance_by_zoom": simplify_tolerance_by_zoom,
    "simplify_lines": simplify_lines,
    "label_points_boxes": label_points_boxes,
    "boundary_lines": boundary_lines,
    "encode_tiles": encode_tiles,
    "encoded_commands": encoded_commands,
    "parse_notifications": parse_notifications,
    "route_changes_to_source": route_changes_to_source,
    "affected_tiles": affected_tiles,
    "incremental_merge": incremental_merge,
    "tileset_inspect": tileset_inspect,
    "tile_count_by_zoom": tile_count_by_zoom,
    "tile_size_stats": tile_size_stats,
    "tileset_diff_summary": tileset_diff_summary,
    "tileset_diff_by_zoom": tileset_diff_by_zoom,
    "tiles_only_in_a": tiles_only_in_a,
    "tiles_in_both": tiles_in_both,
    "metadata_diff": metadata_diff,
    "etag": etag_query,
    "format_bytes": format_bytes_query,
    "merge_events": merge_events,
    "cooldown_windows": cooldown_windows,
    "cooled_events": cooled_events,
    "event_json": event_json,
    "hmac_signature": hmac_query,
    "validate_layers": validate_layers,
    "geojson_export": geojson_export,
    "geometry_round_trip": geometry_round_trip,
}
