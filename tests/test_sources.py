import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quadloom import config
from quadloom.config import Layer, PropertyRule, Source
from quadloom.functions import geometry as G
from quadloom.plans import generate, serving, validate
from quadloom.sources import geojson, layers, mbtiles, publish, tilesets

TOML = """
[database]
host = "db"
[[sources]]
name = "base"
min_zoom = 0
max_zoom = 6
[[sources.layers]]
name = "parks"
table = "parks"
properties = ["name", "type"]
filter = "type != 'private'"
simplify_tolerance = 0.00001
generate_label_points = true
generate_boundary_lines = true
[[sources.layers.property_rules]]
below_zoom = 8
exclude = ["type"]
[[sources]]
name = "net"
min_zoom = 2
max_zoom = 3
[[sources.layers]]
name = "parks"
table = "parks"
[publish]
backend = "local"
destination = "out/"
"""


def test_config():
    c = config.parse(TOML, {})
    assert c.database == config.Database(host="db") and c.updates == config.Updates(200, 8) and c.webhook.retry_count == 2
    parks = c.sources[0].layers[0]
    assert parks.property_rules == (PropertyRule(8, ("type",)),) and parks.names() == ["parks", "parks_labels", "parks_boundary"]
    assert c.sources_of_layer("parks") == ["base", "net"] and c.sources_of_layer("parks_labels") == ["base"] and c.sources_of_layer("x") == []
    assert parks.schema == "public" and parks.geometry_column == "geom" and parks.id_column == "id" and c.source("net").max_zoom == 3
    over = config.parse(TOML, {"TILES_DATABASE__PORT": "5433", "TILES__DATABASE__USER": "me", "OTHER": "1"})
    assert over.database.port == 5433 and over.database.user == "me"


@pytest.mark.parametrize("sources", ["[[sources]]\nname='a'\nmin_zoom=3\nmax_zoom=2", "[[sources]]\nname='a'\nmin_zoom=0\nmax_zoom=1\n[[sources]]\nname='a'\nmin_zoom=0\nmax_zoom=1", "[[sources]]\nname='a'\nmin_zoom=0\nmax_zoom=1\ngeneration_backend='x'"])
def test_bad_config(sources):
    with pytest.raises(ValueError):
        config.parse(sources, {})


def parks(spark):
    rows = [(1, "a", "public", 2.5, "POLYGON ((-122.45 37.75, -122.44 37.75, -122.44 37.76, -122.45 37.76, -122.45 37.75))"), (2, "b", "private", 1.0, "POINT (0 0)"), (3, None, "public", None, "POINT (10 20)"), (4, "d", "public", 1.0, None)]
    return spark.createDataFrame(rows, "id int, name string, type string, area double, wkt string").withColumn("geom", G.from_wkt(F.col("wkt"))).drop("wkt")


def test_scan(spark):
    layer = Layer("parks", "parks", properties=("name", "area"), filter="type != 'private'")
    rows = {r.id: r for r in layers.scan(parks(spark), layer).collect()}
    assert sorted(rows) == [1, 3] and set(rows[1].props) == {"name", "area"} and tuple(rows[1].bbox) == (-122.45, 37.75, -122.44, 37.76)
    assert (rows[3].props["name"].kind, rows[3].props["name"].text) == ("o", "null")
    every = layers.scan(parks(spark), Layer("parks", "parks")).first()
    assert set(every.props) == {"id", "name", "type", "area"}
    odd = layers.scan(parks(spark).withColumn("id", F.lit("x")), Layer("parks", "parks", properties=())).first()
    assert odd.id == 0 and odd.props == {}


def test_derived_layers(spark):
    layer = Layer("parks", "parks", properties=("name",), generate_label_points=True, generate_boundary_lines=True)
    rows = [(r.layer, r.id, r.type) for r in layers.with_derived(layers.scan(parks(spark), layer), layer).select("layer", "id", "geometry.type").collect()]
    assert sorted(rows) == [("parks", 1, "Polygon"), ("parks", 2, "Point"), ("parks", 3, "Point"), ("parks_boundary", 1, "LineString"), ("parks_labels", 1, "Point"), ("parks_labels", 2, "Point"), ("parks_labels", 3, "Point")]


def test_geojson_files(spark, tmp_path):
    features = layers.scan(parks(spark), Layer("parks", "parks", properties=("name", "area")))
    assert geojson.write_collection(features, str(tmp_path / "d" / "x.geojson")) == 3
    read = {f["id"]: f for f in geojson.read_collection(str(tmp_path / "d" / "x.geojson"))}
    assert read[1]["properties"] == {"name": "a", "area": 2.5} and read[3] == {"type": "Feature", "id": 3, "geometry": {"type": "Point", "coordinates": [10.0, 20.0]}, "properties": {"name": None, "area": None}}
    geojson.write_lines(features, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3


def test_mbtiles(spark, tmp_path):
    path = str(tmp_path / "t" / "a.mbtiles")
    df = spark.createDataFrame([(2, 1, 0, bytearray(b"xx")), (3, 0, 7, bytearray(b"y")), (3, 1, 1, None)], "z int, x bigint, y bigint, tile_data binary")
    assert mbtiles.write_tiles(df, path, mbtiles.default_metadata("a", 2, 3)) == 2
    raw = sqlite3.connect(path)
    assert raw.execute("SELECT zoom_level, tile_column, tile_row FROM tiles ORDER BY 1").fetchall() == [(2, 1, 3), (3, 0, 0)]
    read = mbtiles.read_tiles(spark, path)
    assert sorted((r.z, r.x, r.y, bytes(r.tile_data)) for r in read.collect()) == [(2, 1, 0, b"xx"), (3, 0, 7, b"y")] and read.rdd.getNumPartitions() == 2
    metadata = {r.name: r.value for r in mbtiles.read_metadata(spark, path).collect()}
    assert metadata["format"] == "pbf" and metadata["scheme"] == "tms" and metadata["maxzoom"] == "3"
    store = mbtiles.MBTiles(path)
    assert store.get(2, 1, 0) == b"xx" and store.get(2, 1, 9) is None and store.get_raw(2, 1, 3) == b"xx"
    with pytest.raises(ValueError), store.transaction():
        store.put(2, 0, 0, b"z")
        store.put(2, 0, 4, b"z")
    assert store.get(2, 0, 0) is None  # rolled back
    store.delete(2, 1, 0)
    store.delete(2, 1, 0)
    store.put(3, 0, 7, b"new")
    assert store.get(2, 1, 0) is None and store.get(3, 0, 7) == b"new"
    store.close()
    with pytest.raises(FileNotFoundError):
        mbtiles.MBTiles(str(tmp_path / "none"))


def test_mbtiles_over_a_view(tmp_path):
    path = str(tmp_path / "v.mbtiles")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE images (id, d BLOB); CREATE TABLE map (z, x, y, id); CREATE VIEW tiles AS SELECT z AS zoom_level, x AS tile_column, y AS tile_row, d AS tile_data FROM map JOIN images USING (id); CREATE TABLE metadata (name, value); INSERT INTO images VALUES (1, x'00'); INSERT INTO map VALUES (0, 0, 0, 1);")
    db.close()
    store = mbtiles.MBTiles(path)
    store.put(1, 0, 0, b"q")
    assert store.get(0, 0, 0) == b"\x00" and store.get(1, 0, 0) == b"q"
    store.close()


def test_parquet_tilesets(spark, tmp_path):
    path = str(tmp_path / "tiles")
    df = spark.createDataFrame([(2, 1, 0, bytearray(b"xx")), (3, 0, 7, bytearray(b"y"))], "z int, x bigint, y bigint, tile_data binary")
    tilesets.write_tileset(df, path)
    tilesets.replace_zooms(spark.createDataFrame([(3, 1, 1, bytearray(b"n"))], df.schema), path)
    got = tilesets.read_tileset(spark, path)
    assert [tuple(r) for r in tilesets.keys(got).collect()] == [(2, 1, 3), (3, 1, 6)]
    assert tilesets.get_tile_tms(got, 3, 1, 6).count() == 1
    assert "PartitionFilters: [isnotnull(z" in got.where("z = 2")._jdf.queryExecution().toString()


def test_publishing(tmp_path):
    file = tmp_path / "a.mbtiles"
    file.write_bytes(b"1")
    assert publish.publish(str(file), config.Publish("local", str(tmp_path / "out") + "/"), "generate").endswith("out/a.mbtiles")
    assert (tmp_path / "out" / "a.mbtiles").read_bytes() == b"1"
    assert publish.publish(str(file), config.Publish("local", "x", on_update=False), "update") is None
    assert publish.publish("f", config.Publish("s3", "s3://b/k", args=("--acl", "x")), "generate") == ["aws", "s3", "cp", "f", "s3://b/k", "--acl", "x"]
    assert publish.publish("f", config.Publish(), "generate") is None
    for bad in (config.Publish("local"), config.Publish("mapbox", mapbox_token="t"), config.Publish("ftp")):
        with pytest.raises(ValueError):
            publish.publish("f", bad, "generate")


def test_serving(spark):
    status, headers, body = serving.answer(b"tile")
    assert status == 200 and body == b"tile" and headers["Content-Encoding"] == "gzip" and len(headers["ETag"]) == 18
    assert serving.answer(b"tile", headers["ETag"])[0] == serving.answer(b"tile", "*")[0] == serving.answer(b"tile", f'"x", {headers["ETag"]}')[0] == 304
    assert serving.answer(b"tile", '"x"')[0] == 200 and serving.answer(None)[0] == 204
    df = spark.createDataFrame([(1, 0, 1, bytearray(b"t"))], "z int, x bigint, y bigint, tile_data binary")
    assert serving.tile_response({"a": df}, "a", 1, 0, 1)[2] == b"t"
    assert serving.tile_response({"a": df}, "a", 1, 0, 0)[0] == 204 and serving.tile_response({}, "a", 1, 0, 0)[0] == 404
    c = config.parse(TOML, {})
    out = json.loads(serving.tilejson_response(c, "base")[1])
    assert [x["id"] for x in out["vector_layers"]] == ["parks", "parks_labels", "parks_boundary"] and out["tiles"] == ["http://127.0.0.1:3000/base/{z}/{x}/{y}.pbf"]
    assert serving.tilejson_response(c, "none")[0] == 404 and serving.health() == "ok"


def test_validation(spark):
    parks(spark).createOrReplaceTempView("parks_view")
    good = Source("s", 0, 1, (Layer("parks", "parks_view", properties=("name",)),))
    bad = Source("t", 0, 1, (Layer("x", "nothing"), Layer("y", "parks_view", geometry_column="g", id_column="i", properties=("name", "p"))), mbtiles_path="/nowhere/x.mbtiles")
    out = [(r.source, r.layer, r.issue) for r in validate.validate(spark, config.Config((good, bad))).collect()]
    assert all(r[0] == "t" for r in out) and len(out) == 5
    assert validate.layer_issues(good.layers[0], ["id", "geom", "name"], ["a_tile_update_b"]) == []
    assert generate.catalog_tables(spark)(good.layers[0]).count() == 4


def test_generate_runs_the_publishing_command(spark, tmp_path, monkeypatch):
    import subprocess

    from quadloom import __main__ as main

    monkeypatch.setattr(main.G, "generate", lambda source, tables: None)
    monkeypatch.setattr(main.G, "write_mbtiles", lambda source, tiles, path: 0)
    source = config.Source("s", 0, 1, (), mbtiles_path="f")
    made = lambda command: config.Config((source,), publish=config.Publish("command", command=command))
    main.generate(spark, made(f"touch {tmp_path}/done"), None)
    assert (tmp_path / "done").exists()
    with pytest.raises(subprocess.CalledProcessError):
        main.generate(spark, made("exit 3"), None)
