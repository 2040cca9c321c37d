import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.config import Config, Layer, PropertyRule, Source
from quadloom.functions import geometry as G
from quadloom.functions.mvt import decode_tile
from quadloom.functions.text import format_bytes, hmac_signature, signature
from quadloom.operators import encode as E
from quadloom.operators import events as V
from quadloom.operators import tilesets as S
from quadloom.plans import generate as P
from quadloom.streaming import changes as N
from quadloom.streaming import cooldown as C

TILES = "z int, x bigint, y bigint, tile_data binary"


@pytest.mark.parametrize(
    "payload,layer,number,bounds,problem",
    [
        ('{"layer":"water","id":7,"old_bounds":{"min_lon":1.5,"min_lat":2,"max_lon":3,"max_lat":4}}', "water", 7, (1.5, 2, 3, 4), False),
        ('{"layer":"water","id":7,"old_bounds":{"min_lon":1.5}}', "water", 7, (1.5, 0, 0, 0), False),
        ('{"layer":"water","id":7,"old_bounds":null}', "water", 7, None, False),
        ("water:123", "water", 123, None, False),
        ("layer:-1", "layer", -1, None, False),
        ("a:b:1", "a", None, None, True),
        ("nothing", None, None, None, True),
        ("water:x", "water", None, None, True),
        ('{"id":7}', None, 7, None, True),
        ('{"layer":"water"}', "water", None, None, True),
        ('{"layer":5,"id":7}', None, 7, None, True),
        ('{"layer":"w","id":"7"}', "w", None, None, True),
        ('{"layer":"w","id":1.5}', "w", None, None, True),
        ("", None, None, None, True),
        (None, None, None, None, True),
    ],
)
def test_notifications(spark, payload, layer, number, bounds, problem):
    r = N.parse(spark.createDataFrame([(payload,)], "payload string")).first()
    assert (r.layer, r.id, tuple(r.old_bounds) if r.old_bounds else None, r.problem is not None) == (layer, number, bounds, problem)


def source_tables(spark, moved=False):
    boxes = [(i, f"b{i}", i * 1.5, "POLYGON ((%f %f, %f %f, %f %f, %f %f))" % (x, y, x + 3, y, x + 3, y + 2, x, y)) for i, x, y in [(1, -120, 30), (2, 10.3 + 20 * moved, 50), (3, 100, -20)] if not (moved and i == 3)]
    lines = [(1, "LINESTRING (0 0, 10 0.001, 20 0, 30 40)"), (2, "LINESTRING (-50 -50, -51 -49.5, -52 -50)")]
    return {
        "boxes": spark.createDataFrame(boxes, "id int, name string, area double, wkt string").withColumn("geom", G.from_wkt(F.col("wkt"))).drop("wkt"),
        "lines": spark.createDataFrame(lines, "id int, wkt string").withColumn("geom", G.from_wkt(F.col("wkt"))).drop("wkt"),
    }


SOURCE = Source("s", 0, 4, (
    Layer("boxes", "boxes", properties=("name", "area"), property_rules=(PropertyRule(2, ("area",)),), generate_label_points=True, generate_boundary_lines=True),
    Layer("lines", "lines", properties=(), simplify_tolerance=0.00001),
))


def collected(tiles):
    return {(r.z, r.x, r.y): bytes(r.tile_data) for r in tiles.collect()}


def test_generation(spark):
    tiles = collected(P.generate(SOURCE, source_tables(spark)))
    top = {layer["name"]: layer["features"] for layer in decode_tile(tiles[0, 0, 0])}
    assert {k: len(v) for k, v in top.items()} == {"boxes": 3, "boxes_boundary": 3, "boxes_labels": 3, "lines": 2}
    assert set(top["boxes"][0]["properties"]) == {"name"} and set(top["boxes_labels"][0]["properties"]) == {"name", "area"}
    assert {f["type"] for f in top["boxes_boundary"]} == {2} and {f["type"] for f in top["boxes_labels"]} == {1}
    assert len(top["lines"][0]["commands"]) < 3 + 1 + 6  # simplified at low zooms
    assert collected(P.generate(SOURCE, source_tables(spark))) == tiles


def test_incremental_update_is_the_same_as_a_new_generation(spark):
    before, after = source_tables(spark), source_tables(spark, moved=True)
    old = collected(P.generate(SOURCE, before))
    bounds = {2: (10.3, 50.0, 13.3, 52.0), 3: (100.0, -20.0, 103.0, -18.0)}
    changes = spark.createDataFrame([("boxes", i, b) for i, b in bounds.items()] + [("boxes", 1, None)], "layer string, id bigint, old_bounds struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>")
    config = Config((SOURCE,))
    changed, event, release = P.update(spark, config, after, changes)["s"]
    rows = changed.collect()
    for r in rows:
        if r.tile_data is None:
            old.pop((r.z, r.x, r.y), None)
        else:
            old[r.z, r.x, r.y] = bytes(r.tile_data)
    assert old == collected(P.generate(SOURCE, after))
    e = event.first()
    assert (e.event, e.tiles_updated, e.affected_zooms, e.max_zoom, e.layers_affected) == ("update_complete", len(rows), [0, 1, 2, 3, 4], 4, ["boxes"])
    # Deleting without old bounds needs the features as they were.
    bare = spark.createDataFrame([("boxes", 3, None)], changes.schema)
    previous = P.source_features(SOURCE, before).where("layer = 'boxes'")
    assert P.update(spark, config, after, bare)["s"][0].count() == 0
    assert {(r.z, r.x, r.y) for r in P.update(spark, config, after, bare, previous)["s"][0].collect()} <= {(r.z, r.x, r.y) for r in rows}


def test_watching(spark, tmp_path):
    feed, seen, bad = tmp_path / "feed", [], []
    feed.mkdir()
    (feed / "1.txt").write_text('boxes:1\nnonsense\n{"layer":"boxes","id":2}\n')
    query = N.watch(N.read_stream(spark, str(feed)), lambda df, _: seen.extend((r.layer, r.id) for r in df.collect()), str(tmp_path / "check"), reject=lambda df, _: bad.extend(r.payload for r in df.collect()), once=True)
    assert query.awaitTermination(60)
    assert sorted(seen) == [("boxes", 1), ("boxes", 2)] and bad == ["nonsense"]


def test_routing_and_merging(spark):
    two = Config((SOURCE, Source("t", 1, 2, (Layer("boxes", "boxes"),))))
    changes = spark.createDataFrame([("boxes_labels", 1), ("boxes", 2), ("none", 3)], "layer string, id bigint")
    assert sorted((r.source, r.layer, r.id) for r in S.route(changes, P.shown_layers(spark, two)).collect()) == [("s", "boxes", 1), ("s", "boxes", 2), ("t", "boxes", 2)]
    tiles = spark.createDataFrame([(0, 0, 0, bytearray(b"a")), (1, 0, 0, bytearray(b"b")), (1, 1, 1, bytearray(b"c"))], TILES)
    affected = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0)], "z int, x bigint, y bigint")
    fresh = spark.createDataFrame([(1, 1, 1, bytearray(b"C")), (2, 0, 0, bytearray(b"d"))], TILES)
    assert collected(S.merge(tiles, affected, fresh)) == {(0, 0, 0): b"a", (1, 1, 1): b"C", (2, 0, 0): b"d"}
    assert {(r.z, r.x, r.y): r.tile_data for r in S.changes_of(affected, fresh).collect()}[1, 0, 0] is None


def test_comparison(spark):
    a = spark.createDataFrame([(0, 0, 0, bytearray(b"a")), (1, 0, 0, bytearray(b"b")), (1, 1, 0, bytearray(b"c"))], TILES)
    b = spark.createDataFrame([(0, 0, 0, bytearray(b"a")), (1, 0, 0, bytearray(b"x")), (2, 0, 0, bytearray(b"d"))], TILES)
    assert tuple(S.diff_summary(S.compare(a, b)).first()) == (3, 3, 1, 1, 1, 1)
    assert [tuple(r) for r in S.diff_by_zoom(S.compare(a, b)).collect()] == [(1, 0, 1, 1), (2, 1, 0, 0)]
    assert S.diff_by_zoom(S.compare(a, a)).collect() == [] and tuple(S.diff_summary(S.compare(a, a)).first())[2:] == (0, 0, 0, 3)
    m = lambda d: spark.createDataFrame(list(d.items()), "name string, value string")
    assert [tuple(r) for r in S.metadata_diff(m({"a": "1", "b": "2", "c": "3"}), m({"a": "1", "b": "4", "d": "5"})).collect()] == [("b", "changed", "2", "4"), ("c", "removed", "3", None), ("d", "added", None, "5")]


def test_statistics(spark):
    tiles = spark.createDataFrame([(0, 0, 0, bytearray(b"12345")), (1, 0, 0, bytearray(b"1234567"))], TILES)
    assert tuple(S.inspect(tiles).first()) == (2, 12, "12 B", 6, "6 B", 0, 1)
    assert tuple(S.inspect(tiles.limit(0)).first())[:4] == (0, 0, "0 B", 0)
    sizes = [0, 512, 1023, 1024, 1536, 1 << 20, int(5.5 * (1 << 20)), 1 << 30, 1280]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select(format_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == ["0 B", "512 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.5 MB", "1.00 GB", "1.2 KB"]


def test_signatures(spark):
    df = spark.createDataFrame([("body",), (None,)], "t string")
    assert [r[0] for r in df.select(hmac_signature(F.col("t"), "k").alias("s")).collect()] == [signature("k", b"body"), None]
    assert V.retry_delays(3) == [500, 1000, 2000]


def update_event(n, zooms, layers, source="s"):
    return {"event": V.UPDATE, "source": source, "duration_ms": None, "tiles_updated": n, "affected_zooms": zooms, "max_zoom": 7, "layers_affected": layers}


def generate_event(ms, source="s"):
    return {"event": V.GENERATE, "source": source, "duration_ms": ms, "tiles_updated": None, "affected_zooms": [], "max_zoom": None, "layers_affected": []}


def test_merging_events():
    both = C.merge(C.merge(None, update_event(10, [6, 5], ["b"])), update_event(20, [6, 7], ["a"]))
    assert (both["tiles_updated"], both["affected_zooms"], both["layers_affected"]) == (30, [5, 6, 7], ["a", "b"])
    assert C.merge(both, generate_event(5)) == generate_event(5) and C.merge(generate_event(5), both) == generate_event(5)
    assert C.merge(generate_event(5), generate_event(9))["duration_ms"] == 9


EVENTS = st.lists(st.one_of(st.builds(update_event, st.integers(1, 50), st.lists(st.integers(0, 9), min_size=1, max_size=3), st.lists(st.sampled_from("abc"), min_size=1, max_size=2)), st.builds(generate_event, st.integers(1, 99))), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None)
@given(EVENTS)
def test_batch_merging_is_stream_merging(spark, events):
    held = None
    for e in events:
        held = C.merge(held, e)
    df = spark.createDataFrame([(i, *e.values()) for i, e in enumerate(events)], "seq int, " + V.EVENT)
    got = V.merged(df, ["source"]).first().asDict()
    for k in ("event", "tiles_updated", "max_zoom", "duration_ms"):
        assert got[k] == (held[k] if not (held["event"] == V.GENERATE and k in ("tiles_updated", "max_zoom")) else None)
    if held["event"] == V.UPDATE:
        assert got["affected_zooms"] == held["affected_zooms"] and got["layers_affected"] == held["layers_affected"]


def test_kinds_and_texts(spark):
    df = spark.createDataFrame([tuple(update_event(1, [1], ["a"]).values()), tuple(generate_event(3).values())], V.EVENT)
    assert V.of_kinds(df, on_update=False).count() == 1 and V.of_kinds(df, False, False).count() == 0
    texts = [r[0] for r in df.select(V.as_sse(df)).collect()]
    assert texts[1] == 'event: generate_complete\ndata: {"event":"generate_complete","source":"s","duration_ms":3}\n\n'
    assert json.loads(texts[0].split("data: ")[1])["affected_zooms"] == [1]


def test_batch_cooldown(spark):
    rows = [("a", t) for t in (0, 1, 9, 10, 19, 25)] + [("b", 5)]
    out = V.cooldown_windows(spark.createDataFrame(rows, "source string, t bigint"), "source", F.col("t"), 10)
    assert sorted((r.source, r.t, r.window_start) for r in out.collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 9, 0), ("a", 10, 10), ("a", 19, 10), ("a", 25, 25), ("b", 5, 5)]


def test_streaming_cooldown(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "events"
    folder.mkdir()
    events = [update_event(10, [10], ["a"]), update_event(11, [11], ["b"]), update_event(12, [12], ["a"]), update_event(5, [1], ["z"], "other")]
    (folder / "1.json").write_text("\n".join(map(json.dumps, events)))
    stream = spark.readStream.schema(V.EVENT).json(str(folder))
    query = C.cooled(stream, 1).writeStream.format("memory").queryName("cooled").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.sql("SELECT * FROM cooled").count() < 2:
            time.sleep(0.5)
        rows = {r.source: r for r in spark.sql("SELECT * FROM cooled").collect()}
        assert rows["s"].tiles_updated == 33 and rows["s"].affected_zooms == [10, 11, 12] and rows["s"].layers_affected == ["a", "b"]
        assert rows["other"].tiles_updated == 5
    finally:
        query.stop()
    assert C.cooled(stream, None) is stream


def test_excluded_properties(spark):
    layer = Layer("x", "x", property_rules=(PropertyRule(5, ("metadata",)), PropertyRule(10, ("description",))))
    df = spark.createDataFrame([(3,), (7,), (12,)], "z int")
    got = df.select(F.array_sort(E.excluded_properties(F.lit("x"), F.col("z"), [layer])).alias("e")).collect()
    assert [r.e for r in got] == [["description", "metadata"], ["description"], []]


def test_a_tile_that_cannot_be_made_stays_as_it_is(spark):
    rows = [(0, 0, 0, "i", "5"), (1, 0, 0, "i", "no number"), (1, 1, 0, "s", "x")]
    df = spark.createDataFrame([(z, x, y, "l", 1, k, t) for z, x, y, k, t in rows], "z int, x long, y long, layer string, id long, kind string, text string")
    placed = df.withColumn("geometry", G.point(F.lit(0.0), F.lit(0.0))).withColumn("props", F.create_map(F.lit("a"), F.struct("kind", "text")))
    fresh = E.encode(placed, skip_failed=True)
    affected = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)], "z int, x long, y long")
    changed = {(r.z, r.x, r.y): r.tile_data is not None for r in S.changes_of(affected, fresh).collect()}
    assert changed == {(0, 0, 0): True, (1, 1, 0): True, (1, 1, 1): False}
