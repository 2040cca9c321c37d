import gzip

import pytest
from pyspark.sql import functions as F

from quadloom.functions import geometry as G
from quadloom.functions import mvt


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("n,z", [(0, 0), (1, 2), (2, 4), (100, 200), (-1, 1), (-2, 3), (-100, 199), (2147483647, 4294967294), (-2147483648, 4294967295)])
def test_zigzag(spark, n, z):
    assert one(spark, mvt.zigzag(F.lit(n))) == (z,)


@pytest.mark.parametrize("kind,count,n", [(1, 1, 9), (2, 5, 42), (7, 1, 15)])
def test_command(spark, kind, count, n):
    assert one(spark, mvt.command(kind, F.lit(count))) == (n,)


def drawn(spark, kind, parts, restart=False):
    df = spark.createDataFrame([(kind, [[[(x, y) for x, y in ring] for ring in part] for part in parts])], "kind string, parts array<array<array<struct<x: int, y: int>>>>")
    return df.select(mvt.commands(F.col("kind"), F.col("parts"), restart)).first()[0]


def test_commands_draw_what_went_in(spark):
    cases = {
        "Point": [[[(5, 7)]]],
        "MultiPoint": [[[(5, 7)], [(3, 2)], [(9, 9)]]],
        "LineString": [[[(2, 2), (2, 10), (10, 10)]]],
        "MultiLineString": [[[(2, 2), (2, 10), (10, 10)], [(1, 1), (3, 5)]]],
        "Polygon": [[[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 2)]]],
        "MultiPolygon": [[[(0, 0), (10, 0), (10, 10), (0, 0)]], [[(20, 20), (24, 20), (24, 24), (20, 20)]]],
    }
    for kind, parts in cases.items():
        assert mvt.decode_commands(drawn(spark, kind, parts)) == [ring for part in parts for ring in part], kind
    # The specification's own examples.
    assert drawn(spark, "Point", [[[(25, 17)]]]) == [9, 50, 34]
    assert drawn(spark, "MultiPoint", [[[(5, 7)], [(3, 2)]]]) == [17, 10, 14, 3, 9]
    assert drawn(spark, "LineString", [[[(2, 2), (2, 10), (10, 10)]]]) == [9, 4, 4, 18, 0, 16, 16, 0]
    assert drawn(spark, "MultiLineString", cases["MultiLineString"]) == [9, 4, 4, 18, 0, 16, 16, 0, 9, 17, 17, 10, 4, 8]
    assert drawn(spark, "Polygon", [[[(3, 6), (8, 12), (20, 34), (3, 6)]]]) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert drawn(spark, "MultiLineString", cases["MultiLineString"], restart=True)[8:11] == [9, 2, 2]


def test_nothing_is_drawn(spark):
    assert drawn(spark, "LineString", [[[(1, 1)]]]) == []
    assert drawn(spark, "GeometryCollection", [[[(1, 1), (2, 2)]]]) == []
    assert drawn(spark, "Point", []) == []


def test_value_typing(spark):
    df = spark.createDataFrame([("hello", 42, 3.14, True, None, [1, 2], {"a": 1}, -42, 0, 7.0)], "s string, i bigint, d double, b boolean, n string, a array<int>, m map<string, int>, j int, z int, w double")
    kinds = dict(df.dtypes)
    got = df.select(*(mvt.typed_value(F.col(c), kinds[c]).alias(c) for c in df.columns)).first().asDict()
    assert {k: (v.kind, v.text) for k, v in got.items()} == {"s": ("s", "hello"), "i": ("i", "42"), "d": ("d", "3.14"), "b": ("b", "true"), "n": ("o", "null"), "a": ("o", "[1,2]"), "m": ("o", '{"a":1}'), "j": ("i", "-42"), "z": ("i", "0"), "w": ("i", "7")}
    keys = df.select(*(mvt.dictionary_key(mvt.typed_value(F.col(c), kinds[c])).alias(c) for c in ("s", "i", "b", "n"))).first()
    assert tuple(keys) == ("s:hello", "n:42", "b:true", "o:null")


def test_tiles_are_written_and_read():
    w = mvt.LayerWriter("roads")
    w.add(1, 2, [9, 4, 4, 18, 0, 16, 16, 0], {"name": ("s", "a"), "lanes": ("i", "-2"), "ok": ("b", "true"), "w": ("d", "1.5"), "x": ("o", "null")})
    w.add(-5, 1, [9, 50, 34], {"name": ("s", "a"), "lanes": ("i", "3")})
    data = mvt.compressed(mvt.tile_message([w, mvt.LayerWriter("empty")]))
    assert data[:2] == b"\x1f\x8b" and data == mvt.compressed(gzip.decompress(data))
    [layer] = mvt.decode_tile(data)
    assert (layer["name"], layer["version"], layer["extent"]) == ("roads", 2, 4096)
    a, b = layer["features"]
    assert a == {"id": 1, "type": 2, "commands": [9, 4, 4, 18, 0, 16, 16, 0], "properties": {"name": "a", "lanes": -2, "ok": True, "w": 1.5, "x": "null"}}
    assert b["id"] == -5 and b["properties"] == {"name": "a", "lanes": 3}
    assert len(w.values) == 6  # shared ones once


def test_local_geometry(spark):
    g = G.point(F.lit(0.0), F.lit(0.0))
    parts = one(spark, mvt.local_geometry(g, F.lit(0), F.lit(0), F.lit(0)))[0]
    assert (parts[0][0][0].x, parts[0][0][0].y) == (2048, 2048)
