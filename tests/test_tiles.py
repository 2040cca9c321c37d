import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions import tiles as T
from quadloom.operators.cover import cover


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("lon,z,x", [(-180.0, 1, 0), (0.0, 1, 1), (179.9, 1, 1), (0.0, 10, 512), (-200.0, 3, 0), (float("nan"), 3, 0)])
def test_tile_x(spark, lon, z, x):
    assert one(spark, T.tile_x(F.lit(lon), F.lit(z))) == (x,)


@pytest.mark.parametrize("lat,z,y", [(0.0, 1, 1), (85.0, 5, 0), (float("nan"), 3, 0), (89.999999, 4, 0), (-90.0, 4, 4294967295)])
def test_tile_y(spark, lat, z, y):
    got = one(spark, T.tile_y(F.lit(lat), F.lit(z)))[0]
    assert got == y or (lat == -90.0 and got > 15)


def cover_of(spark, bounds, z0, z1):
    df = spark.createDataFrame([(bounds,)], "b struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>")
    return [tuple(r) for r in cover(df, "b", z0, z1).select("z", "x", "y").collect()]


def test_cover_counts(spark):
    assert len(cover_of(spark, (-10.0, -10.0, 10.0, 10.0), 0, 0)) == 1
    assert len(cover_of(spark, (-180.0, -85.0, 180.0, 85.0), 1, 1)) == 4
    assert cover_of(spark, (170.0, -10.0, -170.0, 10.0), 3, 3) == []
    assert cover_of(spark, (0.0, 0.0, 1.0, 1.0), 3, 2) == []


@pytest.mark.parametrize("bounds,n", [((-122.4490, 37.7525, -122.4440, 37.7560), 17), ((-122.4430, 37.7380, -122.4370, 37.7430), 15), ((-122.4420, 37.7680, -122.4380, 37.7710), 16)])
def test_documented_update_sizes(spark, bounds, n):
    assert len(cover_of(spark, bounds, 0, 14)) == n


def test_local_coordinates(spark):
    b = T.tile_bounds(F.lit(0), F.lit(0), F.lit(0))
    assert one(spark, T.local_x(F.lit(-180.0), b), T.local_y(b["max_lat"], b)) == (0, 0)
    b = T.tile_bounds(F.lit(10), F.lit(512), F.lit(340))
    x, y = one(spark, T.local_x((b["min_lon"] + b["max_lon"]) / 2, b), T.local_y((b["min_lat"] + b["max_lat"]) / 2, b))
    assert abs(x - 2048) < 50 and abs(y - 2048) < 50
    x, y = one(spark, T.local_x(b["min_lon"] - 0.0001, b), T.local_y(b["max_lat"] + 0.0001, b))
    assert x <= 0 and y <= 0  # neither clipped nor clamped
    mid = one(spark, T.local_y_mercator(F.lit(0.0), F.lit(0), F.lit(0)))
    assert mid == (2048,)


def test_tms_flip(spark):
    assert one(spark, T.tms_flip(F.lit(0), F.lit(2)), T.tms_flip(F.lit(7), F.lit(3)), T.tms_flip(F.lit(4), F.lit(2)), T.tms_flip(F.lit(-1), F.lit(2))) == (3, 0, None, None)


def test_tolerance(spark):
    assert one(spark, *(T.simplification_tolerance(F.lit(0.5), F.lit(z)) for z in (18, 17, 10, 20))) == (0.5, 1.0, 128.0, 0.5)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(-179, 179), st.floats(-84, 84), st.integers(0, 20)), min_size=5, max_size=30))
def test_a_place_lies_in_its_tile(spark, places):
    df = spark.createDataFrame(places, "lon double, lat double, z int").select("*", T.tile_x(F.col("lon"), F.col("z")).alias("x"), T.tile_y(F.col("lat"), F.col("z")).alias("y"))
    for r in df.select("*", T.tile_bounds(F.col("z"), F.col("x"), F.col("y")).alias("b")).collect():
        slack = 1e-9
        assert r.b.min_lon - slack <= r.lon <= r.b.max_lon + slack and r.b.min_lat - slack <= r.lat <= r.b.max_lat + slack
        n = 2**r.z
        assert r.x == min(n - 1, math.floor((r.lon + 180) / 360 * n))
