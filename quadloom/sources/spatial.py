"""Spatial views of plain tables: the same SQL text runs in Spark and elsewhere, so results can be compared.

Places are arithmetic on ids, kept off tile edges by small offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Layer
from ..functions import geometry as G
from . import layers as L

VIEWS = {
    "geo_points": """
SELECT event_id AS id, 'points' AS layer, event_type AS kind, value, user_id, ts,
  CAST((event_id * 7919) % 36000 AS DOUBLE) / 100 - 180 + 0.001 AS lon,
  CAST((user_id * 104729 + event_id * 31) % 17000 AS DOUBLE) / 100 - 85 + 0.0005 AS lat
FROM events""",
    "geo_boxes": """
SELECT id, 'boxes' AS layer, name, kind, size,
  cx - hw AS min_lon, cy - hw AS min_lat, cx + hw AS max_lon, cy + hw AS max_lat
FROM (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_size AS size, CAST(p_size AS DOUBLE) / 50 AS hw,
  CASE WHEN p_partkey % 97 = 0 THEN NULL
       ELSE CAST((p_partkey * 6151) % 34000 AS DOUBLE) / 100 - 170 + 0.0003 END AS cx,
  CAST((p_partkey * 3571) % 16000 AS DOUBLE) / 100 - 80 + 0.0007 AS cy FROM part) t""",
    "geo_lines": """
SELECT id, 'lines' AS layer, status, x0, y0, x0 + dx AS x1, y0 + dy / 2 AS y1, x0 + dx / 2 AS x2, y0 + dy AS y2
FROM (SELECT o_orderkey AS id, o_orderstatus AS status,
  CAST((o_custkey * 4409) % 35000 AS DOUBLE) / 100 - 175 + 0.0001 AS x0,
  CAST((o_orderkey * 2713) % 15000 AS DOUBLE) / 100 - 75 + 0.0002 AS y0,
  CAST(o_orderkey % 41 - 20 AS DOUBLE) / 10 AS dx,
  CAST(o_orderkey % 23 - 11 AS DOUBLE) / 10 AS dy FROM orders) t""",
    "changes": """
SELECT event_id, ts, CASE
  WHEN event_id % 10 = 7 THEN concat('boxes:', CAST(event_id % 200 AS STRING))
  WHEN event_id % 10 = 9 THEN 'garbage'
  WHEN event_id % 3 = 0 THEN concat('{"layer":"', l, '","id":', CAST(event_id % 200 AS STRING), ',"op":"insert"}')
  ELSE concat('{"layer":"', l, '","id":', CAST(event_id % 200 AS STRING), ',"op":"',
    CASE WHEN event_id % 3 = 1 THEN 'update' ELSE 'delete' END, '","old_bounds":{"min_lon":',
    CAST(event_id % 300 - 150 AS STRING), ',"min_lat":', CAST(event_id % 140 - 70 AS STRING), ',"max_lon":',
    CAST(event_id % 300 - 149 AS STRING), ',"max_lat":', CAST(event_id % 140 - 69 AS STRING), '}}') END AS payload
FROM (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'points' WHEN 1 THEN 'boxes'
        WHEN 2 THEN 'lines' ELSE 'unknown' END AS l FROM events) t""",
}
TABLES = {"geo_points": "events", "geo_boxes": "part", "geo_lines": "orders", "changes": "events"}
LAYERS = {
    "points": Layer("points", "geo_points", properties=("kind", "value", "user_id")),
    "boxes": Layer("boxes", "geo_boxes", properties=("name", "kind", "size")),
    "lines": Layer("lines", "geo_lines", properties=("status",)),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    text = VIEWS[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {" + table + "}")
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_geometry(df: DataFrame, layer: str) -> DataFrame:
    """The view with its geometry column."""
    c = F.col
    made = {
        "points": lambda: G.point(c("lon"), c("lat")),
        "boxes": lambda: G.box(c("min_lon"), c("min_lat"), c("max_lon"), c("max_lat")),
        "lines": lambda: G.line([(c("x0"), c("y0")), (c("x1"), c("y1")), (c("x2"), c("y2"))]),
    }[layer]()
    return df.withColumn("geom", made)


def features(spark: SparkSession, sf_dir: str, layer: str) -> DataFrame:
    return L.scan(with_geometry(view(spark, sf_dir, f"geo_{layer}"), layer), LAYERS[layer])
