"""GeoJSON: features as text, and files of feature collections."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def json_value(value: Column) -> Column:
    """A typed property value as JSON text."""
    return F.when(value["kind"] == "s", F.regexp_extract(F.to_json(F.struct(value["text"].alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)).otherwise(value["text"])


def feature_json(features: DataFrame) -> DataFrame:
    """(layer, id, feature): each feature as a GeoJSON object; properties are sorted by name."""
    pairs = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e["key"].alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(":"), json_value(e["value"])))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"geometry":'), G.to_geojson(F.col("geometry")), F.lit(',"properties":{'), F.concat_ws(",", pairs), F.lit("}}"))
    return features.select("layer", "id", text.alias("feature"))


def write_collection(features: DataFrame, path: str) -> int:
    """Writes a feature collection, feature by feature as they come in from the cluster; returns how many."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", encoding="utf-8") as out:
        out.write('{"type":"FeatureCollection","features":[')
        for row in feature_json(features).select("feature").toLocalIterator():
            out.write(("," if n else "") + row.feature)
            n += 1
        out.write("]}")
    return n


def write_lines(features: DataFrame, path: str) -> None:
    """Writes features as lines of JSON, in parallel, a folder for each layer."""
    feature_json(features).select("layer", "feature").write.mode("overwrite").partitionBy("layer").text(path)


def read_collection(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as file:
        return json.load(file)["features"]
