"""Validation of a configuration against the tables there are."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, Layer


def catalog_columns(spark: SparkSession, layer: Layer) -> list[str] | None:
    """A table's columns, or None if there is no such table."""
    for name in (f"{layer.schema}.{layer.table}", layer.table):
        if spark.catalog.tableExists(name):
            return spark.table(name).columns
    return None


def layer_issues(layer: Layer, columns: list[str] | None, triggers: list[str] | None = None) -> list[str]:
    """What a layer's table lacks. triggers: names of the table's triggers, if they are known."""
    if columns is None:
        return [f'Table "{layer.schema}"."{layer.table}" does not exist']
    lacks = lambda what, c: f'{what} column "{c}" does not exist in "{layer.schema}"."{layer.table}"'
    issues = [lacks("Geometry", c) for c in layer.all_geometry_columns() if c not in columns]
    issues += [lacks("ID", layer.id_column)] * (layer.id_column not in columns)
    issues += [lacks("Property", c) for c in layer.properties or () if c not in columns]
    if triggers is not None and not any("tile_update" in t for t in triggers):
        issues.append(f'No tile_update trigger found on "{layer.schema}"."{layer.table}"')
    return issues


def validate(spark: SparkSession, config: Config, columns: Mapping[str, list[str]] | None = None, triggers: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(source, layer, issue) of everything amiss; no rows if all is well. columns: of tables, if not the catalog's."""
    rows = []
    for source in config.sources:
        if source.mbtiles_path and not Path(source.mbtiles_path).parent.exists():
            rows.append((source.name, None, f"MBTiles parent directory does not exist: {Path(source.mbtiles_path).parent}"))
        for layer in source.layers:
            have = columns.get(layer.table) if columns is not None else catalog_columns(spark, layer)
            known = None if triggers is None else triggers.get(layer.table, [])
            rows += [(source.name, layer.name, issue) for issue in layer_issues(layer, have, known)]
    return spark.createDataFrame(rows, "source string, layer string, issue string")
