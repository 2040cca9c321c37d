"""Layer scans: a table and a layer's configuration become features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Database, Layer
from ..functions import geometry as G
from ..functions import mvt, shapes
from ..functions.text import BOUNDARY, LABELS

FEATURES = ["layer", "id", "geometry", "bbox", "props"]
#: How a geometry column's text or bytes are read.
READERS: dict[str, Callable[[Column], Column]] = {"geojson": G.from_geojson, "wkt": G.from_wkt, "wkb": shapes.from_wkb}


def property_names(df: DataFrame, layer: Layer) -> list[str]:
    """The listed properties, or all columns but geometries."""
    return list(layer.properties) if layer.properties is not None else [c for c in df.columns if c not in layer.all_geometry_columns()]


def properties(df: DataFrame, names: list[str]) -> Column:
    """The named columns as a map of typed values; nulls stay."""
    kinds = dict(df.dtypes)
    if not names:
        return F.create_map().cast(f"map<string, {mvt.VALUE}>")
    return F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(mvt.typed_value(F.col(f"`{n}`"), kinds[n]) for n in names)))


def read_geometry(df: DataFrame, column: str, encoding: str | None = None) -> Column:
    """A geometry column as it is, or read from GeoJSON, WKT or WKB."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("struct"):
        return F.col(f"`{column}`")
    return READERS[encoding or ("wkb" if kind == "binary" else "geojson")](F.col(f"`{column}`"))


def scan(table: DataFrame, layer: Layer, encoding: str | None = None) -> DataFrame:
    """The features of a layer's table: those with a geometry that pass the layer's filter."""
    kept = table.where(F.col(f"`{layer.geometry_column}`").isNotNull())
    if layer.filter:
        kept = kept.where(F.expr(f"({layer.filter})"))
    kind = dict(table.dtypes)[layer.id_column]
    number = F.col(f"`{layer.id_column}`")
    number = number if kind in ("bigint", "int", "smallint", "tinyint") else F.expr(f"try_cast(`{layer.id_column}` AS BIGINT)")
    out = kept.select(F.lit(layer.name).alias("layer"), F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint")).alias("id"), G.to_degrees(read_geometry(table, layer.geometry_column, encoding), layer.srid).alias("geometry"), properties(table, property_names(table, layer)).alias("props"))
    return out.where("geometry IS NOT NULL").select("layer", "id", "geometry", G.bbox(F.col("geometry")).alias("bbox"), "props")


def with_derived(features: DataFrame, layer: Layer) -> DataFrame:
    """A layer's features and those of its derived layers; derived ones keep the bounds and have the parent geometry's place."""
    out = features.withColumn("parent", F.col("geometry"))
    parts = [out]
    if layer.generate_label_points:
        parts.append(out.withColumn("layer", F.lit(layer.name + LABELS)).withColumn("geometry", shapes.point_on_surface(F.col("parent"))))
    if layer.generate_boundary_lines:
        parts.append(out.withColumn("layer", F.lit(layer.name + BOUNDARY)).withColumn("geometry", G.boundary(F.col("parent"))))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p.where("geometry IS NOT NULL"))
    return made


def lookup(features: DataFrame, keys: DataFrame) -> DataFrame:
    """Features by (layer, id), keys without a feature included."""
    return keys.select("layer", "id").distinct().join(features, ["layer", "id"], "left")


def read_jdbc(spark: SparkSession, database: Database, layer: Layer, partition_column: str | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A layer's table over JDBC, the geometry as WKB; in as many parallel reads as the pool has connections, if given id bounds."""
    geometry = f'ST_AsBinary("{layer.geometry_column}") AS "{layer.geometry_column}"'
    names = ", ".join(f'"{c}"' for c in dict.fromkeys([layer.id_column, *(layer.properties or ())]))
    query = f'(SELECT {geometry}, {names} FROM "{layer.schema}"."{layer.table}") AS features'
    reader = spark.read.format("jdbc").option("url", database.jdbc_url()).option("dbtable", query).option("user", database.user).option("password", database.password or "")
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", database.pool_size)
    return reader.load()
