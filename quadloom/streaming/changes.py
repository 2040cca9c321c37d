"""Change notifications: parsing, and the loop that keeps a tileset fresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BOUNDS = "struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>"


def parse(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads with layer, id, old_bounds and `problem` (null if the payload is fine).

    JSON needs layer (text) and id (a whole number); of old_bounds missing members are 0, null means none. Anything else is layer:id.
    """
    text = F.col(payload)
    json = F.expr(f"try_parse_json({payload})")
    is_json = json.isNotNull()
    layer = F.when(F.expr(f"schema_of_variant(try_parse_json({payload}):layer) = 'STRING'"), F.get_json_object(text, "$.layer"))
    whole = F.get_json_object(text, "$.id").rlike(r"^-?\d+$") & F.expr(f"schema_of_variant(try_parse_json({payload}):id) LIKE 'BIGINT%'")
    number = F.when(whole, F.get_json_object(text, "$.id").try_cast("bigint"))
    old = F.get_json_object(text, "$.old_bounds")
    member = lambda n: F.coalesce(F.get_json_object(text, f"$.old_bounds.{n}").try_cast("double"), F.lit(0.0)).alias(n)
    bounds = F.when(is_json & old.isNotNull(), F.struct(*(member(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat"))))
    parts = F.split(text, ":", 2)
    pair = F.size(parts) == 2
    plain = F.when(pair & F.get(parts, F.lit(1)).rlike(r"^[+-]?\d+$"), F.get(parts, F.lit(1)).try_cast("bigint"))
    out = payloads.select("*", F.when(is_json, layer).when(pair, parts[0]).alias("layer"), F.when(is_json, number).otherwise(plain).alias("id"), bounds.cast(BOUNDS).alias("old_bounds"))
    problem = (
        F.when(F.col("layer").isNull() & is_json, "missing layer")
        .when(F.col("layer").isNull(), "neither JSON nor layer:id")
        .when(F.col("id").isNull(), F.when(is_json, "missing id").otherwise("bad id"))
    )
    return out.withColumn("problem", problem)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem IS NULL").drop("problem")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem IS NOT NULL")


def distinct_changes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The good changes of notifications, repeated ones once and parsed once: all that an update's tiles depend on.

    Payloads are read through their counts, as the optimizer moves conditions on plain distinct values (here: all of the parsing) before the grouping.
    """
    counted = payloads.groupBy(payload).agg(F.count("*").alias("_n"))
    return good(parse(counted.select(F.when(F.col("_n") > 0, F.col(payload)).alias(payload)), payload))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Notifications from text files as they appear, a payload a line."""
    return spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).text(folder).withColumnRenamed("value", "payload")


def watch(payloads: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, debounce_ms: int = 200, reject: Callable[[DataFrame, int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Runs update(changes, batch id) for every micro-batch of notifications; what can't be parsed goes to reject.

    The trigger's interval gathers what arrives in the meantime. A batch that fails runs again under the same id after a restart from the checkpoint.
    """

    def handle(batch: DataFrame, number: int) -> None:
        parsed = parse(batch).persist()
        try:
            if reject:
                reject(rejected(parsed), number)
            update(good(parsed), number)
        finally:
            parsed.unpersist()

    writer = payloads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()
