"""Pipeline events: one wide row for both kinds, merging, batch cooldown windows, texts for subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERATE, UPDATE = "generate_complete", "update_complete"
EVENT = "event string, source string, duration_ms bigint, tiles_updated bigint, affected_zooms array<int>, max_zoom int, layers_affected array<string>"


def of_kinds(events: DataFrame, on_generate: bool = True, on_update: bool = True) -> DataFrame:
    kinds = [k for k, on in ((GENERATE, on_generate), (UPDATE, on_update)) if on]
    return events.where(F.col("event").isin(kinds)) if kinds else events.where(F.lit(False))


def _union(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def merged(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One event for each key: updates add up, a generation stands for all, the latest generation's duration counts.

    Zooms and layers are sets of bounded size (zooms of a source, layers of a source), so collecting distinct ones stays small.
    """
    is_update = F.col("event") == UPDATE
    update = lambda c: F.when(is_update, F.col(c))
    out = events.groupBy(*keys).agg(
        F.max(F.col("event") == GENERATE).alias("generated"),
        F.max_by(F.when(~is_update, F.col("duration_ms")), F.when(~is_update, F.col(order))).alias("duration_ms"),
        F.sum(update("tiles_updated")).alias("tiles_updated"),
        _union(F.collect_set(F.coalesce(update("affected_zooms"), F.array().cast("array<int>")))).alias("affected_zooms"),
        F.min_by(update("max_zoom"), F.when(is_update, F.col(order))).alias("max_zoom"),
        _union(F.collect_set(F.coalesce(update("layers_affected"), F.array().cast("array<string>")))).alias("layers_affected"),
    )
    unless = lambda c: F.when(~F.col("generated"), F.col(c)).alias(c)
    kind = F.when(F.col("generated"), GENERATE).otherwise(UPDATE)
    return out.select(*keys, kind.alias("event"), "duration_ms", *(unless(c) for c in ("tiles_updated", "affected_zooms", "max_zoom", "layers_affected")))


def cooldown_windows(events: DataFrame, key: str, seconds: Column, cooldown: int) -> DataFrame:
    """Events with `window_start`: a key's first event opens a window, those within `cooldown` seconds belong to it, the next opens another.

    seconds: the event's time as a whole number. A key's distinct seconds are folded in order; they are at most as many as the
    span of time has seconds.
    """
    timed = events.withColumn("_s", seconds)
    starts = timed.groupBy(key).agg(F.array_sort(F.collect_set("_s")).alias("times"))
    empty = F.struct(F.lit(None).cast("bigint").alias("open"), F.array().cast("array<struct<s: bigint, w: bigint>>").alias("out"))

    def fold(a: Column, s: Column) -> Column:
        start = F.when(a["open"].isNull() | (s - a["open"] >= cooldown), s).otherwise(a["open"])
        fresh = a["open"].isNull() | (start != a["open"])
        return F.struct(start.alias("open"), F.when(fresh, F.concat(a["out"], F.array(F.struct(s.alias("s"), start.alias("w"))))).otherwise(a["out"]).alias("out"))

    folded = starts.select(key, F.aggregate("times", empty, fold, lambda a: F.transform(a["out"], lambda e: e["w"])).alias("_starts"))
    last = F.array_max(F.filter("_starts", lambda w: w <= F.col("_s")))
    return timed.join(folded, key).withColumn("window_start", last).drop("_s", "_starts")


def as_json(events: DataFrame) -> Column:
    """The event's own fields as JSON text."""
    generate = F.to_json(F.struct("event", "source", "duration_ms"))
    update = F.to_json(F.struct("event", "source", "tiles_updated", "affected_zooms", "max_zoom", "layers_affected"))
    return F.when(F.col("event") == GENERATE, generate).otherwise(update)


def as_sse(events: DataFrame) -> Column:
    """The event as a message of a server-sent stream."""
    return F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), as_json(events), F.lit("\n\n"))


def retry_delays(retries: int, first_ms: int = 500) -> list[int]:
    """Milliseconds before each retry."""
    return [first_ms * 2**n for n in range(retries)]
