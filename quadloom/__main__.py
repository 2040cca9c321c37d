"""Commands: python -m quadloom generate|watch|run|serve|inspect|validate|diff ...

Tables are Parquet under --tables (a file or folder for each table), or the session's catalog.
"""

from __future__ import annotations

import argparse
import json
import signal
import sys
import threading
import time
from collections.abc import Callable
from contextlib import closing
from pathlib import Path

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import Config, Layer, load
from .operators import tilesets
from .plans import generate as G
from .plans.server import make_server
from .plans.validate import validate
from .sources import mbtiles
from .sources.publish import publish_now
from .streaming import changes
from .streaming.bus import Bus, start_webhooks
from .streaming.delivery import with_retries

#: How often a stream that fails is started again from its checkpoint.
RESTARTS = 8


def _tables(spark: SparkSession, folder: str | None) -> G.Tables:
    if folder is None:
        return G.catalog_tables(spark)
    return lambda layer: spark.read.parquet(f"{folder}/{layer.table}.parquet")


def generate(spark: SparkSession, config: Config, tables: G.Tables, bus: Bus | None = None) -> list[dict]:
    """Writes every source's MBTiles file; publishes and returns the events."""
    events = []
    for source in config.sources:
        began = time.time()
        n = G.write_mbtiles(source, G.generate(source, tables), source.mbtiles_path)
        if source.layers and (bounds := G.bounds_of(G.source_features(source, tables))):
            with closing(mbtiles.MBTiles(source.mbtiles_path)) as store:
                store.put_metadata(mbtiles.default_metadata(source.name, source.min_zoom, source.max_zoom, bounds))
        publish_now(source.mbtiles_path, config.publish, "generate")
        events.append({"event": "generate_complete", "source": source.name, "duration_ms": int((time.time() - began) * 1000)})
        if bus:
            bus.publish(events[-1])
        print(f"{source.name}: {n} tiles in {source.mbtiles_path}")
    return events


def watch(spark: SparkSession, config: Config, tables: G.Tables, feed: str, checkpoint: str, once: bool = False, bus: Bus | None = None):
    """Keeps the files fresh from a folder of notifications; a batch's tiles are merged in one transaction for each source."""

    def update(batch: DataFrame, _: int) -> None:
        for name, made in G.update(spark, config, tables, batch).items():
            source = config.source(name)
            try:
                with closing(mbtiles.MBTiles(source.mbtiles_path)) as store:
                    put, deleted = store.merge(made.changed.toLocalIterator())
                if put or deleted:
                    publish_now(source.mbtiles_path, config.publish, "update")
                    event = made.event.first().asDict()
                    print(json.dumps(event), flush=True)
                    if bus:
                        bus.publish(event)
            finally:
                made.release()

    return changes.watch(changes.read_stream(spark, feed), update, checkpoint, config.updates.debounce_ms, once=once)


def inspect(spark: SparkSession, path: str) -> None:
    tiles = mbtiles.read_tiles(spark, path)
    for row in mbtiles.read_metadata(spark, path).collect():
        print(f"{row.name}: {row.value}")
    print(json.dumps(tilesets.inspect(tiles).first().asDict()))
    for row in tilesets.count_by_zoom(tiles).collect():
        print(f"zoom {row.z}: {row.tiles} tiles")
    print(f"file: {Path(path).stat().st_size} bytes")


def diff(spark: SparkSession, a: str, b: str) -> None:
    for row in tilesets.metadata_diff(mbtiles.read_metadata(spark, a), mbtiles.read_metadata(spark, b)).collect():
        print(f"{row.name}: {row.state} {row.old!r} -> {row.new!r}")
    compared = tilesets.compare(mbtiles.read_tiles(spark, a), mbtiles.read_tiles(spark, b)).persist()
    print(json.dumps(tilesets.diff_summary(compared).first().asDict()))
    for row in tilesets.diff_by_zoom(compared).collect():
        print(f"zoom {row.z}: {row.added} added, {row.removed} removed, {row.changed} changed")
    compared.unpersist()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("generate", "watch", "run", "serve", "validate"):
        one = commands.add_parser(name)
        one.add_argument("config")
        one.add_argument("--tables")
        if name in ("watch", "run"):
            one.add_argument("--feed", required=True)
            one.add_argument("--checkpoint", required=True)
            one.add_argument("--once", action="store_true")
    commands.add_parser("inspect").add_argument("path")
    two = commands.add_parser("diff")
    two.add_argument("a")
    two.add_argument("b")
    given = parser.parse_args(args)
    if given.command == "serve":
        make_server(load(given.config)).serve_forever()
        return 0
    spark = SparkSession.builder.appName("quadloom").getOrCreate()
    if given.command == "inspect":
        inspect(spark, given.path)
        return 0
    if given.command == "diff":
        diff(spark, given.a, given.b)
        return 0
    config = load(given.config)
    tables = _tables(spark, given.tables)
    if given.command == "validate":
        known = None
        if given.tables:
            layers: list[Layer] = [x for s in config.sources for x in s.layers]
            known = {x.table: spark.read.parquet(f"{given.tables}/{x.table}.parquet").columns for x in layers if Path(f"{given.tables}/{x.table}.parquet").exists()}
        issues = validate(spark, config, known).collect()
        for row in issues:
            print(f"{row.source} {row.layer or ''}: {row.issue}")
        return int(bool(issues))
    bus = Bus()
    webhooks = start_webhooks(bus, config.webhook)
    try:
        if given.command in ("generate", "run"):
            generate(spark, config, tables, bus)
        if given.command in ("watch", "run"):
            if given.command == "run" and not given.once:
                threading.Thread(target=make_server(config, bus, config.webhook.cooldown_secs).serve_forever, daemon=True).start()
            supervise(lambda: watch(spark, config, tables, given.feed, given.checkpoint, given.once, bus))
    finally:
        bus.close()
        if webhooks:
            webhooks.join()
    return 0


def supervise(start: Callable[[], StreamingQuery], retries: int = RESTARTS) -> None:
    """Runs a query to its end, started again after a failure with growing delays; SIGTERM and SIGINT stop it between batches."""
    stopping, running = threading.Event(), []

    def stop(*_) -> None:
        stopping.set()
        for query in running:
            query.stop()

    def run() -> None:
        running[:] = [start()]
        try:
            running[0].awaitTermination()
        except StreamingQueryException:
            if not stopping.is_set():
                raise

    if threading.current_thread() is threading.main_thread():
        for name in (signal.SIGTERM, signal.SIGINT):
            signal.signal(name, stop)
    with_retries(run, retries, longest=60)


if __name__ == "__main__":
    sys.exit(main())
