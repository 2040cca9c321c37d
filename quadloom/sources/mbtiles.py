"""MBTiles files: a Spark data source that reads a zoom in ranges of columns, and a writer.

A file is one SQLite database, so writes go through one process; Parquet is the tileset format that scales, partitioned by zoom.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing, contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "z int, x bigint, y bigint, tile_data binary"
TABLES = """
CREATE TABLE metadata (name TEXT NOT NULL, value TEXT NOT NULL, UNIQUE (name));
CREATE TABLE tiles (zoom_level INTEGER NOT NULL, tile_column INTEGER NOT NULL, tile_row INTEGER NOT NULL, tile_data BLOB NOT NULL, UNIQUE (zoom_level, tile_column, tile_row));
CREATE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row);
"""


#: Columns of tiles that one partition reads, about: high zooms hold most of a file, so a zoom is read in ranges of columns.
COLUMNS = 256
#: Tiles of a batch that is handed on.
BATCH = 1024


class ColumnsPartition(InputPartition):
    """Tiles of a zoom whose columns go from first to last."""

    def __init__(self, zoom: int, first: int, last: int):
        super().__init__((zoom, first, last))
        self.zoom, self.first, self.last = zoom, first, last


class MBTilesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ColumnsPartition]:
        with closing(_open(self.path)) as db:
            zooms = db.execute("SELECT zoom_level, min(tile_column), max(tile_column) FROM tiles GROUP BY zoom_level ORDER BY 1").fetchall()
        out = []
        for zoom, first, last in zooms:
            step = max(COLUMNS, -(-(last - first + 1) // COLUMNS))
            out += [ColumnsPartition(zoom, a, min(a + step - 1, last)) for a in range(first, last + 1, step)]
        return out

    def read(self, partition: ColumnsPartition) -> Iterator[pa.RecordBatch]:
        names = ["z", "x", "y", "tile_data"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        with closing(_open(self.path)) as db:
            found = db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ? AND tile_column BETWEEN ? AND ?", (partition.zoom, partition.first, partition.last))
            while rows := found.fetchmany(BATCH):
                z, x, row, data = zip(*rows, strict=True)
                y = [(1 << partition.zoom) - 1 - r for r in row]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((z, x, y, data), kinds, strict=True)], names=names)


class MBTilesSource(DataSource):
    """spark.read.format("mbtiles").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MBTilesReader:
        return MBTilesReader(self.options["path"])


def _open(path: str) -> sqlite3.Connection:
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def read_tile(path: str, z: int, x: int, y: int) -> bytes | None:
    """One tile's data of a file that isn't written to."""
    if not 0 <= y < 1 << z:
        return None
    with closing(_open(path)) as db:
        found = db.execute("SELECT tile_data FROM tiles WHERE zoom_level = ? AND tile_column = ? AND tile_row = ?", (z, x, (1 << z) - 1 - y)).fetchone()
    return found[0] if found else None


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, tile_data), y counted from the north."""
    spark.dataSource.register(MBTilesSource)
    return spark.read.format("mbtiles").load(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    with closing(_open(path)) as db:
        rows = db.execute("SELECT name, value FROM metadata ORDER BY name").fetchall()
    return spark.createDataFrame(rows, "name string, value string")


def default_metadata(name: str, min_zoom: int | None = None, max_zoom: int | None = None, bounds: tuple[float, float, float, float] | None = None) -> dict[str, str]:
    out = {"name": name, "format": "pbf", "type": "overlay", "version": "2", "description": f"Vector tiles of {name}", "scheme": "tms"}
    if min_zoom is not None and max_zoom is not None:
        out |= {"minzoom": str(min_zoom), "maxzoom": str(max_zoom)}
    if bounds:
        out["bounds"] = ",".join(f"{x:.6f}" for x in bounds)
    return out


class MBTiles:
    """An MBTiles file open for writing."""

    def __init__(self, path: str, create: bool = False):
        target = Path(path)
        if create:
            target.parent.mkdir(parents=True, exist_ok=True)
            target.unlink(missing_ok=True)
        elif not target.is_file():
            raise FileNotFoundError(path)
        self.db = sqlite3.connect(path, isolation_level=None)
        self.db.execute("PRAGMA journal_mode=WAL")
        self.db.execute("PRAGMA synchronous=NORMAL")
        if create:
            self.db.executescript(TABLES)
        elif self.db.execute("SELECT type FROM sqlite_master WHERE name = 'tiles'").fetchone() == ("view",):
            self._materialise()

    def _materialise(self) -> None:
        """A file whose tiles are a view over shared images gets them as a table, which can be written to."""
        with self.transaction():
            self.db.execute("CREATE TABLE tiles_kept AS SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles")
            self.db.execute("DROP VIEW tiles")
            self.db.execute("ALTER TABLE tiles_kept RENAME TO tiles")
            self.db.execute("CREATE UNIQUE INDEX tile_key ON tiles (zoom_level, tile_column, tile_row)")

    @contextmanager
    def transaction(self):
        self.db.execute("BEGIN")
        try:
            yield self
        except BaseException:
            self.db.execute("ROLLBACK")
            raise
        self.db.execute("COMMIT")

    @staticmethod
    def _row(z: int, y: int) -> int:
        if not 0 <= y < 1 << z:
            raise ValueError(f"no row {y} at zoom {z}")
        return (1 << z) - 1 - y

    def put(self, z: int, x: int, y: int, data: bytes) -> None:
        self.db.execute("INSERT OR REPLACE INTO tiles VALUES (?, ?, ?, ?)", (z, x, self._row(z, y), bytes(data)))

    def delete(self, z: int, x: int, y: int) -> None:
        self.db.execute("DELETE FROM tiles WHERE zoom_level = ? AND tile_column = ? AND tile_row = ?", (z, x, self._row(z, y)))

    def get(self, z: int, x: int, y: int) -> bytes | None:
        return self.get_raw(z, x, self._row(z, y)) if 0 <= y < 1 << z else None

    def get_raw(self, z: int, x: int, row: int) -> bytes | None:
        found = self.db.execute("SELECT tile_data FROM tiles WHERE zoom_level = ? AND tile_column = ? AND tile_row = ?", (z, x, row)).fetchone()
        return found[0] if found else None

    def put_metadata(self, items: dict[str, str]) -> None:
        self.db.executemany("INSERT OR REPLACE INTO metadata VALUES (?, ?)", items.items())

    def merge(self, rows: Iterable) -> tuple[int, int]:
        """Puts (z, x, y, tile_data) rows and deletes those whose data is null, all or none; returns how many of either."""
        put = deleted = 0
        with self.transaction():
            for r in rows:
                if r.tile_data is None:
                    self.delete(r.z, r.x, r.y)
                    deleted += 1
                else:
                    self.put(r.z, r.x, r.y, r.tile_data)
                    put += 1
        return put, deleted

    def close(self) -> None:
        self.db.close()


def write_tiles(tiles: DataFrame, path: str, metadata: dict[str, str]) -> int:
    """A new file of (z, x, y, tile_data) and metadata; rows stream in partition by partition. Returns how many."""
    with closing(MBTiles(path, create=True)) as store:
        store.put_metadata(metadata)
        return store.merge(tiles.select("z", "x", "y", "tile_data").where(F.col("tile_data").isNotNull()).toLocalIterator())[0]
