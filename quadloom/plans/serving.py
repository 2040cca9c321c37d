"""What a tile server answers, as functions: tiles with their entity tags, and a source's TileJSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from ..config import Config, Serve, Source
from ..sources.tilesets import get_tile

MAX_AGE = 300


def entity_tag(data: bytes) -> str:
    return f'"{hashlib.sha256(data).hexdigest()[:16]}"'


def answer(data: bytes | None, if_none_match: str | None = None) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body) for a tile's data: 204 without a tile, 304 if the client has it."""
    if data is None:
        return 204, {}, b""
    tag = entity_tag(data)
    headers = {"ETag": tag, "Cache-Control": f"public, max-age={MAX_AGE}"}
    if if_none_match and ("*" == if_none_match.strip() or tag in (t.strip() for t in if_none_match.split(","))):
        return 304, headers, b""
    return 200, headers | {"Content-Type": "application/x-protobuf", "Content-Encoding": "gzip"}, data


def tile_response(tilesets: dict[str, DataFrame], source: str, z: int, x: int, y: int, if_none_match: str | None = None) -> tuple[int, dict[str, str], bytes]:
    if source not in tilesets:
        return 404, {}, b""
    row = get_tile(tilesets[source], z, x, y).select("tile_data").head()
    return answer(bytes(row[0]) if row else None, if_none_match)


def tilejson(source: Source, serve: Serve = Serve()) -> dict:
    layers = []
    for layer in source.layers:
        layers += [{"id": name, "fields": {p: "" for p in layer.properties or ()}} for name in layer.names()]
    return {"tilejson": "3.0.0", "name": source.name, "tiles": [f"http://{serve.host}:{serve.port}/{source.name}/{{z}}/{{x}}/{{y}}.pbf"], "minzoom": source.min_zoom, "maxzoom": source.max_zoom, "vector_layers": layers}


def tilejson_response(config: Config, source: str) -> tuple[int, str]:
    found = next((s for s in config.sources if s.name == source), None)
    return (200, json.dumps(tilejson(found, config.serve), indent=2)) if found else (404, "")


def health() -> str:
    return "ok"
