"""Configuration: sources of layers and the sections around them, from TOML text and the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from .functions.text import BOUNDARY, LABELS

#: Variables that override the file start with this; a double underscore goes one section down.
PREFIX = "TILES"
BACKENDS = ("native", "tippecanoe", "ogr2ogr")
PUBLISH_BACKENDS = ("none", "local", "s3", "mapbox", "command")


@dataclass(frozen=True)
class PropertyRule:
    """Below a zoom these properties are left out."""

    below_zoom: int
    exclude: tuple[str, ...]


@dataclass(frozen=True)
class Layer:
    name: str
    table: str
    schema: str = "public"
    geometry_column: str = "geom"
    geometry_columns: tuple[str, ...] = ()
    id_column: str = "id"
    srid: int = 4326
    properties: tuple[str, ...] | None = None
    filter: str | None = None
    simplify_tolerance: float | None = None
    property_rules: tuple[PropertyRule, ...] = ()
    generate_label_points: bool = False
    generate_boundary_lines: bool = False

    def all_geometry_columns(self) -> tuple[str, ...]:
        return self.geometry_columns or (self.geometry_column,)

    def names(self) -> list[str]:
        """The layer's own name and those of its derived layers."""
        return [self.name, *([self.name + LABELS] if self.generate_label_points else []), *([self.name + BOUNDARY] if self.generate_boundary_lines else [])]


@dataclass(frozen=True)
class Source:
    name: str
    min_zoom: int
    max_zoom: int
    layers: tuple[Layer, ...] = ()
    mbtiles_path: str | None = None
    generation_backend: str = "native"

    def layer_names(self) -> list[str]:
        return [n for layer in self.layers for n in layer.names()]


@dataclass(frozen=True)
class Database:
    host: str = "localhost"
    port: int = 5432
    user: str = "postgres"
    password: str | None = None
    dbname: str = "postgres"
    pool_size: int = 4

    def jdbc_url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.dbname}"


@dataclass(frozen=True)
class Updates:
    debounce_ms: int = 200
    worker_concurrency: int = 8


@dataclass(frozen=True)
class Serve:
    host: str = "127.0.0.1"
    port: int = 3000
    cors_origins: tuple[str, ...] = ()


@dataclass(frozen=True)
class Webhook:
    url: str | None = None
    urls: tuple[str, ...] = ()
    on_generate: bool = True
    on_update: bool = True
    timeout_ms: int = 5000
    retry_count: int = 2
    secret: str | None = None
    cooldown_secs: int | None = None


@dataclass(frozen=True)
class Publish:
    backend: str = "none"
    destination: str | None = None
    on_generate: bool = True
    on_update: bool = True
    command: str | None = None
    args: tuple[str, ...] = ()
    mapbox_tileset_id: str | None = None
    mapbox_token: str | None = None

    def problems(self) -> list[str]:
        """What a backend needs and lacks."""
        needs = {"local": ["destination"], "s3": ["destination"], "command": ["command"], "mapbox": ["mapbox_tileset_id", "mapbox_token"]}
        if self.backend not in PUBLISH_BACKENDS:
            return [f"unknown publish backend {self.backend!r}"]
        return [f"publish backend {self.backend} needs {n}" for n in needs.get(self.backend, []) if not getattr(self, n)]


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = ()
    database: Database = field(default_factory=Database)
    updates: Updates = field(default_factory=Updates)
    serve: Serve = field(default_factory=Serve)
    webhook: Webhook = field(default_factory=Webhook)
    publish: Publish = field(default_factory=Publish)

    def __post_init__(self) -> None:
        names = [s.name for s in self.sources]
        if len(set(names)) != len(names):
            raise ValueError("sources must have different names")
        for s in self.sources:
            if not 0 <= s.min_zoom <= s.max_zoom <= 30:
                raise ValueError(f"source {s.name}: zooms must go from 0 to 30, upwards")
            if s.generation_backend not in BACKENDS:
                raise ValueError(f"source {s.name}: unknown generation backend {s.generation_backend!r}")

    def sources_of_layer(self, layer: str) -> list[str]:
        """The sources that show a layer or a derived layer, in order."""
        return [s.name for s in self.sources if layer in s.layer_names()]

    def source(self, name: str) -> Source:
        return next(s for s in self.sources if s.name == name)


def _made(kind: type, value: Any) -> Any:
    """A dataclass of nested mappings; lists become tuples, and keys that it doesn't know are ignored."""
    if not isinstance(value, Mapping):
        return value
    hints = get_type_hints(kind)
    out = {}
    for f in fields(kind):
        if f.name not in value:
            continue
        given, hint = value[f.name], hints[f.name]
        inner = next((a for a in getattr(hint, "__args__", ()) if is_dataclass(a)), None)
        if is_dataclass(hint):
            given = _made(hint, given)
        elif isinstance(given, list):
            given = tuple(_made(inner, x) if inner else x for x in given)
        out[f.name] = given
    return kind(**out)


def _override(tree: dict, environment: Mapping[str, str]) -> None:
    for name, text in environment.items():
        if not name.startswith(PREFIX + "_"):
            continue
        path = [p.lower() for p in name[len(PREFIX) + 1 :].lstrip("_").split("__")]
        try:
            value = tomllib.loads(f"v = {text}")["v"]
        except tomllib.TOMLDecodeError:
            value = text
        at = tree
        for p in path[:-1]:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                break
        else:
            at[path[-1]] = value


def parse(text: str, environment: Mapping[str, str] | None = None) -> Config:
    """Configuration of TOML text, with the environment's overrides (TILES_SECTION__KEY)."""
    tree = tomllib.loads(text)
    _override(tree, os.environ if environment is None else environment)
    return _made(Config, tree)


def load(path: str, environment: Mapping[str, str] | None = None) -> Config:
    with open(path, encoding="utf-8") as file:
        return parse(file.read(), environment)
