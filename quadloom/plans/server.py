"""A small HTTP server over MBTiles files: tiles, TileJSON, health, and the events of a bus as a server-sent stream.

Files are opened read-only, one connection for each request, so requests neither wait for each other nor change a file.
"""

from __future__ import annotations

import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..config import Config
from ..sources.mbtiles import read_tile
from ..streaming.bus import Bus, cooled, message
from .serving import answer, health, tilejson_response

TILE = re.compile(r"^/([^/]+)/(\d{1,2})/(\d+)/(\d+)\.pbf$")


def respond(config: Config, path: str, if_none_match: str | None = None) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body) of a request's path."""
    path = path.split("?")[0]
    if path == "/health":
        return 200, {"Content-Type": "text/plain"}, health().encode()
    if path.endswith(".json") and path.count("/") == 1:
        status, text = tilejson_response(config, path[1:-5])
        return status, {"Content-Type": "application/json"}, text.encode()
    if not (found := TILE.match(path)):
        return 404, {}, b""
    source = next((s for s in config.sources if s.name == found[1]), None)
    if source is None or source.mbtiles_path is None:
        return 404, {}, b""
    return answer(read_tile(source.mbtiles_path, *(int(found[i]) for i in (2, 3, 4))), if_none_match)


def make_server(config: Config, bus: Bus | None = None, cooldown: float | None = None) -> ThreadingHTTPServer:
    """A server that isn't running yet; origins are allowed as configured, all if none is named. bus: whose events /events streams."""
    allowed = set(config.serve.cors_origins)

    class Handler(BaseHTTPRequestHandler):
        def allow(self, headers: dict[str, str]) -> None:
            origin = self.headers.get("Origin")
            if not allowed:
                headers["Access-Control-Allow-Origin"] = "*"
            elif origin in allowed:
                headers["Access-Control-Allow-Origin"] = origin

        def stream(self) -> None:
            """Events until the bus is closed or the client is gone."""
            get = bus.subscribe()
            headers = {"Content-Type": "text/event-stream", "Cache-Control": "no-cache", "Connection": "close"}
            self.allow(headers)
            self.send_response(200)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.flush()
            try:
                for event in cooled(get, cooldown):
                    self.wfile.write(message(event).encode())
                    self.wfile.flush()
            except OSError:
                return

        def do_GET(self) -> None:
            if bus is not None and self.path.split("?")[0] == "/events":
                return self.stream()
            status, headers, body = respond(config, self.path, self.headers.get("If-None-Match"))
            self.allow(headers)
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            if status not in (204, 304):
                self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if status not in (204, 304):
                self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((config.serve.host, config.serve.port), Handler)
