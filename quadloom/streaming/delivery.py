"""Delivery of events to webhooks: headers, retries, and the sink of an event stream."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Webhook
from ..functions.text import signature
from ..operators.events import as_json, of_kinds, retry_delays

#: Sends (url, headers, body) and returns the status.
Post = Callable[[str, dict[str, str], bytes], int]


def post(url: str, headers: dict[str, str], body: bytes, timeout_ms: int = 5000) -> int:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as answer:
            return answer.status
    except urllib.error.HTTPError as error:
        return error.code


def headers_of(event: str, body: bytes, secret: str | None) -> dict[str, str]:
    out = {"Content-Type": "application/json", "User-Agent": "quadloom-webhook", "X-Quadloom-Event": event}
    return out | ({"X-Quadloom-Signature": signature(secret, body)} if secret else {})


def deliver(event: str, body: bytes, settings: Webhook, send: Post = post, wait: Callable[[float], None] = time.sleep) -> dict[str, bool]:
    """Sends an event to every address, again after each delay until it succeeds; returns which addresses have it."""
    done = {}
    for url in (*settings.urls, *([settings.url] if settings.url else [])):
        done[url] = False
        for delay in (0, *retry_delays(settings.retry_count)):
            if delay:
                wait(delay / 1000)
            try:
                done[url] = 200 <= send(url, headers_of(event, body, settings.secret), body) < 300
            except OSError:
                continue
            if done[url]:
                break
    return done


def webhook_sink(events: DataFrame, settings: Webhook, checkpoint: str, send: Post = post) -> StreamingQuery:
    """Delivers a stream of events. Kinds that the settings turn off are dropped here; put the cooldown after that."""

    def handle(batch: DataFrame, _: int) -> None:
        for row in batch.select("event", as_json(batch).alias("body")).toLocalIterator():
            deliver(row.event, row.body.encode(), settings, send)

    wanted = of_kinds(events, settings.on_generate, settings.on_update)
    return wanted.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def with_retries(action: Callable[[], object], max_retries: int, longest: int = 32, wait: Callable[[float], None] = time.sleep) -> object:
    """What the action returns; after a failure again, 1, 2, 4 ... seconds later, `longest` at most."""
    for attempt in range(max_retries + 1):
        try:
            return action()
        except Exception:
            if attempt == max_retries:
                raise
            wait(min(2**attempt, longest))
    raise AssertionError


def change_payload(layer: str, row: DataFrame, id_column: str, op: str, old_bounds: str | None = None) -> DataFrame:
    """Change rows as notification payloads, as a producer of changes sends them; inserts have no old bounds."""
    fields = [F.lit(layer).alias("layer"), F.col(id_column).cast("bigint").alias("id"), F.lit(op).alias("op")]
    if old_bounds and op != "insert":
        fields.append(F.col(old_bounds).alias("old_bounds"))
    return row.select(F.to_json(F.struct(*fields)).alias("payload"))
