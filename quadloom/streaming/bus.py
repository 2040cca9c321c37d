"""Events within one process: a bus that hands every event to all subscribers, cooldown by wall clock, and delivery to webhooks.

The cooldown here is the streaming one for events that don't come from a Spark stream: a source's first event opens a window, later ones
merge into it, and one event leaves when it ends. What is pending leaves when the bus is closed.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator

from ..config import Webhook
from ..operators.events import GENERATE, UPDATE
from .cooldown import merge
from .delivery import Post, deliver, post

#: Events that a subscriber may lag behind; beyond, it loses the oldest.
CAPACITY = 256
FIELDS = {GENERATE: ("event", "source", "duration_ms"), UPDATE: ("event", "source", "tiles_updated", "affected_zooms", "max_zoom", "layers_affected")}
_CLOSED = object()


def event_json(event: dict) -> str:
    """The event's own fields as JSON text."""
    return json.dumps({k: event.get(k) for k in FIELDS[event["event"]]}, separators=(",", ":"))


def message(event: dict) -> str:
    """The event as a message of a server-sent stream."""
    return f"event: {event['event']}\ndata: {event_json(event)}\n\n"


class Bus:
    def __init__(self) -> None:
        self._lock, self._queues, self._closed = threading.Lock(), [], False

    def publish(self, event: dict) -> None:
        with self._lock:
            for q in self._queues:
                if q.full():
                    q.get_nowait()
                q.put_nowait(event)

    def close(self) -> None:
        """Ends all subscriptions after the events that they hold."""
        with self._lock:
            self._closed = True
            for q in self._queues:
                if q.full():
                    q.get_nowait()
                q.put_nowait(_CLOSED)

    def subscribe(self) -> Callable[[float | None], dict | None]:
        """A function that waits so long for the next event; it gives None when that time is over and raises StopIteration when the bus is closed."""
        q: queue.Queue = queue.Queue(CAPACITY)
        with self._lock:
            self._queues.append(q)
            if self._closed:
                q.put_nowait(_CLOSED)

        def get(timeout: float | None = None) -> dict | None:
            try:
                event = q.get(timeout=timeout)
            except queue.Empty:
                return None
            if event is _CLOSED:
                with self._lock:
                    self._queues.remove(q)
                raise StopIteration
            return event

        return get


def cooled(get: Callable[[float | None], dict | None], seconds: float | None, wanted: Callable[[dict], bool] = lambda _: True, clock: Callable[[], float] = time.monotonic) -> Iterator[dict]:
    """The events of a subscription, kinds that aren't wanted left out first; with a cooldown one merged event for each source and window."""
    pending: dict[str, tuple[float, dict]] = {}
    while True:
        first = min((end for end, _ in pending.values()), default=None)
        try:
            event = get(None if first is None else max(0.0, first - clock()))
        except StopIteration:
            yield from (e for _, e in pending.values())
            return
        if event is not None and wanted(event):
            if not seconds:
                yield event
            else:
                end, held = pending.get(event["source"], (clock() + seconds, None))
                pending[event["source"]] = (end, merge(held, {k: event.get(k) for k in ("event", "source", "duration_ms", "tiles_updated", "affected_zooms", "max_zoom", "layers_affected")}))
        for source in [s for s, (end, _) in pending.items() if end <= clock()]:
            yield pending.pop(source)[1]


def start_webhooks(bus: Bus, settings: Webhook, send: Post = post) -> threading.Thread | None:
    """Delivers the bus's events to the configured addresses, in a thread of its own; None if there is no address."""
    if not (settings.url or settings.urls):
        return None
    kinds = {k for k, on in ((GENERATE, settings.on_generate), (UPDATE, settings.on_update)) if on}
    get = bus.subscribe()

    def run() -> None:
        for event in cooled(get, settings.cooldown_secs, lambda e: e["event"] in kinds):
            deliver(event["event"], event_json(event).encode(), settings, send)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread
