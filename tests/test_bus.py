import json
import threading
import urllib.request

import pytest

from quadloom.config import Config, Serve, Webhook
from quadloom.plans.server import make_server
from quadloom.streaming.bus import Bus, cooled, message, start_webhooks


def update(source, tiles, zooms):
    return {"event": "update_complete", "source": source, "tiles_updated": tiles, "affected_zooms": zooms, "max_zoom": 14, "layers_affected": ["roads"]}


GENERATED = {"event": "generate_complete", "source": "s", "duration_ms": 7}


class Clock:
    """A subscription whose events come at given times, and the time."""

    def __init__(self, events):
        self.now, self.events = 0.0, list(events)

    def get(self, timeout=None):
        if not self.events:
            raise StopIteration
        at, event = self.events[0]
        if timeout is not None and self.now + timeout < at:
            self.now += timeout
            return None
        self.now = max(self.now, at)
        self.events.pop(0)
        return event


def test_cooldown_merges_a_source_in_a_window():
    clock = Clock([(0, update("a", 10, [10])), (1, update("a", 11, [11])), (1, update("b", 5, [3])), (1.5, update("a", 12, [12])), (9, update("a", 1, [1]))])
    out = list(cooled(clock.get, 2, clock=lambda: clock.now))
    assert [(e["source"], e["tiles_updated"], e["affected_zooms"]) for e in out] == [("a", 33, [10, 11, 12]), ("b", 5, [3]), ("a", 1, [1])]


def test_kinds_go_before_merging_and_no_cooldown_passes_all():
    events = [(0, update("s", 1, [1])), (0, GENERATED), (0, update("s", 2, [2]))]
    clock = Clock(events)
    (merged,) = cooled(clock.get, 5, lambda e: e["event"] == "update_complete", lambda: clock.now)
    assert merged["tiles_updated"] == 3
    assert [e["event"] for e in cooled(Clock(events).get, None)] == ["update_complete", "generate_complete", "update_complete"]
    (merged,) = cooled(Clock(events).get, 5)
    assert merged["event"] == "generate_complete" and merged["duration_ms"] == 7


def test_a_subscriber_that_lags_loses_the_oldest():
    bus = Bus()
    get = bus.subscribe()
    for i in range(300):
        bus.publish(update("s", i, []))
    bus.close()
    seen = []
    with pytest.raises(StopIteration):
        while True:
            seen.append(get(0)["tiles_updated"])
    assert seen[-1] == 299 and len(seen) == 255


def test_webhooks_have_what_is_pending_when_the_bus_closes():
    bus, sent = Bus(), []
    send = lambda url, headers, body: sent.append((url, headers["X-Quadloom-Event"], json.loads(body))) or 200
    thread = start_webhooks(bus, Webhook(url="http://a", urls=("http://b",), on_generate=False, cooldown_secs=3600), send)
    for e in (GENERATED, update("s", 1, [1]), update("s", 2, [2])):
        bus.publish(e)
    bus.close()
    thread.join(10)
    assert sorted(u for u, _, _ in sent) == ["http://a", "http://b"] and {b["tiles_updated"] for _, _, b in sent} == {3}
    assert start_webhooks(bus, Webhook()) is None


def test_the_server_streams_events():
    bus = Bus()
    server = make_server(Config(serve=Serve(port=0)), bus)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    answer = urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/events", timeout=10)
    assert answer.headers["Content-Type"] == "text/event-stream"
    bus.publish(GENERATED)
    bus.close()
    assert answer.read().decode() == message(GENERATED) == 'event: generate_complete\ndata: {"event":"generate_complete","source":"s","duration_ms":7}\n\n'
    server.shutdown()
