import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from quadloom import __main__ as commands
from quadloom.config import Webhook, load
from quadloom.functions.text import signature
from quadloom.plans.server import make_server, respond
from quadloom.streaming import changes, delivery

TOML = """
[[sources]]
name = "s"
min_zoom = 0
max_zoom = 3
mbtiles_path = "{folder}/s.mbtiles"
[[sources.layers]]
name = "places"
table = "places"
properties = ["name"]
[serve]
port = 0
"""


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "c.toml").write_text(TOML.format(folder=tmp_path))
    write(spark, tmp_path, [(1, "a", 10.0, 10.0), (2, "b", -100.0, 40.0)])
    return tmp_path


def write(spark, folder, rows):
    text = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]}"))
    spark.createDataFrame(rows, "id int, name string, x double, y double").withColumn("geom", text).drop("x", "y").write.mode("overwrite").parquet(f"{folder}/places.parquet")


def test_commands(spark, folder, capsys):
    config = str(folder / "c.toml")
    assert commands.main(["validate", config, "--tables", str(folder)]) == 0
    assert commands.main(["generate", config, "--tables", str(folder)]) == 0
    commands.main(["inspect", str(folder / "s.mbtiles")])
    assert "zoom 3: 2 tiles" in capsys.readouterr().out
    (folder / "old.mbtiles").write_bytes((folder / "s.mbtiles").read_bytes())
    write(spark, folder, [(1, "a", 10.0, 10.0), (2, "b", 100.0, -40.0)])
    (folder / "feed").mkdir()
    (folder / "feed" / "1.txt").write_text('{"layer":"places","id":2,"old_bounds":{"min_lon":-100,"min_lat":40,"max_lon":-100,"max_lat":40}}\n')
    assert commands.main(["watch", config, "--tables", str(folder), "--feed", str(folder / "feed"), "--checkpoint", str(folder / "check"), "--once"]) == 0
    capsys.readouterr()
    commands.main(["diff", str(folder / "old.mbtiles"), str(folder / "s.mbtiles")])
    out = capsys.readouterr().out
    assert "zoom 3: 1 added, 1 removed, 0 changed" in out and "zoom 0: 0 added, 0 removed, 1 changed" in out
    bad = (folder / "c.toml").read_text().replace('["name"]', '["nothing"]')
    (folder / "bad.toml").write_text(bad)
    assert commands.main(["validate", str(folder / "bad.toml"), "--tables", str(folder)]) == 1


def test_server(spark, folder):
    commands.main(["generate", str(folder / "c.toml"), "--tables", str(folder)])
    config = load(str(folder / "c.toml"), {})
    server = make_server(config)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with urllib.request.urlopen(f"{base}/s/0/0/0.pbf") as answer:
            tag = answer.headers["ETag"]
            assert answer.status == 200 and answer.headers["Access-Control-Allow-Origin"] == "*" and answer.read()[:2] == b"\x1f\x8b"
        with urllib.request.urlopen(f"{base}/s.json") as answer:
            assert json.load(answer)["name"] == "s"
        assert urllib.request.urlopen(f"{base}/health").read() == b"ok"
    finally:
        server.shutdown()
    assert respond(config, "/s/0/0/0.pbf", tag)[0] == 304 and respond(config, "/s/3/0/0.pbf")[0] == 204
    assert respond(config, "/t/0/0/0.pbf")[0] == respond(config, "/x")[0] == 404


def test_delivery():
    sent, waits = [], []
    status = iter([500, 503, 200])

    def send(url, headers, body):
        sent.append((url, headers, body))
        return next(status)

    done = delivery.deliver("update_complete", b"{}", Webhook(url="u", secret="k"), send, waits.append)
    assert done == {"u": True} and waits == [0.5, 1.0] and len(sent) == 3
    assert sent[0][1]["X-Quadloom-Signature"] == signature("k", b"{}")

    def fail(*_):
        raise OSError

    assert delivery.deliver("x", b"", Webhook(urls=("a", "b"), retry_count=0), fail) == {"a": False, "b": False}


def test_retries():
    waits, left = [], [1, 2, 3]

    def action():
        if left:
            left.pop()
            raise ValueError
        return "done"

    assert delivery.with_retries(action, 5, 2, waits.append) == "done" and waits == [1, 2, 2]
    with pytest.raises(ValueError):
        delivery.with_retries(lambda: int("x"), 1, wait=waits.append)


def test_payloads_parse_back(spark):
    df = spark.createDataFrame([(5, (1.0, 2.0, 3.0, 4.0))], "id int, b struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>")
    r = changes.parse(delivery.change_payload("water", df, "id", "update", "b")).first()
    assert (r.layer, r.id, tuple(r.old_bounds)) == ("water", 5, (1, 2, 3, 4))
    assert changes.parse(delivery.change_payload("water", df, "id", "insert", "b")).first().old_bounds is None
