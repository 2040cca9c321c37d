import hashlib
from collections import Counter

import pytest

from quadloom.llm import sharding as S


def table(shards, slots, weights=None):
    """Turn by turn, from whole preference lists."""
    number = lambda name, part: int(hashlib.md5(name.encode()).hexdigest()[part * 15 : part * 15 + 15], 16)
    lists = [[(number(s, 0) + j * (number(s, 1) % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    owner = {}
    while len(owner) < slots:
        for i, prefs in enumerate(lists):
            for _ in range((weights or [1] * len(shards))[i]):
                if len(owner) < slots:
                    owner[next(x for x in prefs if x not in owner)] = i
    return [owner[x] for x in range(slots)]


@pytest.mark.parametrize("weights", [None, [1, 2, 0, 3]])
def test_lookup_table(weights):
    shards = ["a", "b", "c", "d"]
    got = S.lookup_table(shards, 101, weights)
    assert got == table(shards, 101, weights)
    held = Counter(got)
    if weights:
        assert held[2] == 0 and held[3] > held[1] > held[0]
    else:
        assert max(held.values()) - min(held.values()) <= 1


def test_a_shard_that_leaves_moves_few_slots():
    before, after = S.lookup_table(S.SHARDS, S.SLOTS), S.lookup_table(S.SHARDS[:-1], S.SLOTS)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != len(S.SHARDS) - 1)
    assert moved < S.SLOTS // 4


def test_parameters_are_checked():
    for bad in ((["a"], 100), ([], 101), (["a", "a"], 101), (["a", "b", "c"], 2), (["a"], 101, [1, 1]), (["a"], 101, [0]), (["a"], 101, [-1])):
        with pytest.raises(ValueError):
            S.lookup_table(*bad)


def run(spark, rows, schema="key string, slot_ int", **more):
    return S.assign_shards(spark.createDataFrame(rows, schema), "key", **more).collect()


def test_rows(spark):
    rows = [("a", 1), ("a", 2), (None, 3), ("", 4), ("long " * 100_000, 5), ("a", 1)]
    out = run(spark, rows)
    owners = S.lookup_table()
    assert sorted((r.key or "", r.slot_) for r in out) == sorted((k or "", n) for k, n in rows)
    for r in out:
        assert r.slot == int(hashlib.md5((r.key or "").encode()).hexdigest()[:15], 16) % S.SLOTS and r.shard == owners[r.slot]


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [("a", 1)], "key string, slot int")
    out = run(spark, [("a", 1)], "key string, slot int", slot="place", shard="owner")
    assert out[0].slot == 1 and out[0].owner == S.lookup_table()[out[0].place]


def test_the_lookup_is_broadcast_and_nothing_else_moves(spark):
    plan = S.assign_shards(spark.range(1000).selectExpr("CAST(id AS STRING) AS key"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan
