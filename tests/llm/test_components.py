import random

import pytest

from quadloom.llm.common import with_checkpoints
from quadloom.llm.components import _star, components

SCHEMA = "u long, v long"


def run(spark, edges):
    return sorted(tuple(r) for r in components(spark.createDataFrame(edges, SCHEMA)).collect())


def brute(edges):
    at = {x: x for e in edges for x in e}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        at[b] = a
    return sorted((x, root(x)) for x in at)


def test_empty_loops_and_nulls(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1), (None, 2), (3, None), (None, None)]) == []
    assert run(spark, [(2, 1), (1, 2), (2, 1), (5, 5)]) == [(1, 1), (2, 1)]


def test_hub(spark):
    assert run(spark, [(7, i) for i in range(8, 20_000)] + [(3, 19_999)]) == [(3, 3), (7, 3), *((i, 3) for i in range(8, 20_000))]


def test_long_chain(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 700)
    edges = list(zip(names, names[1:], strict=False))
    assert run(spark, edges) == brute(edges)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = [e for e in edges if e[0] != e[1]]
    assert run(spark, edges) == brute(edges)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skewed(spark):
    """A session that takes small partitions for skewed ones."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield with_checkpoints(spark)
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [True, False])
def test_a_hub_is_split_among_tasks(skewed, large):
    edges = skewed.range(200_000).selectExpr("id + 10 AS u", "CASE WHEN id % 3 = 0 THEN 5 ELSE id * 7 % 100000 END AS v").repartition(24)
    if not large:
        edges = edges.selectExpr("CASE WHEN v = 5 THEN 900000 ELSE u END AS u", "u AS v")
    assert "skew=true" in final_plan(_star(edges, large))
