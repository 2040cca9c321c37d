import numpy as np
import pytest

from quadloom.llm import vectors
from quadloom.llm.hnsw import Graph

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, size int"


def brute(rows, least=0.98):
    usable = [i for i, (d, e, k) in enumerate(rows) if d is not None and k is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    links = [0] * len(rows)
    x = {i: np.array(rows[i][1], dtype=np.float32).astype(np.float64) for i in usable}
    for i in usable:
        for j in usable:
            if i < j:
                near = rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least
                if near:
                    links[i] += 1
                    links[j] += 1
                if near or rows[i][0] == rows[j][0]:
                    at[root(i)] = root(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[root(i)] = min(least_id.get(root(i), r[0]), r[0])
    return sorted(((d, links[i], None if d is None else least_id[root(i)], d is not None and least_id[root(i)] == d) for i, (d, _, _) in enumerate(rows)), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "r", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vectors.near_duplicates(df, **more).collect()), key=repr)


def corpus(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            base = np.array(rows[rng.integers(max(0, len(rows) - 40), len(rows))][1])
            e = base + rng.normal(size=dim) * rng.choice([0, 0.02, 0.05, 0.08])
        else:
            e = rng.normal(size=dim)
        rows.append((int(i * 7 % n) * 3, [float(np.float32(x)) for x in e], int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("capacity", [16_384, 60])
def test_against_brute_force(spark, capacity):
    rows = corpus(capacity, 350)
    assert run(spark, rows, capacity=capacity) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], None), (9, [1.0, 2.0], 2), (10, [2.0, 4.0], 2), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 2), (None, [1.0, 2.0], 2), (13, [3.0, -1.0], 2), (13, [-3.0, 9.0], 2), (14, [-3.0, 9.0], 2), (14, [-3.0, 9.0], 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_graph_reaches_recall_and_survives_storage():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.from_bytes(Graph(np.arange(3000), x).to_bytes())
    q = x[:300] + rng.normal(size=(300, 24)) * 0.02
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _ = g._beam(q.astype(np.float32), 0, 64, g._descend(q.astype(np.float32), 0))
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) >= 0.95
    assert len(g.layers) > 1


def test_a_group_of_near_copies_is_one_component_with_all_links(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    rows = [(i, [float(np.float32(v)) for v in base + rng.normal(size=32) * 0.05], 1) for i in range(400)]
    out = run(spark, rows, capacity=150)
    assert {r[2] for r in out} == {0} and out == brute(rows)


class Blinkered:
    """A graph whose search finds no links of some queries until the beam is wide."""

    def __init__(self, vectors, hidden):
        self.ids, self.unit, self.hidden, self.beams = np.arange(len(vectors)), vectors / np.linalg.norm(vectors, axis=1, keepdims=True), hidden, []

    def within(self, queries, least, beam, own=None):
        q, v = np.nonzero(queries @ self.unit.T >= least)
        self.beams.append(beam)
        if beam < 128:
            seen = ~np.isin(v, self.hidden) | (False if own is None else own[q] == v)
            q, v = q[seen], v[seen]
        return q, v


@pytest.mark.parametrize("same", [False, True])
def test_audit_sees_sparse_links(same):
    x = np.random.default_rng(3).normal(size=(1500, 64))
    y = x if same else np.random.default_rng(4).normal(size=(1500, 64))
    a, b, c, d = np.random.default_rng(3000).permutation(1500)[-4:]  # the last that the audit draws
    x[[a, b]] = y[[c, d]] + 1e-3
    bits = vectors._search(x, Blinkered(y, [a, b, c, d]), y, 0.98, 32, same)
    assert np.unpackbits(bits[a])[c] and np.unpackbits(bits[b])[d]


def test_audit_is_not_drowned_by_one_group():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(1500, 64))
    y[:900] = y[0] + rng.normal(size=(900, 64)) * 1e-3
    x = y + 1e-4
    bits = vectors._search(x, Blinkered(y, np.arange(1000, 1030)), y, 0.98, 32)
    assert all(np.unpackbits(bits[i])[i] for i in range(1000, 1030))


def test_doubles_are_judged_in_double_precision(spark):
    """Two cosines of 0.98 to within single precision, one above it and one below."""
    angle = np.arccos(0.98)
    rows = [(1, [1.0, 0.0], 1), (2, [float(np.cos(angle - 1e-9)), float(np.sin(angle - 1e-9))], 1), (3, [1.0, 0.0], 2), (4, [float(np.cos(angle + 1e-9)), float(np.sin(angle + 1e-9))], 2)]
    out = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {1: 1, 2: 1, 3: 0, 4: 0}


def test_recall_is_reported(spark):
    rows = corpus(7, 200)
    df = spark.createDataFrame([(*r, "r", 1) for r in rows], SCHEMA)
    links = {}
    for (_, _, label), (_, n, _, _) in zip(sorted(rows), sorted(brute(rows)), strict=True):
        links[label] = links.get(label, 0) + n
    for r in vectors.recall(df, capacity=40).collect():
        assert (r.audited > 0) == (links[r.label] > 0) and r.audited_found <= r.audited_links and r.recall >= 0.99
