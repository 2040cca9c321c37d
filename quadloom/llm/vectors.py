"""Near-duplicate vectors by one small-world graph per shard, each searched for every vector of its label.

Equal vectors of a label are one class, held by their smallest id. Classes are dealt into shards of about CAPACITY by a hash of its vector, and a
graph is built for each shard in one task. Every two shards of a label (and each with itself) meet in one task, which searches
either's graph for all of the other's vectors. Beams are widened by every vector above the threshold that they meet. Queries are drawn
until AUDITED of them have links other than to themselves (or none are left), by comparison with all vectors of the other shard; while the mean
over them of the share of links that the search found is below RECALL, the beam's first width doubles and the search runs again. Each candidate's cosine is verified in double precision, and what one
direction found counts for both. A task returns, for each vector, how many vectors it links to and one edge to its component in the task: numbers
that grow with the vectors, not with the links, so a large group of near copies isn't expanded into pairs.

Defined results: a vector that is null, empty or zero or holds null, NaN or infinite components, or whose label is null, links with nothing
and is kept. Vectors of different lengths don't link. Rows that share a vec_id are vectors of their own in one component. Rows with a null vec_id link
with nothing, have no component and aren't kept. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, mapped
from .components import components
from .hnsw import Graph

#: Vectors in a shard, about; least cosine; width of the first beam; audited queries with links of each search and the mean share of their links to find.
CAPACITY = 16_384
COSINE = 0.98
BEAM = 32
AUDITED, RECALL = 128, 0.999
#: Rounding of the search's single precision.
SLACK = 1e-4
ROWS = 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of rows a of x and b of y."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 15):
        p, q = x[a[i : i + (1 << 15)]], y[b[i : i + (1 << 15)]]
        out[i : i + (1 << 15)] = np.einsum("kd,kd->k", p, q) / np.sqrt(np.einsum("kd,kd->k", p, p) * np.einsum("kd,kd->k", q, q))
    return out


def _audit(queries: np.ndarray, raw: np.ndarray, least: float, same: bool) -> dict[int, np.ndarray]:
    """All links, by comparison with every vector, of queries drawn until AUDITED of them have a link other than themselves, or all are drawn."""
    whole, truth = _unit(raw), {}
    order = np.random.default_rng(len(queries) + len(raw)).permutation(len(queries))
    for at in range(0, len(order), ROWS):
        drawn = order[at : at + ROWS]
        row, v = np.nonzero(_unit(queries[drawn]) @ whole.T >= least - SLACK)
        q = drawn[row]
        fine = (_cosines(queries, raw, q, v) >= least) & ~(same & (q == v))
        row, v = row[fine], v[fine]
        ends = np.searchsorted(row, np.arange(len(drawn) + 1))
        for i, a, b in zip(drawn.tolist(), ends, ends[1:], strict=False):
            if a < b and len(truth) < AUDITED:
                truth[i] = v[a:b]
        if len(truth) >= AUDITED:
            break
    return truth


def _search(queries: np.ndarray, graph: Graph, raw: np.ndarray, least: float, beam: int, same: bool = False, tally: np.ndarray | None = None) -> np.ndarray:
    """Links of all queries with a graph's vectors, as bits: a row of bits for each query. same: the queries are those vectors.

    tally: to it are added the audited queries, their links and how many of these the search found.
    """
    unit = _unit(queries).astype(np.float32)
    n = len(graph.ids)
    truth = _audit(queries, raw, least, same)
    while True:
        bits = np.zeros((len(queries), -(-n // 8)), dtype=np.uint8)
        for at in range(0, len(queries), ROWS):
            q, v = graph.within(unit[at : at + ROWS], least - SLACK, beam, np.arange(at, min(at + ROWS, n)) if same else None)
            near = _cosines(queries, raw, q + at, v) >= least
            dense = np.zeros((len(unit[at : at + ROWS]), n), dtype=bool)
            dense[q[near], v[near]] = True
            bits[at : at + ROWS] = np.packbits(dense, axis=1)
        recall = [np.unpackbits(bits[i], count=n)[t].mean() for i, t in truth.items()]
        if not recall or np.mean(recall) >= RECALL or beam >= n:
            if tally is not None:
                links = [len(t) for t in truth.values()]
                tally += np.array([len(links), sum(links), round(float(np.dot(links, recall))) if links else 0])
            return bits
        beam *= 2


def _turned(bits: np.ndarray, n: int) -> np.ndarray:
    """The transposed matrix of bits with n columns."""
    out = np.zeros((n, -(-len(bits) // 8)), dtype=np.uint8)
    for at in range(0, n, 8 * ROWS):
        part = np.unpackbits(bits[:, at // 8 : at // 8 + ROWS], axis=1)[:, : n - at]
        out[at : at + part.shape[1]] = np.packbits(part.T, axis=1)
    return out


def _linked(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row, the sizes of the classes whose bits are set."""
    out = np.empty(len(bits), dtype=np.int64)
    for at in range(0, len(bits), ROWS):
        out[at : at + ROWS] = np.unpackbits(bits[at : at + ROWS], axis=1, count=len(sizes)).astype(np.int64) @ sizes
    return out


def _parts(rows: np.ndarray, columns: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges (id, smallest id of its part) of the graph whose links are bits: left x right ids, or left x left if right is None.

    Searched breadth first, whole rows of bits at a time.
    """
    edges = []
    fresh = np.ones(len(left), dtype=bool)
    for seed in range(len(left)):
        if not fresh[seed]:
            continue
        own, others = {seed}, set()
        frontier = np.array([seed])
        fresh[seed] = False
        open_right = None
        while len(frontier):
            reach = np.unpackbits(np.bitwise_or.reduce(rows[frontier], axis=0), count=len(left if right is None else right)).astype(bool)
            if right is None:
                frontier = np.flatnonzero(reach & fresh)
            else:
                if open_right is None:
                    open_right = np.ones(len(right), dtype=bool)
                new = np.flatnonzero(reach & open_right)
                open_right[new] = False
                others.update(new.tolist())
                back = np.unpackbits(np.bitwise_or.reduce(columns[new], axis=0), count=len(left)).astype(bool) if len(new) else np.zeros(len(left), dtype=bool)
                frontier = np.flatnonzero(back & fresh)
            fresh[frontier] = False
            own.update(frontier.tolist())
        ids = [*left[list(own)].tolist(), *(right[list(others)].tolist() if others else [])]
        if len(ids) > 1:
            root = min(ids)
            edges += [(i, root) for i in ids if i != root]
    return edges


def _graph_builder(table: pa.Table) -> pa.Table:
    """One row for a shard: its vectors, class sizes and graph."""
    order = np.argsort(np.asarray(table["cid"]), kind="stable")
    ids, sizes = np.asarray(table["cid"])[order], np.asarray(table["size"])[order]
    flat = table["embedding"].combine_chunks()
    raw = np.asarray(flat.flatten()).reshape(len(flat), -1)[order]
    graph = Graph(ids, _unit(raw.astype(np.float64)))
    first = {c: [table[c][0].as_py()] for c in ("label", "dim", "shard")}
    return pa.table({**first, "n": [len(ids)], "raw": [raw.tobytes()], "sizes": [sizes.astype(np.int64).tobytes()], "graph": [graph.to_bytes()]}, schema=_SHARD)


_SHARD = pa.schema([("label", pa.int64()), ("dim", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("raw", pa.binary()), ("sizes", pa.binary()), ("graph", pa.binary())])
SHARD = "label long, dim long, shard long, n long, raw binary, sizes binary, graph binary"


FOUND = "cid long, links long, root long, audited long, audited_links long, audited_found long"


def _searcher(least: float, beam: int):
    def load(n, raw, sizes, graph):
        held = Graph.from_bytes(graph)
        return held, np.frombuffer(raw, f"f{len(raw) // held.vectors.size}").reshape(n, -1).astype(np.float64), np.frombuffer(sizes, np.int64)

    def one(a, b, same, tally):
        left, x, w = load(*a)
        bits = _search(x, left if same else (right := load(*b))[0], x if same else right[1], least, beam, same, tally)
        if same:
            bits |= _turned(bits, len(x))
            for i in range(len(x)):
                bits[i, i // 8] &= ~np.uint8(128 >> i % 8)
            return left.ids, _linked(bits, w), _parts(bits, bits, left.ids, None)
        graph, y, v = right
        back = _search(y, left, x, least, beam, tally=tally)
        bits |= _turned(back, len(x))
        back = _turned(bits, len(y))
        return np.concatenate([left.ids, graph.ids]), np.concatenate([_linked(bits, v), _linked(back, w)]), _parts(bits, back, left.ids, graph.ids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = [c[row].as_py() for c in batch.columns]
                tally = np.zeros(3, dtype=np.int64)
                ids, links, edges = one(values[1:5], values[5:9], values[0], tally)
                roots = dict(edges)
                audits = np.zeros((3, len(ids)), dtype=np.int64)  # a task's audits stand in its first row
                audits[:, 0] = tally
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array([roots.get(i, i) for i in ids.tolist()], pa.int64()), *map(pa.array, audits)], names=[x.split()[0] for x in FOUND.split(", ")])

    return search


KEYS = ["label", "dim", "h1", "h2"]


def _searched(vectors: DataFrame, least: float, capacity: int, beam: int, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their keys and whether they are valid, the classes of equal vectors, and what the tasks found."""
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast(kind).alias("embedding"), F.col(f"`{label}`").cast("long").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    rows = rows.withColumn("valid", valid).select("*", F.size("embedding").cast("long").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.hash("embedding"), "embedding").alias("h2"))
    classes = cut(rows.where("valid").groupBy(*KEYS).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("embedding").alias("embedding")).withColumn("cid", F.monotonically_increasing_id()))
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / capacity).alias("shards"))
    dealt = classes.join(apart(shards, "label", "dim"), ["label", "dim"]).withColumn("shard", F.pmod("h1", F.col("shards")))
    built = cut(dealt.select("label", "dim", "shard", "cid", "size", "embedding").groupBy("label", "dim", "shard").applyInArrow(_graph_builder, SHARD))

    side = lambda s: built.select("label", "dim", *(F.col(c).alias(f"{s}_{c}") for c in ("shard", "n", "raw", "sizes", "graph")))
    named = built.select("label", "dim", "shard")
    met = named.withColumnRenamed("shard", "a_shard").join(named.withColumnRenamed("shard", "b_shard"), ["label", "dim"]).where("a_shard <= b_shard")
    pairs = met.join(side("a"), ["label", "dim", "a_shard"]).join(side("b"), ["label", "dim", "b_shard"]).repartition("label", "dim", "a_shard", "b_shard")
    columns = ["n", "raw", "sizes", "graph"]
    given = pairs.select((F.col("a_shard") == F.col("b_shard")).alias("same"), *(f"a_{c}" for c in columns), *(F.when(F.col("a_shard") != F.col("b_shard"), F.col(f"b_{c}")).alias(f"b_{c}") for c in columns))
    return rows, classes, cut(mapped(given, _searcher(least, beam), FOUND))


def near_duplicates(vectors: DataFrame, least: float = COSINE, capacity: int = CAPACITY, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links join vectors of one label with a cosine of `least` or more."""
    rows, classes, found = _searched(vectors, least, capacity, beam, vec_id, embedding, label)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    # Rows that share a vec_id join their classes.
    usable = rows.where("valid")
    repeated = usable.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")
    shared = usable.join(apart(repeated, "vec_id"), "vec_id", "left_semi").join(classes.select(*KEYS, "cid"), KEYS)
    same = shared.join(apart(shared.groupBy("vec_id").agg(F.min("cid").alias("v")), "vec_id"), "vec_id").select(F.col("cid").alias("u"), "v")
    labels = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")).union(same)).toDF("cid", "part")
    parted = classes.select(*KEYS, "rep", "size", "cid").join(labels, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    least_id = parted.groupBy("part").agg(F.min("rep").alias("component"))
    keyed = parted.join(apart(least_id, "part"), "part").join(links, "cid", "left")
    # Rows that aren't valid find no class; they are dealt out by their place.
    place = F.when(F.col("valid"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    out = rows.withColumn("place", place).join(keyed.withColumn("place", F.lit(-1).cast("long")), ["place", *KEYS], "left")
    n_links = F.when(F.col("valid"), F.col("size") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def recall(vectors: DataFrame, least: float = COSINE, capacity: int = CAPACITY, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(label, audited, audited_links, audited_found, recall): what the audits of each label's searches saw; a label without links has no recall."""
    _, classes, found = _searched(vectors, least, capacity, beam, vec_id, embedding, label)
    sums = [F.sum(c).alias(c) for c in ("audited", "audited_links", "audited_found")]
    out = found.join(classes.select("cid", "label"), "cid").groupBy("label").agg(*sums)
    return out.withColumn("recall", F.col("audited_found") / F.nullif(F.col("audited_links"), F.lit(0).cast("long")))
