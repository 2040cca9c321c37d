"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations serve for the whole signature: the first scatters a shingle over the universe of 32-bit numbers, then
coordinate k is the minimum, over the set, of the second permutation after a circular shift of the universe by k steps.
Documents that agree in a band are candidates. A candidate becomes a link only after the full sets are compared.

Which candidates are compared: documents with equal sets are one class. In each band bucket every class is first
compared with one centre, picked by a hash, so a bucket of n classes yields n pairs. Classes that these links connect
need no more comparison among each other. What is left are classes of one bucket in different components. A link between
components needs shingles that both hold, so those that no class of another component holds are counted first: too many
of them and a class has no link beyond its component, which rules out a copy with many edits of its own. The others form
the clusters that their buckets connect. A cluster is compared as a whole or bucket by bucket (buckets with the same classes count once),
whichever takes fewer copies of its sets, so a chain of buckets costs no more than its buckets do; in blocks of CROWD classes (fewer if their
sets are large), each two of which meet in one task that counts all intersections at once and returns one link for each pair of
components. Every pair of a bucket is thus compared, connected already or shown to be too unlike, and no pairs within a group are listed.

Defined results: null, empty and blank texts have an empty set, link with nothing and are kept. A text with fewer words
than a shingle has its whole word sequence as its only shingle. Rows that share a doc_id are one document, linked to all
that any of them links to; each such row is returned. Rows with a null doc_id are returned with a null component, not
kept. Other columns of the input, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, apart, cut, joined_hash, mapped, mix64, run_hashes, slices, texts_of, word_hashes
from .components import components

#: Signature: BANDS bands of ROWS coordinates. At a Jaccard index of 0.85 a pair shares no band with probability 3e-7,
#: at 0.8 with 6e-5.
BANDS, ROWS = 32, 6
#: Shingle hashes that one pass of the signature works on, so that they stay in a core's cache.
BLOCK = 1 << 15
#: Classes in a block that is compared with another, and shingles in it, about; shingles that one pass of that counts.
CROWD, CROWD_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Circular shift of the universe by one step of a coordinate.
STEP = 0x9E3779B1


def shingle_hashes(texts: list[bytes], words: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, one text after the other, and where each begins (with the end)."""
    hashes, ends = word_hashes(texts, known)
    runs = run_hashes(hashes, words) if len(hashes) >= words else np.empty(0, np.uint64)
    sets, starts = [], [0]
    for i in range(len(texts)):
        n = int(ends[i + 1] - ends[i])
        if n >= words:
            found = np.unique(runs[ends[i] : ends[i + 1] - words + 1])
        elif n:
            found = mix64(run_hashes(hashes[ends[i] : ends[i + 1]], n) ^ np.uint64(n))
        else:
            found = np.empty(0, np.uint64)
        sets.append(found)
        starts.append(starts[-1] + len(found))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.asarray(starts, dtype=np.int64)


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit universe; in place."""
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x


def signatures(shingles: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of 32-bit minima for each set; sets must not be empty."""
    universe = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    out = np.full((len(starts) - 1, coordinates), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    shifts = (np.arange(coordinates, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)
    for begin in range(0, len(universe), BLOCK):
        block = universe[begin : begin + BLOCK]
        first, last = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, begin + len(block), "left")
        cuts = np.maximum(starts[first:last] - begin, 0)
        for k, shift in enumerate(shifts):
            least = np.minimum.reduceat(_second(block + shift), cuts)
            np.minimum(out[first:last, k], least, out=out[first:last, k])
    return out


def _signer(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text"):
            shingles, starts = shingle_hashes(texts_of(batch.column(1)), words, known)
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sizes), 2), dtype=np.uint64)
            banded = np.zeros((len(sizes), bands), dtype=np.uint64)
            if len(full):
                at = starts[full]
                keys[full, 0] = np.add.reduceat(mix64(shingles), at)
                keys[full, 1] = np.bitwise_xor.reduceat(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)), at)
                signature = signatures(shingles, np.append(at, starts[-1]), bands * rows).reshape(-1, bands, rows).astype(np.uint64)
                held = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(full), 1), np.uint64)
                for r in range(rows):
                    held = joined_hash(held, signature[:, :, r])
                banded[full] = held
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(keys[:, 0].astype(np.int64)), pa.array(keys[:, 1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(banded[full].reshape(-1).astype(np.int64)))],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return sign


def _setter(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text"):
            shingles, starts = shingle_hashes(texts_of(batch.column(1)), words, known)
            raw = [shingles[starts[i] : starts[i + 1]].tobytes() for i in range(batch.num_rows)]
            full = np.flatnonzero(np.diff(starts))
            k1 = np.zeros(batch.num_rows, dtype=np.uint64)
            if len(full):
                k1[full] = np.add.reduceat(mix64(shingles), starts[full])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1.astype(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "k1", "shingles"])

    return make


def _spreader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, shingles) as rows of one shingle."""
    for batch in slices(batches, "shingles"):
        raw = batch.column(2).to_pylist()
        sizes = np.array([len(x) // 8 for x in raw])
        found = np.frombuffer(b"".join(raw), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), sizes)), pa.array(np.repeat(np.asarray(batch.column(1)), sizes)), pa.array(found)], names=["node", "label", "shingle"])


def _comparer(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return compare


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at `left` with those at `right`, by products of 0/1 matrices of shared shingles."""
    holder = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    holder, column = holder[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    holder, column = holder[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((len(sets), int(column[b - 1]) - first + 1), dtype=np.float32)
        dense[holder[a:b], column[a:b] - first] = 1
        out += dense[left] @ dense[right].T
    return np.rint(out).astype(np.int64)


def _crowd(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        label, block = np.asarray(table["label"]), np.asarray(table["block"])
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets])
        one = block.min()
        left = np.flatnonzero(block == one)
        right = left if block.max() == one else np.flatnonzero(block != one)
        both = _intersections(sets, left, right)
        alike = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (label[left][:, None] != label[right][None, :])
        i, j = np.nonzero(alike)
        ends = np.unique(np.stack([label[left][i], label[right][j]], axis=1), axis=0) if len(i) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return compare


def _spread(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label, shingle) of nodes (node, rep, k1, label)."""
    held = sets.join(nodes.select("node", F.col("rep").alias("doc_id"), "k1", "label"), ["doc_id", "k1"])
    return mapped(held.select("node", "label", "shingles"), _spreader, "node long, label long, shingle long")


def _across(spread: DataFrame) -> DataFrame:
    """(shingle, held) of the shingles that nodes of different labels hold, and how many nodes do."""
    found = spread.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("held"))
    return apart(found.where("least < most").select("shingle", "held"), "shingle")


def _keys(rows: DataFrame) -> DataFrame:
    """(key, node, head, held) of the buckets of rows (bucket, node, label) that hold several labels, with their first node and number of nodes.

    Buckets with the same nodes count once.
    """
    xor = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    held = rows.groupBy("bucket").agg(F.count("*").alias("held"), F.min("node").alias("head"), *xor, F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    once = held.groupBy("held", "head", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "head", "held")
    return cut(rows.join(apart(once, "bucket"), "bucket").select(F.col("bucket").alias("key"), "node", "head", "held"), fresh=True)


def _crowds(nodes: DataFrame, keys: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(kind, id, p, q, block, label, rep, k1): the pairs of blocks to compare; a block with itself where p = q.

    A unit (kind, id) is a cluster of nodes that keys connect, or a key where comparing by keys takes fewer copies of the cluster's sets.
    """
    clusters = components(keys.select(F.col("node").alias("u"), F.col("head").alias("v"))).toDF("node", "cluster")
    whole = cut(nodes.join(clusters, "node"), fresh=True)
    blocks_of = lambda count, total: F.greatest(F.ceil(count / crowd), F.ceil(total / CROWD_SHINGLES))
    copies = whole.groupBy("cluster").agg((F.count("*") * blocks_of(F.count("*"), F.sum("n"))).alias("whole"))
    own = keys.where("node = head").select("node", "held").join(whole.select("node", "cluster"), "node")
    cheaper = own.groupBy("cluster").agg(F.sum(F.col("held") * F.ceil(F.col("held") / crowd)).alias("keyed")).join(copies, "cluster").where("keyed < whole").select("cluster")
    unit = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), "rep", "k1", "n", "label")
    together = unit(whole.join(apart(cheaper, "cluster"), "cluster", "left_anti"), 0, "cluster")
    split = unit(whole.join(apart(cheaper, "cluster"), "cluster", "left_semi").join(keys.select("key", "node"), "node"), 1, "key")
    units = cut(together.union(split), fresh=True)
    blocks = units.groupBy("kind", "id").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    dealt = units.join(apart(blocks.select("kind", "id", "blocks"), "id"), ["kind", "id"]).withColumn("block", F.pmod(F.xxhash64("rep", "k1"), F.col("blocks")))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return met.select("kind", "id", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "label", "rep", "k1")


def _crossed(nodes: DataFrame, keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the labels of nodes (node, rep, k1, n, label) that meet under keys."""
    met = _crowds(nodes, keys).withColumnRenamed("rep", "doc_id")
    return met.join(sets, ["doc_id", "k1"]).select("kind", "id", "p", "q", "block", "label", "shingles").groupBy("kind", "id", "p", "q").applyInArrow(_crowd(percent), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, ka, b, kb) whose full sets are alike enough, as (a, b)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("k1").alias("ka"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("k1").alias("kb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, ["a", "ka"]).join(right, ["b", "kb"]).select("a", "b", "sa", "sb")
    return mapped(both, _comparer(percent), "a long, b long")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs, smaller document first, whose sizes allow a link. rows: x, kx, nx, y, ky, ny."""
    fits: Column = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return rows.where((F.col("x") != F.col("y")) & fits).select(pick("x", "y").alias("a"), pick("kx", "ky").alias("ka"), pick("y", "x").alias("b"), pick("ky", "kx").alias("kb")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs. Links: 100 * intersection >= percent * union of word shingles."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = cut(mapped(docs, _signer(words, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    present = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # One class for each distinct set; the smallest document stands for it.
    classes = present.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    own = present.select(F.col("doc_id").alias("rep"), "k1", "k2", "n_shingles", "bands").join(classes, ["rep", "k1", "k2"], "left_semi").dropDuplicates(["rep", "k1", "k2"])
    banded = own.select(F.col("rep"), F.col("k1"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    spread = F.xxhash64("rep", "bucket")
    centres = banded.groupBy("bucket").agg(F.count("*").alias("held"), F.min(F.struct(spread.alias("o"), "rep", "k1", "n")).alias("c")).where("held > 1").select("bucket", F.col("c.rep").alias("y"), F.col("c.k1").alias("ky"), F.col("c.n").alias("ny"))
    members = cut(banded.join(apart(centres, "bucket"), "bucket"), fresh=True)  # only buckets with two classes at least

    needed = members.select(F.col("rep").alias("doc_id"), "k1").distinct()
    texts = docs.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = cut(mapped(texts, _setter(words), "doc_id long, k1 long, shingles binary").join(needed, ["doc_id", "k1"], "left_semi").dropDuplicates(["doc_id", "k1"]))

    stars = _pairs(members.select(F.col("rep").alias("x"), F.col("k1").alias("kx"), F.col("n").alias("nx"), "y", "ky", "ny"), percent)
    repeated = present.groupBy("doc_id").agg(F.count("*").alias("held")).where("held > 1").select("doc_id")
    same = present.join(repeated, "doc_id", "left_semi").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")
    linked = components(_verified(stars, sets, percent).union(same), "a", "b")

    # Classes of buckets that still hold several components, if enough of their shingles are held by other components.
    labelled = members.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "k1", "n", F.coalesce("label", "rep").alias("label"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
    mixed = cut(labelled.join(apart(several, "bucket"), "bucket", "left_semi").select("bucket", F.xxhash64("rep", "k1").alias("node"), "rep", "k1", "n", "label"), fresh=True)
    nodes = mixed.select("node", "rep", "k1", "n", "label").distinct()
    spread = _spread(nodes, sets)
    bounds = spread.join(_across(spread), "shingle").groupBy("node").agg(F.count("*").alias("c"))
    nodes = cut(nodes.join(bounds, "node").where(F.col("c") * 100 >= F.col("n") * percent).drop("c"), fresh=True)
    late = _crossed(nodes, _keys(mixed.select("bucket", "node", "label").join(nodes.select("node"), "node")), sets, percent)
    merged = components(late, "a", "b")

    # A document that holds several classes (repeated doc_id) joins their components; rows find theirs by set.
    labels = linked.select("node", "label").union(merged.select("node", "label").join(linked.select("node"), "node", "left_anti"))
    final = labels.join(merged.toDF("label", "last"), "label", "left").select(F.col("node").alias("rep"), F.coalesce("last", "label").alias("component"))
    classed = classes.join(final, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    found = signed.join(classed, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
