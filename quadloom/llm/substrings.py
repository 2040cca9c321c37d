"""Removal of repeated word passages by hashes of windows, grouped at suffixes that minimisers choose.

This stands in for prefix-partitioned suffix trees: "tree", "branch" and "leaf" below name groups of equal 64-bit hashes, not nodes of a tree.

A window is a run of `window` words of one document. Every word goes that is covered by a window whose words also start
earlier (smaller doc_id, or earlier in the same document).

Suffixes. Of the suffixes of every document (one for each word), those go into trees that start where a window's
prefix of `prefix` words has the least hash in that window (the leftmost of equals). Equal windows hold theirs at the same distance, so every repeated window
meets its other occurrences in the subtree of one prefix; a suffix stands for all windows that chose it (they are
neighbours), which lets a tree hold an eighth of all suffixes.

Subtrees. A suffix's path is its prefix, then the words that its windows span. The prefix alone deals the suffixes out to
tasks; within a task they are sorted by path, so that one prefix's subtree is a run of rows, its branches (equal spans) are runs
within that run, and any number of groups, of any size, streams through in constant memory. Branches with several leaves are internal
nodes at least a window deep (spans, not maximal repeats). All leaves but the first are repeats there and then. A prefix with several
branches is lengthened: one suffix of each branch is sent on with whole windows as prefixes, where the spans overlap in part only.
Either way a repeat is two equal 64-bit hashes (prefix and span, or two of the window): 10^12 windows hold an unlike pair with a probability of 10^-15.
Prefixes with a single leaf, nearly all, end here. Leaves of one branch are merged before the shuffle, batch by batch, so
a passage that a third of all documents hold is a few rows for each batch.

Defined results: a null or blank text has no words. Rows with a null doc_id come after all others and are never
removed from, nor do they make others repeats. Rows that share a doc_id are told apart by the hash of their texts; equal rows (same doc_id,
same text) are one document and each gets its result. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, joined_hash, mapped, mix64, run_hashes, slices, texts_of, within, word_hashes

WINDOW, PREFIX = 20, 6
#: A place packs a window's start and the number of neighbours after it that are meant as well.
COUNT_BITS = 5
FLAG, LEAF, BRANCH = 0, 1, 2
#: Makes a second, independent hash of a window out of its words' hashes.
OTHER = np.uint64(0xD1B54A32D192ED03)


def _least_starts(hashes: np.ndarray, span: int) -> np.ndarray:
    """For every window of `span` neighbours, where its leftmost least hash stands."""
    n = len(hashes) - span + 1
    at = np.arange(len(hashes))
    reach = 1
    while reach < span:  # doubling: the least of `reach` neighbours is known
        step = min(reach, span - reach)
        m = len(at) - step
        left, right = at[:m], at[step : step + m]
        at = np.where(hashes[left] <= hashes[right], left, right)
        reach += step
    return at[:n]


def _suffixes(batch: pa.RecordBatch, known: WordHashes, window: int, prefix: int):
    """Of each group of neighbouring windows that choose the same suffix: row, start, count, prefix hash, span hash."""
    hashes, ends = word_hashes(texts_of(batch.column(2)), known)
    total = len(hashes)
    if total < window:
        return None
    inside = within(ends, window, total)
    prefixes = run_hashes(hashes, prefix)
    windows = run_hashes(hashes, window)
    chosen = _least_starts(prefixes, window - prefix + 1)
    row = np.searchsorted(ends, np.arange(len(windows)), "right") - 1
    starts = np.flatnonzero(inside)
    if not len(starts):
        return None
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (chosen[starts[1:]] != chosen[starts[:-1]]) | (starts[1:] != starts[:-1] + 1) | (row[starts[1:]] != row[starts[:-1]])
    heads = np.flatnonzero(fresh)
    first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
    shape = ((chosen[first] - first) * 64 + (last - first)).astype(np.uint64)
    span = joined_hash(joined_hash(windows[first], windows[last]), shape)
    return row[first], first - ends[row[first]], last - first + 1, prefixes[chosen[first]], span


def _batch(kind, ids, prints, places, prefixes, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(kind, dtype=np.int8)), pa.array(ids), pa.array(prints), pa.array(np.asarray(places, dtype=np.int64)), pa.array(np.asarray(prefixes).astype(np.int64)), pa.array(np.asarray(spans).astype(np.int64))],
        names=["kind", "doc", "print", "place", "prefix", "span"],
    )


SUFFIXES = "kind byte, doc long, print long, place long, prefix long, span long"


def _planter(window: int, prefix: int):
    """Suffixes of documents; of the leaves of one branch within a slice only the earliest stays a leaf."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text"):
            if (found := _suffixes(batch, known, window, prefix)) is None:
                continue
            row, start, count, prefixes, spans = found
            ids, prints = np.asarray(batch.column(0))[row], np.asarray(batch.column(1))[row]
            order = np.lexsort((start, prints, ids, spans, prefixes))
            p, s = prefixes[order], spans[order]
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (p[1:] == p[:-1]) & (s[1:] == s[:-1])
            twin = again.copy()  # the same place of a row that occurs twice
            for c in (ids, prints, start):
                twin[1:] &= c[order][1:] == c[order][:-1]
            order, p, s, again = order[~twin], p[~twin], s[~twin], again[~twin]
            yield _batch(np.where(again, FLAG, LEAF), ids[order], prints[order], (start[order] << COUNT_BITS) + count[order], np.where(again, 0, p), np.where(again, 0, s))

    return plant


def _walker(lengthen: bool):
    """Over rows sorted by prefix, span and place: FLAG for all leaves of a branch but the first, BRANCH for the first leaves of a prefix with several branches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the leaf before
        waiting: tuple | None = None  # the first leaf of the open prefix while that has one branch
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            given = columns[0] == FLAG
            if given.any():
                yield batch.filter(pa.array(given))
                columns = [c[~given] for c in columns]
            _, ids, prints, places, prefixes, spans = columns
            if not len(ids):
                continue
            changed = lambda c, before: np.concatenate([[last is None or c[0] != before], c[1:] != c[:-1]])  # noqa: B023, E731
            before = last or (None,) * 5
            head = changed(prefixes, before[3])
            fork = head | changed(spans, before[4])
            twin = ~(fork | changed(ids, before[0]) | changed(prints, before[1]) | changed(places, before[2]))
            last = (ids[-1], prints[-1], places[-1], prefixes[-1], spans[-1])
            out = ~fork & ~twin
            if out.any():
                zero = np.zeros(int(out.sum()), dtype=np.int64)
                yield _batch(zero + FLAG, ids[out], prints[out], places[out], zero, zero)
            if not lengthen:
                continue
            groups = np.cumsum(head)  # 0: goes on from the batch before
            firsts = np.flatnonzero(fork)
            group = groups[firsts]
            several = (np.bincount(group, minlength=groups[-1] + 1) > 1)[group] | (group == 0)
            if waiting is not None and len(group) and group[0] == 0:
                yield _batch([BRANCH], *([x] for x in waiting), [0], [0])
                waiting = None
            if groups[-1]:
                newest = firsts[group == groups[-1]]
                waiting = tuple(c[newest[0]] for c in (ids, prints, places)) if len(newest) == 1 else None
            picked = firsts[several]
            if len(picked):
                zero = np.zeros(len(picked), dtype=np.int64)
                yield _batch(zero + BRANCH, ids[picked], prints[picked], places[picked], zero, zero)

    return walk


def _lengthener(window: int):
    """The whole windows of the branches that a document holds, as suffixes whose prefix is the window."""

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text"):
            hashes, ends = word_hashes(texts_of(batch.column(2)), known)
            if len(hashes) < window:
                continue
            windows, others = run_hashes(hashes, window), run_hashes(mix64(hashes ^ OTHER), window)
            places = batch.column(4)
            packed, row = np.asarray(places.flatten()), np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(places), 0)))
            count = packed & ((1 << COUNT_BITS) - 1)
            each = np.repeat(np.arange(len(packed)), count)
            start = (packed >> COUNT_BITS)[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            row = row[each]
            at = ends[row] + start
            ids, prints = np.asarray(batch.column(0))[row], np.asarray(batch.column(1))[row]
            yield _batch(np.full(len(row), LEAF), ids, prints, (start << COUNT_BITS) + 1, windows[at], others[at])

    return lengthen


def covered(places: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Mask of the words that the packed places cover."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    start = places >> COUNT_BITS
    np.add.at(edges, start, 1)
    np.add.at(edges, start + (places & ((1 << COUNT_BITS) - 1)) - 1 + window, -1)
    return np.cumsum(edges[:-1]) > 0


def kept_words(text: bytes, places: np.ndarray, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not len(places):
        return words, len(words)
    gone = covered(places, window, len(words))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def _places(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x or (), dtype=np.int64) for x in column.to_pylist()]


def _digester(window: int):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, removed, sha = [], [], []
            for text, places in zip(texts_of(batch.column(1)), _places(batch.column(2)), strict=True):
                words, total = kept_words(text, places, window)
                n.append(total)
                removed.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return digest


def _cleaner(window: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = []
            for text, places in zip(batch.column(0).to_pylist(), _places(batch.column(1)), strict=True):
                texts.append(text if not len(places) else b" ".join(kept_words(text.encode(), places, window)[0]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], names=["text", "row"])

    return clean


#: Stands for a null doc_id among the join keys, which must not be null.
NO_DOC = -(1 << 63)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, print, text, row): join keys without nulls, the text, and the other columns under names that can't clash."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_DOC)).alias("doc"), F.xxhash64(f"`{text}`").alias("print"), F.col(f"`{text}`").alias("text"), F.struct(*rest).alias("row"))


def _repeats(keyed: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc, print, places) of every document with repeated windows; places are packed."""
    if not prefix <= window <= prefix + (1 << COUNT_BITS) - 2:
        raise ValueError(f"a window is {prefix} to {prefix + (1 << COUNT_BITS) - 2} words long")
    known = keyed.select("doc", "print", "text").where((F.col("doc") != NO_DOC) & F.col("text").isNotNull())
    # Shuffle 1: suffixes by prefix. Flags ride along, dealt out by place, so that the documents are read once.
    planted = mapped(known, _planter(window, prefix), SUFFIXES)
    salt = F.when(F.col("kind") == FLAG, F.xxhash64("doc", "place")).otherwise(F.col("prefix"))
    walked = mapped(planted.repartition(salt).sortWithinPartitions("kind", "prefix", "span", "doc", "print", "place"), _walker(True), SUFFIXES)
    of_kind = lambda kind, name: F.collect_list(F.when(F.col("kind") == kind, F.col("place"))).alias(name)
    by_document = cut(walked.groupBy("doc", "print").agg(of_kind(FLAG, "places"), of_kind(BRANCH, "branches")))
    # Shuffle 2: documents with a branch of a forked prefix, for their windows. The exchange of documents is that of the final join.
    forked = keyed.join(by_document.where(F.size("branches") > 0).select("doc", "print", "branches"), ["doc", "print"])
    longer = mapped(forked, _lengthener(window), SUFFIXES)
    late = mapped(longer.repartition("prefix").sortWithinPartitions("prefix", "span", "doc", "print", "place"), _walker(False), SUFFIXES)
    late = late.groupBy("doc", "print").agg(F.collect_list("place").alias("late"))
    places = F.concat(F.col("places"), F.coalesce("late", F.array().cast("array<long>")))
    return by_document.join(late, ["doc", "print"], "left").select("doc", "print", places.alias("places")).where(F.size("places") > 0)


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated words gone from its texts: the words left, joined by a space; untouched texts stay as they are."""
    keyed = _keyed(docs, doc_id, text)
    joined = keyed.join(_repeats(keyed, window, prefix), ["doc", "print"], "left").select("text", "places", "row")
    cleaned = mapped(joined, _cleaner(window), f"text string, row {keyed.schema['row'].dataType.simpleString()}")
    return cleaned.select(*(F.col("text").alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def repeat_digests(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs."""
    keyed = _keyed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id", "text")
    joined = keyed.join(_repeats(keyed, window, prefix), ["doc", "print"], "left").select(F.col("row.c0").cast("long").alias("doc_id"), "text", "places")
    return mapped(joined, _digester(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
