"""Token counts that follow edits: a segment tree over the pre-token segments of each document.

A leaf is a run of whole pre-tokens, about LEAF characters of text, with its characters and its tokens; inner nodes hold the sums of their two
children, the root the document's. Leaves are cut where white space follows another character: no pre-token spans such a place, and
what follows is tokenised without regard to what stands before. An edit therefore touches the leaves that it overlaps, with CONTEXT
characters before (how far a pre-token looks ahead) and one after (it keeps the next cut valid): only their text is encoded again,
and the sums on the paths from those leaves to the root are updated. A leaf that has grown beyond GROWN leaves' worth is cut anew, which
reshapes the tree but encodes nothing else.

Trees are rows of the form {chars, tokens}, arrays in level order with the root first, so they can be stored with the documents.

Defined results: a null or empty text has one empty leaf and no tokens. Edits are clipped to the text; a null insertion is empty and null
numbers are 0. Rows are independent: repeated rows, null ids and other columns change nothing. A special token's string is one
token, as the tokenizers library counts it; it holds no white space, so it lies within one leaf. All edits of a document travel in one row
beside it, so they should fit a task's memory as the text itself does. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices
from .tokens import BYTE_BPE, audit, encode

LEAF, GROWN = 1024, 4
CONTEXT = 3
_CUT = re.compile(r"(?<=\S)[ \n]")


def segments(text: str, leaf: int = LEAF) -> list[str]:
    """The text in runs of whole pre-tokens, each the shortest of at least `leaf` characters."""
    out, start = [], 0
    while len(text) - start > leaf:
        found = _CUT.search(text, start + leaf)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


class SegmentTree:
    """Characters and tokens of a text's segments, with their sums; holds the text as well."""

    def __init__(self, text: str, path: str = BYTE_BPE, leaf: int = LEAF, tree: tuple[list[int], list[int]] | None = None):
        self.path, self.leaf, self.text, self.encoded = path, leaf, text, 0
        if tree:
            self.chars, self.tokens = map(list, tree)
            self.width = (len(self.chars) + 1) // 2
            if self.chars[0] != len(text):
                raise ValueError("the tree isn't that of this text")
        else:
            parts = segments(text, leaf)
            self._shape([len(p) for p in parts], [self._count(p) for p in parts])

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(encode(text, self.path))

    def _shape(self, chars: list[int], tokens: list[int]) -> None:
        """Builds the sums over given leaves."""
        self.width = 1 << (len(chars) - 1).bit_length()
        pad = [0] * (self.width - len(chars))
        self.chars, self.tokens = ([0] * (self.width - 1) + x + pad for x in (chars, tokens))
        for i in range(self.width - 2, -1, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i + 1] + self.chars[2 * i + 2]
        self.tokens[i] = self.tokens[2 * i + 1] + self.tokens[2 * i + 2]

    @property
    def total(self) -> int:
        return self.tokens[0]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last that holds any, and where it starts."""
        i, start = 0, 0
        place = min(place, max(0, self.chars[0] - 1))
        while i < self.width - 1:
            left = 2 * i + 1
            if place < start + self.chars[left]:
                i = left
            else:
                start += self.chars[left]
                i = left + 1 if self.chars[left + 1] else left
                if i == left:
                    start -= self.chars[left]
        return i - (self.width - 1), start

    def edit(self, place: int, removed: int, inserted: str) -> None:
        """Replaces `removed` characters from `place` on; encodes the leaves around it alone."""
        place = min(max(place, 0), len(self.text))
        end = min(place + max(removed, 0), len(self.text))
        first, start = self._leaf_at(max(0, place - CONTEXT))
        last, stop = self._leaf_at(min(end + 1, max(0, len(self.text) - 1)))
        stop += self.chars[self.width - 1 + last]
        region = self.text[start:place] + inserted + self.text[end:stop]
        self.text = self.text[:place] + inserted + self.text[end:]
        slots = last - first + 1
        parts = segments(region, max(1, -(-len(region) // slots)))
        parts += [""] * (slots - len(parts))
        if max(map(len, parts)) > GROWN * self.leaf and len(fresh := segments(region, self.leaf)) > slots:
            base = self.width - 1
            chars, tokens = self.chars[base:], self.tokens[base:]
            chars[first : last + 1] = [len(p) for p in fresh]
            tokens[first : last + 1] = [self._count(p) for p in fresh]
            while len(chars) > 1 and not chars[-1]:
                chars.pop(), tokens.pop()
            self._shape(chars, tokens)
            return
        touched = range(self.width - 1 + first, self.width + last)
        for i, part in zip(touched, parts, strict=True):
            self.chars[i], self.tokens[i] = len(part), self._count(part)
        while touched[0]:
            touched = range((touched[0] - 1) // 2, (touched[-1] - 1) // 2 + 1)
            for i in touched:
                self._sum(i)


_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def _planter(path: str, leaf: int):
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            audit(texts, path)
            trees = [SegmentTree(t, path, leaf) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], _TREE), pa.array([t.total for t in trees], pa.int64())], names=["doc_id", "text", "tree", "n_tokens"])

    return plant


COUNTED = "doc_id long, text string, tree struct<chars: array<int>, tokens: array<int>>, n_tokens long"


def count_tokens(docs: DataFrame, path: str = BYTE_BPE, leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, tree, n_tokens) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return mapped(rows, _planter(path, leaf), COUNTED)


def _editor(path: str, leaf: int):
    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            trees = []
            for text, tree, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                t = SegmentTree(text or "", path, leaf, (tree["chars"], tree["tokens"]))
                for e in edits or []:
                    t.edit(e["place"] or 0, e["removed"] or 0, e["inserted"] or "")
                trees.append(t)
            arrays = [pa.array([t.text for t in trees], pa.string()), pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], _TREE), pa.array([t.total for t in trees], pa.int64()), pa.array([t.encoded for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "text", "tree", "n_tokens", "encoded_chars"])

    return edit


def apply_edits(counted: DataFrame, edits: DataFrame, path: str = BYTE_BPE, leaf: int = LEAF) -> DataFrame:
    """counted after edits (doc_id, seq, place, removed, inserted), applied to each document in order of seq; encoded_chars is what that cost."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "place", "removed", "inserted"))).alias("edits"))
    rows = counted.join(each, "doc_id", "left").select("doc_id", "text", "tree", "edits")
    return mapped(rows, _editor(path, leaf), COUNTED + ", encoded_chars long")


def standard_edits(n: int) -> list[tuple[int, int, str]]:
    """Edits of a text of n characters: one at its beginning, one in its middle, one near its end."""
    return [(0, 0, "Draft: "), (7 + n // 2, 12, "it's re-edited"), (max(0, n - 9), 5, "")]


def _recounter(path: str, leaf: int):
    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, texts = [], [t or "" for t in batch.column(1).to_pylist()]
            audit(texts, path)
            for text in texts:
                t = SegmentTree(text, path, leaf)
                before, whole = t.total, t.encoded
                for e in standard_edits(len(t.text)):
                    t.edit(*e)
                rows.append((before, t.total, t.encoded - whole, hashlib.sha256(t.text.encode()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))], names=["doc_id", "n_tokens", "edited_tokens", "encoded_chars", "edited_sha256"])

    return recount


def recounts(docs: DataFrame, path: str = BYTE_BPE, leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, edited_tokens, encoded_chars, edited_sha256): every document before and after its standard edits."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return mapped(rows, _recounter(path, leaf), "doc_id long, n_tokens long, edited_tokens long, encoded_chars long, edited_sha256 string")
