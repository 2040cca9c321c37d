"""Vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens.

Every example, or piece of one, is a vector (tokens, one segment, loss-bearing tokens). The largest of a pool go first; each
goes to the open sequence whose free vector has the largest dot product with it among those where it fits, both
measured in shares of the limits; where none fits, a sequence is opened. Each task packs its own rows, batch by batch, so nothing is
shuffled and a sequence never spans two tasks; sequence ids carry the task's partition number.

pack_examples never cuts: an example that breaks a limit by itself raises. pack_texts may cut: whole runs of a
sequence's length are sequences of their own, rests are packed as above, sequences left open at the end of a pool are filled with cuts of
the emptiest ones, and the last rest of a task is cut into sequences whose lengths are powers of two.

Defined results: null and empty texts are the end id alone. Rows may repeat and ids may be null or equal: each row is packed once
under its own id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices
from .tokens import BYTE_BPE, audit, encode

#: Sequence ids: the partition's number, then this many bits for the sequences of one task.
TASK_BITS = 40
#: Pieces that are packed against each other.
POOL = 256


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


@dataclass
class Piece:
    """A run of an example's tokens; what says whose it is."""

    what: object
    start: int
    length: int
    loss: int


@dataclass
class Sequences:
    """The open sequences: what each holds and its free vector."""

    limits: Limits
    held: list[list[Piece]] = field(default_factory=list)
    free: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))

    def place(self, piece: Piece) -> None:
        """By the largest dot product of the piece and the free vectors where it fits."""
        size = np.array([piece.length, 1, piece.loss], dtype=np.float64)
        if (size > self.limits.vector).any():
            raise ValueError(f"an example of {piece.length} tokens, {piece.loss} with loss, breaks the limits by itself")
        if len(self.held):
            score = np.where((self.free >= size).all(axis=1), self.free @ (size / self.limits.vector**2), -1.0)
            best = int(score.argmax())
            if score[best] >= 0:
                self.held[best].append(piece)
                self.free[best] -= size
                return
        self.held.append([piece])
        self.free = np.vstack([self.free, self.limits.vector - size])

    def take(self, which: np.ndarray) -> list[list[Piece]]:
        """Closes the sequences of a mask."""
        out = [h for h, w in zip(self.held, which, strict=True) if w]
        self.held = [h for h, w in zip(self.held, which, strict=True) if not w]
        self.free = self.free[~which]
        return out

    def fill_by_cuts(self) -> list[list[Piece]]:
        """Fills the fullest sequences with cuts of the emptiest ones; closes all but the last that has room."""
        order = np.argsort(self.free[:, 0], kind="stable").tolist()  # fullest first
        i, j, out = 0, len(order) - 1, []
        while i < j:
            room, donor = self.free[order[i]], self.held[order[j]]
            if room[0] < 1 or room[1] < 1 or room[2] < 1:
                out.append(self.held[order[i]])
                i += 1
                continue
            piece = donor.pop()
            n = int(min(room[0], room[2], piece.length))
            self.held[order[i]].append(Piece(piece.what, piece.start, n, n))
            room -= (n, 1, n)
            back = self.free[order[j]]
            back += (n, 0, n)
            if n < piece.length:
                donor.append(Piece(piece.what, piece.start + n, piece.length - n, piece.length - n))
            else:
                back += (0, 1, 0)
            if not donor:
                j -= 1
        last = order[i : j + 1]
        self.held, self.free = [self.held[k] for k in last], self.free[last]
        return out


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces cut into sequences whose lengths are powers of two, longest first."""
    left = [*pieces]
    total = sum(p.length for p in left)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        out = []
        while want:
            p = left.pop(0)
            n = min(want, p.length)
            out.append(Piece(p.what, p.start, n, n))
            if n < p.length:
                left.insert(0, Piece(p.what, p.start + n, p.length - n, p.length - n))
            want -= n
        yield out


def _cut_pack(examples: Iterator[tuple[object, int]], limits: Limits) -> Iterator[list[Piece]]:
    """The sequences of examples (what, tokens) that may be cut and bear loss on every token."""
    most = min(limits.tokens, limits.loss)
    open_, pool = Sequences(limits), []

    def settle() -> Iterator[list[Piece]]:
        pool.sort(key=lambda p: -p.length)
        for piece in pool:
            open_.place(piece)
        pool.clear()
        yield from open_.take(open_.free[:, 0] < 1)
        yield from open_.fill_by_cuts()

    for what, n in examples:
        start = 0
        while n - start >= most:
            yield [Piece(what, start, most, most)]
            start += most
        if n > start:
            pool.append(Piece(what, start, n - start, n - start))
        if len(pool) >= POOL:
            yield from settle()
    yield from settle()
    for pieces in open_.held:
        yield from powers_of_two(pieces)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _text_packer(limits: Limits, end_id: int, path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=np.uint32)
        number = TaskContext.get().partitionId() << TASK_BITS

        def examples() -> Iterator[tuple[object, int]]:
            for batch in slices(batches, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                audit(texts, path)
                for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    ids = np.concatenate([encode(text, path), end])
                    yield (doc, ids), len(ids)

        columns: list[list] = [[] for _ in range(7)]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])
            for c in columns:
                c.clear()
            return out

        for pieces in _cut_pack(examples(), limits):
            offset = 0
            for p in pieces:
                doc, ids = p.what
                crc = zlib.crc32(ids[p.start : p.start + p.length].astype("<u4", copy=False).tobytes())
                for c, v in zip(columns, (doc, p.start, p.length, crc, len(ids), number, offset), strict=True):
                    c.append(v)
                offset += p.length
            number += 1
            if len(columns[0]) >= 8192:
                yield flush()
        yield flush()

    return pack


def pack_texts(docs: DataFrame, limits: Limits = Limits(), end_id: int = 1, path: str = BYTE_BPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: whose ids, which of them, their CRC-32, and the sequence and offset where they stand."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return mapped(rows, _text_packer(limits, end_id, path), PIECES)


def _example_packer(limits: Limits):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TASK_BITS
        open_, pool = Sequences(limits), []

        def settle() -> None:
            pool.sort(key=lambda p: -max(p.length / limits.tokens, p.loss / limits.loss))
            for piece in pool:
                open_.place(piece)
            pool.clear()

        def emit(closed: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for pieces in closed:
                offset = 0
                for p in pieces:
                    rows.append((p.what, p.length, p.loss, number, offset))
                    offset += p.length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["example_id", "tokens", "loss_tokens", "sequence_id", "offset"])

        for batch in batches:
            for what, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pool.append(Piece(what, 0, tokens or 0, loss or 0))
                if len(pool) >= POOL:
                    settle()
                    full = (open_.free[:, 0] < 1) | (open_.free[:, 1] < 1)
                    if len(open_.held) - full.sum() > POOL:  # bounded: the fullest go
                        full |= open_.free[:, 0] <= np.median(open_.free[:, 0])
                    yield emit(open_.take(full))
        settle()
        yield emit(open_.held)

    return pack


def pack_examples(examples: DataFrame, limits: Limits = Limits(), example_id: str = "example_id", tokens: str = "tokens", loss: str = "loss_tokens") -> DataFrame:
    """Packs whole examples by their sizes: (example_id, tokens, loss_tokens, sequence_id, offset). Null sizes count as 0."""
    rows = examples.select(*(F.col(f"`{c}`").cast("long").alias(n) for c, n in ((example_id, "example_id"), (tokens, "tokens"), (loss, "loss_tokens"))))
    return mapped(rows, _example_packer(limits), "example_id long, tokens long, loss_tokens long, sequence_id long, offset long")
