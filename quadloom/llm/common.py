"""What several of the operators share: table reading, checkpoints, Arrow batches and word hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A slice of an Arrow batch holds at most this many bytes of text (one longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: Spark's bound on the bytes of an Arrow batch; its own default (64 MB, met by 10,000 rows of long texts) is held several times over by the
#: JVM and by each worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words whose hash a Python worker keeps at hand.
CACHED_WORDS = 200_000
#: Spark's setting by which a checkpoint's files go when its frame is no longer in use.
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"
#: Spark's setting by which an execution's shuffle files go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Sees to it that checkpoint() has a folder, the cluster's own, and that its files go with the frames that they hold.

    A temporary folder is made only where the session names none and all runs in one process; on a cluster that raises.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    context._jsc.sc().conf().setIfMissing(CLEAN, "true")
    return spark


def settled(df: DataFrame, action: Callable[[DataFrame], object]):
    """action(df), whose shuffle files go at its end. For actions whose result needs the shuffles no more: a checkpoint, a few counts.

    Otherwise they stay until the driver collects garbage, and iterations pile them up: three files for each task of each shuffle.
    The setting is read when a plan is made, so only the plan of this action, which nobody else holds, has it.
    """
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        return action(df.select("*"))
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)


def cut(df: DataFrame, fresh: bool = False) -> DataFrame:
    """df with its rows in the checkpoint folder, where they outlive the executors; the files go when the frame is collected as garbage.

    The shuffles that made the rows go at once. A checkpoint keeps its plan's partitioning and its estimate of size, which every join multiplies: after some rounds that is a number of
    millions of digits. fresh: forget both, for frames that many others are made from, one after the other.
    """
    spark = with_checkpoints(df.sparkSession)
    held = settled(df, lambda d: d.checkpoint())
    if not fresh:
        return held
    rows = held._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, held._jdf.schema(), False), spark)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df with its whole-number keys computed anew, so that a join by them deals it out once more.

    A table grouped by a key is dealt out by it already, and a join would read it in the stage that groups; adaptive execution
    splits a hot key only where both sides of a join come straight from an exchange. The grouped side has one row for each key.
    """
    return df.withColumns({k: F.bitwise_not(F.bitwise_not(k)) for k in keys})


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes of the text column, so that memory follows one slice, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold as many bytes as a slice, about, unless it has a bound of its own. Results don't depend on it."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    in_small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


class WordHashes(dict):
    """64-bit hashes of words, computed on first sight; forgets all when it has grown to its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one after the other, and where each text's words begin (with the end).

    bytes.split() parts at exactly 0x20 and 0x09-0x0D, as [^\\x20\\x09-\\x0D]+ asks.
    """
    lookup = known.__getitem__
    parts, ends = [], [0]
    for text in texts:
        words = text.split()
        parts.append(np.fromiter(map(lookup, words), np.uint64, len(words)))
        ends.append(ends[-1] + len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.asarray(ends, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs, order-sensitive."""
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(32))))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of `length` neighbours, by doubling: about 2 log2(length) passes."""
    done, power, size = None, hashes, 1
    covered = 0
    while length:
        if length & 1:
            if done is None:
                done, covered = power, size
            else:
                n = min(len(done), len(power) - covered)
                done, covered = (joined_hash(done[:n], power[covered : covered + n]) if n > 0 else done[:0]), covered + size
        length >>= 1
        if length:
            power = joined_hash(power[:-size], power[size:]) if len(power) > size else power[:0]
            size *= 2
    return done


def within(ends: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask of the run starts (total - length + 1 of them) whose run lies inside one text."""
    if total < length:
        return np.zeros(0, dtype=bool)
    mask = np.ones(total - length + 1, dtype=bool)
    for end in ends[1:-1].tolist():
        mask[max(0, end - length + 1) : end] = False
    return mask


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
