"""Shared helpers of the corpus operators: tables, checkpoints, joins on hot keys, word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at once inside a task.
PIECE_BYTES = 1 << 18
#: Bytes of an Arrow batch, Spark's setting for it and that setting's default.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where the setting is unset in local mode."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(df: DataFrame, name: str, **options) -> DataFrame:
    df.write.options(**{"parquet.block.size": 32 << 20, **options}).parquet(name)
    return df.sparkSession.read.schema(df.schema).parquet(name)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back: its lineage ends there.

    The files go when the application ends.
    """
    name = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    path, system = _path(df.sparkSession, name)
    system.deleteOnExit(path)
    return _write(df, name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that materialises like `materialise`, whose tables all go at the end of the block.

    They hold hashes, mostly, which no codec makes smaller; without one, its buffers don't stay with the executor.
    """
    name = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path, system = _path(spark, name)
    system.deleteOnExit(path)
    try:
        yield lambda df: _write(df, f"{name}/{uuid.uuid4().hex}", compression="none")
    finally:
        system.delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold about `BATCH_BYTES` from now on, unless the session sets a bound of its own.

    The default lets 10,000 rows or 64 MB go at once, whose buffers stay with the executor and its Python workers.
    """
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def release_memory() -> None:
    """Give freed memory back to the system; Spark reuses a Python worker, and what it keeps would add to later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow whose worker gives back, when the task ends, the memory that it doesn't need."""

    def run(batches):
        yield from function(batches)
        release_memory()

    return run


def groups(batches, keys: list[str]):
    """The rows of each group as one table; rows of a group come one after another."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if (now := tuple(key[:, s])) != last:
                if held:
                    yield last, pa.Table.from_batches(held)
                held, last = [], now
            held.append(batch.slice(s, e - s))
    if held:
        yield last, pa.Table.from_batches(held)


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether df has at most `limit` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def bounded_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = 500_000) -> DataFrame:
    """Join that broadcasts `right` after counting at most `limit` narrow rows of it, and shuffles otherwise."""
    return left.join(F.broadcast(right) if small_enough(right, limit) else right, on, how)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, hot: int = 1000, most: int = 100_000, limit: int = 500_000) -> DataFrame:
    """Inner join to `right`, a written table unique by `keys`, whose column `count` says how many left rows a key has.

    A table of at most `limit` narrow rows is broadcast. Of a larger one, keys with `hot` rows or more are broadcast,
    so that no task has to take all rows of such a key, and the others are shuffled; where that could be more than
    `most` keys, the bound is raised to rows / most: a key below it is no larger than a fair share of `most` tasks.
    """
    if small_enough(right, limit):
        return left.join(F.broadcast(right), keys)
    hot = max(hot, (right.agg(F.sum(count)).first()[0] or 0) // most)
    many = F.broadcast(right.where(F.col(count) >= hot))
    few = right.where(F.col(count) < hot)
    return left.join(many, keys).unionByName(left.join(many, keys, "left_anti").join(few, keys))


def ascii_lower(col):
    """Lower-case A-Z only. Spark's lower() does just that where the text is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


# ---------------------------------------------------------------------------------------------- words in numpy

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers = np.array([1], np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 256), _MULTIPLIER, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that follow from the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(_MULTIPLIER)) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `limit` bytes of text each; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each row, the range of its words."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = _power_table(int(lengths.max()) + 1)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    values = data[within + np.repeat(starts, lengths)]
    values = (_LOWER[values] if lower else values).astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * powers[within], first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash of each n consecutive words; the caller leaves out those that cross rows."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    for j, c in enumerate(constants(n, seed)):
        total += words[j : j + count] * c
    return mix(total)
