"""Chunks of documents and the exchange of packed hashes between chunks and buckets.

Documents are dealt to chunks of a few MB by a hash of their id and text, in one shuffle that later passes reuse;
rows that share an id or have none are spread by their texts. What a
chunk has to learn about the whole corpus (which hashes other chunks have, or how often) goes to buckets by hash
range as packed arrays and comes back the same way. A chunk sends each distinct hash once, so a hash that a third
of all documents hold costs a few bytes a chunk, and no bucket gathers documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import PIECE_BYTES, bounded_batches, split_words, utf8, word_hashes

#: Stands for a null id.
NO_ID = (1 << 63) - 1
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 12 << 20


def in_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, id, text) and the number of chunks, which follows the bytes of all texts."""
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(4, -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(n)).cast("long")
    return docs.select(chunk.alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n


class Words:
    """The word hashes of a chunk's rows, row after row."""

    def __init__(self, rows: pa.Table, lower: bool = False):
        # 64-bit ids stay exact; a null id ranks after all others
        self.ids = pc.fill_null(rows.column("id"), NO_ID).to_numpy()
        hashes, counts = [], []
        for start, stop in _pieces(rows):
            data, offsets = utf8(rows.column("text").slice(start, stop - start))
            starts, ends, ranges = split_words(data, offsets)
            hashes.append(word_hashes(data, starts, ends, lower))
            counts.append(np.diff(ranges))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.within = np.arange(len(self.hashes)) - np.repeat(self.starts, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.within  # words from here to the row's end


def _pieces(rows: pa.Table):
    sizes = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > PIECE_BYTES:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def cuts(hashes: np.ndarray, buckets: int) -> list[int]:
    """Where the ranges of the buckets start and end in the ascending hashes."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]


def by_bucket(chunk: int, hashes: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.Table:
    """Rows (bucket, chunk, hashes, ...) of packed arrays; `hashes` ascend."""
    ends = cuts(hashes, buckets)
    spans = [(k, s, e) for k, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
    out = {"bucket": pa.array([k for k, _, _ in spans], pa.int64()), "chunk": pa.array([chunk] * len(spans), pa.int64())}
    for name, values in {"hashes": hashes, **columns}.items():
        out[name] = pa.array([values[s:e].tobytes() for _, s, e in spans], pa.binary())
    return pa.table(out)


def unpack(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def lengths(column) -> np.ndarray:
    return np.array([len(x) // 8 for x in column.to_pylist()], np.int64)


def to_chunks(owner: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Rows (chunk, ...) of packed arrays: what a bucket tells each chunk."""
    by = np.argsort(owner, kind="stable")
    owner = owner[by]
    firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    lasts = np.append(firsts[1:], len(owner)) if len(owner) else firsts
    out = {"chunk": pa.array(owner[firsts], pa.int64())}
    for name, values in columns.items():
        values = values[by]
        out[name] = pa.array([values[s:e].tobytes() for s, e in zip(firsts, lasts)], pa.binary())
    return pa.table(out)


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of `values` are in the ascending array `found`."""
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values
