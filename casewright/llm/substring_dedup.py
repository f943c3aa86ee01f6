"""Substring dedup with difference-cover anchors.

A word of a document is removed if it is covered by a window of `WINDOW` words that also starts in a document
with a smaller id. {0, 1, 3} is a difference cover modulo 7: for any two places there is a shift below 7 that takes
both to cover places. So any two equal windows of 13 words hold equal anchors of 13 - 6 = 7 words that both start
at cover places, and hashing 3 of 7 places is enough to find every shared window.

1. Each chunk of documents sends its distinct anchors to buckets; an anchor of two or more chunks, or documents,
   is shared.
2. Anchors extend: only whole windows that hold a shared anchor are hashed (96 bits) and sent, with the smallest
   id of the chunk; a bucket answers with the windows that start in a smaller document elsewhere.
3. Each chunk marks the words and writes what is kept. Windows are judged on the input.

Edge cases: a null text has no words; texts of fewer words than a window keep everything; repeats within one
document and rows with the same id don't remove each other; rows with a null id have the largest id of all (that of
2^63 - 1), so that they don't remove each other either; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.chunks import Words, among, by_bucket, in_chunks, lengths, to_chunks, unpack
from casewright.llm.common import mix, ngram_hashes

PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors."""
    size = window - PERIOD + 1
    grams = ngram_hashes(words.hashes, size, seed=31)
    at = np.flatnonzero(np.isin(words.within[: len(grams)] % PERIOD, COVER) & (words.left[: len(grams)] >= size))
    return at, grams[at]


def _several(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The hashes, ascending, that more than one owner has."""
    by = np.argsort(hashes, kind="stable")
    h, o = hashes[by], owner[by]
    firsts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(firsts):
        return h
    several = np.minimum.reduceat(o, firsts) != np.maximum.reduceat(o, firsts)
    return h[firsts[several]]


def _send_anchors(rows: pa.Table, window: int, buckets: int) -> pa.Table:
    words = Words(rows)
    _, hashes = _anchors(words, window)
    return by_bucket(rows.column("chunk")[0].as_py(), np.unique(hashes), buckets)


def _shared(rows: pa.Table) -> pa.Table:
    hashes, chunk = unpack(rows.column("hashes"), np.uint64), np.repeat(rows.column("chunk").to_numpy(), lengths(rows.column("hashes")))
    told = among(hashes, _several(hashes, chunk))
    return to_chunks(chunk[told], hashes=hashes[told])


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows, their hashes and 32 further bits."""
    grams = ngram_hashes(words.hashes, window, seed=32)
    at = np.flatnonzero(words.left[: len(grams)] >= window)
    return at, grams[at], (mix(ngram_hashes(words.hashes, window, seed=33))[at] >> np.uint64(32)).astype(np.uint32)


def _first_owner(hashes, checks, owner):
    """Distinct (hash, check), ascending, with the smallest owner of each."""
    by = np.lexsort((checks, hashes))
    h, c, o = hashes[by], checks[by], owner[by]
    firsts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[firsts], c[firsts], np.minimum.reduceat(o, firsts) if len(firsts) else o


def _send_windows(key, rows: pa.Table, told: pa.Table, window: int, buckets: int) -> pa.Table:
    if not rows.num_rows:
        return by_bucket(0, np.zeros(0, np.uint64), buckets, checks=np.zeros(0, np.uint32), owners=np.zeros(0, np.int64))
    words = Words(rows)
    places, anchors = _anchors(words, window)
    shared = np.union1d(unpack(told.column("hashes"), np.uint64), _several(anchors, words.ids[words.row[places]]))
    hit = np.zeros(len(words.hashes) + PERIOD, np.int64)
    hit[places[among(anchors, shared)]] = 1
    seen = np.concatenate([[0], np.cumsum(hit)])
    at, hashes, checks = _windows(words, window)
    holds = seen[at + PERIOD] > seen[at]
    h, c, o = _first_owner(hashes[holds], checks[holds], words.ids[words.row[at[holds]]])
    return by_bucket(key[0].as_py(), h, buckets, checks=c, owners=o)


def _beaten(rows: pa.Table) -> pa.Table:
    """The windows of each chunk that start in a document of another chunk with a smaller id."""
    hashes, checks, owners = (unpack(rows.column(n), t) for n, t in (("hashes", np.uint64), ("checks", np.uint32), ("owners", np.int64)))
    chunk = np.repeat(rows.column("chunk").to_numpy(), lengths(rows.column("hashes")))
    by = np.lexsort((owners, checks, hashes))
    h, c, o = hashes[by], checks[by], owners[by]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
    least = o[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else o
    lost = o > least
    return to_chunks(chunk[by][lost], hashes=h[lost], checks=c[lost])


def _kept(key, rows: pa.Table, told: pa.Table, window: int, whole: bool) -> pa.Table:
    if not rows.num_rows:
        return pa.schema(_SCHEMA + [("kept_text", pa.string())] * whole).empty_table()
    words = Words(rows)
    owner = words.ids
    at, hashes, checks = _windows(words, window)
    own = owner[words.row[at]]
    h, c, least = _first_owner(hashes, checks, own)
    where = np.searchsorted(h, hashes)
    same = np.flatnonzero(c[where] != checks) if len(h) else np.zeros(0, np.int64)
    for i in same:  # two windows with one 64-bit hash: take the one whose other bits fit
        k = int(where[i])
        while c[k] != checks[i]:
            k += 1
        where[i] = k
    removed = own > least[where] if len(h) else np.zeros(0, bool)
    th, tc = unpack(told.column("hashes"), np.uint64), unpack(told.column("checks"), np.uint32)
    lost = among(hashes, np.sort(th))
    if lost.any():
        known = set(zip(th.tolist(), tc.tolist())) if len(np.unique(th)) != len(th) else None
        if known is None:
            by = np.argsort(th)
            lost[lost] = tc[by][np.searchsorted(th[by], hashes[lost])] == checks[lost]
        else:
            lost[lost] = [x in known for x in zip(hashes[lost].tolist(), checks[lost].tolist())]
    removed |= lost
    edge = np.zeros(len(words.hashes) + window + 1, np.int64)
    np.add.at(edge, at[removed], 1)
    np.add.at(edge, at[removed] + window, -1)
    keep = np.cumsum(edge)[: len(words.hashes)] == 0
    shas, texts = [], []
    for text, s, n in zip(rows.column("text").to_pylist(), words.starts.tolist(), words.counts.tolist()):
        parts = (text or "").encode().split()
        left = b" ".join(parts if keep[s : s + n].all() else compress(parts, keep[s : s + n].tolist()))
        shas.append(hashlib.sha256(left).hexdigest())
        if whole:
            texts.append(left.decode())
    n_removed = np.bincount(words.row[~keep], minlength=len(words.counts))
    out = [rows.column("id"), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
    return pa.table(out + [pa.array(texts, pa.string())] * whole, names=[n for n, _ in _SCHEMA] + ["kept_text"] * whole)


_SCHEMA = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, whole: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, with `whole`, kept_text of each row."""
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a window has {2 * PERIOD - 1} words at least")
    chunked, n = in_chunks(docs, id_col, text_col)

    def send_anchors(rows: pa.Table) -> pa.Table:
        return _send_anchors(rows, window, n)

    def send_windows(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        return _send_windows(key, rows, told, window, n)

    def keep(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        return _kept(key, rows, told, window, whole)

    anchors = chunked.groupBy("chunk").applyInArrow(send_anchors, "bucket long, chunk long, hashes binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared, "chunk long, hashes binary")
    windows = chunked.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, "bucket long, chunk long, hashes binary, checks binary, owners binary")
    beaten = windows.groupBy("bucket").applyInArrow(_beaten, "chunk long, hashes binary, checks binary")
    kept = chunked.groupBy("chunk").cogroup(beaten.groupBy("chunk")).applyInArrow(
        keep, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * whole
    )
    return kept.withColumnRenamed("id", id_col)
