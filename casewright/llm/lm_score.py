"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus, computed relationally.

1. Documents are dealt to chunks of some MB. A chunk asks how often other chunks have its n-grams, each distinct one
   once, so that a word that every document has gives one row a chunk. Words and pairs are asked first, then one order
   a round: an n-gram can stand in another chunk only where both its (n - 1)-grams do, so others are not asked.
2. The questions travel as arrays by ranges of hashes and explode there into rows (hash, chunk, n). The sums by hash
   are the count table, which the rows meet in the same partitioning.
3. The counts of other chunks go back to the chunk in the order of its questions, without hashes. Its places are
   scored and summed per document.

A document's own n-grams don't count for it: counts are those of all other documents, so the score tells how well
the rest of the corpus predicts the text.

S(w | u) = c(u w) / c(u) if c(u w) > 0, else 0.4 S(w | shorter u); a word with no count has 0.4 ^ (order - 1) / N.

Edge cases: a null or wordless text has n_words 0 and no score (null); texts shorter than the order use the
context there is; rows with the same or no id are documents of their own; repeated rows and copies count for each
other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.chunks import Words, cuts, in_chunks
from casewright.llm.common import groups, ngram_hashes, tidy

ORDER, BACKOFF = 3, 0.4
#: Smaller than the usual chunk: a task holds several arrays as long as the chunk has words.
CHUNK_BYTES = 8 << 20


def _grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where an n-gram of a row starts, and its hashes. Orders have different seeds, so they never meet."""
    hashes = ngram_hashes(words.hashes, n, seed=50 + n)
    at = np.flatnonzero(words.left[: len(hashes)] >= n)
    return at, hashes[at]


def _rounds(order: int) -> list[range]:
    """The orders that are asked together."""
    return [range(1, min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))]


def _possible(at: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Of the places of n-grams, those where other chunks have both (n - 1)-grams."""
    return met[at] & met[at + 1]


def _with_empty(words: Words, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With the empty n-gram, the context of single words, first: it has the hash 0 and stands before each word."""
    return np.append(np.uint64(0), hashes), np.append(len(words.hashes), counts)


class _Round:
    """The n-grams of a chunk of a round's orders: distinct ones, their counts, and which of them other chunks may have.

    `met` tells of each place whether other chunks have the (n - 1)-gram that starts there.
    """

    def __init__(self, words: Words, orders: range, met: np.ndarray):
        found = [_grams(words, n) for n in orders]
        self.size = len(words.hashes)
        self.distinct, where, self.counts = np.unique(np.concatenate([h for _, h in found]), return_inverse=True, return_counts=True)
        if orders.start == 1:
            where, (self.distinct, self.counts) = where + 1, _with_empty(words, self.distinct, self.counts)
        self.at = [at for at, _ in found]
        self.where = np.split(where, np.cumsum([len(at) for at in self.at])[:-1])
        asked = np.full(len(self.distinct), orders.start == 1)
        if orders.start > 1:
            asked[where[_possible(self.at[0], met)]] = True
        self.asked = np.flatnonzero(asked)

    def learn(self, others: np.ndarray) -> np.ndarray:
        """Adds the counts of other chunks; returns `met` for the next round."""
        self.counts[self.asked] += others
        shared = np.zeros(len(self.distinct), bool)
        shared[self.asked] = others > 0
        met = np.zeros(self.size, bool)
        met[self.at[-1]] = shared[self.where[-1]]
        return met


def _planes(values: np.ndarray) -> bytes:
    """64-bit integers, the lowest bytes of all first: most are small, and the zeros lie together."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _others(told: pa.Table, k: int) -> np.ndarray:
    """The answers to the questions of round k, one after another."""
    rows = told.filter(pc.equal(told.column("round"), k)).sort_by("bucket").select(["n", "some", "others"]).to_pylist()
    some = [np.unpackbits(np.frombuffer(r["some"], np.uint8), count=r["n"]) for r in rows]
    found = [np.frombuffer(r["others"], np.uint8).reshape(8, -1).T.copy().view("<i8").ravel() for r in rows]
    out = np.zeros(sum(map(len, some)), np.int64)
    if len(out):
        out[np.concatenate(some) > 0] = np.concatenate(found)
    return out


def _learnt(words: Words, told: pa.Table, rounds: list[range]) -> tuple[list[_Round], np.ndarray]:
    """The rounds with the counts of all chunks, and `met` for the next one."""
    met, out = np.zeros(0, bool), []
    for k, orders in enumerate(rounds):
        out.append(_Round(words, orders, met))
        met = out[-1].learn(_others(told, k))
    return out, met


def _ask(rows: pa.Table, told: pa.Table | None, rounds: list[range], buckets: int) -> pa.Table:
    """The questions of a chunk's last round, a row for each range of hashes.

    A hash has three parts: of ascending hashes, the first parts are nearly the same, so that they take little space.
    """
    words = Words(rows, lower=True)
    found = [_grams(words, n) for n in rounds[-1]]
    if told is not None:
        met = _learnt(words, told, rounds[:-1])[1]
        found = [(at, hashes[_possible(at, met)]) for at, hashes in found]
    hashes, counts = np.unique(np.concatenate([h for _, h in found]), return_counts=True)
    if told is None:
        hashes, counts = _with_empty(words, hashes, counts)
    # with the sign bit turned, signed order is that of the hashes
    parts = (hashes ^ np.uint64(1 << 63)).astype("<u8").view("<i2").reshape(-1, 4)
    columns = {"top": parts[:, 3], "mid": parts[:, 2], "low": hashes.astype(np.uint32).view(np.int32), "few": (counts & 127).astype(np.int8), "more": (counts >> 7).astype(np.int32)}
    ends = pa.array(cuts(hashes, buckets), pa.int32())
    lists = {name: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for name, x in columns.items()}
    chunk = pa.array(np.full(buckets, rows.column("chunk")[0].as_py()))
    return pa.table({"bucket": pa.array(np.arange(buckets)), "chunk": chunk, **lists}).filter(pc.greater(pc.list_value_length(lists["low"]), 0))


def _tell(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What a bucket, its rows by hash, answers to each chunk in round k."""
    for (bucket,), rows in groups(batches, ["bucket"]):
        chunk, others = rows.column("chunk").to_numpy(), rows.column("others").to_numpy()
        by = np.argsort(chunk, kind="stable")
        of, firsts = np.unique(chunk[by], return_index=True)
        answers = np.split(others[by], firsts[1:])
        some = pa.array([np.packbits(x > 0).tobytes() for x in answers], pa.binary())
        packed = pa.array([_planes(x[x > 0]) for x in answers], pa.binary())
        sizes = pa.array([len(x) for x in answers], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.full(len(of), k, np.int32)), pa.array(np.full(len(of), bucket)), sizes, some, packed], ["chunk", "round", "bucket", "n", "some", "others"])


def _answers(asked: DataFrame, k: int, partitions: int) -> DataFrame:
    """(chunk, round, bucket, n, some, others) for the questions that all chunks ask in round k: how often other chunks have each n-gram.

    Of n answers, the bits `some` tell which aren't 0.
    """
    rows = asked.repartition(partitions, "bucket").select("bucket", "chunk", "top", "mid", "few", "more", F.posexplode("low").alias("at", "low"))
    part = lambda value, bits, at: F.shiftleft(value.cast("long").bitwiseAND((1 << bits) - 1), at)
    top, mid, few, more = (F.get(name, "at") for name in ("top", "mid", "few", "more"))
    hashed = part(top, 16, 48).bitwiseOR(part(mid, 16, 32)).bitwiseOR(part(F.col("low"), 32, 0))
    rows = rows.select("bucket", "chunk", hashed.alias("hash"), (few + F.shiftleft(more.cast("long"), 7)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("hash", "bucket"))
    told = rows.select("bucket", "chunk", "hash", (total - F.col("n")).alias("others"))
    return told.sortWithinPartitions("hash", "bucket").select("bucket", "chunk", "others").mapInArrow(tidy(partial(_tell, k=k)), "chunk long, round int, bucket long, n long, some binary, others binary")


def _own(words: Words, at: np.ndarray, where: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often the n-gram at each place stands in the same row; `total` says how often all rows have it."""
    own = np.ones(len(at), np.int64)
    several = np.flatnonzero(total[where] > 1)
    key = words.row[at[several]].astype(np.uint64) << np.uint64(32) | where[several].astype(np.uint64)
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    own[several] = counts[back]
    return own


def _score(rows: pa.Table, told: pa.Table, order: int) -> pa.Table:
    """Sums of log S over the rows of a chunk; `told` has the answers to its questions."""
    if not rows.num_rows:
        return pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())]).empty_table()
    words = Words(rows, lower=True)
    n_words = words.counts
    learnt, _ = _learnt(words, told, _rounds(order))
    others = learnt[0].counts[0] - n_words[words.row]  # words of all other rows
    score = np.log(BACKOFF ** (order - 1) / np.maximum(others, 1.0))
    context = others.astype(np.float64)
    found = [(at, where, x.counts) for x in learnt for at, where in zip(x.at, x.where)]
    for n, (at, where, total) in enumerate(found, 1):
        count = total[where] - _own(words, at, where, total)
        last = at + n - 1  # a place's score belongs to the n-gram's last word
        used = count > 0
        before = context[at] if n > 1 else context[last]
        score[last[used]] = np.log(count[used] / np.maximum(before[used], 1.0)) + np.log(BACKOFF) * (order - n)
        context = np.zeros(len(words.hashes))
        context[at] = count
    # words too early in their row for longer contexts have no further backoff to pay
    short = np.minimum(words.within + 1, order)
    score -= np.log(BACKOFF) * (order - short)
    sums = np.bincount(words.row, score, minlength=len(n_words))
    return pa.table([rows.column("id"), pa.array(n_words, pa.int64()), pa.array(np.where(n_words > 0, sums, np.nan), pa.float64(), from_pandas=True)], names=["id", "n_words", "log_score"])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, n_words, log_score (sum of log S over the words) and mean_log_score of each row."""
    chunked, n = in_chunks(docs, id_col, text_col, CHUNK_BYTES)
    by_chunk = chunked.repartition(n, "chunk").groupBy("chunk")

    def asked(told: DataFrame | None, rounds: list[range]) -> DataFrame:
        schema = "bucket long, chunk long, top array<short>, mid array<short>, low array<int>, few array<tinyint>, more array<int>"
        if told is None:
            return by_chunk.applyInArrow(lambda rows: _ask(rows, None, rounds, 2 * n), schema)
        return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(lambda key, rows, told: _ask(rows, told, rounds, 2 * n), schema)

    def score(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        return _score(rows, told, order)

    rounds, told = _rounds(order), None
    for k in range(len(rounds)):
        answers = _answers(asked(told, rounds[: k + 1]), k, n).repartition(n, "chunk")
        told = told.unionByName(answers) if told is not None else answers
    scored = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(score, "id long, n_words long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
