"""Quality classifier: a byte-level convolutional network in numpy.

Filters over `WIDTH` bytes, one weight for each filter, place and byte value, slide over the whole text. Their
rectified outputs are max-pooled in chunks of two blocks of `BLOCK` bytes that overlap by one block; a chunk's
maxima give its logit, and the mean of the chunks' logits gives the document's probability.

The network is fitted by Adam on at most `limit` labelled documents, those with the smallest hash of the id (a
parameter), and on every chunk of each. They are chosen among the labels alone, so only their texts are read into
the driver. Scoring covers every byte of every document.

Edge cases: a null or empty text is scored as one empty chunk; repeated rows are scored alike; ties of the hash go to
the smaller id; of labelled documents with one id the smallest text counts, once for each label; labels without a
document, null labels and null ids are left out; without any labelled row, or with one class only, the score is the
share of label 1 (0.5 if none); an empty table gives an empty result; other columns of the input are ignored, or kept
by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, pieces, tidy, utf8

WIDTH, FILTERS, BLOCK = 6, 24, 256
#: Labelled documents that the network is fitted on, at most.
LIMIT = 3000
PASSES, STEP = 8, 64
#: Blocks whose filter outputs are in memory at once.
TOGETHER = 64


def _blocks(data: np.ndarray) -> np.ndarray:
    """The text's blocks, each with the bytes that its last filters reach into; 256 stands for what is beyond the end."""
    n = max(1, -(-len(data) // BLOCK))
    padded = np.full(n * BLOCK + WIDTH - 1, 256, np.int64)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, BLOCK + WIDTH - 1)[::BLOCK]


class Network:
    def __init__(self, seed: int = 0, share: float = 0.5):
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.25, (WIDTH, 257, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.base = np.array([np.log(share / (1 - share))], np.float32)

    def _responses(self, blocks: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Filter outputs (block, place, filter), some blocks at a time; places beyond a text's end have none."""
        for s in range(0, len(blocks), TOGETHER):
            at = slice(s, s + TOGETHER)
            out = self.taps[0][blocks[at, :BLOCK]]
            for k in range(1, WIDTH):
                out += self.taps[k][blocks[at, k : k + BLOCK]]
            for i in np.flatnonzero(sizes[at] < BLOCK):
                out[i, sizes[s + i] :] = -np.inf
            yield at, out

    def logit(self, data: np.ndarray) -> float:
        """Over all chunks of the text."""
        blocks = _blocks(data)
        sizes = np.full(len(blocks), BLOCK)
        sizes[-1] = max(1, len(data) - BLOCK * (len(blocks) - 1))
        tops = np.concatenate([out.max(axis=1) for _, out in self._responses(blocks, sizes)])
        pooled = np.maximum(tops[:-1], tops[1:]) if len(tops) > 1 else tops
        return float((np.maximum(pooled + self.bias, 0) @ self.out).mean() + self.base[0])

    def _gradients(self, arrays: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over some texts, all their chunks at once."""
        parts = [_blocks(x) for x in arrays]
        counts = np.array([len(p) for p in parts])
        blocks = np.concatenate(parts)
        ends = np.cumsum(counts)
        sizes = np.full(len(blocks), BLOCK)
        sizes[ends - 1] = [max(1, len(x) - BLOCK * (n - 1)) for x, n in zip(arrays, counts)]
        tops, places = np.empty((len(blocks), FILTERS), np.float32), np.empty((len(blocks), FILTERS), np.int64)
        for at, out in self._responses(blocks, sizes):
            places[at] = out.argmax(axis=1)
            tops[at] = np.take_along_axis(out, places[at][:, None], axis=1)[:, 0]
        # a chunk is a block and the next one of its text; a text of one block is one chunk
        single = np.repeat(counts == 1, counts)
        first = np.flatnonzero(single | ~np.isin(np.arange(len(blocks)), ends - 1))
        second = np.where(single[first], first, first + 1)
        text = np.repeat(np.arange(len(arrays)), counts)[first]
        n_chunks = np.bincount(text, minlength=len(arrays))
        from_second = tops[second] > tops[first]
        z = np.where(from_second, tops[second], tops[first]) + self.bias
        h = np.maximum(z, 0)
        logits = np.bincount(text, h @ self.out, minlength=len(arrays)) / n_chunks + self.base[0]
        d = (1 / (1 + np.exp(-logits)) - labels) / len(arrays)
        each = (d / n_chunks)[text]
        back = (each[:, None] * self.out * (z > 0)).astype(np.float32)
        grad = {"base": np.array([d.sum()], np.float32), "out": (each @ h).astype(np.float32), "bias": back.sum(axis=0), "taps": np.zeros_like(self.taps)}
        block = np.where(from_second, second[:, None], first[:, None])
        place = places[block, np.arange(FILTERS)]
        for k in range(WIDTH):
            np.add.at(grad["taps"][k], (blocks[block, place + k], np.arange(FILTERS)), back)
        return grad

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        arrays = [np.frombuffer(t, np.uint8) for t in texts]
        names = ("taps", "bias", "out", "base")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        t = 0
        for _ in range(PASSES):
            order = rng.permutation(len(arrays))
            for s in range(0, len(order), STEP):
                batch = order[s : s + STEP]
                grad = self._gradients([arrays[i] for i in batch], labels[batch])
                t += 1
                for n in names:
                    g = grad[n] + (1e-5 * getattr(self, n) if n in ("taps", "out") else 0)
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    setattr(self, n, (getattr(self, n) - 0.01 * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.99**t)) + 1e-6)).astype(np.float32))
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = LIMIT) -> Network:
    """A network fitted on the documents of at most `limit` rows of labels, chosen by a hash of the id.

    The rows are chosen without the texts; a share of the hashes that holds about twice the wanted rows is sorted.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    share = min(1.0, 2 * limit / max(1, rows.count()))
    chosen = rows.where(F.col("u") <= share * (1 << 31)).orderBy("u", "id", "label").limit(limit).drop("u")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["id", "label"])
    given = found["label"].to_numpy(np.float64)
    net = Network(share=float(np.clip(given.mean(), 1e-3, 1 - 1e-3)) if len(given) else 0.5)
    if len(set(given)) < 2:
        net.out[:] = 0
        return net
    return net.fit([t.encode() for t in found["text"]], given)


def _score(batches, net: Network):
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = utf8(piece.column("text"))
            logits = np.array([net.logit(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
            keep = [n for n in piece.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in keep), pa.array(1 / (1 + np.exp(-logits)))], [*keep, "score"])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 if the score is 0.5 or more) of each row."""
    bounded_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(net)
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    scored = narrow.mapInArrow(tidy(lambda batches: _score(batches, spread.value)), f"`{id_col}` long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of docs that the network doesn't reject, with all their columns and no shuffle."""
    bounded_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(net)

    def kept(batches):
        for batch in batches:
            for piece in pieces(batch, text_col):
                data, offsets = utf8(piece.column(text_col))
                good = [spread.value.logit(data[a:b]) >= 0 for a, b in zip(offsets[:-1], offsets[1:])]
                yield piece.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidy(kept), docs.schema)
