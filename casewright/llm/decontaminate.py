"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. A pass over the documents finds which n-grams of benchmark items each holds; how many documents and how many items
   hold an n-gram is counted relationally.
2. An n-gram's pairs are its documents times its items. One with more pairs than there are documents is common. In each
   stretch of `STRETCH` n-grams of an item, those are its seeds that some document holds, that aren't common and have at
   most `FACTOR` times the stretch's fewest pairs. Common n-grams are seeds of a stretch without another only for
   items of which they cover as many words as the threshold asks for (items that are alike, say), so an n-gram that all
   documents and items share makes no pair by itself.
3. A document with a seed of an item is a candidate for it. It goes on if it has, near the item's n-grams, as many of
   the item's words as the threshold needs. Around these places, document and item are aligned word by word (local
   alignment with gaps). The best score, over the score of the item with itself, says how much of the item the document
   has, also where words were changed, added or left out.

A copy is lost if it has no n-gram of the item left (say, with every third word changed), or none but those that are
much more frequent than others of their stretch or common.

Words are runs of ASCII letters, digits and all other non-ASCII characters, in lower case; so punctuation and
case don't matter. Items go to the tasks in blocks of about `BLOCK_GRAMS` words, one block at a time: the driver holds
one block, and documents are read twice for each, the second time only as far as they are candidates.

Edge cases: null or empty texts and items have no words and match nothing; items with fewer words than an n-gram
match if a document has all of them in a row; a null id is an id like others, of documents and of items; rows with one
id are searched one by one and reported once per id and item, with their best score (of equal ones, the place that comes
last), and so are items that share an id; empty tables give an empty result; other columns of the input are ignored, or
kept by `drop_contaminated`, which drops each row that holds an item itself.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import common
from casewright.functions.columns import unused
from casewright.llm.common import bounded_batches, bounded_join, join_hot, materialise, ngram_hashes, pieces, tidy, utf8, word_hashes

GRAM = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_GRAMS = 1_000_000
#: N-grams of an item that choose their seeds together, and how much more frequent than the rarest of them a seed may be.
STRETCH, FACTOR = 8, 8

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column and, for each row, where its words begin."""
    data, offsets = utf8(column)
    clean = np.where(_WORD[data], data, np.uint8(0x20))
    starts, ends, ranges = common.split_words(clean, offsets)
    return word_hashes(clean, starts, ends, lower=True), ranges


def _grams(words: np.ndarray) -> np.ndarray:
    return ngram_hashes(words, GRAM, seed=61) if len(words) >= GRAM else ngram_hashes(words, len(words), seed=70 + len(words)) if len(words) else words


def _items(rows, item_col: str) -> dict[int, np.ndarray]:
    words, ranges = _words(pa.array([r["text"] for r in rows], pa.string()))
    return {r[item_col]: words[a:b] for r, a, b in zip(rows, ranges[:-1], ranges[1:]) if b > a}


def _own_grams(batches):
    """(item, place, n, words, gram) for each n-gram of each item: its first word, its length and that of the item."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, ranges = _words(piece.column("text"))
            found = [_grams(words[a:b]) for a, b in zip(ranges[:-1], ranges[1:])]
            counts, sizes = np.array([len(g) for g in found], np.int64), np.diff(ranges)
            item = np.repeat(piece.column("item").to_numpy(), counts)
            place = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = (item, place, np.repeat(np.minimum(sizes, GRAM), counts), np.repeat(sizes, counts), np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "place", "n", "words", "gram"])


def _hits(batches, told):
    grams, sizes = told.value
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, ranges = _words(piece.column("text"))
            row = np.repeat(np.arange(piece.num_rows), np.diff(ranges))
            keys = []
            for n in sizes:
                h = ngram_hashes(words, n, seed=61 if n == GRAM else 70 + n)
                inside = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
                at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
                hit = np.flatnonzero(inside & (grams[at] == h))
                keys.append(np.stack([row[hit], at[hit]]))
            keys = np.unique(np.concatenate(keys, axis=1), axis=1) if keys else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(keys[0])), piece.column("digest").take(pa.array(keys[0])), pa.array(grams[keys[1]].view(np.int64))], ["id", "digest", "gram"])


def align(doc: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score over the item's score with itself, and the document's words it ends at and spans.

    Rows go over the item's words; gaps in the document's direction come from a running maximum.
    """
    n = len(doc)
    step = -GAP * np.arange(n + 1)
    h = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best, where = 0, (0, 0)
    for w in item:
        diagonal = np.zeros(n + 1, np.int64)
        diagonal[1:] = h[:-1] + np.where(doc == w, MATCH, MISMATCH)
        up = h + GAP
        new = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(new == 0, np.arange(n + 1), np.where(new == diagonal, np.concatenate([[0], start[:-1]]), start))
        shifted = new + step
        top = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == top, np.arange(n + 1), 0))
        along = top - step
        better = along > new
        origin = np.where(better, origin[source], origin)
        h, start = np.where(better, along, new), origin
        k = int(h.argmax())
        if h[k] > best:
            best, where = int(h[k]), (int(start[k]), k)
    return best / (MATCH * len(item)), *where


def _shared(doc: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> int:
    """How many of an item's words (distinct ones and their counts) the stretch has: no alignment matches more."""
    at = np.minimum(np.searchsorted(kinds, doc), len(kinds) - 1)
    return int(np.minimum(np.bincount(at[kinds[at] == doc], minlength=len(kinds)), counts).sum())


def _align(batches, told, threshold: float):
    items = told.value
    seeds = {}
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            words, _ = _words(batch.column("text").slice(i, 1))
            doc = (batch.column("id")[i].as_py(), batch.column("digest")[i].as_py())
            hashes = {}
            for item in batch.column("items")[i].as_py():
                wanted = items[item]
                if item not in seeds:
                    seeds[item] = np.unique(_grams(wanted))
                kinds, counts = np.unique(wanted, return_counts=True)
                needed = threshold * len(wanted)
                if _shared(words, kinds, counts) < needed:
                    continue
                n = min(GRAM, len(wanted))
                if n not in hashes:
                    hashes[n] = ngram_hashes(words, n, seed=61 if n == GRAM else 70 + n)
                places = np.flatnonzero(np.isin(hashes[n], seeds[item]))
                # an alignment over the threshold spans at most the item and the words left in that its score can pay for
                reach = len(wanted) + int(MATCH * max(0.0, 1 - threshold) * len(wanted) / -GAP) + n
                best = (0.0, 0, 0)
                for group in np.split(places, np.flatnonzero(np.diff(places) > reach) + 1) if len(places) else ():  # places within reach of one another are aligned together
                    lo, hi = max(0, int(group[0]) - reach), min(int(group[-1]) + reach, len(words))
                    for s in range(lo, hi, 4096):  # long stretches in overlapping parts
                        first = max(lo, s - 2 * reach)
                        part = words[first : min(hi, s + 4096)]
                        if _shared(part, kinds, counts) < needed:
                            continue
                        score, x, y = align(part, wanted)
                        if score > best[0]:
                            best = (score, first + x, first + y)
                out.append((*doc, item, *best))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        names = ["id", "digest", "item", "score", "first_word", "end_word"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


FOUND = "id long, digest long, item long, score double, first_word long, end_word long"


def _seeds(own: DataFrame, hits: DataFrame, documents: int, threshold: float) -> DataFrame:
    """(gram, item, documents) of the seeds that the items of a block have, after `hits` (gram, ...) of the documents."""
    held = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("documents"))
    shared = own.select("gram", "item").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("items"))
    pairs = F.col("documents") * F.col("items")
    told = held.join(shared, "gram").select("gram", "documents", pairs.alias("pairs"), (pairs > documents).alias("common"))
    places = materialise(own.join(told, "gram"))
    covered = places.where("common").select("item", "words", F.explode(F.sequence("place", F.col("place") + F.col("n") - 1)).alias("word")).distinct()
    alike = covered.groupBy("item").agg((F.count(F.lit(1)) >= threshold * F.first("words")).alias("alike")).where("alike")
    stretch = F.floor(F.col("place") / STRETCH).alias("stretch")
    usable = places.join(alike, "item", "left").where(~F.col("common") | F.col("alike")).select("item", stretch, "gram", "documents", "pairs", "common")
    fewest = usable.groupBy("item", "stretch").agg(F.min(F.struct("common", "pairs")).alias("least"))
    near = (F.col("common") == F.col("least.common")) & (F.col("pairs") <= FACTOR * F.col("least.pairs"))
    return usable.join(fewest, ["item", "stretch"]).where(near).select("gram", "item", "documents").distinct()


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, threshold: float) -> DataFrame:
    """id, digest of the text, item_id, score, first_word and end_word, for each row and item that it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    item_id = F.col(item_col).cast("long")
    key = F.xxhash64(item_id.isNull(), item_id, F.col("text"))
    items = materialise(benchmark.where(F.col("text").isNotNull()).select(key.alias("item"), item_id.alias("item_id"), "text").dropDuplicates(["item"]))
    own = materialise(items.select("item", "text").mapInArrow(tidy(_own_grams), "item long, place long, n long, words long, gram long"))
    words = items.agg(F.sum(F.expr("octet_length(text) div 2 + 1"))).first()[0] or 0
    blocks, documents = max(1, -(-words // BLOCK_GRAMS)), narrow.count()
    parts = []
    for k in range(blocks):
        in_block = F.pmod(F.col("item"), F.lit(blocks)) == k
        texts = _items(items.where(in_block).select("item", "text").collect(), "item")
        if texts:
            parts.append(_one_block(narrow, texts, own, in_block, documents, threshold))
    if not parts:
        return spark.createDataFrame([], FOUND.replace("item", "item_id"))
    return bounded_join(reduce(DataFrame.unionByName, parts), items.select("item", "item_id"), "item", "inner").drop("item")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, score, first_word, end_word.

    Words are counted in the document's own words as defined above; end_word is exclusive.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, threshold)
    return found.groupBy("id", "item_id").agg(F.max(F.struct("score", "first_word", "end_word")).alias("x")).select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "x.*")


def _one_block(narrow: DataFrame, items: dict[int, np.ndarray], own: DataFrame, in_block, documents: int, threshold: float) -> DataFrame:
    """The rows of FOUND for a block of items, written; the block's words leave the executors after that."""
    spark = narrow.sparkSession
    grams = np.unique(np.concatenate([_grams(w) for w in items.values()]))
    told = spark.sparkContext.broadcast((grams, sorted({min(GRAM, len(w)) for w in items.values()})))
    hits = materialise(narrow.mapInArrow(tidy(partial(_hits, told=told)), "id long, digest long, gram long"))
    told.unpersist()
    # an n-gram of the block counts with the items of all blocks that have it
    seeds = materialise(_seeds(own, hits, documents, threshold).where(in_block))
    found = join_hot(hits, seeds, ["gram"], "documents").select("id", "digest", "item").distinct()
    candidates = found.groupBy("id", "digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    candidates = materialise(candidates.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "items"))
    texts = bounded_join(narrow, candidates, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "inner", limit=200_000)
    told = spark.sparkContext.broadcast(items)
    aligned = texts.select("id", "digest", "text", "items").mapInArrow(tidy(partial(_align, told=told, threshold=threshold)), FOUND)
    aligned = materialise(aligned.where(F.col("score") >= threshold))
    told.unpersist()
    return aligned


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns are kept."""
    found_id, found_digest = unused(docs, "found_id", "found_digest")
    found = _found(docs, benchmark, id_col, text_col, item_col, threshold).select(F.col("id").alias(found_id), F.col("digest").alias(found_digest)).distinct()
    key = [docs[id_col].eqNullSafe(F.col(found_id)), F.xxhash64(docs[text_col]) == F.col(found_digest)]
    return bounded_join(docs, materialise(found), key, "left_anti")
