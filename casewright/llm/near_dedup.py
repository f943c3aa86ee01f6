"""MinHash near-duplicates: universal hash minima, banding, signature check, confirmation on full sets, components.

1. Each row gives the set of its distinct word shingles, `bands * rows` minima of universal hashes over the set, a
   key per band and a short signature (one byte per minimum). The input is read once; a set is not written but made
   again, from a packed copy of its text, where a later step needs it.
2. Rows with the same set form one class; only the first row of a class goes on.
3. Star rounds: every class is compared with the first class that shares a band with it, then, where a band
   still holds several components, with the one nearest medoid of such bands. A round makes one pair a class.
4. What still lies in bands with several components gets a long signature and is compared block by block; only
   pairs whose signatures can belong to linked sets come out, each from the first band that it shares.
5. Pairs whose sizes and signatures can belong to linked sets are confirmed on full sets; confirmed links make
   components.

A band, hub or component that holds a large part of all rows is never gathered in one task: such keys are joined by
a broadcast of a bounded number of keys, and a hub's text is copied to as many tasks as its pairs need. Rows that a
step needs are picked by a broadcast of one bit per row, so that the others' texts and signatures don't move.

Edge cases: null or wordless texts have an empty set, n_shingles 0 and stand alone; a text with fewer words than
a shingle has one shingle, its whole sequence; every row is reported, and rows with the same id are rows of their
own (those of the component's smallest id are kept, whatever their texts); a null id ranks after all other ids, so
that it is kept only where nothing but null ids is linked with it; an empty table gives an empty result; other
columns of the input are ignored, or kept by `drop_near_copies`.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.columns import unused
from casewright.llm.common import PIECE_BYTES, bounded_batches, bounded_join, constants, groups, join_hot, materialise, mix, ngram_hashes, pieces, scratch, small_enough, split_words, tidy, utf8, word_hashes
from casewright.llm.components import connected_components, merge_components

BANDS, ROWS = 32, 4
#: Members of a band that are compared in one block, and pairs of a hub that meet one copy of its set.
BLOCK, HUB = 2048, 512
#: Minima of the long signature, of each of which it has LONG_BITS bits, and the standard deviations below its expected
#: agreement at which it rules a pair out: a linked pair is lost with a probability under 1e-6. The short signature has
#: 8 bits of each minimum and takes SHORT_SIGMAS.
LONG, LONG_BITS, SIGMAS, SHORT_SIGMAS = 2048, 2, 5.0, 6.0
#: Pairs that are broadcast to the rows of one end.
PAIRS = 500_000
#: Star rounds about medoids at most; they go on while a round links this share of the documents it compares. They
#: only save work; the comparison in blocks that follows is complete.
MEDOID_ROUNDS, MEDOID_YIELD = 3, 0.05


def _shingles(words: np.ndarray, first: int, last: int, grams: np.ndarray, size: int) -> np.ndarray:
    n = last - first
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        return ngram_hashes(words[first:last], n, seed=100 + n)
    return np.unique(grams[first : last - size + 1])


def shingle_sets(piece: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The set of shingle hashes, ascending, of each row of a batch with a column text."""
    data, offsets = utf8(piece.column("text"))
    starts, ends, ranges = split_words(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    grams = ngram_hashes(words, size)
    return [_shingles(words, ranges[i], ranges[i + 1], grams, size) for i in range(piece.num_rows)]


def _unpacked(column: pa.Array, size: int):
    """The shingle set of each packed text of a column, one piece of texts at a time."""
    held, total = [], 0
    for packed in column:
        held.append(zlib.decompress(packed.as_py()))
        total += len(held[-1])
        if total >= PIECE_BYTES:
            yield from shingle_sets(pa.record_batch([pa.array(held, pa.large_binary())], ["text"]), size)
            held, total = [], 0
    if held:
        yield from shingle_sets(pa.record_batch([pa.array(held, pa.large_binary())], ["text"]), size)


def _minima(found: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """The least value of each hash a * x + b over the upper halves of a set."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), step):
        np.minimum(low, (a * x[None, k : k + step] + b).min(axis=1), out=low)
    return low


def _hashes(n: int, seeds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (constants(n, seed) >> np.uint64(16) for seed in seeds)
    return (a.astype(np.uint32) | np.uint32(1))[:, None], b.astype(np.uint32)[:, None]


def _byte(low: np.ndarray) -> bytes:
    return (low * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8).tobytes()


def _quarters(low: np.ndarray) -> bytes:
    """`LONG_BITS` bits of each minimum, four minima to a byte."""
    parts = (low * np.uint32(0x85EBCA6B) >> np.uint32(32 - LONG_BITS)).astype(np.uint8).reshape(-1, 4)
    return (parts << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


_SIGNED = [("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("packed", pa.binary())]


def _signatures(batches, size: int, bands: int, rows: int):
    a, b = _hashes(bands * rows, (7, 8))
    c = constants(rows, 9)
    for piece in (p for batch in batches for p in pieces(batch, "text")):
        data, ends = utf8(piece.column("text"))
        out = {name: [] for name, _ in _SIGNED}
        for found, start, end in zip(shingle_sets(piece, size), ends[:-1], ends[1:]):
            out["n_shingles"].append(len(found))
            out["set_a"].append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
            out["set_b"].append(int(mix(found * np.uint64(0xDA942042E4DD58B5)).sum(dtype=np.uint64).view(np.int64)))
            if not len(found):
                out["bands"].append(None)
                out["signature"].append(None)
                out["packed"].append(None)
                continue
            low = _minima(found, a, b, 2048)
            keys = mix((low.reshape(bands, rows).astype(np.uint64) * c).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out["bands"].append(keys.view(np.int64))
            out["signature"].append(_byte(low))
            out["packed"].append(zlib.compress(data[start:end], 1))
        columns = [piece.column("id"), piece.column("digest"), *(pa.array(out[name], kind) for name, kind in _SIGNED)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "digest", *out])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, digest (a hash of the text), n_shingles, set_a and set_b (128 bits that name the set), bands, signature and packed text of each row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(partial(_signatures, size=size, bands=bands, rows=rows)), "id long, digest long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary, packed binary")


def _hubs(pairs: DataFrame) -> DataFrame:
    """(v, parts) of the nodes v with more than `HUB` pairs: to how many tasks their sets have to go."""
    return pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts")).where("parts > 1")


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id, a row number, is in ids (id): these are broadcast as bitmaps, one bit per row number."""
    bits = ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    place = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("bucket", F.bitmap_bucket_number("id")).join(F.broadcast(bits), "bucket")
    return met.where(F.bit_get(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def _with_both(pairs: DataFrame, many: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
    """pairs (u, v) with the named columns of both ends in `of` (id, ...), as name_u and name_v.

    The row of a node v in `many` is copied to several tasks, each with a part of the pairs. Up to `PAIRS` pairs are
    broadcast, so that only the way to v takes u's columns through a shuffle.
    """
    parts = F.coalesce("parts", F.lit(1))
    dealt = bounded_join(pairs, many, "v", "left").withColumn("part", F.pmod(F.xxhash64("u"), parts).cast("int")).drop("parts")
    dealt = F.broadcast(dealt) if small_enough(pairs, PAIRS) else dealt
    end = lambda name: _among(of.select("id", *names), pairs.select(F.col(name).alias("id"))).select(F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in names))
    copied = bounded_join(end("v"), many, "v", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return end("u").join(dealt, "u").join(copied, ["v", "part"])


def _agreeing(batches, least: int, threshold: float):
    """The pairs whose sizes and short signatures can belong to linked sets."""
    for batch in batches:
        m, n = (batch.column(f"n_shingles_{c}").to_numpy() for c in "uv")
        near = np.minimum(m, n) >= (threshold - 1e-9) * np.maximum(m, n)
        x, y = (_matrix(batch.column(f"signature_{c}")) for c in "uv")
        near &= (x == y).sum(axis=1) >= least
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(near))


def _linking(batches, size: int, percent: int):
    """The pairs whose full sets are linked; rows of the same v come one after another, mostly, and share its set."""
    for batch in batches:
        v = batch.column("v").to_numpy()
        fresh = np.concatenate([v[:1] == v[:1], v[1:] != v[:-1]])
        others, linked = _unpacked(batch.column("packed_v").filter(pa.array(fresh)), size), []
        for x, new in zip(_unpacked(batch.column("packed_u"), size), fresh):
            y = next(others) if new else y
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(linked, pa.bool_()))


def confirm(pairs: DataFrame, signed: DataFrame, size: int, threshold: float, minima: int, keep=materialise) -> DataFrame:
    """The pairs (u, v) of ids in signed (id, n_shingles, signature, packed) whose full sets reach the threshold."""
    many = keep(_hubs(pairs))
    told = _with_both(pairs, many, signed, ["n_shingles", "signature"])
    near = keep(told.mapInArrow(tidy(partial(_agreeing, least=_least(threshold, minima, SHORT_SIGMAS), threshold=threshold)), "u long, v long"))
    return _with_both(near, many, signed, ["packed"]).mapInArrow(tidy(partial(_linking, size=size, percent=round(threshold * 100))), "u long, v long")


def _long_signatures(batches, size: int, minima: int):
    a, b = _hashes(minima, (17, 18))
    for batch in batches:
        out = [_quarters(_minima(found, a, b, 256)) for found in _unpacked(batch.column("packed"), size)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_shingles"), batch.column("bands"), pa.array(out, pa.binary())], ["id", "n_shingles", "bands", "long"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1 if len(column) else 1)


def _medoid_pairs(batches):
    """(id, medoid, agreement) for the rows of a block whose label isn't that of the block's medoid.

    The medoid is the row that agrees best with the most common value of each signature byte.
    """
    for _, rows in groups(batches, ["band", "own"]):
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        if len(ids) < 2 or (labels == labels[0]).all():
            continue
        sig = _matrix(rows.column("signature"))
        counts = np.zeros((sig.shape[1], 256), np.int64)
        np.add.at(counts, (np.broadcast_to(np.arange(sig.shape[1]), sig.shape), sig), 1)
        m = int((sig == counts.argmax(axis=1).astype(np.uint8)).sum(axis=1).argmax())
        at = np.flatnonzero(labels != labels[m])
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), ids[m])), pa.array((sig[at] == sig[m]).sum(axis=1))], ["id", "medoid", "agree"])


def _least(threshold: float, minima: int, sigmas: float, bits: int = 8) -> int:
    p = threshold + (1 - threshold) / 2**bits
    return int(np.floor(minima * p - sigmas * np.sqrt(minima * p * (1 - p))))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """members with the number of blocks of their band; only bands of several blocks are looked up."""
    large = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    return bounded_join(members, large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def medoid_pairs(members: DataFrame, threshold: float, minima: int, block: int = BLOCK) -> DataFrame:
    """For each id of members (band, id, label, signature) the nearest medoid with another label, as (u, v)."""
    rows = _blocks(members, block).select("band", "own", "id", "label", "signature")
    found = rows.repartition("band", "own").sortWithinPartitions("band", "own", "id").mapInArrow(tidy(_medoid_pairs), "id long, medoid long, agree long")
    best = found.where(F.col("agree") >= _least(threshold, minima, SHORT_SIGMAS)).groupBy("id").agg(F.max_by("medoid", F.struct("agree", -F.col("medoid"))).alias("m"))
    return best.select(F.greatest("id", "m").alias("u"), F.least("id", "m").alias("v")).distinct()


def _block_pairs(batches, least: int, threshold: float):
    """Pairs of a block with other labels and agreeing long signatures, where the band is the first they share.

    All rows of a block have as many earlier bands, as a band's key tells its place, too.
    """
    for _, rows in groups(batches, ["band", "i", "j"]):
        ids, labels, sizes = (rows.column(c).to_numpy() for c in ("id", "label", "n_shingles"))
        earlier = pc.list_flatten(rows.column("earlier")).to_numpy()
        sig, earlier = _matrix(rows.column("long")).view(np.uint64), earlier.reshape(len(ids), len(earlier) // len(ids))
        us, vs = [], []
        for i in range(len(ids) - 1):
            near = (labels[i + 1 :] != labels[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= (threshold - 1e-9) * np.maximum(sizes[i + 1 :], sizes[i]))
            at = i + 1 + np.flatnonzero(near)
            at = at[~(earlier[at] == earlier[i]).any(axis=1)]
            other = sig[at] ^ sig[i]
            other = np.bitwise_count((other | other >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
            at = at[32 * sig.shape[1] - other >= least]
            us.append(np.maximum(ids[at], ids[i]))
            vs.append(np.minimum(ids[at], ids[i]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or [ids[:0]])), pa.array(np.concatenate(vs or [ids[:0]]))], ["u", "v"])


def crossing_pairs(members: DataFrame, threshold: float, minima: int, block: int = BLOCK) -> DataFrame:
    """Pairs with different labels that share a band (band, id, label, n_shingles, bands, long) and may be linked.

    A band with over `block` members is dealt out to pairs of blocks, so that a task never holds more than two
    blocks of it. A row carries only those of its bands that come before the one it is dealt by.
    """
    rows = _blocks(members, block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", "n_shingles", F.expr("slice(bands, 1, int(array_position(bands, band)) - 1)").alias("earlier"), "long")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id")
    return dealt.mapInArrow(tidy(partial(_block_pairs, least=_least(threshold, minima, SIGMAS, LONG_BITS), threshold=threshold)), "u long, v long").distinct()


def _crossing(members: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """(band, id, label) of the bands that hold more than one component."""
    labelled = keep(bounded_join(members, labels.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("label")))
    several = keep(labelled.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("n")).where("l <> h").select("band", "n"))
    return keep(join_hot(labelled, several, ["band"], "n").select("band", "id", "label"))


def _components(signed: DataFrame, classes: DataFrame, size: int, threshold: float, minima: int, keep) -> DataFrame:
    """(node, component) of the classes, as their first rows, that are linked with others."""
    first = _among(signed, classes.select(F.col("rep").alias("id")))
    exploded = first.select(F.explode("bands").alias("band"), "id")
    shared = keep(exploded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("band", "low", "n"))
    members = keep(join_hot(exploded, shared, ["band"], "n").select("band", "id", "low"))

    tested = keep(members.where("id <> low").groupBy("id").agg(F.min("low").alias("v")).select(F.col("id").alias("u"), "v"))
    links = keep(confirm(tested, signed, size, threshold, minima, keep))
    labels = keep(connected_components(links, keep=keep))
    left = _crossing(members.select("band", "id"), labels, keep)
    for _ in range(MEDOID_ROUNDS):
        pairs = medoid_pairs(left.join(_among(signed.select("id", "signature"), left), "id"), threshold, minima)
        pairs = keep(pairs.join(tested, ["u", "v"], "left_anti"))
        more = keep(confirm(pairs, signed, size, threshold, minima, keep))
        tested, linked = tested.unionByName(pairs), more.count()
        compared = left.select("id").distinct().count()
        if linked:
            labels = keep(merge_components(labels, more, keep))
            left = _crossing(left.select("band", "id"), labels, keep)
        if linked <= MEDOID_YIELD * compared:
            break
    wanted = _among(signed.select("id", "n_shingles", "bands", "packed"), left)
    long = keep(wanted.mapInArrow(tidy(partial(_long_signatures, size=size, minima=LONG)), "id long, n_shingles long, bands array<long>, long binary"))
    pairs = keep(crossing_pairs(left.join(long, "id"), threshold, LONG).join(tested, ["u", "v"], "left_anti"))
    more = keep(confirm(pairs, signed, size, threshold, minima, keep))
    return labels if more.isEmpty() else keep(merge_components(labels, more, keep))


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """id, digest, n_shingles, component_id and kept of each row, as a written table."""
    bounded_batches(docs.sparkSession)
    sets = ["set_a", "set_b", "n_shingles"]
    with scratch(docs.sparkSession) as keep:
        every = keep(signatures(docs, id_col, text_col, size, bands, rows).withColumn("row", F.monotonically_increasing_id()))
        full = every.where("n_shingles > 0")
        signed = full.select(F.col("row").alias("id"), "n_shingles", "bands", "signature", "packed")
        classes = keep(full.groupBy(*sets).agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
        labels = _components(signed, classes, size, threshold, bands * rows, keep)
        sized = labels.join(classes.select(F.col("rep").alias("node"), "least"), "node")
        tops = keep(sized.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
        named = join_hot(labels, tops, ["component"], "n").select(F.col("node").alias("rep"), F.lit(True).alias("linked"), "component_id")
        of_set = keep(classes.join(named, "rep", "left").select(*sets, "copies", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
        told = join_hot(full.select("id", "digest", *sets), of_set, sets, "copies").select("id", "digest", "n_shingles", "component_id")
        alone = every.where("n_shingles = 0").select("id", "digest", "n_shingles", F.col("id").alias("component_id"))
        return materialise(told.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept."""
    return _linked(docs, id_col, text_col, size, threshold, bands, rows).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that are linked to one with a smaller id; all columns are kept."""
    linked = _linked(docs, id_col, text_col, size, threshold, BANDS, ROWS)
    near_id, near_digest = unused(docs, "near_id", "near_digest")
    dropped = linked.where("not kept").select(F.col("id").alias(near_id), F.col("digest").alias(near_digest)).distinct()
    return bounded_join(docs, dropped, [docs[id_col].eqNullSafe(F.col(near_id)), F.xxhash64(docs[text_col]) == F.col(near_digest)], "left_anti")
