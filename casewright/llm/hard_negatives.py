"""Hard negatives by an inverted multi-index over two half spaces.

Vectors are whole numbers; each is cut into two halves, and each half space has a codebook of centroids with radii (the
farthest member of each centroid). A row lies in the cell of its two nearest centroids. For an anchor, a half's score
in a centroid is at most its product with the centroid plus its length times the radius; so the sum of two half bounds
bounds every score of a cell.

Cells of a part of the index are visited in the order of their bounds: a heap over the two sorted lists of half bounds
gives the cells one by one (the multi-sequence algorithm). A window (low, high) of scores asks for the k best rows in it;
it is certified, and left, when its k-th best score is above the bound of the next cell, or that bound is below `low`.
A batch of anchors that lie in the same cells shares one sequence, whose half bounds are the greatest of its anchors'.

How Spark does it: every row is in the index, which is written in parts of whole cells (a large cell is split) with at
most `PART_ROWS` rows. Anchors first search the parts of their own cell, which gives each window a score to beat; then
they are sent only to the other parts that have a cell whose bound reaches it. A task has one part and `BLOCK` anchors
at most, and returns at most k rows for each of an anchor's windows; these are ranked by anchor and window. The result
is exact: cells are left out only by their bounds. Vectors without structure, as in high-dimensional noise, make bounds
that exclude little; then every anchor meets every part, as matrix products in blocks.

The codebooks are fitted on `SAMPLE` rows at most, chosen by a hash; their quality changes the cost, not the result.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors count as
followed by zeros; a null id is no anchor and ranks after all ids; repeated rows are rows of their own, and an anchor
that is one leaves out only itself; ties go by id; fewer rows than asked for are all returned; an empty table gives an
empty result; other columns are ignored. Components must be below 2**26 in size so that products stay exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, bounded_join, materialise, scratch, tidy

#: Rows that the codebooks are fitted on, at most, and rounds of that fit.
SAMPLE, ROUNDS = 4096, 12
#: Centroids of a half space: grows with the rows up to this.
CENTROIDS = 64
#: Parts of the index at least, rows of a part at most, anchors of a task at most.
PARTS, PART_ROWS, BLOCK = 48, 65_536, 8_192
#: Anchors that share a sequence of cells, and rows that a step scores at least.
BATCH, STEP = 64, 1024
#: Stands for a null id.
NO_ID = (1 << 63) - 1


@dataclass
class Codebooks:
    """Centroids of the two half spaces, and the radius of each centroid's members."""

    centroids: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def half(self) -> int:
        return self.centroids[0].shape[1]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def nearest(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the nearest centroid of each vector and the distance to it, rounded up."""
        out = []
        for part, centroids in zip(self.halves(vectors), self.centroids):
            near = np.argmin((centroids**2).sum(1) - 2 * part @ centroids.T, axis=1)
            out.append((near, np.sqrt(((part - centroids[near]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6))
        return out

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each half, the most that a member of each centroid can score with each vector."""
        out = []
        for part, centroids, radii in zip(self.halves(vectors), self.centroids, self.radii):
            out.append(part @ centroids.T + np.sqrt((part**2).sum(1))[:, None] * radii + 1e-3)
        return out[0], out[1]


def fit(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> Codebooks:
    """k-means in each half of the sampled vectors; the first k distinct-looking rows begin."""
    width = sample.shape[1]
    books = []
    for part in (sample[:, : -(-width // 2)], sample[:, -(-width // 2) :]):
        centroids = np.unique(part, axis=0)
        centroids = centroids[np.linspace(0, len(centroids) - 1, min(k, len(centroids))).astype(int)].astype(float)
        for _ in range(rounds):
            near = np.argmin((centroids**2).sum(1) - 2 * part @ centroids.T, axis=1)
            sizes = np.bincount(near, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, part)
            centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        books.append(centroids)
    return Codebooks((books[0], books[1]))


def cells_in_order(first: np.ndarray, second: np.ndarray, present: set[tuple[int, int]]) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of the present cells, by first[i] + second[j] descending: the multi-sequence algorithm."""
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen, left = [(-(first[rows[0]] + second[columns[0]]), 0, 0)], {(0, 0)}, len(present)
    while heap and left:
        bound, a, b = heapq.heappop(heap)
        cell = (int(rows[a]), int(columns[b]))
        if cell in present:
            left -= 1
            yield -bound, *cell
        for nxt in ((a + 1, b), (a, b + 1)):
            if nxt not in seen and nxt[0] < len(rows) and nxt[1] < len(columns):
                seen.add(nxt)
                heapq.heappush(heap, (-(first[rows[nxt[0]]] + second[columns[nxt[1]]]), *nxt))


def _unpacked(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(np.float64)


@dataclass
class Part:
    """Rows of one part of the index in the order of their cells."""

    vectors: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    spans: dict[tuple[int, int], tuple[int, int]]

    @classmethod
    def read(cls, table: pa.Table, width: int) -> Part:
        table = table.sort_by([("c1", "ascending"), ("c2", "ascending")])
        cells = np.stack([table.column("c1").to_numpy(), table.column("c2").to_numpy()])
        firsts = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        spans = {(int(cells[0, s]), int(cells[1, s])): (s, e) for s, e in zip(firsts, firsts[1:])}
        plain = [table.column(c).to_numpy() for c in ("id", "row", "label")]
        return cls(_unpacked(table.column("vector"), width), *plain, spans)


def best_in_windows(part: Part, books: Codebooks, vectors: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, beat: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, window, score, position in the part) of the k best rows of each window, certified by the cells' bounds.

    Anchors lie in the order of their cells. `low`, `high` and `beat` have a row for each anchor and a column for each
    window: a window takes scores from low to high, and rows below `beat` can't be among its best. Rows of the anchor's
    label count with `same`, rows of other labels else; the row `own` is the anchor itself.
    """
    found = []
    for s in range(0, len(vectors), BATCH):
        batch = slice(s, s + BATCH)
        a, b = books.bounds(vectors[batch])
        low_, high_ = np.maximum(low[batch], beat[batch]), high[batch]
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
        pending, size = [], 0
        order = cells_in_order(a.max(0), b.max(0), set(part.spans))
        cell = next(order, None)
        while cell:
            pending.append(part.spans[cell[1:]])
            size += pending[-1][1] - pending[-1][0]
            cell = next(order, None)
            if size < STEP and cell:
                continue
            at = np.concatenate([np.arange(x, y) for x, y in pending])
            pending, size = [], 0
            scores = vectors[batch] @ part.vectors[at].T
            allowed = (part.labels[at] == labels[batch][:, None]) == same
            allowed &= part.rows[at] != own[batch][:, None]
            new = []
            for w in range(low.shape[1]):
                who, what = np.nonzero(allowed & (scores >= low_[:, w, None]) & (scores <= high_[:, w, None]))
                new.append((who, np.full(len(who), w), scores[who, what], at[what]))
            kept = _top([kept, *new], part.ids, k)
            counts = np.zeros(low_.shape, np.int64)
            np.add.at(counts, (kept[0], kept[1]), 1)
            last = np.full(low_.shape, np.inf)
            np.minimum.at(last, (kept[0], kept[1]), kept[2])
            low_ = np.where(counts >= k, np.maximum(low_, last), low_)
            if cell and (low_ > np.minimum(cell[0], high_)).all():
                break  # no later cell reaches any window: its best are certified
        found.append((kept[0] + s, *kept[1:]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _top(groups: list[tuple[np.ndarray, ...]], ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each (anchor, window): higher scores, then smaller ids."""
    who, window, score, at = (np.concatenate([g[i] for g in groups]) for i in range(4))
    by = np.lexsort((ids[at], -score, window, who))
    who, window, score, at = who[by], window[by], score[by], at[by]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (window[1:] != window[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))
    keep = np.arange(len(who)) - start < k
    return who[keep], window[keep], score[keep], at[keep]


@dataclass
class Layout:
    """Which parts of the index hold which cells: the first part of each cell and how many it is split into."""

    cells: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, cells: list[tuple[int, int, int]], most: int) -> Layout:
        """cells (c1, c2, rows) in order: neighbours share a part of at most `most` rows, larger cells have several of their own."""
        first, parts, part, filled = [], [], 0, 0
        for _, _, n in cells:
            if filled and filled + n > most:
                part, filled = part + 1, 0
            first.append(part)
            parts.append(max(1, -(-n // most)))
            if parts[-1] > 1:
                part, filled = part + parts[-1], 0
            else:
                filled += n
        return cls(np.array([c[:2] for c in cells]), np.array(first), np.array(parts))


def _placed(batches, books: Codebooks, width: int):
    """Rows with their vectors packed, the centroid of each half and the distances to them."""
    for batch in batches:
        values, offsets = batch.column("vector").flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *batch.column("size").to_pylist()])
        vectors = np.zeros((batch.num_rows, width), np.int32)
        lengths = np.diff(offsets)
        within = np.arange(len(values)) - np.repeat(offsets[:-1], lengths)
        vectors[np.repeat(np.arange(batch.num_rows), lengths), within] = values
        (c1, r1), (c2, r2) = books.nearest(vectors.astype(np.float64))
        out = [pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(r1), pa.array(r2)]
        names = ["id", "row", "label", "anchor"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out], [*names, "vector", "c1", "c2", "r1", "r2"])


def _routed(batches, books: Codebooks, layout: Layout, width: int):
    """Anchors once for each part, outside their own cell, where a row could be among the best of a window."""
    cell = np.repeat(np.arange(len(layout.cells)), layout.parts)
    part = np.repeat(layout.first, layout.parts) + np.concatenate([np.arange(m) for m in layout.parts])
    by = np.argsort(part, kind="stable")
    cell, part = cell[by], part[by]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for whole in batches:
        for s in range(0, whole.num_rows, 256):
            batch = whole.slice(s, 256)
            a, b = books.bounds(_unpacked(batch.column("vector"), width))
            bound = a[:, layout.cells[:, 0]] + b[:, layout.cells[:, 1]]
            windows = [np.array(batch.column(c).to_pylist(), np.float64) for c in ("low", "high", "beat")]
            needed = np.where(windows[0] <= windows[1], np.maximum(windows[0], windows[2]), np.inf).min(1)
            reach = np.logical_or.reduceat((bound >= needed[:, None])[:, cell], starts, axis=1)
            own_first, own_parts = batch.column("first").to_numpy(), batch.column("parts").to_numpy()
            numbers = part[starts]
            reach &= (numbers < own_first[:, None]) | (numbers >= (own_first + own_parts)[:, None])
            who, where = np.nonzero(reach)
            sent = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[where], pa.int32()), *sent.columns], ["part", *sent.schema.names])


def _searched(part: pa.Table, anchors: pa.Table, books: Codebooks, width: int, same: bool, k: int) -> pa.Table:
    kinds = pa.schema([("row", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
    if not part.num_rows or not anchors.num_rows:
        return kinds.empty_table()
    anchors = anchors.sort_by([("c1", "ascending"), ("c2", "ascending"), ("row", "ascending")])
    held = Part.read(part, width)
    rows = anchors.column("row").to_numpy()
    low, high, beat = (np.array(anchors.column(c).to_pylist(), np.float64) for c in ("low", "high", "beat"))
    who, window, score, at = best_in_windows(held, books, _unpacked(anchors.column("vector"), width), anchors.column("label").to_numpy(), rows, low, high, beat, same, k)
    return pa.table([rows[who], window.astype(np.int32), np.rint(score).astype(np.int64), held.ids[at]], schema=kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _search(index: DataFrame, anchors: DataFrame, books: Codebooks, layout: Layout, width: int, windows: int, same: bool, k: int, keep) -> DataFrame:
    """(row, window, score, id, rank) of the k best rows in each window of the anchors; what is sent to parts is written first."""

    def within(sent: DataFrame) -> DataFrame:
        pairs = sent.select(F.col("part").alias("in_part"), F.col("block").alias("in_block")).distinct()
        met = bounded_join(index.drop("block"), pairs, F.col("part") == F.col("in_part"), "inner")
        parts = met.select("part", F.col("in_block").alias("block"), "c1", "c2", "vector", "id", "row", "label")
        both = parts.groupBy("part", "block").cogroup(sent.groupBy("part", "block"))
        return _ranked(both.applyInArrow(partial(_searched, books=books, width=width, same=same, k=k), "row long, window int, score long, id long"), k)

    none = F.array(*[F.lit(float("-inf"))] * windows)
    at_home = anchors.withColumn("beat", none).withColumn("part", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    near = keep(within(keep(at_home.drop("first", "parts"))))
    last = [F.coalesce(F.max(F.when((F.col("window") == w) & (F.col("rank") == k), F.col("score"))).cast("double"), F.lit(float("-inf"))) for w in range(windows)]
    beaten = anchors.join(near.groupBy("row").agg(F.array(*last).alias("beat")), "row", "left").withColumn("beat", F.coalesce("beat", none))
    kind = "part int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in beaten.schema)
    sent = keep(beaten.mapInArrow(tidy(partial(_routed, books=books, layout=layout, width=width)), kind)).drop("first", "parts")
    return keep(_ranked(near.drop("rank").unionByName(within(sent).drop("rank")), k))


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95
) -> DataFrame:
    """For each anchor and each of its best `positives` of its label, the best `negatives` of other labels in a window.

    Components become floor(scale * x), scores are their products; a negative's score is from `least` to `most` hundredths
    of the positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    number = F.col(vector_col).cast("array<double>")
    fit_for_use = F.col(label_col).isNotNull() & F.coalesce(F.forall(number, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True))), F.lit(False))
    with scratch(spark) as keep:
        whole = F.transform(number, lambda x: F.floor(x * scale).cast("double"))
        rows = vectors.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), F.when(fit_for_use, whole).alias("vector"),
            (anchors & F.col(id_col).isNotNull()).alias("anchor"),
        ).where("vector is not null")
        rows = keep(rows.withColumn("size", F.size("vector")).withColumn("row", F.monotonically_increasing_id()))
        n, width, highest = rows.agg(F.count(F.lit(1)), F.max("size"), F.max(F.array_max(F.transform("vector", F.abs)))).first()
        if not n:
            return spark.createDataFrame([], OUT)
        width, highest = max(width, 2), highest or 0
        if highest**2 * width >= 2**53 or highest >= 2**31:
            raise ValueError("components are too large for exact scores")
        rows = rows.withColumn("vector", F.col("vector").cast("array<int>"))
        sample = np.zeros((min(n, SAMPLE), width))
        for k, r in enumerate(rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").collect()):
            sample[k, : len(r["vector"])] = r["vector"]
        books = fit(sample, max(1, min(CENTROIDS, round((n / 64) ** 0.5))))

        placed = keep(rows.mapInArrow(tidy(partial(_placed, books=books, width=width)), "id long, row long, label long, anchor boolean, vector binary, c1 int, c2 int, r1 double, r2 double"))
        cells = placed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("anchor"), F.lit(False)).cast("long")).alias("anchors"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
        cells = sorted(map(tuple, cells.collect()))  # CENTROIDS squared at most
        radii = [np.zeros(len(c)) for c in books.centroids]
        for c1, c2, _, _, r1, r2 in cells:
            radii[0][c1], radii[1][c2] = max(radii[0][c1], r1), max(radii[1][c2], r2)
        books.radii = (radii[0], radii[1])
        layout = Layout.of([c[:3] for c in cells], min(PART_ROWS, -(-n // PARTS)))
        before = np.cumsum([0, *(c[3] for c in cells)]).tolist()
        table = [(c[0], c[1], int(f), int(m), b, max(1, c[3])) for c, f, m, b in zip(cells, layout.first, layout.parts, before)]
        of_cell = F.broadcast(spark.createDataFrame(table, "c1 int, c2 int, first int, parts int, before long, anchors long"))
        index = placed.join(of_cell, ["c1", "c2"]).withColumn("part", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
        index = keep(index.withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("anchors"))) / BLOCK).cast("int")).drop("before", "anchors", "r1", "r2"))

        asked = index.where("anchor").select("row", "label", "vector", "c1", "c2", "block", "first", "parts")
        everything = asked.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
        best = _search(index, everything, books, layout, width, 1, True, positives, keep)
        edge = lambda w, part, none: F.coalesce(F.max(F.when(F.col("rank") == w + 1, F.col("score") * part / 100)), F.lit(none))
        windows = best.groupBy("row").agg(
            F.array(*[edge(w, least, float("inf")) for w in range(positives)]).alias("low"), F.array(*[edge(w, most, float("-inf")) for w in range(positives)]).alias("high")
        )
        found = _search(index, asked.join(windows, "row"), books, layout, width, positives, False, negatives, keep)
        pairs = best.select("row", (F.col("rank") - 1).cast("int").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = index.where("anchor").select("row", F.col("id").alias("anchor_id"))
        met = found.select("row", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["row", "window"]).join(named, "row")
        plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        return materialise(met.select("anchor_id", plain("positive_id"), F.col("rank").cast("int").alias("rank"), plain("negative_id"), "positive_score", "negative_score"))
