"""Inverted-file index over embeddings: written once, read back for every search, re-ranked exactly.

Unit vectors lie in the list of their nearest centroid. A search visits the lists whose centroids are nearest to the
query, as matrix products inside tasks, and ranks what it finds by exact cosine. How many lists are visited is measured
when the index is built, so that the wanted share of true neighbours is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.operators.vectors import vector_topk
from casewright.sources.store import scratch_folder, stored

#: Rows that the centroids are fitted on and rows that the number of visited lists is measured with, at most.
SAMPLE, MEASURED = 20_000, 64
#: Rows of a slice: a larger list is split, so that no task has to hold a whole one. Smaller ones are searched together up to it.
SLICE_ROWS = 50_000
#: Lists at most; their centroids are sent to every task.
MOST_LISTS = 4096
#: Queries that meet a slice in one task, at most.
QUERY_BLOCK = 4096


def _unit(vector: str) -> Column:
    """The vector at length 1; null if it is null, has no length or holds a null."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: (x / length).cast("float")))


def _matrix(column) -> np.ndarray:
    return np.array(list(column), np.float32) if len(column) else np.zeros((0, 0), np.float32)


def _nearest(rows: DataFrame, centroids: np.ndarray, n: int, vector: str) -> DataFrame:
    """rows with `lists`: the numbers of the n nearest centroids, nearest first."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lists array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = _matrix(batch[vector]) @ centroids.T if len(batch) else np.zeros((0, len(centroids)))
            best = near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
            yield batch.assign(lists=list(best.astype(np.int32)))

    return rows.mapInPandas(run, kind)


def fit_centroids(units: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of `lists` lists, fitted on `SAMPLE` unit vectors at most, which a hash of the id chooses."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if lists < 2:
        return _matrix([r["unit"] for r in units.limit(1).collect()])
    sample = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector(F.transform("unit", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=lists, maxIter=20, seed=seed).fit(stored(sample.withColumn("k", F.lit(0))).select("features"))
    return np.array(model.clusterCenters(), np.float32)


def build_index(emb: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 5) -> None:
    """Write an index of every row with a direction into `folder`: rows by list and slice, centroids, and lists to visit.

    The number of lists follows the number of rows. Rows with a null id or vector, or one without length, have no place
    in it. `MEASURED` rows at most look for their k nearest among all rows exactly; the lists to visit are the fewest
    that hold the share `recall` of these.
    """
    spark = emb.sparkSession
    units = stored(emb.select(F.col(key).cast("long").alias("id"), _unit(vector).alias("unit")).where("id is not null and unit is not null"))
    n = units.count()
    count = max(1, min(lists or round(n**0.5 / 2), MOST_LISTS, n))
    centroids = fit_centroids(units, count)
    placed = _nearest(units, centroids, 1, "unit").withColumn("list", F.col("lists")[0]).drop("lists") if n else units.withColumn("list", F.lit(0))
    placed = stored(placed)
    sizes = placed.groupBy("list").count().withColumn("slices", F.ceil(F.col("count") / SLICE_ROWS).cast("int"))
    sliced = placed.join(F.broadcast(sizes.select("list", "slices")), "list")  # a row for each list
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
    sliced.repartition("list", "slice").write.partitionBy("list").parquet(f"{folder}/rows")

    visits = len(centroids)
    if n > 1:
        asked = stored(units.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(MEASURED))
        true = vector_topk(asked, units, k, "id", "unit").select("query", "id")
        order = _nearest(asked, centroids, len(centroids), "unit").select(F.col("id").alias("query"), F.posexplode("lists").alias("place", "list"))
        places = true.join(placed.select("id", "list"), "id").join(order, ["query", "list"]).groupBy("place").count().orderBy("place").collect()
        total, seen = sum(r["count"] for r in places), 0
        for r in places:
            seen += r["count"]
            if seen >= recall * total:
                visits = r["place"] + 1
                break
    rows = [(i, [float(x) for x in c], visits) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<float>, visits int").join(sizes.select("list", "slices", "count"), "list", "left").coalesce(1).write.parquet(f"{folder}/lists")


def _best(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows for each query among the lists that it visits here, list by list in steps of some queries."""
    kind = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("near", pa.float32())])
    if not rows.num_rows or not queries.num_rows:
        return kind.empty_table()
    width = len(rows.column("unit")[0])
    flat = lambda c: c.combine_chunks().flatten().to_numpy().reshape(-1, width)
    by = np.argsort(rows.column("list").to_numpy(), kind="stable")
    lists, ids, vectors = rows.column("list").to_numpy()[by], rows.column("id").to_numpy()[by], flat(rows.column("unit"))[by]
    asked, wanted, visited = queries.column("query").to_numpy(), flat(queries.column("unit")), queries.column("lists").combine_chunks()
    owner, goal = np.repeat(np.arange(len(asked)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()
    found = []
    for one in np.unique(lists):
        start, end = np.searchsorted(lists, [one, one + 1])
        of = owner[goal == one]
        for s in range(0, len(of), 512):
            who = of[s : s + 512]
            near = wanted[who] @ vectors[start:end].T
            near[asked[who, None] == ids[start:end]] = -np.inf
            at, what = np.nonzero(_among_best(near, k))
            found.append((who[at], start + what, near[at, what]))
    if not found:
        return kind.empty_table()
    who, what, near = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-near, who))
    who, what, near = who[order], what[order], near[order]
    first = np.searchsorted(who, who)
    last = np.minimum(first + k, np.searchsorted(who, who, "right")) - 1
    kept = near >= near[last] - 1e-5
    return pa.table([asked[who[kept]], ids[what[kept]], near[kept]], schema=kind)


def _among_best(near: np.ndarray, k: int) -> np.ndarray:
    """Which of each row are among the k greatest; equal ones beyond the k-th stay, as ids decide between them later."""
    at = max(0, near.shape[1] - k)
    return (near >= np.partition(near, at, axis=1)[:, at][:, None] - 1e-5) & np.isfinite(near)


def _bins(lists: list) -> list[tuple[int, int, int]]:
    """(list, slice, bin): slices of lists, one after another, in bins of about `SLICE_ROWS` rows."""
    out, now, held = [], 0, 0
    for r in lists:
        for s in range(r["slices"] or 0):
            rows = -(-r["count"] // r["slices"])
            if held and held + rows > SLICE_ROWS:
                now, held = now + 1, 0
            out.append((r["list"], s, now))
            held += rows
    return out


def _dealt(queries: DataFrame, centroids: np.ndarray, visits: int, bins: list[tuple[int, int, int]]) -> DataFrame:
    """(query, unit, bin, lists): each query once for each bin that has some of the lists it visits."""
    place = np.array([(r[0], r[2]) for r in bins], np.int64).reshape(-1, 2)
    of_bin = {int(b): np.unique(place[place[:, 1] == b, 0]) for b in np.unique(place[:, 1])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            near = _matrix(batch["unit"]) @ centroids.T
            visited = np.zeros(near.shape, bool)
            np.put_along_axis(visited, np.argsort(-near, axis=1, kind="stable")[:, :visits], True, axis=1)
            for number, lists in of_bin.items():
                some = visited[:, lists].any(axis=1)
                told = [lists[v].astype(np.int32) for v in visited[some][:, lists]]
                yield batch[some].assign(bin=np.int32(number), lists=told)

    return queries.mapInPandas(run, "query long, unit array<float>, bin int, lists array<int>")


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", visits: int | None = None) -> DataFrame:
    """(query, id, similarity, rank) of the k nearest rows of the visited lists, without the query itself.

    Lists lie in bins of about `SLICE_ROWS` rows. A query goes once to each bin that has lists of its, `QUERY_BLOCK` to a
    task at most; a bin is read once for each block that asks for it. Queries without a direction find nothing. `visits`
    overrides the measured number.
    """
    lists = spark.read.parquet(f"{folder}/lists").orderBy("list").collect()  # MOST_LISTS rows at most
    asked = queries.select(F.col(key).cast("long").alias("query"), _unit(vector).alias("unit")).where("query is not null and unit is not null")
    out = "query long, id long, near float"
    bins = _bins(lists)
    if not bins:
        return spark.createDataFrame([], f"query long, `{key}` long, similarity double, rank int")
    centroids = _matrix([r["centroid"] for r in lists])
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    sent = stored(_dealt(asked, centroids, min(visits or lists[0]["visits"], len(lists)), bins).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")))
    places = spark.createDataFrame(bins, "list int, slice int, bin int").join(sent.select("bin", "block").distinct(), "bin").select(F.col("list").alias("in_list"), F.col("slice").alias("in_slice"), F.col("bin").alias("of_bin"), F.col("block").alias("for_block"))
    rows = spark.read.parquet(f"{folder}/rows").join(F.broadcast(places) if places.limit(100_001).count() <= 100_000 else places, (F.col("list") == F.col("in_list")) & (F.col("slice") == F.col("in_slice")))
    rows = rows.select("list", F.col("of_bin").alias("bin"), F.col("for_block").alias("block"), "id", "unit")
    by = ["bin", "block"]
    found = rows.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(lambda a, b: _best(a, b, k), out)
    rounded = found.select("query", F.col("id").alias(key), F.round(F.col("near").cast("double"), 4).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return rounded.withColumn("rank", place).where(F.col("rank") <= k)


def recall_of(found: DataFrame, true: DataFrame, key: str = "vec_id") -> float:
    """The share of the true (query, key) pairs that were found; 1 where there are none."""
    pairs = true.select("query", key).distinct()
    total = pairs.count()
    return pairs.join(found.select("query", key).distinct(), ["query", key], "left_semi").count() / total if total else 1.0


def scratch_index(emb: DataFrame, **options) -> str:
    """The folder of an index that goes when the application ends."""
    folder = scratch_folder(emb.sparkSession)
    build_index(emb, folder, **options)
    return folder
