"""Vector search, rank fusion, clusters and projections over embeddings (array columns)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


#: Query vectors that are broadcast at most, and rows that a task takes beside a block of queries beyond that.
QUERY_BLOCK, ROW_BLOCK = 2000, 50_000


def _normed(df: DataFrame, vector: str, name: str) -> list[Column]:
    """The vector and its length, which is computed once for each row."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return [v.alias(name), F.nullif(F.sqrt(dot(F.col(vector), F.col(vector))), F.lit(0.0)).alias(f"{name}_norm")]


def similarities(queries: DataFrame, emb: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: list[str] | tuple[str, ...] = (), on: str | None = None) -> DataFrame:
    """(query, id, similarity, carried columns) of a stated query set against every embedding.

    With `on`, only against those with the query's value in that column, which decides before anything is computed. The
    queries are counted; up to `QUERY_BLOCK` are broadcast. More are dealt to blocks, and so are the rows: each block of
    queries meets each block of rows in a partition of its own.
    """
    q = queries.select(F.col(key).alias("query"), *([F.col(on).alias("_on")] if on else []), *_normed(queries, vector, "_q"))
    rows = emb.select(key, *carry, *([F.col(on).alias("_of")] if on else []), *_normed(emb, vector, "_v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    if on:
        met = rows.join(F.broadcast(q) if blocks == 1 else q, F.col("_on") == F.col("_of"))
    elif blocks == 1:
        met = rows.crossJoin(F.broadcast(q))
    else:
        parts = max(1, -(-rows.count() // ROW_BLOCK))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = q.withColumn("_qb", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("_rb", numbers(parts))
        met = rows.withColumn("_rb", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_qb", numbers(blocks)).join(dealt, ["_qb", "_rb"])
    near = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (F.col("_q_norm") * F.col("_v_norm"))
    return met.where(F.col(key) != F.col("query")).select("query", key, rounded(near).alias("similarity"), *carry)


def vector_topk(queries: DataFrame, emb: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by cosine, of equal ones those with the smallest keys."""
    return best_by_score(queries, emb, k, key, vector).select("query", key, F.col("score").alias("similarity"), "rank")


#: Products that a task holds at once, and how far apart two scores that are equal once rounded can be, with some room.
PRODUCTS, APART = 4_000_000, 2.5e-4
#: Queries and rows that meet in one task.
SIDE_BLOCKS = 4096, 20_000


def rounded(value: Column, digits: int = 4) -> Column:
    """value rounded half away from zero as it is stored, as SQL does with a double.

    Spark's own round takes a double's shortest decimal text: 0.55 * 0.0030 is a half there and lies below it as stored.
    """
    return F.round(value * 10.0**digits) / 10.0**digits


def _half_away(value: np.ndarray) -> np.ndarray:
    scaled = np.abs(value * 10000.0)
    whole = np.trunc(scaled)
    return np.copysign(whole + (scaled - whole >= 0.5), value) / 10000.0 + 0.0


def _best_of_blocks(rows: pa.Table, queries: pa.Table, k: int, weight: float | None, carry: list[str]) -> pa.Table:
    """The k best rows of a block in each tier for each query of a block: (query, id, score, tier, carried columns).

    Matrix products choose; what can be among the best is then computed in the order that one pair at a time has.
    """
    asked, ids = queries.column("query"), rows.column("id")
    kind = pa.schema([("query", asked.type), ("id", ids.type), ("score", pa.float64()), ("tier", pa.int32()), *((c, rows.column(c).type) for c in carry)])
    if not len(ids) or not len(asked):
        return kind.empty_table()
    matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)
    v, q, vn, qn = matrix(rows.column("v")), matrix(queries.column("q")), rows.column("v_norm").to_numpy(), queries.column("q_norm").to_numpy()
    key, own, tiers = ids.to_numpy(), asked.to_numpy(), rows.column("tier").to_numpy()
    add, more, place_of = rows.column("add").to_numpy(), rows.column("more").to_numpy(), np.unique(key, return_inverse=True)[1]
    added, places = add + more, {t: np.flatnonzero(tiers == t) for t in np.unique(tiers)}
    # directions have length 1, so 32 bits are exact enough to choose by while what is added is small
    narrow = np.float32 if weight is None or np.abs(added).max() < 100 else np.float64
    to, ways = (q / qn[:, None]).astype(narrow), {t: (v[of] / vn[of, None]).astype(narrow).T for t, of in places.items()}
    out, step = [], max(1, PRODUCTS // len(ids))
    for s in range(0, len(asked), step):
        for tier, of in places.items():
            part = to[s : s + step] @ ways[tier]
            if weight is not None:
                part *= narrow(weight)
                part += added[of].astype(narrow)
            own_at = np.nonzero(own[s : s + step, None] == key[of])
            part[own_at] = -np.inf
            at = max(0, len(of) - k)
            floor = np.partition(part, at, axis=1)[:, at] - narrow(APART)
            who, what = np.nonzero(part >= np.maximum(floor, np.finfo(narrow).min)[:, None])
            who, what, exact = who + s, of[what], np.zeros(len(who))
            for d in range(v.shape[1]):
                exact += q[who, d] * v[what, d]
            score = _half_away(exact / (qn[who] * vn[what]))
            score = score if weight is None else _half_away(weight * score + add[what] + more[what])
            order = np.lexsort((place_of[what], -score, who))
            kept = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < k]
            out.append(pa.table([asked.take(who[kept]), ids.take(what[kept]), pa.array(score[kept]), *(rows.column(c).take(what[kept]) for c in ("tier", *carry))], schema=kind))
    return pa.concat_tables(out)


def best_by_score(queries: DataFrame, emb: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", weight: float | None = None, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(query, key, score, tier, rank, carried columns) of the k best rows of each query in each tier, equal scores by key.

    The score is the cosine, to four decimals; with a `weight` it is weight * cosine + add + more, to four decimals, of
    emb's doubles add and more; its int tier may part the rows. A query's own row doesn't count.

    Queries and rows are dealt to blocks, and each block of queries meets each block of rows in a task of its own as a
    product of matrices; a row is shuffled once for each block of queries. Rows and queries without a direction, with
    nulls, another width or values that aren't finite meet pair by pair.
    """
    from pyspark.sql import Window

    norm = F.nullif(F.sqrt(dot(F.col(vector), F.col(vector))), F.lit(0.0))
    fine = F.coalesce((norm > 1e-150) & (norm < 1e150), F.lit(False))
    given = lambda c, zero: (F.col(c) if c in emb.columns else F.lit(zero)).alias(c)
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("q"), norm.alias("q_norm"), F.when(fine, F.size(vector)).alias("q_size")).where("query is not null")
    rows = emb.select(F.col(key).alias("id"), F.col(vector).alias("v"), norm.alias("v_norm"), F.when(fine, F.size(vector)).alias("v_size"), given("add", 0.0), given("more", 0.0), given("tier", 0), *carry).where("id is not null")
    asked, width = q.agg(F.count(F.lit(1)), F.max("q_size")).first()
    width = width or 0
    odd_row, odd_query = ~F.col("v_size").eqNullSafe(F.lit(width)), ~F.col("q_size").eqNullSafe(F.lit(width))
    held, odd_rows = rows.agg(F.count(F.lit(1)), F.count_if(odd_row)).first()
    odd_queries = q.where(odd_query).count()
    blocks, parts = (max(1, -(-n // most)) for n, most in zip((asked, held), SIDE_BLOCKS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # ints on both sides: equal numbers of different types are hashed to different partitions
    left = rows.where(~odd_row).drop("v_size").withColumns({"rb": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "qb": numbers(blocks)})
    right = q.where(~odd_query).drop("q_size").withColumns({"qb": F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"), "rb": numbers(parts)})
    named = lambda df, c: df.schema[c].dataType.simpleString()
    kind = ", ".join([f"query {named(q, 'query')}, id {named(rows, 'id')}, score double, tier int", *(f"`{c}` {named(rows, c)}" for c in carry)])
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(lambda a, b: _best_of_blocks(a, b, k, weight, list(carry)), kind)
    near = F.aggregate(F.zip_with("q", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x) / (F.col("q_norm") * F.col("v_norm"))
    score = rounded(near) if weight is None else rounded(F.lit(weight) * F.coalesce(rounded(near), F.lit(0.0)) + F.col("add") + F.col("more"))
    for few, met in ((odd_queries, lambda: q.where(odd_query).crossJoin(rows)), (odd_rows, lambda: q.where(~odd_query).crossJoin(rows.where(odd_row)))):
        if few:
            found = found.unionByName(met().where("query <> id").select("query", "id", score.alias("score"), "tier", *carry))
    best = Window.partitionBy("query", "tier").orderBy(F.desc_nulls_last("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumnRenamed("id", key)


def rrf_fuse(a: DataFrame, b: DataFrame | None, key: str, k: int = 60, n: int = 20, limit: int = 10, embedded: DataFrame | None = None, query: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion of a vector and a text list (key, rank) of at most n rows; a missing rank counts as n + 1.

    Rows that aren't in `embedded` are dropped. Without a text list (a blank query) the vector list alone decides. With
    `query` the lists hold several queries, each of which gets its `limit` best rows.
    """
    from pyspark.sql import Window

    if b is None:
        b = a.where(F.lit(False))
    keys = [query, key] if query else [key]
    both = a.select(*keys, F.col("rank").alias("rank_a")).join(b.select(*keys, F.col("rank").alias("rank_b")), keys, "full_outer")
    if embedded is not None:
        both = both.join(embedded.select(key).distinct(), key, "left_semi")
    part = lambda c: 1.0 / (k + F.coalesce(F.col(c), F.lit(n + 1)))
    fused = both.withColumn("fused", rounded((part("rank_a") + part("rank_b")) * 1000))
    if query is None:
        return fused.orderBy(F.desc("fused"), key).limit(limit)
    best = Window.partitionBy(query).orderBy(F.desc("fused"), key)
    return fused.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= limit).drop("_at")


#: The cosine's share in a hybrid score.
COSINE_WEIGHT = 0.55


def hybrid_parts(rank: Column, feedback: Column) -> tuple[Column, Column]:
    """What a hybrid score adds to the cosine's share: 0.35 text rank (1 at most), 0.10 feedback between 0 and 10, over 10."""
    return 0.35 * F.least(F.coalesce(rank, F.lit(0.0)), F.lit(1.0)), 0.10 * F.greatest(F.lit(0), F.least(feedback, F.lit(10))) / 10


def hybrid_score(similarity: Column, rank: Column, feedback: Column) -> Column:
    """0.55 cosine + 0.35 text rank (1 at most) + 0.10 feedback between 0 and 10, over 10."""
    add, more = hybrid_parts(rank, feedback)
    return COSINE_WEIGHT * F.coalesce(similarity, F.lit(0.0)) + add + more


def clusters_for(n: int) -> int:
    if n < 3:
        raise ValueError("three rows at least are needed")
    return 2 if n < 6 else 3 if n < 15 else 5 if n < 30 else 7


def cluster(emb: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance, features) and (cluster, size, medoid, members) by k-means; k follows the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = emb.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=clusters_for(rows.count()), maxIter=150, tol=1e-6, seed=seed).fit(rows)
    centers = emb.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    placed = model.transform(rows).withColumnRenamed("prediction", "cluster").join(F.broadcast(centers), "cluster")
    gap = F.zip_with(vector_to_array("features"), "center", lambda x, y: (x - y) * (x - y))
    placed = placed.withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))).drop("center")
    profile = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min_by(key, F.struct("distance", key)).alias("medoid"))
    return placed.drop("features"), profile


def cluster_mix(placed: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(cluster, kind, value, n): how often each value of the columns stands in each cluster; members are the rows of `placed`."""
    joined = placed.select(key, "cluster").join(facts.select(key, *columns), key)
    rows = joined.select("cluster", F.inline(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))))
    return rows.where(F.col("value").isNotNull()).groupBy("cluster", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def project_2d(emb: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x, y): the two main components, each scaled to 0..1; a constant axis is 0.5."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = emb.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(rows).transform(rows)
    two = PCA(k=2, inputCol="features", outputCol="p").fit(centred).transform(centred).select(key, vector_to_array("p").alias("p")).select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    ends = two.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.5)
    return two.crossJoin(F.broadcast(ends)).select(key, scaled("x").alias("x"), scaled("y").alias("y"))
