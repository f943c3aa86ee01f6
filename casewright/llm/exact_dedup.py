"""Exact duplicates with a heavy-hitter split.

A frequent-items sketch (the mergeable Misra-Gries family) finds digests that may be frequent. Their exact
counts and winners are verified by an aggregate, and the few verified winners are broadcast, so the copies of a
hot text leave on the map side and never meet in one task. All other digests go through an ordinary shuffle: their
groups are counted first, and rows meet the counts of their group, so that a group that the sketch just misses is no
single task's either. Only DataFrame and SQL functions are used.

Edge cases: a null text counts as empty; rows with the same id and text are rows of their own, and exactly one
row of a group stays; a null id ranks below every other id; an empty table gives an empty result; other
columns of the input are ignored, or kept by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.columns import unused
from casewright.llm.common import ascii_lower, bounded_join, join_hot, materialise

#: Entries of a sketch: a digest with more than about 3.5 / TRACKED of the rows can't be missed.
TRACKED = 1024
#: Digests that are verified and, at most, broadcast.
HEAVY = 256
#: Digests up to which the groups of the remaining rows are broadcast, and alike rows that are written out at once.
LOOKED_UP, BLOCK = 100_000, 65_536


def heavy_digests(keyed: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """Up to `heavy` digests that may be frequent: what is frequent overall is so in one of the 64 sketches."""
    sketch = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch"))
    items = sketch.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("x"))
    counts = items.groupBy(F.col("x.item").alias("digest")).agg(F.sum("x.count").alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), "digest").limit(heavy).select("digest")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    """For each digest: keep_id, group_size and how many rows have the id that stays (copies). Counted before each shuffle."""
    by_id = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = by_id.groupBy("digest").agg(F.max(F.struct("id", "n")).alias("best"), F.sum("n").alias("group_size"))
    return groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.n").alias("copies"), "group_size")


def _repeated(groups: DataFrame) -> DataFrame:
    """The rows of groups whose kept id stands in several rows: these are alike, so the first stays, whichever it is."""
    many = groups.where("copies > 1").withColumn("block", F.explode(F.expr(f"sequence(0, (copies - 1) div {BLOCK})")))
    many = many.withColumn("place", F.explode(F.expr(f"sequence(block * {BLOCK}, least(copies, (block + 1) * {BLOCK}) - 1)")))
    return many.select("digest", F.col("keep_id").alias("id"), "keep_id", "group_size", (F.col("place") == 0).alias("kept"))


def group_copies(keyed: DataFrame) -> DataFrame:
    """For each row of (id, digest): keep_id, group_size and whether it is the one row that stays.

    The row with the largest id stays; `keyed` must give the same rows whenever it is read.
    """
    winners = materialise(_groups(keyed.join(F.broadcast(heavy_digests(keyed)), "digest", "left_semi")))
    rest = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = materialise(_groups(rest))
    told = keyed.join(F.broadcast(winners), "digest").unionByName(join_hot(rest, groups, ["digest"], "group_size", limit=LOOKED_UP))
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    single = told.where(~stays | (F.col("copies") == 1)).select("digest", "id", "keep_id", "group_size", stays.alias("kept"))
    return single.unionByName(_repeated(winners)).unionByName(_repeated(groups))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    groups = group_copies(materialise(digests(docs, id_col, text_col)))
    return groups.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that an equal text with a larger id replaces; all columns are kept."""
    groups = materialise(group_copies(materialise(digests(docs, id_col, text_col))).where("group_size > 1"))
    copy_id, copy_digest = unused(docs, "copy_id", "copy_digest")
    by_key = groups.groupBy(F.col("id").alias(copy_id), F.col("digest").alias(copy_digest)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    digest = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    key = [digest.eqNullSafe(F.col(copy_digest)), docs[id_col].eqNullSafe(F.col(copy_id))]
    left = bounded_join(docs, by_key.where("not kept").select(copy_id, copy_digest), key, "left_anti")
    again = by_key.where("kept and n > 1").select(copy_id, copy_digest)
    if again.isEmpty():
        return left
    repeated = bounded_join(left, again, key, "left_semi").withColumn(copy_digest, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    return bounded_join(left, again, key, "left_anti").unionByName(repeated.dropDuplicates([id_col, copy_digest]).drop(copy_digest))
