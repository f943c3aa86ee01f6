"""Pages of an ordered table by their first keys, so that every page is found by a range and none by counting through the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.numbering import number_rows

#: Rows of a file of the ordered table, about.
FILE_ROWS = 200_000


def write_paged(df: DataFrame, folder: str, order: list[str], size: int) -> None:
    """Write df in ascending `order` (which tells all rows apart, without nulls) and the first key of each page of `size` rows.

    Rows are dealt to files by ranges of the order, so a range of keys lies in few files, whose statistics show it.
    """
    size = min(100, max(10, size))
    n = max(1, -(-df.count() // FILE_ROWS))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/rows")
    bounds = number_rows(df.sparkSession.read.parquet(f"{folder}/rows").select(*order), order).where(F.col("position") % size == 0)
    bounds.withColumn("page", F.expr(f"position div {size} + 1")).drop("position").sort("page").coalesce(1).write.parquet(f"{folder}/pages")


def _at_least(order: list[str], key) -> Column:
    """(order) >= key, column by column, beginning with a range of the first one that reaches the scan."""
    exact = F.lit(True)
    for name in reversed(order):
        exact = (F.col(name) > F.lit(key[name])) | ((F.col(name) == F.lit(key[name])) & exact)
    return (F.col(order[0]) >= F.lit(key[order[0]])) & exact


def read_page(spark: SparkSession, folder: str, order: list[str], page: int) -> DataFrame:
    """The rows of a page in order; none beyond the last page. Pages begin with 1, and lower numbers mean that one."""
    page = max(1, page)
    ends = {r["page"]: r for r in spark.read.parquet(f"{folder}/pages").where(F.col("page").isin(page, page + 1)).collect()}
    rows = spark.read.parquet(f"{folder}/rows")
    if page not in ends:
        return rows.where(F.lit(False))
    asked = [_at_least(order, ends[page])]
    if page + 1 in ends:
        asked += [F.col(order[0]) <= F.lit(ends[page + 1][order[0]]), ~_at_least(order, ends[page + 1])]
    return rows.where(reduce(lambda a, b: a & b, asked)).orderBy(*order)


def page_count(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/pages").count()
