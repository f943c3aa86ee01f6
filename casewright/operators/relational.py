"""Joins, aggregates, windows and top-k over case-management tables.

Catalogs are joined by name; Spark broadcasts them while their statistics are under its threshold, and AQE turns
joins whose sides turn out small into broadcasts, so no hint here can grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_active(df: DataFrame) -> DataFrame:
    """Rows whose flag is true; null flags are in neither scan."""
    return df.where(F.col("is_active"))


def scan_trash(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_active"))


def enrich(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left lookups: (dimension, fact key, dimension key)."""
    for dim, key, dim_key in dims:
        fact = fact.join(dim.withColumnRenamed(dim_key, "_key") if key != dim_key else dim, F.col(key) == F.col("_key") if key != dim_key else key, "left")
        fact = fact.drop("_key")
    return fact


def left_join_where(left: DataFrame, right: DataFrame, on, condition: Column) -> DataFrame:
    """Left join with a condition on the right side; unmatched left rows stay."""
    return left.join(right.where(condition), on, "left")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a tie-breaker."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def has_child(df: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(child.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_child_counts(df: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """A count column for each child table, 0 where there is none; children are counted before they are joined."""
    for name, child in children.items():
        df = df.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return df


def collapse_bridge(df: DataFrame, bridge: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The distinct non-null values of each key as a sorted array; null where there is none."""
    values = bridge.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))
    return df.join(values.where(F.size(name) > 0), key, "left")


def poly_join(log: DataFrame, target: DataFrame, tag_col: str, tag: str, id_col: str, key: str) -> DataFrame:
    """Left join of log rows tagged `tag` to target, keys compared as text; other rows keep nulls.

    The tag is part of the key on both sides, so the join stays an equi-join.
    """
    right = target.withColumn("_id", F.col(key).cast("string"))
    return log.join(right, (F.when(F.col(tag_col) == tag, F.col(id_col).cast("string")) == F.col("_id")), "left").drop("_id")


def find_duplicates(new: DataFrame, base: DataFrame, keys: list[str], new_id: str, base_id: str) -> DataFrame:
    """(new id, base id) where any of the keys agrees; one equi-join for each key instead of an OR."""
    found = [new.select(new_id, k).join(base.select(base_id, k), k).select(new_id, base_id) for k in keys]
    return reduce(DataFrame.unionByName, found).distinct()


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row; more rows are an error."""
    checked = one_row.limit(2).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    single = checked.where(F.coalesce(F.assert_true(F.col("_n") == 1, "one row expected"), F.lit(True))).drop("_n")
    return df.crossJoin(F.broadcast(single))


def count_where(df: DataFrame, by: list[str], counts: dict[str, Column]) -> DataFrame:
    aggs = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def mean_duration(df: DataFrame, start: Column, end: Column, unit: str, by: list[str], condition: Column | None = None, name: str = "mean") -> DataFrame:
    """Rows and mean time from start to end of each group, in hours or days; only rows for which `condition` holds count."""
    took = F.unix_millis(end) - F.unix_millis(start)
    if condition is not None:
        took = F.when(condition, took)
    per = df.groupBy(*by).agg(F.count(took).alias("n"), F.sum(took).alias("_sum"))
    mean = F.when(F.col("n") > 0, F.col("_sum").cast("double") / F.col("n").cast("double") / F.lit({"hours": 3600e3, "days": 86400e3}[unit]))
    return per.withColumn(name, mean).drop("_sum")


def page_info(found: DataFrame, size: int, whole: DataFrame, facet: str) -> DataFrame:
    """One row: the number of found rows and of their pages, and the distinct values of a facet of all rows."""
    size = min(100, max(10, size))
    counted = found.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"))
    facets = whole.select(facet).distinct().agg(F.array_join(F.array_sort(F.collect_list(facet)), ",").alias("facets"))
    return counted.crossJoin(facets)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of df; number is 1 at least, size between 10 and 100."""
    size, number = min(100, max(10, size)), max(1, number)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def distribution(df: DataFrame, by: str, value: str, name: str = "distribution") -> DataFrame:
    """For each group a map from value to its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias(name))


def attainment(goals: DataFrame, actions: DataFrame, on: list[str]) -> DataFrame:
    """Percentage of its target that each goal's weights reach: no actions give 0, a target of 0 gives null."""
    done = actions.groupBy(*on).agg(F.sum("weight").alias("done"))
    joined = goals.join(done, on, "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))
    return joined.withColumn("percent", F.when(F.col("target") != 0, F.col("done") * 100 / F.col("target")))


def business_calendar(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar rows (day) with is_business and the running ordinal of business days.

    The window runs over the calendar only, a few hundred rows a year.
    """
    marked = days.join(holidays.select(F.col("day"), F.lit(True).alias("off")), "day", "left")
    flag = (~F.dayofweek("day").isin(1, 7) & F.col("off").isNull()).cast("int")
    return marked.select("day", (flag == 1).alias("is_business"), F.sum(flag).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("ordinal"))


def business_due_date(df: DataFrame, start: str, n: Column, calendar: DataFrame, name: str = "due") -> DataFrame:
    """The n-th business day after `start`; start itself for n of 0 or less."""
    here = calendar.select(F.col("day").alias(start), F.col("ordinal").alias("_from"))
    there = calendar.where("is_business").select(F.col("ordinal").alias("_to"), F.col("day").alias("_due"))
    moved = df.join(here, start, "left").withColumn("_n", n).withColumn("_to", F.col("_from") + F.col("_n"))
    return moved.join(there, "_to", "left").withColumn(name, F.when(F.col("_n") <= 0, F.col(start)).otherwise(F.col("_due"))).drop("_from", "_to", "_n", "_due")
