"""Dense numbers in order, without a window over all rows of a group."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.columns import unused
from casewright.sources.store import stored

#: Rows of a partition of the sort, about; rows of counts that are broadcast at most.
SORTED_ROWS, FEW = 500_000, 100_000


def _equal(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names))


def number_rows(rows: DataFrame, order: list[str], groups: list[str] | tuple[str, ...] = (), position: str = "position", size: str | None = None, keep=stored) -> DataFrame:
    """rows with their `position` from 0 among equal `groups`, in ascending `order` with nulls first, and the group's `size`.

    The rows are sorted by ranges of (groups, order), so a large group lies in many partitions and a row counts on from
    the rows of its group in earlier ones. Only the counts, one for each group and partition that meet, are summed up:
    without groups there is one for each partition. `keep` must write its table: the numbers are read more than once.
    Null groups are equal to each other; rows that tie in `order` are numbered in any order; no rows give no rows.
    """
    groups = list(groups)
    at, part, first, count, before, total = unused(rows, "at", "part", "first", "count", "before", "total")
    n = max(-(-rows.count() // SORTED_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order)
    # the lower 33 bits of the id count the rows of a partition, the upper ones number the partitions in order
    placed = keep(ordered.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(part, *groups).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(count))
    if groups:
        by = Window.partitionBy(*groups)
        earlier = F.coalesce(F.sum(count).over(by.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = keep(counts.select(part, *groups, first, earlier.alias(before), F.sum(count).over(by).alias(total)))
        few = starts.limit(FEW + 1).count() <= FEW
    else:
        found = sorted(tuple(r) for r in counts.select(part, first, count).collect())
        ends = list(accumulate((n for *_, n in found), initial=0))
        offsets = [(p, f, b, ends[-1]) for (p, f, _), b in zip(found, ends)]
        starts = rows.sparkSession.createDataFrame(offsets, ", ".join(f"`{c}` long" for c in (part, first, before, total)))
        few = True
    met = placed.alias("l").join((F.broadcast(starts) if few else starts).alias("r"), _equal([part, *groups]))
    place = (F.col(at) - F.col(first) + F.col(before)).alias(position)
    return met.select(*(F.col(f"l.`{c}`") for c in rows.columns), place, *([F.col(total).alias(size)] if size else []))
