"""Change application: tables in, changed tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.numbering import number_rows


def _patched(base: DataFrame, patch: DataFrame, key: str, columns: list[str], rule) -> DataFrame:
    renamed = patch.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(renamed, key, "left")
    return joined.select(*(rule(c).alias(c) if c in columns else F.col(c) for c in base.columns))


def patch_merge(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null values of the patch win; base rows without a patch stay as they are."""
    return _patched(base, patch, key, columns, lambda c: F.coalesce(f"_{c}", c))


def fill_merge(base: DataFrame, patch: DataFrame, key: str, columns: list[str], undecided: str = "Depende") -> DataFrame:
    """Existing non-empty values stay, except `undecided`, which the patch may replace."""
    return _patched(base, patch, key, columns, lambda c: F.coalesce(F.when((F.col(c) != "") & (F.col(c) != undecided), F.col(c)), F.col(f"_{c}"), F.col(c)))


def insert_missing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and the new rows whose key it lacks; null keys count as equal to each other."""
    fresh = new.alias("n").join(base.select(*keys).distinct().alias("b"), [F.col(f"n.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_anti")
    return base.unionByName(fresh)


def upsert(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows replace the chosen columns of base rows with their key, or are added."""
    b, n = base.withColumn("_old", F.lit(True)), new.select(key, *(F.col(c).alias(f"_{c}") for c in new.columns if c != key)).withColumn("_new", F.lit(True))
    joined = b.join(n, key, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(c in columns)), F.col(f"_{c}")).otherwise(F.col(c)) if c in new.columns else F.col(c)
    return joined.select(*(F.col(c) if c == key else pick(c).alias(c) for c in base.columns))


def accumulate(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds child rows without repeats; a null key part counts as an empty text."""
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]
    fresh = new.select("*", *filled).dropDuplicates([f"_{k}" for k in keys])
    return base.unionByName(fresh.join(base.select(*filled).distinct(), [f"_{k}" for k in keys], "left_anti").select(*base.columns))


def append_section(base: DataFrame, patch: DataFrame, key: str, text: str, index: str, part: str, number: str) -> DataFrame:
    """Appends patch.part to base.text, and patch.number to the set-like list base.index, as its last item."""
    joined = base.join(patch.select(key, F.col(part).alias("_p"), F.col(number).alias("_n")), key, "left")
    grown = F.when(F.col("_p").isNull(), F.col(text)).otherwise(F.concat(F.coalesce(text, F.lit("")), "_p"))
    listed = F.when(F.col("_n").isNull(), F.col(index)).otherwise(F.array_append(F.array_remove(F.coalesce(F.col(index), F.array().cast("array<int>")), F.col("_n")), F.col("_n")))
    return joined.select(*(grown.alias(c) if c == text else listed.alias(c) if c == index else F.col(c) for c in base.columns))


def apply_transitions(base: DataFrame, changes: DataFrame, key: str, closed: list[str], stamps: dict[str, str] | None = None, as_of: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base with new states and the activity they imply, audit rows old to new, notices to owners).

    `stamps` names the date column that a new state fills with `as_of`.
    """
    joined = base.join(changes.select(key, F.col("state").alias("_state")), key, "left")
    moved = joined.where(F.col("_state").isNotNull() & ~F.col("_state").eqNullSafe(F.col("state")))
    state = F.coalesce("_state", "state")
    active = F.when(F.col("_state").isNull(), F.col("is_active")).otherwise(~state.isin(closed))
    changed = {"state": state, "is_active": active}
    for name, column in (stamps or {}).items():
        entered = (F.col("_state") == name) & ~F.col("_state").eqNullSafe(F.col("state"))
        changed[column] = F.when(entered, F.lit(as_of).cast("date")).otherwise(F.col(column))
    out = joined.select(*(changed.get(c, F.col(c)).alias(c) for c in base.columns))
    audit = moved.select(key, F.col("state").alias("old_state"), F.col("_state").alias("new_state"))
    notices = moved.where(F.col("owner_id").isNotNull()).select(key, "owner_id", F.concat(F.lit("Estado: "), F.col("_state")).alias("notice"))
    return out, audit, notices


def set_active(df: DataFrame, keys: DataFrame, key: str, flag: bool) -> DataFrame:
    """Soft delete or restore of the rows in `keys`."""
    marked = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*(F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col(c)).alias(c) if c == "is_active" else F.col(c) for c in df.columns))


def replace_set(bridge: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in `new` are replaced by the rows of `new`."""
    return bridge.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def build_mapping(old: DataFrame, new: DataFrame, natural: list[str], old_id: str, new_id: str) -> DataFrame:
    return old.select(*natural, old_id).join(new.select(*natural, new_id), natural).select(old_id, new_id)


def remap_fk(df: DataFrame, mapping: DataFrame, column: str, old_id: str, new_id: str) -> DataFrame:
    """Foreign keys through the mapping; keys that it lacks become null."""
    m = mapping.select(F.col(old_id).alias(column), F.col(new_id).alias("_new"))
    return df.join(m, column, "left").select(*(F.col("_new").alias(c) if c == column else F.col(c) for c in df.columns))


def extract_dimension(df: DataFrame, column: str, id_name: str) -> tuple[DataFrame, DataFrame]:
    """(dimension of the distinct values, df with the id in place of the text). Ids from 1 follow the order of values.

    The values are numbered by ranges and their counts, so a dimension may be as large as a table.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    dim = number_rows(values, [column], position=id_name).withColumn(id_name, F.col(id_name) + 1)
    return dim, df.join(dim, column, "left").drop(column)


def purge_orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return df.join(parents.select(key).distinct(), key, "left_semi")


def null_orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    hit = df.join(parents.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.select(*(F.when(F.col("_hit"), F.col(c)).alias(c) if c == key else F.col(c) for c in df.columns))


def insert_or_reactivate(base: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(base with absent names added and inactive ones active again, conflicts: names that are active already)."""
    asked = new.select(key).distinct()
    conflicts = asked.join(base.where("is_active"), key, "left_semi")
    back = base.join(asked.withColumn("_ask", F.lit(True)), key, "left")
    out = back.select(*((F.col(c) | F.coalesce("_ask", F.lit(False))).alias(c) if c == "is_active" else F.col(c) for c in base.columns))
    fresh = asked.join(base, key, "left_anti").withColumn("is_active", F.lit(True))
    return out.unionByName(fresh, allowMissingColumns=True), conflicts


def assign_exclusive(users: DataFrame, wanted: DataFrame, key: str, team: str) -> tuple[DataFrame, DataFrame]:
    """(users with new teams, rejected wishes of users who are in another team)."""
    joined = users.join(wanted.select(key, F.col(team).alias("_team")), key, "left")
    free = F.col(team).isNull() | (F.col(team) == F.col("_team"))
    out = joined.select(*(F.when(F.col("_team").isNotNull() & free, F.col("_team")).otherwise(F.col(team)).alias(c) if c == team else F.col(c) for c in users.columns))
    return out, joined.where(F.col("_team").isNotNull() & ~free).select(key, F.col("_team").alias(team))


def columns_to_rows(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each non-null value of the columns."""
    return df.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def default_domain(df: DataFrame, column: str, allowed: list[str], default: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(allowed), F.col(column)).otherwise(F.lit(default)))


def dedupe_keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    from casewright.operators.relational import latest_per_key

    return latest_per_key(df, keys, order)
