"""Column helpers: labels, dates, rates, ordinals and row rules."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def clean_label(col, default: str) -> Column:
    """The trimmed text, or `default` where nothing is left."""
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(default))


def first_label(*cols) -> Column:
    return F.coalesce(*cols)


def due_days(due, as_of: str) -> Column:
    """Whole days from the start of as_of to due, rounded up."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.ceil((micros(F.col(due)) - micros(F.lit(as_of))) / 86400e6).cast("long")


def is_overdue(due, state, closed: list[str], as_of: str) -> Column:
    return (F.col(due) < F.to_date(F.lit(as_of))) & ~F.col(state).isin(closed)


def due_within(due, days: int, as_of: str) -> Column:
    start = F.to_date(F.lit(as_of))
    return F.col(due).between(start, F.date_add(start, days))


def rank_label(col, order: list[str]) -> Column:
    """Ordinal of a label, from 1; labels that aren't in `order` come last."""
    return reduce(lambda out, x: out.when(F.col(col) == x[1], x[0]), enumerate(order, 1), F.when(F.lit(False), 0)).otherwise(len(order) + 1)


def rate(part, whole) -> Column:
    """100 * part / whole with one decimal, halves up, for counts; null where whole is 0."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(whole > 0, F.floor((part * 2000 + whole) / (whole * 2)).cast("double") / 10)


def mean_of(total, n) -> Column:
    """total / n for exact totals; null where n is 0."""
    total, n = (F.col(c) if isinstance(c, str) else c for c in (total, n))
    return F.when(n > 0, total.cast("double") / n.cast("double"))


def optional_filters(df: DataFrame, wanted: dict) -> DataFrame:
    """Equality for each column whose value is given; a list means membership."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def date_range(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """Both ends included, each optional; a date as the end of a timestamp column is its midnight."""
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first).cast(df.schema[column].dataType))
    if last is not None:
        df = df.where(F.col(column) <= F.lit(last).cast(df.schema[column].dataType))
    return df


def search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Case-insensitive contains over several columns; % and _ in the term stay wildcards."""
    return df.where(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{term}%") for c in columns)))


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the names of the rules that they break (null counts as broken)."""
    errors = F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in rules.items())))
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed characters, trimmed; Spark has no built-in for it."""
    return text.str.normalize("NFC").str.strip()


#: Spellings that are repaired before a row is judged.
SYNONYMS = {"Si": "Sí", "Critico": "Crítico"}


def repaired(col: str, synonyms: dict[str, str] = SYNONYMS, default=None) -> Column:
    """The composed and trimmed text, a known misspelling set right, `default` where nothing is left."""
    plain = F.octet_length(col) == F.char_length(col)  # ASCII is composed: only other rows go to Python
    text = F.nullif(F.when(plain, F.regexp_replace(F.trim(col), r"^\s+|\s+$", "")).otherwise(nfc(F.when(~plain, F.col(col)))), F.lit(""))
    for wrong, right in synonyms.items():
        text = F.when(text == wrong, right).otherwise(text)
    return text if default is None else F.coalesce(text, F.lit(default))


def is_uuid(col: str) -> Column:
    return F.col(col).rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def is_url(col: str) -> Column:
    return F.col(col).rlike(r"^https?://[^\s/$.?#][^\s]*$")


def is_whole(col: str) -> Column:
    """A text that is an integer."""
    return F.col(col).rlike(r"^[+-]?[0-9]+$")


def long_date(col) -> Column:
    """A date in words, as 05 de marzo de 2024. The months' names."""
    months = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
    name = F.element_at(F.array(*(F.lit(m) for m in months)), F.month(col))
    return F.concat(F.date_format(col, "dd"), F.lit(" de "), name, F.lit(" de "), F.year(col).cast("string"))


def to_common(df: DataFrame, tag: str, mapping: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Project to `columns` (name: type) with typed nulls where `mapping` has nothing, and a module tag."""
    return df.select(F.lit(tag).alias("module"), *((F.col(mapping[c]) if c in mapping else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
