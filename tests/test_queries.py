"""Every report query against its DuckDB equivalent; those without one must give rows."""

import math
import re

import duckdb
import pytest
from conftest import MEDIUM

from casewright.plans import corpus, knowledge, modules, records, reports, timeline  # noqa: F401
from casewright.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{MEDIUM}/{t}.parquet'")
    return db


def _rows(rows, order, in_order=False):
    clean = lambda v: (None if math.isnan(v) else float(f"{v:.12g}")) if isinstance(v, float) else v
    found = [tuple(clean(r[i]) for i in order) for r in rows]
    return found if in_order else sorted(found, key=repr)


def _ordered(sql):
    """Whether the outermost SELECT has an ORDER BY."""
    depth, outer = 0, []
    for part in re.split(r"([()])", sql):
        depth += {"(": 1, ")": -1}.get(part, 0)
        if depth == 0:
            outer.append(part)
    return "ORDER BY" in "".join(outer)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, MEDIUM)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        in_order = _ordered(ORACLE_SQL[name])
        assert _rows(rows, df.columns, in_order) == _rows(want.fetchall(), [want.columns.index(c) for c in df.columns], in_order)
