"""The Merkle manifest against a version on plain lists."""

import hashlib
import re
import zlib

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from casewright.llm import merkle, queries

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, lower=False):
    i, text, lang, source, n = row
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower and text is not None else text
    return digest("".join(map(field, (i, source, lang, n, text))))


def climb(nodes):
    """(top, for each node the siblings left and right on every level)."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            steps[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            at[k] = p // 16
        level = [digest("".join(level[s : s + 16])) for s in range(0, len(level), 16)]
    return level[0], steps


def by_lists(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    inner = {s: climb([leaf(r) for r in ordered[s]]) for s in names}
    root, outer = climb([inner[s][0] for s in names])
    out = []
    for s, above in zip(names, outer):
        for r, steps in zip(ordered[s], inner[s][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, tampered)
            for left, right in steps + above:
                folded = digest(left + folded + right)
            out.append((r[0], leaf(r), inner[s][0], root, digest("".join(a + b for a, b in steps + above)), folded, folded == root))
    return sorted(out, key=repr)


def made(sizes):
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            rows.append((i * 7 % 10007, f"Text {i} É", "en" if i % 3 else None, source, i))
            i += 1
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        made([("a", 1)]), made([("a", 16)]), made([("a", 17), ("b", 1)]), made([(None, 300), ("", 1), ("é", 40), ("z", 257)]), made([(f"s{k}", 1 + k % 3) for k in range(20)]), made([("a", 5000), ("b", 3)]),
        [(1, "A", None, "x", 1), (1, "A", None, "x", 1), (1, "B", None, "x", 1), (None, "C", None, "x", None), (None, None, None, None, None), (2, "", "en", "", 0), (3, "Long " * 50000, "en", "x", 1)],
    ],
)
def test_manifest_equals_lists(spark, rows):
    got = merkle.verified_manifest(spark.createDataFrame(rows, KINDS).withColumns({"slot": F.lit(1), "key": F.lit("k"), "position": F.lit(2), "size": F.lit(3)}))
    assert sorted(map(tuple, got.collect()), key=repr) == by_lists(rows)


def test_no_rows(spark):
    assert merkle.verified_manifest(spark.createDataFrame([], KINDS)).count() == 0


def test_far_ancestors_are_joined_without_broadcast_too(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ANCESTORS", 0)
    rows = made([("a", 600), ("b", 3)])
    assert sorted(map(tuple, merkle.verified_manifest(spark.createDataFrame(rows, KINDS)).collect()), key=repr) == by_lists(rows)


def test_query_equals_lists(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op13_merkle_manifest"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=repr) == by_lists(rows)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)
