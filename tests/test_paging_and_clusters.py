"""Pages by their first keys against offsets; the stored cluster model against a fit of its own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import cluster_model as C
from casewright.operators import paging as P
from casewright.operators.vectors import cluster


def test_pages_equal_offsets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FILE_ROWS", 50)
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 9), k, f"t{k}") for k in range(437)]
    folder = str(tmp_path / "log")
    P.write_paged(spark.createDataFrame(rows, "newest int, id int, text string").repartition(3), folder, ["newest", "id"], 20)
    ordered = sorted(rows)
    assert P.page_count(spark, folder) == 22
    for page in (1, 2, 11, 21, 22):
        assert [tuple(r) for r in P.read_page(spark, folder, ["newest", "id"], page).collect()] == ordered[(page - 1) * 20 : page * 20]
    assert P.read_page(spark, folder, ["newest", "id"], 23).count() == 0 and P.read_page(spark, folder, ["newest", "id"], -3).first()["id"] == ordered[0][1]
    empty = str(tmp_path / "none")
    P.write_paged(spark.createDataFrame([], "newest int, id int"), empty, ["newest", "id"], 20)
    assert P.read_page(spark, empty, ["newest", "id"], 1).count() == 0


def test_a_late_page_reads_no_more_than_the_first(spark, tmp_path):
    folder = str(tmp_path / "log")
    P.write_paged(spark.range(200_000).select((F.col("id") * 7 % 200_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text")), folder, ["k"], 20)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read, keys = {}, {}
        for page in (1, 5_000, 9_990):
            df = P.read_page(spark, folder, ["k"], page)
            keys[page] = [r["k"] for r in df.collect()]
            scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
            read[page] = scan.metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    every = sorted(k * 7 % 200_003 for k in range(200_000))
    assert all(keys[p] == every[(p - 1) * 20 : p * 20] for p in keys)
    assert read[1] < 100_000 and max(read.values()) <= 2 * read[1] + 20_000, read


def test_rows_are_assigned_without_a_fit(spark, tmp_path, monkeypatch):
    rnd = np.random.default_rng(4)
    middle = rnd.normal(0, 1, (7, 6))
    made = lambda ids: spark.createDataFrame([(k, [float(x) for x in middle[k % 7] + rnd.normal(0, 0.05, 6)]) for k in ids], "vec_id long, embedding array<float>")
    old, new, folder = made(range(200)).cache(), made(range(200, 209)).cache(), str(tmp_path / "model")
    assert C.is_stale(spark, folder, old)
    C.refreshed(spark, folder, old).count()
    fits = []
    fit = C.fit_model
    monkeypatch.setattr(C, "fit_model", lambda *a, **k: (fits.append(1), fit(*a, **k)))
    placed = {r["vec_id"]: r for r in C.refreshed(spark, folder, old.unionByName(new)).collect()}
    assert not fits and len(placed) == 209
    assert all(len({placed[k]["cluster"] for k in range(c, 209, 7)}) == 1 for c in range(7)) and len({r["cluster"] for r in placed.values()}) == 7
    assert all(0 <= placed[k]["x"] <= 1 and 0 <= placed[k]["y"] <= 1 for k in range(200))
    whole, _ = cluster(old)
    for r in whole.collect():
        assert placed[r["vec_id"]]["distance"] == pytest.approx(r["distance"], abs=1e-6)
    odd = spark.createDataFrame([(1000, None)], "vec_id long, embedding array<float>")
    assert C.assign(spark, folder, odd).count() == 0
    C.refreshed(spark, folder, old.unionByName(made(range(300, 310)))).count()
    assert fits == [1]
