"""The inverted-file index against exact search."""

import numpy as np
from conftest import MEDIUM

from casewright.operators import vector_index as I
from casewright.operators.vectors import vector_topk

KIND = "vec_id long, embedding array<float>"


def clustered(spark, n=3000, width=16, centres=60, seed=3):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(0, 1, (centres, width))
    return spark.createDataFrame([(k, [float(x) for x in middle[k % centres] + rnd.normal(0, 0.3, width)]) for k in range(n)], KIND).repartition(4)


def pairs(df):
    return sorted((r["query"], r["rank"], r["vec_id"], r["similarity"]) for r in df.collect())


def test_all_lists_give_the_exact_result(spark, monkeypatch):
    monkeypatch.setattr(I, "SLICE_ROWS", 40)
    monkeypatch.setattr(I, "QUERY_BLOCK", 10)
    emb = clustered(spark)
    folder, asked = I.scratch_index(emb), emb.where("vec_id % 100 = 0")
    got, exact = pairs(I.search_index(spark, folder, asked, 5, visits=10**6)), pairs(vector_topk(asked, emb, 5).select("query", "rank", "vec_id", "similarity"))
    assert [g[:2] for g in got] == [e[:2] for e in exact] and all(abs(g[3] - e[3]) <= 1e-4 for g, e in zip(got, exact))
    assert len({g[:3] for g in got} & {e[:3] for e in exact}) >= 0.97 * len(exact)  # 32-bit products may swap neighbours that tie


def test_few_lists_find_nearly_all(spark):
    emb = clustered(spark)
    folder, asked = I.scratch_index(emb), emb.where("vec_id % 100 = 0")
    lists = spark.read.parquet(f"{folder}/lists")
    visits = lists.first()["visits"]
    assert visits < lists.count() / 2
    assert I.recall_of(I.search_index(spark, folder, asked, 5), vector_topk(asked, emb, 5)) >= 0.9
    assert spark.read.parquet(f"{folder}/rows").count() == emb.count()


def test_recall_on_vectors_without_structure(spark):
    emb = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").select("vec_id", "embedding")
    asked = emb.where("vec_id % 100 = 0")
    assert I.recall_of(I.search_index(spark, I.scratch_index(emb), asked, 5), vector_topk(asked, emb, 5)) >= 0.9


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.1]), (None, [1.0, 0.0]), (5, [-1.0, 0.0]), (5, [-1.0, 0.0]), (6, [None, 1.0])]
    emb = spark.createDataFrame(rows, KIND)
    got = pairs(I.search_index(spark, I.scratch_index(emb), emb, 1, visits=9))
    assert {(q, i) for q, _, i, _ in got} == {(1, 4), (4, 1), (5, 4)}
    none = emb.where("false")
    assert I.search_index(spark, I.scratch_index(none), emb, 5).count() == 0 == I.search_index(spark, I.scratch_index(emb), none, 5).count()
    one = emb.where("vec_id = 1")
    assert pairs(I.search_index(spark, I.scratch_index(one), emb.where("vec_id = 4"), 3)) == [(4, 1, 1, 0.995)]


def test_a_query_goes_once_to_each_bin_however_many_lists_it_visits(spark, monkeypatch):
    monkeypatch.setattr(I, "SLICE_ROWS", 100)
    lists = [{"list": k, "slices": 3 if k == 4 else 1, "count": 250 if k == 4 else 20} for k in range(12)] + [{"list": 12, "slices": None, "count": None}]
    bins = I._bins(lists)
    assert sorted({b[:2] for b in bins}) == sorted([(k, 0) for k in range(12)] + [(4, 1), (4, 2)]) and max(b[2] for b in bins) < 6
    emb = clustered(spark, 300).withColumnsRenamed({"vec_id": "query", "embedding": "unit"})
    sent = I._dealt(emb, np.random.default_rng(1).normal(0, 1, (13, 16)).astype(np.float32), 13, bins).collect()
    assert len(sent) == 300 * len({b[2] for b in bins})
    assert {(r["bin"], k) for r in sent for k in r["lists"]} == {(b, k) for k, _, b in bins}
