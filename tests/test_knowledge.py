"""Knowledge search, keyword tables, diffs by edits and blocks of similarities, on hand-made rows."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import keywords as W
from casewright.operators import records as K
from casewright.operators import text as X
from casewright.operators import vectors as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


KNOWN = "document_id long, vec_id long, category string, embedding array<float>, comprehension array<float>, successful boolean, feedback long, rank double"


def test_best_chunk_of_each_successful_document(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    known = spark.createDataFrame(
        [
            (1, 11, "x", a, None, True, 0, 0.2), (1, 12, "x", b, None, True, 0, 0.5), (1, 13, "x", a, None, False, 9, 0.9),  # the third isn't successful
            (2, 21, "x", a, None, True, 20, None), (2, 22, "x", b, None, True, 0, 0.0),  # no rank counts as 0, the smaller key wins
            (3, 31, "y", a, b, True, -5, 2.0),  # a comprehension vector stands in; ranks count up to 1
            (4, 41, "y", None, a, True, 0, 1.0), (5, 51, "y", a, None, None, 0, 1.0),  # no vector of its own; success unknown
        ],
        KNOWN,
    )
    assert [r["vec_id"] for r in K.best_chunks(known, "document_id", "vec_id", "rank").orderBy("vec_id").collect()] == [12, 21, 31]
    asked = spark.createDataFrame([(900, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r["document_id"]: r["score"] for r in K.knowledge_scores(asked, known, "document_id", "vec_id").collect()}
    assert got == {1: pytest.approx(0.35 * 0.5), 2: pytest.approx(0.55 + 0.1), 3: pytest.approx(0.35)}
    assert K.knowledge_scores(asked, known.limit(0), "document_id", "vec_id").count() == 0


def test_blocks_of_queries_and_rows_give_the_same_similarities(spark, monkeypatch):
    rnd = random.Random(1)
    emb = spark.createDataFrame([(k, [rnd.uniform(-1, 1) for _ in range(4)], k % 3) for k in range(60)], "vec_id long, embedding array<float>, label int")
    once, by_label = rows(V.similarities(emb, emb, carry=["label"])), rows(V.similarities(emb, emb, on="label"))
    assert len(once) == 60 * 59 and len(by_label) == 60 * 19 and {r[:3] for r in by_label} <= {r[:3] for r in once}
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "ROW_BLOCK", 11)
    assert rows(V.similarities(emb, emb, carry=["label"])) == once and rows(V.similarities(emb, emb, on="label")) == by_label
    plan = V.similarities(emb, emb)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("category", ["en", "xx"])
def test_scores_are_rounded_as_they_are_stored(spark, category):
    """Where 0.55 * cosine is a half in its shortest decimal text, the double may lie below it."""
    similar = [k / 1000 for k in range(1, 1000)]
    e = spark.createDataFrame([(k, [s, math.sqrt(1 - s * s)], "en", 0.0, 0) for k, s in enumerate(similar)], "vec_id long, embedding array<double>, category string, rank double, feedback long")
    asked = spark.createDataFrame([(5000, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = K.best_with_topup(asked, e, "vec_id", F.col("category") == category, 999, ["category"])
    expected = {k: math.floor(0.55 * s * 10000 + 0.5) / 10000 for k, s in enumerate(similar)}
    assert {r["vec_id"]: r["score"] for r in got.collect()} == expected
    known = e.withColumn("comprehension", F.lit(None).cast("array<double>")).withColumn("successful", F.lit(True)).withColumn("document_id", F.col("vec_id"))
    assert {r["vec_id"]: r["score"] for r in K.knowledge_scores(asked, known, "document_id", "vec_id").collect()} == expected


def test_every_block_meets_its_partner_in_partitions_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(V, "SIDE_BLOCKS", (9, 30))
    emb = spark.createDataFrame([(k, [float(k % 11), 1.0]) for k in range(90)], "vec_id long, embedding array<float>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert V.vector_topk(emb.where("vec_id % 5 = 0"), emb, 89).count() == 18 * 89
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_best_rows_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "SIDE_BLOCKS", (7, 40))
    monkeypatch.setattr(V, "PRODUCTS", 200)
    rnd = random.Random(4)
    vectors = [[float(rnd.randint(-2, 2)) for _ in range(3)] for _ in range(150)]  # many ties
    odd = [None, [], [0.0, 0.0, 0.0], [None, 1.0, 0.0], [1.0, 0.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0]]
    kind = "vec_id long, embedding array<double>, label int"
    emb = spark.createDataFrame([(k, v, k % 3) for k, v in enumerate(vectors + odd)] + [(None, [1.0, 0.0, 0.0], 1), (3, vectors[4], 1)], kind)
    for asked in (emb.where("vec_id % 5 = 0 or vec_id >= 150"), emb.where("vec_id = 1"), emb.limit(0)):
        w = Window.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), "vec_id")
        every = V.similarities(asked, emb).withColumn("rank", F.row_number().over(w)).where("rank <= 4")
        assert repr(rows(V.vector_topk(asked, emb, 4))) == repr(rows(every.select("query", "vec_id", "similarity", "rank")))  # nan isn't nan


def test_pairs_of_vectors_are_pruned_where_they_meet(spark):
    emb = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(300)], "vec_id long, embedding array<float>")
    for found in (V.vector_topk(emb.where("vec_id % 100 = 0"), emb, 3), V.rrf_fuse(V.vector_topk(emb.where("vec_id % 100 = 0"), emb, 3), None, "vec_id", embedded=emb, query="query")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_python_sees_few_texts_at_once():
    """A batch of many rows gives its results in small parts, long before it is worked through."""
    seen = []
    work = lambda a, b: [(len(a), seen.append(a) or b)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["x" * 300] * 10_000), pa.array(["y" * 300] * 10_000)], ["k", "a", "b"])
    parts = X.few_at_once(work, [("n", pa.int64()), ("text", pa.string())])(iter([batch]))
    first = next(parts)
    assert len(seen) == first.num_rows <= X.FEW_ROWS
    assert first.num_rows + sum(p.num_rows for p in parts) == 10_000 == len(seen)


@pytest.mark.parametrize("query", ["clause_changes", "version_changes"])
def test_diffs_go_through_arrow_in_parts(spark, query):
    from casewright.plans import corpus

    plan = getattr(corpus, query)(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


TABLE = [("salud", "b", 2), ("Salud pública", "a", 1), ("pensión", "c", 3), ("ña", "d", 0), ("x", None, None), (None, "e", 0), ("salud", "a2", 1)]


def test_keyword_table(spark, monkeypatch):
    keywords = spark.createDataFrame(TABLE, "keyword string, category string, place int")
    texts = ["SALUD", "saludo", "la salud pública", "pensión, y", "pensiónx", None, "", "España ña", "España", "_salud_", "1salud", "salud\nsalud pública"]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "id int, text string, place int")
    expected = {0: "a2", 2: "a", 3: "c", 7: "d", 9: "a2", 11: "a"}
    got = W.classify_by_table(docs, "text", keywords)
    assert got.columns == ["id", "text", "place", "keyword_class"]
    # of equal places the category that sorts first stands for the place
    assert {r["id"]: r["keyword_class"] for r in got.collect() if r["keyword_class"]} == {k: "a" if v == "a2" else v for k, v in expected.items()}
    monkeypatch.setattr(W, "BLOCK", 2)
    assert rows(W.classify_by_table(docs, "text", keywords)) == rows(got)
    assert W.classify_by_table(docs, "text", keywords.limit(0)).where("keyword_class is not null").count() == 0


def test_keyword_table_equals_the_patterns(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(2, 5))).strip() or "a" for _ in range(60)]
    categories = [(f"c{k:02}", words[k * 6 : k * 6 + 6]) for k in range(10)]
    docs = spark.createDataFrame([(k, " ".join(rnd.choice(["a", "bé", "cd", "-", "abc", "éa", "Dd"]) for _ in range(6))) for k in range(300)], "id int, text string")
    table = spark.createDataFrame([(w, c, k) for k, (c, ws) in enumerate(categories) for w in ws], "keyword string, category string, place int")
    assert rows(W.classify_by_table(docs, "text", table)) == rows(X.classify_keywords(docs, "text", categories))


def test_a_large_keyword_table_stays_out_of_the_tasks(spark, monkeypatch):
    rnd = random.Random(8)
    letters = ["a", "b", "é", " ", "-", "_", "1", "A", "\U00010400", "²"]
    word = lambda most: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
    keywords = spark.createDataFrame([(word(5), f"c{k}", k) for k in range(400)], "keyword string, category string, place int")
    docs = spark.createDataFrame([(k, word(14) if k else None) for k in range(500)], "id int, text string")
    small = rows(W.classify_by_table(docs, "text", keywords))
    monkeypatch.setattr(W, "BLOCK", 300)
    monkeypatch.setattr(W, "_lowest", None)  # no automaton of a part of the table either
    assert rows(W.classify_by_table(docs, "text", keywords)) == small == rows(W.classify_by_table(docs, "text", keywords, key="id"))
    assert sum(r[2] is not None for r in small) > 200


def test_time_of_a_text_does_not_grow_with_the_keywords():
    text = " ".join(f"w{k % 977}" for k in range(200_000))
    took = []
    for n in (50, 50_000):
        words = W.automaton([(f"v{k}", k) for k in range(n)])
        began = time.time()
        assert W.lowest_place(words, text, 0) is None
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 0.5


def longest(a, b):
    return int(X._lengths(np.array(a), np.array(b))[-1])


def test_diffs_by_edits_are_longest_common_subsequences():
    rnd = random.Random(9)
    for _ in range(300):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 25))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 25))]
        pairs = X.places_by_edits(np.array(a, int), np.array(b, int), 60)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs)) and len(pairs) == longest(a, b)
    assert X.places_by_edits(np.arange(10), np.arange(100, 110), 5) is None


def test_a_diff_of_twenty_thousand_paragraphs_takes_seconds():
    rnd = random.Random(2)
    old = [f"paragraph {k} {rnd.random()}" for k in range(20_000)]
    new = list(old)
    for _ in range(50):
        at = rnd.randrange(len(new))
        new[at : at + 1] = rnd.choice([[], ["other " + str(rnd.random())], [new[at], "added"]])
    began = time.time()
    runs = X.diff_runs(old, new)
    assert time.time() - began < 5 and sum(part != "equal" for part, _ in runs) >= 40


def test_prompt_sections(spark):
    from casewright.operators import prompts as S

    kind = "theme string, rights array<string>, requests array<string>, excerpt string, seen array<struct<kind: string, result: string>>, urgency string, notes array<struct<title: string, content: string>>"
    full = ("T", ["a", None, "b"], ["x", "y"], "e", [("k", "favorable"), None, ("", "favorable"), ("k", "favorable"), ("z", "desfavorable")], "alta", [("n", None), None])
    df = spark.createDataFrame([full, (" ", ["a"], ["x"], "e", [], None, []), ("T", None, [], " ", [None], "baja", None), ("T", None, None, None, [("k", "referencia")], "otra", None)], kind)
    c = S.comprehension_section(F.col("theme"), F.col("rights"), F.col("requests"), F.col("excerpt"))
    s = S.strategy_section(F.col("seen"), F.col("urgency"))
    got = [tuple(r) for r in df.select(c, s, S.titled_section("NOTAS", F.col("notes"))).collect()]
    assert got[0] == ("ANÁLISIS\n  Tema: T\n  Derechos: a, b\n  Peticiones:\n    1. x\n    2. y\n  Extracto: e", "ESTRATEGIA\n  - k: 2\n  - General: 1\n  ALERTA desfavorables: 1\n  Tono: breve y directo", "NOTAS\n  - n: ")
    assert got[1] == (None, None, None) and got[2] == ("ANÁLISIS\n  Tema: T", None, None)
    assert got[3] == ("ANÁLISIS\n  Tema: T", "ESTRATEGIA\n  - sin precedentes favorables\n  Tono: institucional", None)
    known = S.inherited_comprehension(F.col("theme"), F.lit(None).cast("string"), F.col("rights"))
    told = [tuple(r) for r in df.select(known["kind"], known["rights"], S.comprehension_text(known)).collect()]
    assert told[1] == (None, None, None) and told[3] == ("General", [], "T. ")


def test_ascii_stays_out_of_python(spark):
    from casewright.functions.columns import repaired

    df = spark.createDataFrame([(" \tSi\n",), ("Crítico ",), ("Critico",), ("  ",), ("",), (None,), (" é ",)], "x string")
    assert [r[0] for r in df.select(repaired("x", default="-")).collect()] == ["Sí", "Crítico", "Crítico", "-", "-", "-", "é"]
