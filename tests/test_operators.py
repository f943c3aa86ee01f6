"""Operators on hand-made rows, with the quirks that the report queries don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import changes as M
from casewright.operators import records as K
from casewright.operators import relational as R
from casewright.operators import text as X
from casewright.operators import vectors as V
from casewright.sources import tables as T
from casewright.streaming import alerts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_due_days_and_rate(spark):
    df = spark.sql("SELECT date'1998-06-04' d, 1L part, 8L whole, 0L zero")
    assert rows(df.select(C.due_days("d", "1998-06-01"), C.rate("part", "whole"), C.rate("part", "zero"))) == [(3, 12.5, None)]


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", ""), (2, "b", "Depende"), (3, None, "Sí")], "k int, x string, y string")
    patch = spark.createDataFrame([(1, None, "No"), (2, "z", "No"), (3, "w", "No")], "k int, x string, y string")
    assert rows(M.patch_merge(base, patch, "k", ["x"])) == [(1, "a", ""), (2, "z", "Depende"), (3, "w", "Sí")]
    assert rows(M.fill_merge(base, patch, "k", ["y"])) == [(1, "a", "No"), (2, "b", "No"), (3, None, "Sí")]
    new = spark.createDataFrame([(3, "n", "m"), (9, "q", "r")], base.schema)
    assert rows(M.upsert(base, new, "k", ["x"])) == [(1, "a", ""), (2, "b", "Depende"), (3, "n", "Sí"), (9, "q", "r")]
    assert len(rows(M.insert_missing(base, new, ["k"]))) == 4
    twice = spark.createDataFrame([(1, "n", None), (2, "n", None), (3, "n", "5")], "k int, norm string, article string")
    assert len(rows(M.accumulate(twice.limit(0), twice, ["norm", "article"]))) == 2
    named = spark.createDataFrame([("a", True), ("b", False)], "name string, is_active boolean")
    out, conflicts = M.insert_or_reactivate(named, spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), "name")
    assert rows(out) == [("a", True), ("b", True), ("c", True)] and rows(conflicts) == [("a",)]
    people = spark.createDataFrame([(1, None), (2, 5)], "u int, team int")
    placed, refused = M.assign_exclusive(people, spark.createDataFrame([(1, 7), (2, 7)], "u int, team int"), "u", "team")
    assert rows(placed) == [(1, 7), (2, 5)] and rows(refused) == [(2, 7)]
    lists = spark.createDataFrame([(1, "t", [1, 2])], "k int, text string, idx array<int>")
    grown = M.append_section(lists, spark.createDataFrame([(1, "+", 1)], "k int, p string, n int"), "k", "text", "idx", "p", "n")
    assert [tuple(r) for r in grown.collect()] == [(1, "t+", [2, 1])]


def test_duplicates_and_bridge(spark):
    new = spark.createDataFrame([(1, "f", "c"), (2, "g", "d"), (3, None, None)], "id int, file string, content string")
    base = spark.createDataFrame([(7, "f", "x"), (8, "y", "d"), (9, None, None)], "base_id int, file string, content string")
    assert rows(R.find_duplicates(new, base, ["file", "content"], "id", "base_id")) == [(1, 7), (2, 8)]
    assert R.page(spark.range(100), [F.asc("id")], 0, 3).count() == 10


CHUNKS = [
    # text, size, overlap, chunks
    ("Este es un párrafo pequeño de prueba.", 100, 20, ["Este es un párrafo pequeño de prueba."]),
    ("uno\n\ndos\n\ntres", 10, 2, ["uno\n\ndos", "os\n\ntres"]),
    ("abcdefgh\n\nijklmnop", 8, 3, ["abcdefgh", "fgh\n\nijklmnop"]),  # tail and unit may pass the size
    ("Uno dos. Tres cuatro! Cinco", 13, 0, ["Uno dos.", "Tres cuatro!", "Cinco"]),
    ("xxxxxxxxxxxxxxxxxxxxxxxxx. fin", 10, 0, ["xxxxxxxxxx", "xxxxxxxxxx", "xxxxx.", "fin"]),
    ("  \n \n ", 10, 2, []),
]


def test_chunks(spark):
    assert X.chunk_text("", 10, 2, r"\n\s*\n") == [] == X.chunk_text(None, 10, 2, r"\n\s*\n")
    for text, size, overlap, want in CHUNKS:
        assert X.chunk_text(text, size, overlap, r"\n\s*\n") == want
        df = spark.createDataFrame([(7, text)], "id int, t string")
        assert [tuple(r) for r in X.chunk_documents(df, "id", "t", size, overlap).orderBy("number").collect()] == [(7, i, c) for i, c in enumerate(want, 1)]
    assert len(X.chunk_text("Párrafo uno muy largo...\n\nPárrafo dos también largo...", 15, 3, r"\n\s*\n")) > 1
    with pytest.raises(ValueError):
        X.chunk_documents(spark.createDataFrame([(1, "x")], "id int, t string"), "id", "t", 10, 10)


REQUESTS = [
    ("Hechos\n1.- pido agua\ny más agua\n2) pido luz\n\n\n\nhoy\n3. gas", [("1.", "pido agua\ny más agua"), ("2.", "pido luz\n\nhoy"), ("3.", "gas")]),
    ("Primero: uno\nSEGUNDO. dos\ncon más\ndécimo tres", [("Primero:", "uno"), ("Segundo:", "dos\ncon más"), ("Décimo:", "tres")]),
    ("1. solo uno", [("1.", "1. solo uno")]),
    (" texto libre ", [("1.", "texto libre")]),
    (" \n ", []),
    (None, []),
]


def test_requests_and_fields(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REQUESTS)], "id int, t string")
    got = X.split_requests(df, "id", "t").orderBy("id", "number").collect()
    assert [(r["id"], r["number"], r["label"], r["request"]) for r in got] == [(i, n, *x) for i, (_, xs) in enumerate(REQUESTS) for n, x in enumerate(xs, 1)]
    texts = [
        ("Rad. No. 2024-00123-00. Juzgado 3 Civil  Municipal de Cali, Accionante: maría josé PÉREZ identificada con cc 1", "20240012300", "JUZGADO 3 CIVIL  MUNICIPAL".replace("  ", " "), "MARÍA JOSÉ PÉREZ"),
        ("proceso 11001400300120240 de hoy. Yo, Ana Ruiz Gil, mayor de edad", "11001400300120240", X.UNKNOWN, "ANA RUIZ GIL"),
        ("tel 3001234567, demandante: Al.", X.NO_DOCKET, X.UNKNOWN, X.UNKNOWN),
        (None, X.NO_DOCKET, X.UNKNOWN, X.UNKNOWN),
    ]
    fields = X.extract_fields(spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id int, t string"), "t").orderBy("id").collect()
    for r, (_, docket, court, claimant) in zip(fields, texts):
        assert (r["docket"], r["claimant"]) == (docket, claimant) and (r["court"] == court or r["court"].startswith("JUZGADO 3 CIVIL"))


def test_layout_and_html(spark):
    texts = [
        ("uno  dos\r\ntres\rCuatro.\nCinco\n\n\n\nseis-\nsiete", "uno dos tres\nCuatro.\n\nCinco\n\nseis-\nsiete"),
        ('el total\n5 (cinco\n"x"', 'el total 5 (cinco "x"'),
        ("fin.\n2 dos", "fin.\n\n2 dos"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, t string")
    assert [r[0] for r in df.orderBy("id").select(X.repair_layout(F.col("t"))).collect()] == [want for _, want in texts]
    pages = [("<h2>T</h2><p>a &amp;lt; b</p><ul><li>x</li><li>y</li></ul>z<br/>w&#39;&nbsp;q", "T\n\na < b\n\n• x\n• yz\nw  q")]
    df = spark.createDataFrame([(t,) for t, _ in pages], "t string")
    assert [r[0] for r in df.select(X.html_to_text(F.col("t"))).collect()] == [want for _, want in pages]


def test_diff(spark):
    pairs = [
        (1, "a\n\nb\n\nc", "a\n\nx\n\nc\n\nd"),
        (2, "same", "same"),
        (3, "A  b\n\nzz", "a B\n\nzz"),
        (4, "uno\n\ndos\n\nfin", "tres\n\ncuatro\n\nfin"),  # runs of several paragraphs are one change
        (5, "Texto\nCLÁUSULA PRIMERA: objeto\nsigue", "Texto\nCLÁUSULA PRIMERA: objeto\nsigue\nAnexo 2"),
        (6, None, "nuevo"), (7, "viejo", None),
    ]
    df = spark.createDataFrame(pairs, "id int, o string, n string")
    changes = X.group_changes(X.diff_pairs(df, "id", "o", "n"), "id").orderBy("id", "seq").collect()
    assert [(r["id"], r["change"], r["old_text"], r["new_text"]) for r in changes] == [
        (1, "MODIFICACIÓN", "b", "x"), (1, "ADICIÓN", None, "d"), (4, "MODIFICACIÓN", "uno dos", "tres cuatro"), (5, "ADICIÓN", None, "Anexo 2"), (6, "ADICIÓN", None, "nuevo"), (7, "ELIMINACIÓN", "viejo", None),
    ]


def test_common_places_is_longest():
    """Divide and conquer against the whole table."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 25)) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        found = X.common_places(a, b)
        assert len(found) == table[-1, -1] and all(a[i] == b[j] for i, j in found)
        assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))
    old, new = ([str(x) for x in rng.integers(0, 6, 40)] for _ in range(2))
    runs = X.diff_runs(old, new)
    joined = lambda parts: [line for part, text in runs if part in parts for line in text.split("\n\n")]
    assert joined(("equal", "removed")) == old and joined(("equal", "added")) == new


def test_text_jobs(spark):
    answers = spark.createDataFrame([(1, 'Claro:\n```json\n{"a": 1, "b": "x ``` y"}\n```'), (2, "no json"), (3, '{"b": "y"}')], "id int, raw string")
    ok, bad = X.parse_llm_json(answers, "raw", "a int, b string", ["a"])
    assert [tuple(r["parsed"]) for r in ok.collect()] == [(1, "x ``` y")] and sorted(r["id"] for r in bad.collect()) == [2, 3]
    assert spark.range(1).select(X.split_sections(F.lit("aa\n\nbb\n\ncc"), 6).alias("s")).first()["s"] == ["aa\n\nbb", "cc"]
    items = spark.createDataFrame([(k, i, n) for k in (1, 2) for i, n in enumerate([5, 5, 5, 30, None, 1])], "k int, i int, n int")
    assert sorted(map(tuple, X.pack_batches(items, "k", "i", "n", 10).collect())) == [(k, i, b) for k in (1, 2) for i, b in enumerate([0, 0, 1, 2, 3, 3])]
    chunks = spark.createDataFrame([(1, 2, "fin", "T (2/2)"), (1, 1, " inicio del texto", "T (1/2)")], "id int, number int, chunk string, title string")
    assert tuple(X.rebuild_document(chunks, "id", "inicio del", "title").first()) == (1, " inicio del texto\nfin", 1, "T")
    docs = spark.createDataFrame([(1, "gato gato perro", "x"), (2, "gato", None), (3, None, "y"), (4, "", "y")], "id int, t string, title string")
    assert [tuple(r) for r in X.term_stats(docs, F.col("t"), 5, longer_than=3).collect()] == [("gato", 2, 3), ("perro", 1, 1)]
    assert [r["id"] for r in X.text_rank(docs, "id", F.col("t"), ["gato", "perro"]).collect()] == [1]
    assert [r[0] for r in docs.orderBy("id").select(X.searchable(docs, ["title", "id"], "t", 4)).collect()] == ["x 1 gato", "2 gato", "y 3", "y 4 "]


def test_cleaned_columns(spark):
    df = spark.createDataFrame([(" Si ", "https://a.b/c", "123e4567-e89b-12d3-a456-426614174000", "12"), ("Cri\u0301tico", "ftp://x", "nope", "1.5"), ("", None, None, None)], "v string, url string, id string, n string")
    assert [r[0] for r in df.select(C.repaired("v", default="Medio")).collect()] == ["Sí", "Crítico", "Medio"]
    assert [tuple(r) for r in df.select(C.is_url("url"), C.is_uuid("id"), C.is_whole("n")).collect()] == [(True, True, True), (False, False, False), (None, None, None)]
    ok, bad = C.validate_rows(df, {"url": C.is_url("url"), "id": C.is_uuid("id")})
    assert ok.count() == 1 and [r["errors"] for r in bad.collect()] == [["url", "id"], ["url", "id"]]
    assert spark.sql("SELECT date'2024-03-05' d").select(C.long_date("d")).first()[0] == "05 de marzo de 2024"
    labels = spark.createDataFrame([(None, "b"), ("a", "b"), (None, None)], "x string, y string")
    assert [r[0] for r in labels.select(C.first_label("x", "y")).collect()] == ["b", "a", None]


def test_read_documents_and_catalogs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\ndos")
    assert [r["text"] for r in T.read_documents(spark, str(tmp_path / "a.txt")).collect()] == ["uno\ndos"]
    with pytest.raises(ValueError):
        T.read_documents(spark, str(tmp_path), "pdf")
    with pytest.raises(ValueError):
        T.read_catalog(spark, "/root/testdata/sf0.001", "usuarios")


def test_joins_of_one_row_and_null_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(left.join(right, "k", "left_anti")) == [(2,), (None,)]  # a null key neither matches nor empties the result
    assert R.with_scalar(left, left.agg(F.count("k").alias("n"))).count() == 3
    with pytest.raises(Exception, match="one row expected"):
        R.with_scalar(left, left.withColumnRenamed("k", "n")).collect()


def test_knowledge(spark):
    given = spark.createDataFrame([(1, "c" * 2000, "contenido"), (1, "a", "analisis"), (2, "z" * 2000, "contenido"), (3, None, "contenido")], "k int, t string, o string")
    got = {r["k"]: (r["o"], r["t"]) for r in K.embedding_upsert(given, "k", "t", "o", ["analisis", "contenido"]).collect()}
    assert got == {1: ("analisis", "a"), 2: ("contenido", "z" * 1500), 3: ("contenido", None)}
    answers = spark.createDataFrame([(1, "Favorable", "uno.\n\ndos", "A"), (2, "Favorable", " ", "A"), (3, "Desfavorable", "x", "B"), (4, "Favorable", "ya", "B")], "k int, r string, t string, cat string")
    fit = K.promotable(answers, spark.createDataFrame([(4,), (None,)], "k int"), "k", "r", "Favorable", "t")
    out = K.promote(fit, "k", "t", F.concat(F.lit("R "), F.col("k").cast("string")), 5, 0).orderBy("number").collect()
    assert [(r["k"], r["chunk"], r["title"], r["cat"]) for r in out] == [(1, "uno.", "R 1 (1/2)", "A"), (1, "dos", "R 1 (2/2)", "A")] and len({r["embedding_key"] for r in out}) == 2
    scored = spark.createDataFrame([(q, i, float(i), "en" if i < n else "fr") for q, n in ((1, 2), (2, 4)) for i in range(6)], "q int, id int, s double, c string")
    top = K.search_with_topup(scored, "q", "id", "s", F.col("c") == "en", 4)
    assert sorted((r["q"], r["tier"], r["id"]) for r in top.collect()) == [(1, 0, 0), (1, 0, 1), (1, 1, 4), (1, 1, 5), (2, 0, 0), (2, 0, 1), (2, 0, 2), (2, 0, 3)]


def test_thresholds(spark):
    df = spark.createDataFrame([(i, 1, d, "Pendiente", True) for i, d in enumerate(["1998-05-01", "1998-06-01", "1998-06-02", "1998-06-03", "1998-06-04", "1998-06-06", "1998-06-07"])], "id int, owner_id int, due string, state string, is_active boolean")
    got = alerts.threshold_alerts(df.withColumn("due", F.to_date("due")), "id", "1998-06-01", alerts.FILE_THRESHOLDS, ["Archivado"]).orderBy("id").collect()
    assert [r["alert"] for r in got] == ["vence hoy o vencida", "vence hoy o vencida", "vence mañana", "vence en 5 días", "vence en 3 días", "vence en 5 días"]


def test_clusters(spark):
    e = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 1.0]) for i in range(5)] + [(9, [50.0, 50.0])], "vec_id long, embedding array<double>")
    placed, profile = V.cluster(e)
    of = {r["vec_id"]: r["cluster"] for r in placed.collect()}
    assert {r["cluster"]: r["size"] for r in profile.collect()} == {c: list(of.values()).count(c) for c in set(of.values())}
    assert all(of[r["medoid"]] == r["cluster"] for r in profile.collect()) and len(set(of.values())) == V.clusters_for(6)
    mix = V.cluster_mix(placed, spark.createDataFrame([(i, "a" if i else None, 1) for i in range(10)], "vec_id long, kind string, risk int"), "vec_id", ["kind", "risk"])
    assert mix.where("kind = 'kind'").agg(F.sum("n")).first()[0] == 5 and mix.where("kind = 'risk'").agg(F.sum("n")).first()[0] == 6
    points = {r["vec_id"]: (r["x"], r["y"]) for r in V.project_2d(e).collect()}
    assert min(x for x, _ in points.values()) == 0 and max(x for x, _ in points.values()) == 1 and abs(points[9][0] - points[0][0]) == 1


def test_vectors(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    top = V.vector_topk(e.where("vec_id = 0"), e, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in top] == [1, 2, 3] and top[-1]["similarity"] is None
    a, b = (spark.createDataFrame(x, "k int, rank int") for x in ([(1, 1), (2, 2)], [(2, 1)]))
    fused = V.rrf_fuse(a, b, "k").collect()
    assert [r["k"] for r in fused] == [2, 1] and fused[1]["fused"] == round((1 / 61 + 1 / 81) * 1000, 4)
    assert V.rrf_fuse(a, None, "k", limit=1).first()["k"] == 1
    assert [r["k"] for r in V.rrf_fuse(a, b, "k", embedded=a.where("k = 1")).collect()] == [1]
    with pytest.raises(ValueError):
        V.clusters_for(2)
    was, V.QUERY_BLOCK = V.QUERY_BLOCK, 1
    assert V.similarities(e, e).count() == 12
    V.QUERY_BLOCK = was


def test_streams_agree_with_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = events.withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.to_date("ts").alias("day")
    cases = {
        "trend": (alerts.trend_stream(stream, "ts", "event_type").select(F.to_date("start").alias("day"), "event_type", "n"), "complete", batch.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"))),
        "state": (alerts.latest_state_stream(stream, "user_id", "event_type", "ts"), "complete", alerts.latest_state_stream(batch, "user_id", "event_type", "ts")),
        "alerts": (alerts.alerts_stream(stream, "user_id", "ts").select("user_id", "day"), "append", batch.select("user_id", day).distinct()),
    }
    for name, (df, mode, want) in cases.items():
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert rows(spark.table(name)) == rows(want.select(*df.columns))


def test_idle_states_leave(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    first = [(1, "a", start), (1, "b", start + timedelta(hours=1)), (2, "c", start)]
    later = [(3, "d", start + timedelta(days=30))]
    schema = "k int, s string, ts timestamp"
    for part in (first, later, [(4, "e", start + timedelta(days=31))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df = alerts.latest_state_stream(stream, "k", "s", "ts", idle="5 days", delay="1 day")
    q = df.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("idle")) == [(1, "b", first[1][2]), (2, "c", start)]


def test_records(spark, tmp_path):
    assert spark.sql("SELECT '[1.5, 2]' v").select(K.parse_vector(F.col("v"))).first()[0] == [1.5, 2.0]
    pairs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "k string, v string")
    assert K.config_map(pairs, "k", "v").first()["config"] == {"a": "2", "b": "3"}
    nested = spark.createDataFrame([(1, [("x", 5), ("y", 6)]), (2, []), (3, None)], "id int, found array<struct<kind:string,n:int>>")
    assert rows(K.explode_analysis(nested, ["id"], "found")) == [(1, 1, "x", 5), (1, 2, "y", 6), (2, None, None, None), (3, None, None, None)]
    K.write_snapshot(pairs, str(tmp_path / "snap"), {"made": "today"})
    K.write_snapshot(pairs.limit(1), str(tmp_path / "snap"), {"made": "later"})
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1 and spark.read.parquet(str(tmp_path / "snap_meta")).first()["made"] == "later"
    for _ in range(2):
        K.append_log(pairs.where("k = 'b'"), str(tmp_path / "log"), ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "log"))) == [("b", '{"v":"3"}')] * 2
