"""Stems by published examples, the inverted index by brute force."""

import math
import re

import duckdb
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from casewright.functions.stemming import stem
from casewright.operators import search_index as S
from casewright.operators.text import STOP_WORDS, runs_of, text_rank
from casewright.plans import corpus
from casewright.sources.store import scratch_folder

#: Words and stems of the published sample.
STEMS = """cheque chequ|chequera chequer|cheques chequ|chesca chesc|chetumal chetumal|chica chic|chicago chicag|chicas chic|chicharrones chicharron|chichimecas chichimec|chicles chicl|chico chic
torá tor|tórax torax|torcer torc|toreado tor|toreándolo tor|torear tor|toreara tor|torearlo tor|toreo tore|torero torer|toreros torer|tormenta torment|tornado torn|torneo torne
derechos derech|derecho derech|petición peticion|peticiones peticion|rápidamente rapid|nacionalidad nacional|biología biolog|consecuencia consecuent|constituyendo constitu|sí si|de de|a a|obligaciones oblig""".replace("\n", "|").split("|")  # fmt: skip


@pytest.mark.parametrize("pair", STEMS)
def test_stems(pair):
    word, expected = pair.split(" ")
    assert stem(word) == expected


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w and w not in STOP_WORDS]


def by_scan(docs, queries, stems):
    of = (lambda w: stem(w)) if stems else (lambda w: w)
    out = []
    for q, asked in queries:
        terms = {of(w) for w in words(asked)}
        for i, text in docs:
            held = [of(w) for w in words(text)]
            if terms and terms <= set(held):
                out.append((q, i, round(min(1.0, sum(h in terms for h in held) / (1 + math.log(len(held)))), 9)))
    return sorted(out)


DOCS = [(1, "El derecho de petición y los derechos"), (2, "peticiones del derecho"), (3, None), (4, "de la"), (5, "Derecho " * 50), (6, "otra cosa, otra-cosa"), (7, ""), (2, "peticiones del derecho")]
QUERIES = [(1, "derechos"), (2, "petición derecho"), (3, "  de la "), (4, None), (5, "cosa otra cosa"), (6, "ausente derecho"), (7, "DERECHO")]


@pytest.mark.parametrize("stems", [False, True])
@pytest.mark.parametrize("few", [200_000, 0])
def test_index_equals_scan(spark, monkeypatch, stems, few):
    monkeypatch.setattr(S, "FEW_TERMS", few)
    docs = spark.createDataFrame(DOCS[:-1], "id long, text string")
    folder = scratch_folder(spark)
    S.write_index(docs, folder, "id", F.col("text"), stems)
    got = S.search_index(spark, folder, spark.createDataFrame(QUERIES, "q long, asked string"), "id", "q", F.col("asked"), stems)
    assert sorted((r["query"], r["id"], round(r["rank"], 9)) for r in got.collect()) == by_scan(DOCS[:-1], QUERIES, stems)


def test_hundred_queries_over_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("lang = 'es'").limit(60).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs if re.fullmatch(r"[\w\W]*", r["text"] or "") and r["text"]]
    queries = [(k, " ".join(words(t)[:2])) for k, (_, t) in enumerate(rows)] * 2
    queries = [(k, q) for k, (_, q) in enumerate(queries)]
    folder = scratch_folder(spark)
    S.write_index(spark.createDataFrame(rows, "id long, text string"), folder, "id", F.col("text"))
    got = S.search_index(spark, folder, spark.createDataFrame(queries, "q long, asked string"), "id", "q", F.col("asked"))
    assert sorted((r["query"], r["id"], round(r["rank"], 9)) for r in got.collect()) == by_scan(rows, queries, True)


def test_text_is_not_read_at_query_time(spark):
    docs = spark.createDataFrame(DOCS[:-1], "id long, text string")
    folder = scratch_folder(spark)
    S.write_index(docs, folder, "id", F.col("text"))
    got = S.search_index(spark, folder, spark.createDataFrame(QUERIES, "q long, asked string"), "id", "q", F.col("asked"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "text#" not in plan.split("FileScan")[1].split("\n")[0]


def test_runs_and_ranks(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "id int, w array<string>")
    got = {r["id"]: r["r"] for r in df.select("id", runs_of(F.array_sort("w")).alias("r")).collect()}
    assert got[1] == [("a", 1), ("b", 2)] and got[2] == [] and got[3] is None and got[4] == [("x", 1)]
    docs = spark.createDataFrame(DOCS, "id long, text string")
    assert sorted((r["id"], round(r["rank"], 9)) for r in text_rank(docs, "id", F.col("text"), ["derecho", "peticiones"]).collect()) == [(i, r) for _, i, r in by_scan(DOCS, [(0, "derecho peticiones")], False)]


def test_queries_of_equal_terms_meet_each_block_of_postings_once(spark, monkeypatch):
    """What Python works on follows documents and distinct sets of terms, not documents times queries."""
    monkeypatch.setattr(S, "POSTINGS", 3)
    monkeypatch.setattr(S, "SETS", 2)
    queries = [(k, QUERIES[k % 7][1]) for k in range(70)]
    docs, folder = spark.createDataFrame(DOCS[:-1], "id long, text string"), scratch_folder(spark)
    lists = S.postings(docs.coalesce(1), "id", F.col("text"))
    assert lists.count() < lists.select(F.explode("postings")).count()
    S.write_index(docs, folder, "id", F.col("text"))
    got = S.search_index(spark, folder, spark.createDataFrame(queries, "q long, asked string"), "id", "q", F.col("asked"))
    assert sorted((r["query"], r["id"], round(r["rank"], 9)) for r in got.collect()) == by_scan(DOCS[:-1], queries, True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate(keys=[query" not in plan


def test_words_after_the_beginning_of_a_text_are_found_and_counted(spark, tmp_path):
    """FINDINGS_r04, F1: only the first 2,000 characters of a text were indexed."""
    rows = [(100, "gatos perros", "es", "web"), (1, "gato " + "casa " * 3000 + "perro", None, None), (2, "x" * 5000 + " perro gato gato", "es", "web"), (3, "gato " * 900, "es", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, corpus.stemmed_text_ranks(spark, str(tmp_path)).collect()))
    whole = [(i, " ".join(filter(None, (kind, category, text)))) for i, text, category, kind in rows]
    assert got == [(q, i, round(r * 1e6)) for q, i, r in by_scan(whole, [(100, "gatos perros")], True)]
    assert [i for _, i, _ in got] == [1, 2, 100]


def test_stems_of_all_words_of_all_files(spark):
    """The query on a whole table against a scan of every word of every text, split by DuckDB."""
    split = "regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+')"
    files = duckdb.sql(f"SELECT doc_id, {split.format('text')}, {split.format('concat_ws(chr(32), source, lang, text)')}, length(text) FROM '{MEDIUM}/documents.parquet'").fetchall()
    kept = lambda words: [w for w in words or [] if w and w not in STOP_WORDS]
    stems = {i: [stem(w) for w in kept(words)] for i, _, words, _ in files}
    asked = {i: {stem(w) for w in kept(words)[:2]} for i, words, _, _ in files if i % 100 == 0}
    rank = lambda held, terms: round(min(1.0, sum(h in terms for h in held) / (1 + math.log(len(held)))) * 1e6)
    want = sorted((q, i, rank(held, terms)) for q, terms in asked.items() if terms for i, held in stems.items() if terms <= set(held))
    assert want and max(n or 0 for *_, n in files) > 2000
    assert sorted(map(tuple, corpus.stemmed_text_ranks(spark, MEDIUM).collect())) == want


@pytest.mark.parametrize("size", [1, 2, 4000])
def test_blocks_of_documents_have_one_list_a_term_and_each_length_once(spark, monkeypatch, size):
    monkeypatch.setattr(S, "FEW_DOCUMENTS", size)
    monkeypatch.setattr(S, "POSTINGS", 3)
    docs, folder = spark.createDataFrame(DOCS[:-1], "id long, text string").coalesce(1), scratch_folder(spark)
    lists = S.postings(docs, "id", F.col("text")).collect()
    assert len({(r["term"], r["block"]) for r in lists}) == len(lists)
    lengths = sorted(x for r in lists if r["term"] == S.LENGTHS for x in zip(r["postings"], r["hits"]))
    assert lengths == sorted((i, len(words(t))) for i, t in DOCS[:-1] if words(t))
    S.write_index(docs, folder, "id", F.col("text"))
    got = S.search_index(spark, folder, spark.createDataFrame(QUERIES, "q long, asked string"), "id", "q", F.col("asked"))
    assert sorted((r["query"], r["id"], round(r["rank"], 9)) for r in got.collect()) == by_scan(DOCS[:-1], QUERIES, True)
