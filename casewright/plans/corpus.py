"""Text, retrieval, cluster and stream-twin queries over files, embeddings, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import cluster_model as M
from casewright.operators import relational as R
from casewright.operators import search_index as S
from casewright.operators import text as X
from casewright.operators import vector_index as I
from casewright.operators import vectors as V
from casewright.plans.registry import query
from casewright.sources import tables as T
from casewright.sources.store import scratch_folder, stored
from casewright.sources.tables import with_tables

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_STATISTIC = ", ".join(f"'{w}'" for w in X.STATISTIC_STOP_WORDS)
_TOKENS = f", tok AS (SELECT file_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS word FROM files), tokens AS (SELECT * FROM tok WHERE word NOT IN ({_STOP}))"


@query(with_tables(_TOKENS + ", p AS (SELECT word, file_id, count(*) AS n FROM tokens WHERE length(word) > 4 AND word NOT IN (" + _STATISTIC + ") GROUP BY 1, 2) SELECT word, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM p GROUP BY 1 ORDER BY documents DESC, occurrences DESC, word LIMIT 24", "files"))
def top_terms(spark, folder) -> DataFrame:
    return X.term_stats(T.files(spark, folder), F.col("text"), 24, X.STOP_WORDS + X.STATISTIC_STOP_WORDS)


@query(with_tables(_TOKENS + " SELECT file_id, CAST(least(1.0, count(*) FILTER (word IN ('the', 'tion')) / (1 + ln(count(*)))) * 1000000 AS BIGINT) AS rank_millionths FROM tokens GROUP BY 1 HAVING count(DISTINCT CASE WHEN word IN ('the', 'tion') THEN word END) = 2", "files"))
def text_rank(spark, folder) -> DataFrame:
    r = X.text_rank(T.files(spark, folder), "file_id", F.col("text"), ["the", "tion"])
    return r.select("file_id", F.round(F.col("rank") * 1000000).cast("long").alias("rank_millionths"))


@query(with_tables("SELECT sha256(text) AS content_hash, min(file_id) AS first_id, count(*) AS copies FROM files WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "files"))
def duplicate_files(spark, folder) -> DataFrame:
    return X.hash_dedup(T.files(spark, folder).where("text is not null"), "file_id", "text")


@query(with_tables("SELECT file_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(token|license)($|[^\\p{L}\\p{N}])') THEN 'tecnico' WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(the|and)($|[^\\p{L}\\p{N}])') THEN 'ingles' WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(que|los)($|[^\\p{L}\\p{N}])') THEN 'espanol' END AS keyword_class FROM files", "files"))
def keyword_classes(spark, folder) -> DataFrame:
    return X.classify_keywords(T.files(spark, folder), "text", [("tecnico", ["token", "license"]), ("ingles", ["the", "and"]), ("espanol", ["que", "los"])]).select("file_id", "keyword_class")


@query(with_tables("SELECT file_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)[#*$%&]{3}', '', 'g'), '(?i)token = \"[0-9a-f]+\"', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS clean FROM files", "files"))
def cleaned_files(spark, folder) -> DataFrame:
    return T.files(spark, folder).select("file_id", X.clean_text(F.col("text"), [r"[#*$%&]{3}", r'token = "[0-9a-f]+"']).alias("clean"))


@query()
def file_chunks(spark, folder) -> DataFrame:
    """Overlapping chunks of 1,500 characters with 300 of overlap; paragraphs are lines here."""
    return X.chunk_documents(T.files(spark, folder), "file_id", "text", 1500, 300, r"\n")


_LISTED = "string_agg(CASE conv_id % 3 WHEN 0 THEN (turn + 1) || '.- ' || text || chr(10) || 'fin' WHEN 1 THEN CASE turn WHEN 0 THEN 'Primero: ' WHEN 1 THEN 'SEGUNDO. ' WHEN 2 THEN 'tercero ' WHEN 3 THEN 'Cuarto: ' WHEN 4 THEN 'Quinto: ' ELSE 'Sexto: ' END || text ELSE text END, chr(10) ORDER BY turn)"


@query(with_tables(f""", m AS (SELECT * FROM messages WHERE turn < 6 AND text IS NOT NULL AND trim(text, ' ' || chr(10) || chr(9)) <> ''), t AS (SELECT conv_id, count(*) AS n, {_LISTED} AS whole FROM m GROUP BY 1),
    p AS (SELECT m.conv_id, n, whole, text, turn, row_number() OVER (PARTITION BY m.conv_id ORDER BY turn) AS number FROM m JOIN t ON m.conv_id = t.conv_id)
    SELECT conv_id, count(*) AS requests FROM (SELECT conv_id, number FROM p WHERE n >= 2 AND conv_id % 3 < 2 UNION ALL SELECT DISTINCT conv_id, 1 FROM p WHERE n < 2 OR conv_id % 3 = 2) GROUP BY 1""", "messages"))
def conversation_requests(spark, folder) -> DataFrame:
    """How many requests the petition has that a conversation's turns make: numbered, by ordinals, or none of both."""
    return X.split_requests(_listed(spark, folder), "conv_id", "whole").groupBy("conv_id").agg(F.count(F.lit(1)).alias("requests"))


def _listed(spark, folder) -> DataFrame:
    m = T.messages(spark, folder).where("turn < 6 and trim(regexp_replace(text, r'[\\s]+', ' ')) <> ''")
    ordinal = F.element_at(F.array(*(F.lit(x) for x in ("Primero: ", "SEGUNDO. ", "tercero ", "Cuarto: ", "Quinto: ", "Sexto: "))), (F.col("turn") + 1).cast("int"))
    part = F.when(F.col("conv_id") % 3 == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit(".- "), "text", F.lit("\nfin"))).when(F.col("conv_id") % 3 == 1, F.concat(ordinal, "text")).otherwise(F.col("text"))
    return m.select("conv_id", "turn", part.alias("part")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("whole"))


@query(with_tables(f", m AS (SELECT * FROM messages WHERE turn < 6 AND text IS NOT NULL AND trim(text, ' ' || chr(10) || chr(9)) <> '' AND conv_id % 3 = 0), n AS (SELECT conv_id, count(*) AS n FROM m GROUP BY 1) SELECT m.conv_id, CAST(row_number() OVER (PARTITION BY m.conv_id ORDER BY turn) AS INTEGER) AS number, row_number() OVER (PARTITION BY m.conv_id ORDER BY turn) || '.' AS label, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\n{{3,}}', chr(10) || chr(10), 'g') || chr(10) || 'fin' AS request FROM m JOIN n ON m.conv_id = n.conv_id WHERE n >= 2", "messages"))
def numbered_requests(spark, folder) -> DataFrame:
    """Numbered requests with all their lines."""
    listed = _listed(spark, folder).where("conv_id % 3 = 0")
    found = X.split_requests(listed, "conv_id", "whole")
    several = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("conv_id")
    return found.join(several, "conv_id", "left_semi")


_NEWLINES = "chr(10) || chr(10)"
_HTML_SQL = "html"
for _pattern, _new in X.HTML:
    _to = _NEWLINES if _new == "\n\n" else "chr(10) || '• '" if _new == "\n• " else "chr(10)" if _new == "\n" else f"'{_new}'"
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_pattern}', {_to}, 'g')"
_LAYOUT_SQL = "text"
for _pattern, _new in X.LAYOUT[1:]:
    _to = {"\n": "chr(10)", "\n\n": _NEWLINES, "$1 $2": "'\\1 \\2'", "$1\n\n$2": "'\\1' || chr(10) || chr(10) || '\\2'"}.get(_new, f"'{_new}'")
    _LAYOUT_SQL = f"regexp_replace({_LAYOUT_SQL}, '{_pattern}', {_to}, 'g')"


@query(f"SELECT page_id, {_HTML_SQL} AS text FROM pages")
def page_texts(spark, folder) -> DataFrame:
    return T.read(spark, folder, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(with_tables(f"SELECT file_id, {_LAYOUT_SQL} AS text FROM files WHERE text IS NOT NULL", "files"))
def repaired_files(spark, folder) -> DataFrame:
    return T.files(spark, folder).where("text is not null").select("file_id", X.repair_layout(F.col("text")).alias("text"))


@query()
def version_changes(spark, folder) -> DataFrame:
    """Change events between each page's text and its file's text with the same id, paragraph by paragraph."""
    pages = T.read(spark, folder, "pages").select(F.col("page_id").alias("file_id"), X.html_to_text(F.col("html")).alias("old"))
    pairs = pages.join(T.files(spark, folder).select("file_id", F.col("text").alias("new")), "file_id")
    return X.group_changes(X.diff_pairs(pairs, "file_id", "old", "new"), "file_id")


@query(with_tables("SELECT file_id, 'MODIFICACIÓN' AS change, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS old_text, 'Objeto nuevo.' AS new_text FROM files WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND file_id % 2 = 0 UNION ALL SELECT file_id, 'ADICIÓN', NULL, 'Anexo 1.' FROM files WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND file_id % 2 = 1", "files"))
def clause_changes(spark, folder) -> DataFrame:
    """Versions with a replaced body (one change, however many paragraphs) or an added annex, whose clause head opens a paragraph."""
    f = T.files(spark, folder).select("file_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("body")).where("body <> ''")
    head, tail = F.lit("Contrato 1\n\n"), F.lit("\n\nFirmas")
    new = F.when(F.col("file_id") % 2 == 0, F.concat(head, F.lit("Objeto  nuevo."), tail)).otherwise(F.concat(F.upper(head), "body", tail, F.lit("\nAnexo 1.")))
    pairs = f.select("file_id", F.concat(head, "body", tail).alias("old"), new.alias("new"))
    return X.group_changes(X.diff_pairs(pairs, "file_id", "old", "new"), "file_id").select("file_id", "change", "old_text", "new_text")


@query("SELECT doc_id AS file_id, text, CAST(1 AS INTEGER) AS matched FROM documents WHERE text IS NOT NULL AND text LIKE left(text, 3) || '%' AND doc_id >= 0")
def rebuilt_files(spark, folder) -> DataFrame:
    """Texts cut into lines and put together again, with the first line that matches its own beginning."""
    d = T.read(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("pos", "chunk"))
    out = X.rebuild_document(d.select("file_id", (F.col("pos") + 1).alias("number"), "chunk"), "file_id", "")
    return out.select("file_id", "text", "matched")


@query(with_tables("SELECT kind, CAST(file_id AS BIGINT) AS file_id, CAST((row_number() OVER (PARTITION BY kind ORDER BY file_id) - 1) // 3 AS BIGINT) AS batch FROM files", "files"))
def fixed_batches(spark, folder) -> DataFrame:
    """Three files of a kind in a batch.

    A kind's files are numbered in ranges of 4,096 ids, whose sizes are added up before, so no task takes a whole kind.
    """
    from pyspark.sql import Window

    f = T.files(spark, folder).select("kind", "file_id", F.expr("file_id div 4096").alias("range"))
    sizes = f.groupBy("kind", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    at = F.row_number().over(Window.partitionBy("kind", "range").orderBy("file_id"))
    numbered = f.withColumn("at", at).join(sizes.select(F.col("kind").alias("_kind"), F.col("range").alias("_range"), before.alias("before")), F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("range") == F.col("_range")))
    return numbered.select("kind", "file_id", F.expr("(before + at - 1) div 3").alias("batch"))


@query()
def prompt_batches(spark, folder) -> DataFrame:
    """Greedy batches of each conversation's turns under a budget of characters."""
    m = T.messages(spark, folder).select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return X.pack_batches(m, "conv_id", "turn", "chars", 400)


@query(
    with_tables(
        """, q AS (SELECT case_id, string_agg(line || '. ' || state, chr(10) ORDER BY line, state) AS listed FROM requests WHERE priority = 'Alta' GROUP BY 1), a AS (SELECT case_id, count(*) AS n FROM actions GROUP BY 1)
        SELECT c.case_id, concat_ws(chr(10) || chr(10), 'Radicado: ' || c.case_id || chr(10) || 'Materia: ' || invoked_right, 'Solicitudes:' || chr(10) || listed, CASE ruling WHEN 'Favorable' THEN 'Precedente favorable' WHEN 'Desfavorable' THEN 'ALERTA: precedente desfavorable' END, CASE WHEN n > 2 THEN 'Actuaciones: ' || n END) AS prompt
        FROM cases c LEFT JOIN q ON q.case_id = c.case_id LEFT JOIN a ON a.case_id = c.case_id""",
        "cases", "requests", "actions",
    )
)
def case_prompts(spark, folder) -> DataFrame:
    """A prompt a case of its sections; sections without content are left out."""
    asked = T.requests(spark, folder).where("priority = 'Alta'").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("line", "state"))).alias("xs"))
    listed = F.array_join(F.transform("xs", lambda x: F.concat(x["line"].cast("string"), F.lit(". "), x["state"])), "\n")
    n = T.actions(spark, folder).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    c = T.cases(spark, folder).join(asked, "case_id", "left").join(n, "case_id", "left")
    sections = [
        F.concat(F.lit("Radicado: "), F.col("case_id").cast("string"), F.lit("\nMateria: "), "invoked_right"),
        F.concat(F.lit("Solicitudes:\n"), listed),
        F.when(F.col("ruling") == "Favorable", "Precedente favorable").when(F.col("ruling") == "Desfavorable", "ALERTA: precedente desfavorable"),
        F.when(F.col("n") > 2, F.concat(F.lit("Actuaciones: "), F.col("n").cast("string"))),
    ]
    return X.assemble_prompts(c, "case_id", sections)


@query(with_tables("SELECT m.conv_id, string_agg(kind || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM messages m GROUP BY 1", "messages"))
def assembled_prompts(spark, folder) -> DataFrame:
    m = T.messages(spark, folder).select("conv_id", "turn", F.concat("kind", F.lit(": "), "text").alias("part"))
    joined = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("turn", "part"))))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(joined, lambda x: x["part"]), "\n").alias("prompt"))


_COS = """list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"""
_SIM = f"round({_COS.format(a='q.embedding', b='e.embedding')} / (sqrt({_COS.format(a='q.embedding', b='q.embedding')}) * sqrt({_COS.format(a='e.embedding', b='e.embedding')})), 4)"


@query(f"SELECT query, vec_id, similarity, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC NULLS LAST, vec_id) AS k FROM (SELECT q.vec_id AS query, e.vec_id, {_SIM} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)) WHERE k <= 5")
def similar_files(spark, folder) -> DataFrame:
    """The five nearest embeddings of each query (every hundredth id) by cosine."""
    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding")
    return V.vector_topk(e.where("vec_id % 100 = 0"), e, 5).select("query", "vec_id", "similarity", "rank")


@query()
def similar_files_indexed(spark, folder) -> DataFrame:
    """The same by an inverted-file index that is written, read back and searched in the lists that were measured to hold 95 % of neighbours."""
    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding")
    return I.search_index(spark, I.scratch_index(e), e.where("vec_id % 100 = 0"), 5).select("query", "vec_id", "similarity", "rank")


@query("SELECT CAST(count(*) * 5 AS BIGINT) AS neighbours, TRUE AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, folder) -> DataFrame:
    """Whether the index finds nine tenths of all true neighbours of every hundredth vector."""
    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 100 = 0")
    found, true = I.search_index(spark, I.scratch_index(e), asked, 5), stored(V.vector_topk(asked, e, 5).select("query", "vec_id"))
    both = true.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query(
    with_tables(
        f""", w AS (SELECT file_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP})) AS words FROM files),
        q AS (SELECT file_id AS query, list_distinct(words[1:2]) AS terms FROM w WHERE file_id % 100 = 0 AND len(words) > 0),
        t AS (SELECT file_id, words, len(words) AS n FROM w WHERE len(words) > 0)
        SELECT query, file_id, CAST(least(1.0::DOUBLE, len(list_filter(words, lambda x: list_contains(terms, x)))::DOUBLE / (1 + ln(n))) * 1000000 AS BIGINT) AS rank_millionths
        FROM q, t WHERE list_has_all(words, terms)""",
        "files",
    )
)
def indexed_text_ranks(spark, folder) -> DataFrame:
    """Text ranks of all files for many queries at once, by the inverted index: the first two words of every hundredth file."""
    f = T.files(spark, folder).select("file_id", "text")
    return _by_index(spark, f, stems=False)


@query()
def stemmed_text_ranks(spark, folder) -> DataFrame:
    """The same over title, category and the whole text as one searchable text, with words of one Spanish stem as one term."""
    f = T.file_texts(spark, folder)
    whole = f.select("file_id", X.searchable(f, ["kind", "category"], "text").alias("text"))
    return _by_index(spark, whole, stems=True, asked_of=f)


def _by_index(spark, files: DataFrame, stems: bool, asked_of: DataFrame | None = None) -> DataFrame:
    """Writes the index of file_id and text and asks it for the first two words of every hundredth file's text."""
    index = scratch_folder(spark)
    S.write_index(files, index, "file_id", F.col("text"), stems)
    asked = (files if asked_of is None else asked_of).where("file_id % 100 = 0").select("file_id", F.concat_ws(" ", F.slice(X.words_of(F.col("text")), 1, 2)).alias("asked"))
    found = S.search_index(spark, index, asked, "file_id", "file_id", F.col("asked"), stems)
    return found.select("query", "file_id", F.round(F.col("rank") * 1000000).cast("long").alias("rank_millionths"))


#: The words that stand for the text of every query vector.
_ASKED = ["the", "tion"]
_STOPPED = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_RANKED = f"""w AS (SELECT file_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({_STOPPED})) AS words FROM files),
    r AS (SELECT file_id, CASE WHEN list_contains(words, 'the') AND list_contains(words, 'tion') THEN least(1.0::DOUBLE, len(list_filter(words, lambda x: x IN ('the', 'tion')))::DOUBLE / (1 + ln(len(words)))) ELSE 0 END AS rank FROM w)"""
@query(
    with_tables(
        f""", {_RANKED}, q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 100 = 0),
        t AS (SELECT file_id AS vec_id, row_number() OVER (ORDER BY rank DESC, file_id) AS place FROM (SELECT file_id, CAST(round(rank * 1000000) AS BIGINT) AS rank FROM r WHERE rank > 0 AND file_id IN (SELECT vec_id FROM embeddings)) ORDER BY rank DESC, file_id LIMIT 20),
        v AS (SELECT * FROM (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY similarity DESC NULLS LAST, vec_id) AS place FROM (SELECT q.query, e.vec_id, {_SIM} AS similarity FROM embeddings e, q WHERE e.vec_id <> q.query)) WHERE place <= 20),
        x AS (SELECT q.query, t.vec_id, t.place FROM t, q WHERE t.vec_id <> q.query),
        f AS (SELECT coalesce(v.query, x.query) AS query, coalesce(v.vec_id, x.vec_id) AS vec_id, round((1.0::DOUBLE / (60 + coalesce(v.place, 21)) + 1.0::DOUBLE / (60 + coalesce(x.place, 21))) * 1000, 4) AS fused FROM v FULL JOIN x ON v.query = x.query AND v.vec_id = x.vec_id)
        SELECT query, vec_id, fused FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, vec_id) AS k FROM f) WHERE k <= 10""",
        "files",
    )
)
def fused_ranking(spark, folder) -> DataFrame:
    """For every hundredth vector, reciprocal-rank fusion of its 20 nearest vectors and the 20 best files by text rank."""
    from pyspark.sql import Window

    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = e.where("vec_id % 100 = 0")
    near = V.vector_topk(queries, e, 20).select("query", "vec_id", "rank")
    ranks = X.text_rank(T.files(spark, folder), "file_id", F.col("text"), _ASKED).select(F.col("file_id").alias("vec_id"), F.round(F.col("rank") * 1000000).cast("long").alias("text_rank"))
    best = ranks.join(e.select("vec_id"), "vec_id", "left_semi").orderBy(F.desc("text_rank"), "vec_id").limit(20)
    placed = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("text_rank"), "vec_id"))).select("vec_id", "rank")
    text = queries.select(F.col("vec_id").alias("query")).crossJoin(placed).where("query <> vec_id")
    return V.rrf_fuse(near, text, "vec_id", embedded=e, query="query").select("query", "vec_id", "fused")


@query(with_tables("SELECT kind, risk, count(*) AS n FROM files WHERE risk IS NOT NULL GROUP BY 1, 2", "files"))
def risk_distribution(spark, folder) -> DataFrame:
    return R.distribution(T.files(spark, folder), "kind", "risk").select("kind", F.explode("distribution").alias("risk", "n"))


@query()
def cluster_map(spark, folder) -> DataFrame:
    """Clusters of all embeddings by size, with their medoids."""
    _, profile = V.cluster(T.read(spark, folder, "embeddings"))
    return profile.orderBy(F.desc("size"), "cluster")


@query("SELECT vec_id, TRUE AS placed FROM embeddings")
def stored_clusters(spark, folder) -> DataFrame:
    """All embeddings placed by a stored model that was fitted on nine tenths of them: cluster, distance and map are there for each."""
    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding")
    model = scratch_folder(spark)
    M.fit_model(e.where("vec_id % 10 <> 0"), model)
    found = M.assign(spark, model, e)
    return found.select("vec_id", (F.col("cluster").between(0, 6) & (F.col("distance") >= 0) & F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed"))


@query()
def cluster_members(spark, folder) -> DataFrame:
    """The members of each cluster with their distances."""
    placed, _ = V.cluster(T.read(spark, folder, "embeddings"))
    return placed.select("cluster", "vec_id", "distance")


@query()
def cluster_distributions(spark, folder) -> DataFrame:
    """Types and risks of the files in each cluster."""
    placed, _ = V.cluster(T.read(spark, folder, "embeddings"))
    return V.cluster_mix(placed, T.files(spark, folder).withColumnRenamed("file_id", "vec_id"), "vec_id", ["kind", "risk"])


@query()
def embedding_points(spark, folder) -> DataFrame:
    return V.project_2d(T.read(spark, folder, "embeddings"))


@query(with_tables("SELECT file_id, CAST(coalesce(sum(delta), 0) AS BIGINT) AS feedback, coalesce(sum(delta), 0) > -5 AS useful FROM files f LEFT JOIN (SELECT event_id // 10 AS ref, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS delta FROM events) v ON f.file_id = v.ref GROUP BY 1", "files"))
def applied_feedback(spark, folder) -> DataFrame:
    """Votes of plus or minus one summed onto files; -5 and below marks a file as not useful."""
    votes = T.read(spark, folder, "events").select(F.expr("event_id div 10").alias("file_id"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("delta"))
    total = votes.groupBy("file_id").agg(F.sum("delta").alias("feedback"))
    out = T.files(spark, folder).select("file_id").join(total, "file_id", "left").withColumn("feedback", F.coalesce("feedback", F.lit(0).cast("long")))
    return out.withColumn("useful", F.col("feedback") > -5)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_trend(spark, folder) -> DataFrame:
    """Batch twin of the windowed trend stream."""
    from casewright.streaming.alerts import trend_stream

    return trend_stream(T.read(spark, folder, "events"), "ts", "event_type").select(F.to_date("start").alias("day"), "event_type", "n")


@query("SELECT user_id, max_by(event_type, ts) AS state, max(ts) AS since FROM events GROUP BY 1")
def latest_state(spark, folder) -> DataFrame:
    """Batch twin of the current-state stream."""
    from casewright.streaming.alerts import latest_state_stream

    return latest_state_stream(T.read(spark, folder, "events"), "user_id", "event_type", "ts")


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def alert_days(spark, folder) -> DataFrame:
    """Batch twin of the alert stream: one row a user and day."""
    return T.read(spark, folder, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
