"""Knowledge search over chunks, alerts with memory, ingestion into known cases, keyword tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import prompts as S
from casewright.operators import records as K
from casewright.operators import text as X
from casewright.operators.keywords import classify_by_table
from casewright.plans.corpus import _ASKED, _RANKED, _SIM
from casewright.plans.records import _PETITION, _STEPS, _VOTES, _petitions, _voted
from casewright.plans.registry import query
from casewright.sources import tables as T
from casewright.sources.store import KeyedTable, scratch_folder, stored
from casewright.sources.tables import with_tables

_CHUNKS = f"""{_RANKED}, c AS (SELECT e.vec_id, e.vec_id // 4 AS document_id, v.category, v.feedback, coalesce(f.risk <> 'Alto', TRUE) AS successful, coalesce(r.rank, 0) AS rank, coalesce(m.embedding, e.embedding) AS embedding
        FROM embeddings e JOIN votes v ON v.file_id = e.vec_id JOIN files f ON f.file_id = e.vec_id LEFT JOIN r ON r.file_id = e.vec_id LEFT JOIN embeddings m ON m.vec_id = (e.vec_id // 4) * 4 + 1 AND (e.vec_id // 4) % 3 = 0),
    b AS (SELECT * FROM c WHERE successful QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY rank DESC, vec_id) = 1),
    s AS (SELECT q.vec_id AS query, e.document_id, e.vec_id, e.category, round(0.55::DOUBLE * coalesce({_SIM}, 0) + 0.35::DOUBLE * e.rank + 0.10::DOUBLE * greatest(0, least(e.feedback, 10)) / 10, 4) AS score
        FROM b e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id)"""


@query(
    with_tables(
        f""", {_VOTES}, {_CHUNKS}, t AS (SELECT *, CASE WHEN category = 'es' THEN 0 ELSE 1 END AS tier FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query, tier ORDER BY score DESC, vec_id) AS place FROM t),
        d AS (SELECT * FROM (SELECT *, count(*) FILTER (tier = 0) OVER (PARTITION BY query) AS found FROM k WHERE place <= 5) WHERE tier = 0 OR found < 3)
        SELECT query, document_id, vec_id, category, score, CAST(tier AS INTEGER) AS tier FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, vec_id) <= 5""",
        "files",
    )
)
def knowledge_context(spark, folder) -> DataFrame:
    """The five best documents of a category for each query: successful chunks only, each document's best one, its comprehension vector where it has one.

    Four embeddings in a row are the chunks of a document; every third document has a comprehension vector, that of its second chunk.
    """
    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding")
    document = F.expr("vec_id div 4")
    ranks = X.text_rank(T.files(spark, folder), "file_id", F.col("text"), _ASKED).withColumnRenamed("file_id", "vec_id")
    facts = _voted(spark, folder).join(T.files(spark, folder).select("file_id", F.coalesce(F.col("risk") != "Alto", F.lit(True)).alias("successful")), "file_id").withColumnRenamed("file_id", "vec_id")
    second = e.where("vec_id % 4 = 1 and (vec_id div 4) % 3 = 0").select(document.alias("document_id"), F.col("embedding").alias("comprehension"))
    rows = e.withColumn("document_id", document).join(facts, "vec_id").join(ranks, "vec_id", "left").join(second, "document_id", "left").drop("kind")
    known = stored(K.understood_chunks(rows, "document_id", "vec_id").drop("comprehension"))
    best = K.best_with_topup(e.where("vec_id % 100 = 0"), known, "vec_id", F.col("category") == "es", 5, ["document_id", "category"])
    return best.select("query", "document_id", "vec_id", "category", "score", "tier")


def case_events(spark, folder) -> DataFrame:
    """How cases stand from a moment on: (key, owner, due, open, ts) from the event log."""
    e = T.read(spark, folder, "events")
    due = F.date_add(F.to_date("ts"), (F.col("event_id") % 6).cast("int"))
    return e.select((F.col("event_id") % 4000).alias("key"), F.when(F.col("event_id") % 29 != 0, F.col("user_id")).alias("owner"), due.alias("due"), (F.col("event_type") != "purchase").alias("open"), F.col("ts").cast("timestamp").alias("ts"))


@query(
    """WITH e AS (SELECT event_id % 4000 AS key, CASE WHEN event_id % 29 <> 0 THEN user_id END AS owner, CAST(CAST(ts AS DATE) + CAST(event_id % 6 AS INTEGER) AS DATE) AS due, event_type <> 'purchase' AS open, ts FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
    o AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS until FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY open, owner DESC NULLS LAST, due DESC) = 1)),
    d AS (SELECT key, owner, due, unnest(generate_series(greatest(CAST(ts AS DATE) + CASE WHEN date_trunc('day', ts) = ts THEN 0 ELSE 1 END, due - 3)::TIMESTAMP, least(CAST(until AS DATE) + CASE WHEN date_trunc('day', until) = until THEN 0 ELSE 1 END - 1, DATE '2024-02-03')::TIMESTAMP, INTERVAL 1 DAY)) AS day
        FROM o WHERE open AND owner IS NOT NULL AND due IS NOT NULL)
    SELECT key, owner, CAST(day AS DATE) AS day, CAST(date_diff('day', CAST(day AS DATE), due) AS INTEGER) AS days,
        CASE WHEN date_diff('day', CAST(day AS DATE), due) <= 0 THEN 'vence hoy o vencida' WHEN date_diff('day', CAST(day AS DATE), due) = 1 THEN 'vence mañana' ELSE 'vence en 3 días' END AS alert FROM d"""
)
def daily_alerts(spark, folder) -> DataFrame:
    """One alert a day for each open, owned case that is due within three days or overdue, up to a day: what the stateful stream tells."""
    from casewright.streaming import stateful

    return stateful.daily_alerts(case_events(spark, folder), "2024-02-03")


_INGESTED = f""", t AS (SELECT case_id, received, {_PETITION} AS p FROM cases), x AS (SELECT case_id, {_STEPS['docket']} AS d, p FROM t),
    k AS (SELECT CASE WHEN d = 'POR DEFINIR' THEN 'SIN-' || case_id % 997 ELSE d END AS docket, case_id, CASE WHEN p ILIKE '%token%' THEN 'tecnico' WHEN p ILIKE '%identificad%' THEN 'persona' END AS keyword_class FROM x),
    b AS (SELECT * FROM k WHERE case_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY docket ORDER BY case_id DESC) = 1),
    n AS (SELECT * FROM k WHERE case_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY docket ORDER BY case_id DESC) = 1)"""


def _ingest(spark, folder) -> KeyedTable:
    """A table of the cases that every third petition made, after the other petitions came in."""
    p = _petitions(spark, folder).withColumn("text", X.repair_layout(X.clean_text(F.col("text"), [r"[#*$%&]{3}"])))
    found = X.classify_keywords(X.extract_fields(p, "text"), "text", [("tecnico", ["token"]), ("persona", ["identificado", "identificada"])])
    docket = F.when(F.col("docket") == X.NO_DOCKET, F.concat(F.lit("SIN-"), (F.col("case_id") % 997).cast("string"))).otherwise(F.col("docket"))
    keyed = found.select(docket.alias("docket"), "case_id", "keyword_class")
    newest = lambda df: df.groupBy("docket").agg(F.max_by(F.struct("case_id", "keyword_class"), "case_id").alias("x")).select("docket", "x.*")
    table = KeyedTable(spark, scratch_folder(spark), "docket")
    table.create(newest(keyed.where("case_id % 3 = 0")))
    table.apply(newest(keyed.where("case_id % 3 <> 0")), 1, ["case_id", "keyword_class"])
    return table


@query(with_tables(_INGESTED + " SELECT docket, case_id, keyword_class FROM n UNION ALL SELECT docket, case_id, keyword_class FROM b WHERE docket NOT IN (SELECT docket FROM n)", "cases"))
def reingested_cases(spark, folder) -> DataFrame:
    """Petitions upserted into known cases by docket: some are updated, some added, others stay; only touched parts are rewritten."""
    return _ingest(spark, folder).read()


@query(
    with_tables(
        _INGESTED
        + """ SELECT n.docket, 'case_id' AS "column", CAST(b.case_id AS VARCHAR) AS before, CAST(n.case_id AS VARCHAR) AS after FROM n LEFT JOIN b ON n.docket = b.docket WHERE n.case_id IS DISTINCT FROM b.case_id
        UNION ALL SELECT n.docket, 'keyword_class', b.keyword_class, n.keyword_class FROM n LEFT JOIN b ON n.docket = b.docket WHERE n.keyword_class IS DISTINCT FROM b.keyword_class""",
        "cases",
    )
)
def ingestion_audit(spark, folder) -> DataFrame:
    """Every value that the same ingestion changed, before and after."""
    return _ingest(spark, folder).read_audit().select("docket", "column", "before", "after")


_WORDS = "SELECT file_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS words FROM files"


@query(
    with_tables(
        f""", w AS ({_WORDS}), u AS (SELECT file_id, unnest(words) AS word FROM w), k AS (SELECT DISTINCT word FROM u WHERE file_id % 5 = 0 AND regexp_full_match(word, '[a-z]{{7,}}'))
        SELECT file_id, min(length(word)) % 100 AS place FROM u JOIN k USING (word) GROUP BY 1""",
        "files",
    )
)
def classes_by_keyword_table(spark, folder) -> DataFrame:
    """The class of each file by a table of thousands of keywords: the longer words of every fifth file, shorter ones first."""
    f = T.files(spark, folder).select("file_id", "text")
    words = f.where("file_id % 5 = 0").select(F.explode(X.tokens(F.col("text"))).alias("keyword")).distinct().where("keyword rlike '^[a-z]{7,}$'")
    table = words.select("keyword", F.length("keyword").alias("place"), F.length("keyword").cast("string").alias("category"))
    return classify_by_table(f, "text", table, key="file_id").where("keyword_class is not null").select("file_id", (F.col("keyword_class").cast("long") % 100).alias("place"))


@query(with_tables("SELECT p.contract_id, p.line, p.amount, g.names FROM payments p LEFT JOIN (SELECT r.case_id, list_sort(list_distinct(list(g.group_name))) AS names FROM requests r JOIN groups g ON r.group_id = g.group_id GROUP BY 1) g ON p.contract_id = g.case_id WHERE p.asked >= DATE '1998-01-01'", "payments", "requests", "groups"))
def payments_with_groups(spark, folder) -> DataFrame:
    """Payments with all groups of their contract as one array of distinct names; the names come together before the join."""
    p = T.payments(spark, folder).where("asked >= date'1998-01-01'")
    named = T.requests(spark, folder).select("case_id", "group_id").join(T.groups(spark, folder).select("group_id", "group_name"), "group_id")
    names = named.groupBy(F.col("case_id").alias("contract_id")).agg(F.array_sort(F.collect_set("group_name")).alias("names"))
    return p.join(names, "contract_id", "left").select("contract_id", "line", "amount", "names")


@query(with_tables("SELECT entity_id, count(*) AS total, count(*) FILTER (state <> 'liberado') AS pending, CAST(sum(amount) AS DECIMAL(25,2)) AS amount FROM conformities GROUP BY 1", "conformities"))
def conformity_pending(spark, folder) -> DataFrame:
    """Conformities of each entity: all, those in any state but the final one, and their sum."""
    c = T.conformities(spark, folder)
    return c.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") != "liberado").alias("pending"), F.sum("amount").cast("decimal(25,2)").alias("amount"))


@query(
    """WITH l AS (SELECT doc_id AS file_id, text, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents WHERE text IS NOT NULL),
    m AS (SELECT file_id, left(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g'), 80) AS head FROM l WHERE number = 2)
    SELECT l.file_id, min(l.number) FILTER (starts_with(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g'), head)) AS matched, sha256(any_value(text)) AS text_sha256 FROM l JOIN m ON l.file_id = m.file_id GROUP BY 1"""
)
def rebuilt_matches(spark, folder) -> DataFrame:
    """Texts put together from their lines, with the first line that begins like the second one."""
    d = T.read(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("file_id"), F.split("text", "\n").alias("lines")).where("size(lines) > 1")
    chunks = d.select("file_id", F.col("lines")[1].alias("wanted"), F.posexplode("lines").alias("at", "chunk")).select("file_id", "wanted", "chunk", (F.col("at") + 1).cast("long").alias("number"))
    return X.rebuild_document(chunks, "file_id", F.col("wanted")).select("file_id", "matched", F.sha2("text", 256).alias("text_sha256"))


@query(
    with_tables(
        """, q AS (SELECT case_id, list(line || ' ' || state ORDER BY line, state) AS asked FROM requests GROUP BY 1),
        n AS (SELECT case_id, list({'title': 'Nota ' || line, 'content': priority} ORDER BY line, priority) AS notes FROM requests WHERE priority = 'Alta' GROUP BY 1),
        a AS (SELECT case_id, list(CASE WHEN weight <> 4 THEN {'kind': CASE WHEN action <> 'error' THEN action END, 'result': CASE weight WHEN 0 THEN 'desfavorable' WHEN 1 THEN 'referencia' ELSE 'favorable' END} END ORDER BY action_id) AS seen FROM actions GROUP BY 1),
        k AS (SELECT *, list_filter(seen, lambda p: p IS NOT NULL) AS known, list_transform(list_filter(seen, lambda p: p.result = 'favorable'), lambda p: coalesce(p.kind, 'General')) AS kinds FROM a),
        s AS (SELECT case_id, len(known) AS n, len(list_filter(known, lambda p: p.result = 'desfavorable')) AS against,
            array_to_string(list_transform(list_filter(list_transform(range(1, len(kinds) + 1), lambda i: {'i': i, 'k': kinds[i]}), lambda x: list_position(kinds, x.k) = x.i), lambda x: '  - ' || x.k || ': ' || len(list_filter(kinds, lambda y: y = x.k))), chr(10)) AS lines FROM k)
        SELECT c.case_id, concat_ws(chr(10) || chr(10),
            'Radicado: ' || c.case_id,
            CASE WHEN trim(court) <> '' THEN concat_ws(chr(10), 'ANÁLISIS', '  Tema: ' || court, '  Derechos: ' || invoked_right, '  Peticiones:' || chr(10) || array_to_string(list_transform(asked, lambda r, i: '    ' || i || '. ' || r), chr(10)), '  Extracto: ' || ruling) END,
            CASE WHEN s.n > 0 THEN concat_ws(chr(10), 'ESTRATEGIA', CASE WHEN s.lines <> '' THEN s.lines ELSE '  - sin precedentes favorables' END, CASE WHEN s.against > 0 THEN '  ALERTA desfavorables: ' || s.against END,
                '  Tono: ' || CASE lower(c.priority) WHEN 'alta' THEN 'breve y directo' WHEN 'baja' THEN 'extenso, con análisis normativo' ELSE 'institucional' END) END,
            'NOTAS' || chr(10) || array_to_string(list_transform(notes, lambda x: '  - ' || x.title || ': ' || x.content), chr(10))) AS prompt
        FROM cases c LEFT JOIN q ON q.case_id = c.case_id LEFT JOIN n ON n.case_id = c.case_id LEFT JOIN s ON s.case_id = c.case_id""",
        "cases", "requests", "actions",
    )
)
def case_prompt_sections(spark, folder) -> DataFrame:
    """A prompt a case with what its petition is about, what its precedents advise and its notes; actions stand for precedents."""
    r = T.requests(spark, folder)
    named = lambda df, name, *fields: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    asked, notes = named(r, "asked", "line", "state"), named(r.where("priority = 'Alta'"), "notes", "line", "priority")
    result = F.when(F.col("weight") == 0, "desfavorable").when(F.col("weight") == 1, "referencia").otherwise("favorable")
    told = F.when(F.col("weight") != 4, F.struct(F.when(F.col("action") != "error", F.col("action")).alias("kind"), result.alias("result")))
    seen = named(T.actions(spark, folder).select("case_id", "action_id", told.alias("precedent")), "seen", "action_id", "precedent")
    c = T.cases(spark, folder).join(asked, "case_id", "left").join(notes, "case_id", "left").join(seen, "case_id", "left")
    requests = F.transform("asked", lambda x: F.concat(x["line"].cast("string"), F.lit(" "), x["state"]))
    listed = F.transform("notes", lambda x: F.struct(F.concat(F.lit("Nota "), x["line"].cast("string")).alias("title"), x["priority"].alias("content")))
    sections = [
        F.concat(F.lit("Radicado: "), F.col("case_id").cast("string")), S.comprehension_section(F.col("court"), F.array("invoked_right"), requests, F.col("ruling")),
        S.strategy_section(F.transform("seen", lambda x: x["precedent"]), F.lower("priority")), S.titled_section("NOTAS", listed),
    ]
    return X.assemble_prompts(c, "case_id", sections)


@query(with_tables("SELECT case_id, court AS resolves, invoked_right AS kind, 'favorable' AS result, court || '. ' || invoked_right AS embedded FROM cases WHERE ruling = 'Favorable' AND trim(court) <> ''", "cases"))
def promoted_comprehension(spark, folder) -> DataFrame:
    """What the knowledge rows of promoted cases inherit of their comprehension, and the text that its vector is made of."""
    c = T.cases(spark, folder).where("ruling = 'Favorable'").select("case_id", S.inherited_comprehension(F.col("court"), F.col("invoked_right"), F.array("invoked_right")).alias("known"))
    return c.where("known is not null").select("case_id", "known.resolves", "known.kind", "known.result", S.comprehension_text(F.col("known")).alias("embedded"))
