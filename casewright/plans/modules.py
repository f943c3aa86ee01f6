"""Reports of single modules: conformities, communications, environmental files, contracts, teams, rulings and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import changes as M
from casewright.operators import records as K
from casewright.operators import relational as R
from casewright.operators import text as X
from casewright.plans.registry import query
from casewright.plans.reports import _rate
from casewright.sources import tables as T
from casewright.sources.tables import AS_OF, with_tables

_TODAY = f"DATE '{AS_OF}'"


def _count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# ------------------------------------------------------------------------------------------------- catalogs and source


@query(with_tables("SELECT g.*, coalesce(m.members, 0) AS members FROM groups g LEFT JOIN (SELECT team_id, count(user_id) AS members FROM users GROUP BY 1) m ON g.group_id = m.team_id", "groups", "users"))
def catalog_areas(spark, folder) -> DataFrame:
    """Areas with the number of their members, 0 included."""
    return T.read_catalog(spark, folder, "areas")


@query(with_tables("SELECT * FROM templates WHERE is_active", "templates"))
def catalog_templates(spark, folder) -> DataFrame:
    return T.read_catalog(spark, folder, "minutas")


@query("SELECT source AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def document_source(spark, folder) -> DataFrame:
    """The document source over the documents' own files."""
    d = T.read_documents(spark, f"{folder}/documents.parquet", "parquet")
    return d.groupBy(F.col("source").alias("kind")).agg(_count(), F.sum(F.length("text")).cast("long").alias("chars"))


_ANSWER = "'Claro:' || chr(10) || '```json' || chr(10) || CASE WHEN event_id % 5 = 0 THEN '{\"k\": oops' WHEN event_id % 5 = 1 THEN '{\"otro\": 1}' ELSE props END || chr(10) || '```'"


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 5 NOT IN (0, 1) AS accepted FROM events")
def parsed_answers(spark, folder) -> DataFrame:
    """Model answers in fences and chatter, parsed; those that are no JSON or lack a key are rejected."""
    body = F.when(F.col("event_id") % 5 == 0, '{"k": oops').when(F.col("event_id") % 5 == 1, '{"otro": 1}').otherwise(F.col("props"))
    e = T.read(spark, folder, "events").select("event_id", F.concat(F.lit("Claro:\n```json\n"), body, F.lit("\n```")).alias("answer"))
    ok, bad = X.parse_llm_json(e, "answer", "k long", ["k"])
    return ok.select("event_id", F.col("parsed.k").alias("k"), F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(False).alias("accepted")))


@query(with_tables("SELECT c.exp_id, x.position, x.finding, x.norm FROM expedientes c LEFT JOIN (SELECT exp_id, CAST(row_number() OVER (PARTITION BY exp_id ORDER BY finding, norm) AS INTEGER) AS position, finding, norm FROM analyses) x ON c.exp_id = x.exp_id", "expedientes", "analyses"))
def exploded_findings(spark, folder) -> DataFrame:
    """Nested analyses as rows of a child table; files without any keep one row."""
    nested = T.analyses(spark, folder).groupBy("exp_id").agg(F.array_sort(F.collect_list(F.struct("finding", "norm"))).alias("findings"))
    whole = T.expedientes(spark, folder).select("exp_id").join(nested, "exp_id", "left")
    return K.explode_analysis(whole, ["exp_id"], "findings")


@query("SELECT vec_id, len(embedding) AS size, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def vector_literals(spark, folder) -> DataFrame:
    """Vectors to their literals and back."""
    literal = T.read(spark, folder, "embeddings").select("vec_id", K.vector_text(F.col("embedding")).alias("literal"))
    back = literal.select("vec_id", K.parse_vector(F.col("literal")).alias("v"))
    return back.select("vec_id", F.size("v").cast("long").alias("size"), F.element_at("v", 1).cast("double").alias("first"))


@query("SELECT string_agg(n_name || '=' || n_regionkey, ',' ORDER BY n_name) AS config FROM nation")
def config_text(spark, folder) -> DataFrame:
    n = T.read(spark, folder, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("v"))
    m = K.config_map(n, "n_name", "v")
    return m.select(F.array_join(F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("config"))


# ------------------------------------------------------------------------------------------------------- conformities

_CONF = """SELECT c.conf_id, c.concept, c.state, c.asked, c.amount, e.entity_name, u.user_name AS asked_by_name, o.user_name AS owner_name, g.groups
    FROM conformities c LEFT JOIN entities e ON c.entity_id = e.entity_id LEFT JOIN users u ON c.asked_by = u.user_id LEFT JOIN users o ON c.owner_id = o.user_id
    LEFT JOIN (SELECT conf_id, string_agg(group_name, ',' ORDER BY group_name) AS groups FROM (SELECT DISTINCT conf_id, group_name FROM conformities x JOIN entities y ON x.entity_id = y.entity_id JOIN groups z ON y.group_id = z.group_id) GROUP BY 1) g ON g.conf_id = c.conf_id"""
_CONF_TABLES = ("conformities", "entities", "users", "groups")


def _conformities(spark, folder, mine: int | None = None) -> DataFrame:
    every = T.conformities(spark, folder)
    c = every if mine is None else every.where((F.col("asked_by") == mine) | (F.col("owner_id") == mine))
    entities, users = T.entities(spark, folder), T.users(spark, folder).select("user_id", "user_name")
    bridge = every.select("conf_id", "entity_id").join(entities, "entity_id").join(T.groups(spark, folder), "group_id").select("conf_id", "group_name")
    named = R.enrich(c, [(entities.select("entity_id", "entity_name"), "entity_id", "entity_id"), (users.withColumnRenamed("user_name", "asked_by_name"), "asked_by", "user_id"), (users.withColumnRenamed("user_name", "owner_name"), "owner_id", "user_id")])
    full = R.collapse_bridge(named, bridge, "conf_id", "group_name", "groups")
    return full.select("conf_id", "concept", "state", "asked", "amount", "entity_name", "asked_by_name", "owner_name", F.array_join("groups", ",").alias("groups")).orderBy(F.desc("asked"))


@query(with_tables(_CONF, *_CONF_TABLES))
def conformity_list(spark, folder) -> DataFrame:
    """Conformities, newest first, with names and the distinct groups of their entity."""
    return _conformities(spark, folder)


@query(with_tables(f"{_CONF} WHERE c.asked_by = 7 OR c.owner_id = 7", *_CONF_TABLES))
def my_conformities(spark, folder) -> DataFrame:
    """Those that a user asked for or owns."""
    return _conformities(spark, folder, 7)


@query(with_tables("SELECT c.conf_id, a.action_id, a.action, a.created, u.user_name FROM conformities c JOIN actions a ON a.case_id = c.contract_id JOIN users u ON a.user_id = u.user_id WHERE c.state = 'rechazado'", "conformities", "actions", "users"))
def conformity_trace(spark, folder) -> DataFrame:
    """The log of rejected conformities with its authors, newest first."""
    c = T.conformities(spark, folder).where("state = 'rechazado'").select("conf_id", F.col("contract_id").alias("case_id"))
    log = T.actions(spark, folder).select("case_id", "action_id", "action", "created", "user_id").join(T.users(spark, folder).select("user_id", "user_name"), "user_id")
    return c.join(log, "case_id").select("conf_id", "action_id", "action", F.col("created").cast("timestamp_ntz").alias("created"), "user_name").orderBy(F.desc("created"))


@query(with_tables("SELECT count(*) AS n, CAST(sum(amount) AS DECIMAL(25,2)) AS total, count(*) FILTER (state = 'pendiente') AS pending, count(*) FILTER (state = 'liberado') AS released, count(*) FILTER (state = 'rechazado') AS rejected FROM conformities WHERE is_active", "conformities"))
def conformity_kpis(spark, folder) -> DataFrame:
    state = F.col("state")
    return R.scan_active(T.conformities(spark, folder)).agg(_count(), F.sum("amount").cast("decimal(25,2)").alias("total"), *(F.count_if(state == s).alias(n) for n, s in (("pending", "pendiente"), ("released", "liberado"), ("rejected", "rechazado"))))


@query(with_tables("SELECT state, count(*) AS n, CAST(sum(amount) AS DECIMAL(25,2)) AS total, count(*) FILTER (NOT is_active) AS archived FROM conformities GROUP BY 1", "conformities"))
def conformity_by_state(spark, folder) -> DataFrame:
    return T.conformities(spark, folder).groupBy("state").agg(_count(), F.sum("amount").cast("decimal(25,2)").alias("total"), F.count_if(~F.col("is_active")).alias("archived"))


@query(with_tables("SELECT p.contract_id, p.line, p.amount, p.state, s.n AS conformities FROM payments p LEFT JOIN (SELECT contract_id, count(*) AS n FROM conformities GROUP BY 1) s ON p.contract_id = s.contract_id WHERE p.creditor_id = 7", "payments", "conformities"))
def my_payments(spark, folder) -> DataFrame:
    """Payments of one creditor beside their contract's conformities."""
    p = T.payments(spark, folder).where("creditor_id = 7")
    n = T.conformities(spark, folder).groupBy("contract_id").agg(_count("conformities"))
    return p.join(n, "contract_id", "left").select("contract_id", "line", "amount", "state", "conformities")


@query(with_tables("SELECT p.contract_id, p.line, p.state, a.action, a.created FROM payments p JOIN actions a ON p.contract_id = a.case_id WHERE p.state = 'rechazado' ORDER BY a.created DESC, p.contract_id, p.line, a.action LIMIT 50", "payments", "actions"))
def payment_trace_newest(spark, folder) -> DataFrame:
    p = T.payments(spark, folder).where("state = 'rechazado'").select("contract_id", "line", "state")
    traced = p.join(T.actions(spark, folder).select(F.col("case_id").alias("contract_id"), "action", F.col("created").cast("timestamp_ntz").alias("created")), "contract_id")
    return R.top_k(traced, 50, F.desc("created"), F.asc("contract_id"), F.asc("line"), F.asc("action"))


@query(with_tables("SELECT case_id, state AS new_state, CASE WHEN state = 'liberado' THEN DATE '1998-06-01' END AS released FROM (SELECT conf_id AS case_id, CASE WHEN conf_id % 2 = 0 THEN 'liberado' ELSE state END AS state FROM conformities WHERE state = 'pendiente') WHERE case_id % 2 = 0", "conformities"))
def released_conformities(spark, folder) -> DataFrame:
    """Every second pending conformity is released; the day of release goes with the new state."""
    c = T.conformities(spark, folder).where("state = 'pendiente'").withColumn("released", F.lit(None).cast("date"))
    out, audit, _ = M.apply_transitions(c, c.where("conf_id % 2 = 0").select("conf_id", F.lit("liberado").alias("state")).distinct(), "conf_id", ["rechazado"], {"liberado": "released"}, AS_OF)
    return out.where("conf_id % 2 = 0").select(F.col("conf_id").alias("case_id"), F.col("state").alias("new_state"), "released")


# ----------------------------------------------------------------------------------------------------- communications

_IN_GROUP = "communications c JOIN communication_groups g ON c.comm_id = g.comm_id WHERE g.group_id = 3"
_MOST = "(SELECT entity_name FROM communications c JOIN entities e ON c.entity_id = e.entity_id WHERE c.is_active GROUP BY 1 ORDER BY count(*) DESC, entity_name LIMIT 1)"


def _of_group(spark, folder) -> DataFrame:
    """Communications of one group; a communication that is linked twice stands there twice."""
    return T.communications(spark, folder).join(T.communication_groups(spark, folder).where("group_id = 3"), "comm_id")


@query(with_tables(f"SELECT count(DISTINCT c.comm_id) AS total, count(*) FILTER (state = 'pendiente') AS pending, count(*) FILTER (state = 'respondida') AS answered, count(*) FILTER (due < DATE '2024-01-20' AND state <> 'respondida') AS overdue, {_MOST} AS most_active FROM {_IN_GROUP}", "communications", "communication_groups", "entities"))
def comm_kpis_of_group(spark, folder) -> DataFrame:
    """The total is of distinct communications, the other counts repeat for links that stand there twice; the most active entity ignores the filter."""
    state = F.col("state")
    kpis = _of_group(spark, folder).agg(F.countDistinct("comm_id").alias("total"), F.count_if(state == "pendiente").alias("pending"), F.count_if(state == "respondida").alias("answered"), F.count_if((F.col("due") < F.lit("2024-01-20").cast("date")) & (state != "respondida")).alias("overdue"))
    per = R.scan_active(T.communications(spark, folder)).groupBy("entity_id").agg(_count())
    most = per.join(T.entities(spark, folder), "entity_id").groupBy("entity_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity_name").limit(1).select(F.col("entity_name").alias("most_active"))
    return R.with_scalar(kpis, most)


@query(with_tables("SELECT entity_name, count(*) AS n FROM communications c JOIN entities e ON c.entity_id = e.entity_id GROUP BY 1 ORDER BY n DESC, entity_name LIMIT 5", "communications", "entities"))
def comm_top_entities(spark, folder) -> DataFrame:
    per = T.communications(spark, folder).groupBy("entity_id").agg(_count()).join(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id")
    return R.top_k(per.groupBy("entity_name").agg(F.sum("n").alias("n")), 5, F.desc("n"), F.asc("entity_name"))


@query(with_tables("SELECT strftime(received, '%Y-%m') AS month, count(*) FILTER (kind = 'recibida') AS received, count(*) FILTER (kind = 'enviada') AS sent FROM communications GROUP BY 1", "communications"))
def comm_trend(spark, folder) -> DataFrame:
    c = T.communications(spark, folder).select(F.date_format("received", "yyyy-MM").alias("month"), "kind")
    return R.count_where(c, ["month"], {"received": F.col("kind") == "recibida", "sent": F.col("kind") == "enviada"}).orderBy("month")


_COMM = """SELECT c.comm_id, c.subject, c.state, c.received, e.entity_name, u.user_name AS owner_name, g.groups FROM communications c LEFT JOIN entities e ON c.entity_id = e.entity_id LEFT JOIN users u ON c.owner_id = u.user_id
    LEFT JOIN (SELECT comm_id, string_agg(group_name, ',' ORDER BY group_name) AS groups FROM (SELECT DISTINCT comm_id, group_name FROM communication_groups b JOIN groups x ON b.group_id = x.group_id) GROUP BY 1) g ON g.comm_id = c.comm_id WHERE c.is_active"""
_COMM_TABLES = ("communications", "communication_groups", "entities", "users", "groups")


def _communications(spark, folder, mine: int | None = None) -> DataFrame:
    c = C.optional_filters(R.scan_active(T.communications(spark, folder)), {"owner_id": mine})
    bridge = T.communication_groups(spark, folder).join(T.groups(spark, folder), "group_id").select("comm_id", "group_name")
    named = R.enrich(c, [(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id", "entity_id"), (T.users(spark, folder).select("user_id", F.col("user_name").alias("owner_name")), "owner_id", "user_id")])
    full = R.collapse_bridge(named, bridge, "comm_id", "group_name", "groups")
    return full.select("comm_id", "subject", "state", "received", "entity_name", "owner_name", F.array_join("groups", ",").alias("groups"))


@query(with_tables(_COMM, *_COMM_TABLES))
def comm_list(spark, folder) -> DataFrame:
    """Active communications with entity, owner and distinct groups."""
    return _communications(spark, folder)


@query(with_tables(f"{_COMM} AND c.owner_id = 7", *_COMM_TABLES))
def my_communications(spark, folder) -> DataFrame:
    return _communications(spark, folder, 7)


@query(with_tables("SELECT c.comm_id, a.action_id AS comment_id, a.created, u.user_name FROM communications c JOIN actions a ON a.action_id // 3 = c.comm_id LEFT JOIN users u ON a.user_id = u.user_id WHERE c.is_active", "communications", "actions", "users"))
def comm_comments(spark, folder) -> DataFrame:
    """Comments of active communications with their authors; three log rows stand for the comments of each."""
    notes = T.actions(spark, folder).select(F.expr("action_id div 3").alias("comm_id"), F.col("action_id").alias("comment_id"), F.col("created").cast("timestamp_ntz").alias("created"), "user_id")
    named = R.enrich(notes, [(T.users(spark, folder).select("user_id", "user_name"), "user_id", "user_id")])
    return R.scan_active(T.communications(spark, folder)).select("comm_id").join(named, "comm_id").select("comm_id", "comment_id", "created", "user_name").orderBy("created")


# ------------------------------------------------------------------------------------------------- environmental files

_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY created DESC NULLS LAST, analysis_id, level, finding, norm) AS k FROM analyses) WHERE k = 1)"


def _latest(analyses: DataFrame) -> DataFrame:
    return R.latest_per_key(analyses, ["exp_id"], [F.desc_nulls_last("created"), F.asc("analysis_id"), F.asc("level"), F.asc("finding"), F.asc("norm")])


@query(with_tables("SELECT analysis_id, level, count(*) AS n FROM analyses GROUP BY 1, 2", "analyses"))
def repaired_levels(spark, folder) -> DataFrame:
    """Levels that came without accents and with blanks around them, set right."""
    raw = T.analyses(spark, folder).select("analysis_id", F.concat(F.lit(" "), F.translate("level", "í", "i"), F.lit("\t")).alias("level"))
    return raw.select("analysis_id", C.repaired("level").alias("level")).groupBy("analysis_id", "level").agg(_count())


@query(with_tables("SELECT count(*) FILTER (is_active) AS total, count(*) FILTER (is_active AND state = 'Pendiente') AS pending, count(*) FILTER (is_active AND state = 'Analizado') AS analysed, count(*) FILTER (is_active AND state = 'Revisado') AS reviewed, " f"count(*) FILTER (is_active AND due < {_TODAY} AND state <> 'Archivado') AS overdue FROM expedientes", "expedientes"))
def dashboard_totals(spark, folder) -> DataFrame:
    state, active = F.col("state"), F.col("is_active")
    counts = {"total": active, "pending": active & (state == "Pendiente"), "analysed": active & (state == "Analizado"), "reviewed": active & (state == "Revisado"), "overdue": active & C.is_overdue("due", "state", ["Archivado"], AS_OF)}
    return R.count_where(T.expedientes(spark, folder), [], counts)


@query(with_tables("SELECT a.level, CAST(CASE a.level WHEN 'Crítico' THEN 1 WHEN 'Alto' THEN 2 WHEN 'Medio' THEN 3 ELSE 4 END AS INTEGER) AS place, count(*) AS n FROM analyses a JOIN expedientes e ON e.exp_id = a.exp_id WHERE e.is_active GROUP BY 1", "analyses", "expedientes"))
def dashboard_by_risk(spark, folder) -> DataFrame:
    """Analyses, not files, by level, the gravest first."""
    active = R.scan_active(T.expedientes(spark, folder)).select("exp_id")
    n = T.analyses(spark, folder).join(active, "exp_id", "left_semi").groupBy("level").agg(_count())
    return n.select("level", C.rank_label("level", ["Crítico", "Alto", "Medio"]).alias("place"), "n").orderBy("place")


@query(with_tables("SELECT state, count(*) AS n FROM expedientes WHERE is_active GROUP BY 1", "expedientes"))
def dashboard_by_state(spark, folder) -> DataFrame:
    return R.scan_active(T.expedientes(spark, folder)).groupBy("state").agg(_count()).orderBy(F.desc("n"))


@query(with_tables("SELECT kind, count(*) AS n FROM expedientes WHERE is_active GROUP BY 1 ORDER BY n DESC, kind LIMIT 6", "expedientes"))
def dashboard_by_kind(spark, folder) -> DataFrame:
    return R.top_k(R.scan_active(T.expedientes(spark, folder)).groupBy("kind").agg(_count()), 6, F.desc("n"), F.asc("kind"))


@query(with_tables(f", {_LATEST} SELECT e.exp_id, e.title, e.number, e.due, n.entity_name, l.level, date_diff('day', {_TODAY}, e.due) AS days FROM expedientes e LEFT JOIN entities n ON n.entity_id = e.entity_id LEFT JOIN l ON l.exp_id = e.exp_id WHERE e.is_active AND e.state <> 'Archivado' AND e.due BETWEEN {_TODAY} AND {_TODAY} + 15", "expedientes", "entities", "analyses"))
def dashboard_due_soon(spark, folder) -> DataFrame:
    """Files that are due within 15 days, both ends included, with their latest level."""
    e = R.scan_active(T.expedientes(spark, folder)).where((F.col("state") != "Archivado") & C.due_within("due", 15, AS_OF)).withColumn("days", C.due_days("due", AS_OF))
    named = R.enrich(e, [(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id", "entity_id")])
    return named.join(_latest(T.analyses(spark, folder)).select("exp_id", F.col("level").alias("risk")), "exp_id", "left").select("exp_id", "title", "number", "due", "entity_name", F.col("risk").alias("level"), "days")


@query(with_tables(f"SELECT count(*) FILTER (p.state = 'solicitado') AS pending, count(*) FILTER (p.state = 'aprobado') AS paid, count(*) FILTER (p.state = 'solicitado' AND p.asked < {_TODAY}) AS overdue FROM payments p JOIN expedientes e ON e.exp_id = p.contract_id WHERE e.is_active", "payments", "expedientes"))
def dashboard_payments(spark, folder) -> DataFrame:
    active = R.scan_active(T.expedientes(spark, folder)).select(F.col("exp_id").alias("contract_id"))
    p, state = T.payments(spark, folder).join(active, "contract_id", "left_semi"), F.col("state")
    return R.count_where(p, [], {"pending": state == "solicitado", "paid": state == "aprobado", "overdue": (state == "solicitado") & (F.col("asked") < F.lit(AS_OF).cast("date"))})


@query(with_tables("SELECT entity_name, count(*) AS n FROM expedientes e JOIN entities n ON n.entity_id = e.entity_id WHERE e.is_active GROUP BY 1 ORDER BY n DESC, entity_name LIMIT 5", "expedientes", "entities"))
def dashboard_by_entity(spark, folder) -> DataFrame:
    per = R.scan_active(T.expedientes(spark, folder)).groupBy("entity_id").agg(_count()).join(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id")
    return R.top_k(per.groupBy("entity_name").agg(F.sum("n").alias("n")), 5, F.desc("n"), F.asc("entity_name"))


@query(with_tables(f", {_LATEST} SELECT e.exp_id, coalesce(e.title, e.number) AS title, e.due, e.dated, e.state, n.entity_name, l.level FROM expedientes e LEFT JOIN entities n ON n.entity_id = e.entity_id LEFT JOIN l ON l.exp_id = e.exp_id WHERE e.is_active AND (e.due IS NOT NULL OR e.dated IS NOT NULL) AND e.state <> 'Archivado'", "expedientes", "entities", "analyses"))
def file_calendar(spark, folder) -> DataFrame:
    """Files that aren't archived and have a date, with their latest level."""
    e = R.scan_active(T.expedientes(spark, folder)).where("(due is not null or dated is not null) and state <> 'Archivado'")
    named = R.enrich(e.withColumn("title", C.first_label("title", "number")), [(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id", "entity_id")])
    return named.drop("level").join(_latest(T.analyses(spark, folder)).select("exp_id", "level"), "exp_id", "left").select("exp_id", "title", "due", "dated", "state", "entity_name", "level")


@query(with_tables("SELECT p.contract_id AS exp_id, p.line, p.amount, p.asked AS due, coalesce(e.title, e.number) AS title FROM payments p JOIN expedientes e ON e.exp_id = p.contract_id WHERE e.is_active AND p.asked IS NOT NULL AND p.state = 'solicitado'", "payments", "expedientes"))
def calendar_payments(spark, folder) -> DataFrame:
    """Pending payments with a date of active files, by date."""
    e = R.scan_active(T.expedientes(spark, folder)).select("exp_id", C.first_label("title", "number").alias("title"))
    p = T.payments(spark, folder).where("state = 'solicitado' and asked is not null").select(F.col("contract_id").alias("exp_id"), "line", "amount", F.col("asked").alias("due"))
    return p.join(e, "exp_id").select("exp_id", "line", "amount", "due", "title").orderBy("due")


@query(
    with_tables(
        f""", {_LATEST}, f AS (SELECT exp_id, created, string_agg(finding, ';' ORDER BY finding) AS findings FROM analyses GROUP BY 1, 2), n AS (SELECT exp_id, string_agg(norm, ';' ORDER BY norm) AS norms FROM (SELECT DISTINCT exp_id, norm FROM analyses) GROUP BY 1),
        p AS (SELECT contract_id AS exp_id, count(*) AS n_payments, CAST(sum(amount) AS DECIMAL(25,2)) AS paid FROM payments WHERE is_active GROUP BY 1)
        SELECT e.exp_id, coalesce(e.title, e.number) AS title, m.entity_name, g.group_name, l.level, f.findings, n.norms, coalesce(n_payments, 0) AS n_payments, paid
        FROM expedientes e LEFT JOIN entities m ON m.entity_id = e.entity_id LEFT JOIN groups g ON g.group_id = e.group_id LEFT JOIN l ON l.exp_id = e.exp_id
        LEFT JOIN f ON f.exp_id = e.exp_id AND f.created = l.created LEFT JOIN n ON n.exp_id = e.exp_id LEFT JOIN p ON p.exp_id = e.exp_id WHERE e.is_active""",
        "expedientes", "entities", "groups", "analyses", "payments",
    )
)
def file_report(spark, folder) -> DataFrame:
    """A row a file: its latest analysis with the findings of its day, all cited norms and its active payments."""
    a = T.analyses(spark, folder)
    e = R.scan_active(T.expedientes(spark, folder)).select("exp_id", C.first_label("title", "number").alias("title"), "entity_id", "group_id")
    named = R.enrich(e, [(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id", "entity_id"), (T.groups(spark, folder).select("group_id", "group_name"), "group_id", "group_id")])
    latest = _latest(a).select("exp_id", "level", "created")
    of_day = a.groupBy("exp_id", "created").agg(F.array_join(F.array_sort(F.collect_list("finding")), ";").alias("findings"))
    norms = a.groupBy("exp_id").agg(F.array_join(F.array_sort(F.collect_set("norm")), ";").alias("norms"))
    paid = R.scan_active(T.payments(spark, folder)).groupBy(F.col("contract_id").alias("exp_id")).agg(_count("n_payments"), F.sum("amount").cast("decimal(25,2)").alias("paid"))
    full = named.join(latest, "exp_id", "left").join(of_day, ["exp_id", "created"], "left").join(norms, "exp_id", "left").join(paid, "exp_id", "left")
    return full.select("exp_id", "title", "entity_name", "group_name", "level", "findings", "norms", F.coalesce("n_payments", F.lit(0).cast("long")).alias("n_payments"), "paid")


@query(with_tables("SELECT c.exp_id, c.comm_id, c.subject, c.received, u.user_name FROM communications c JOIN expedientes e ON e.exp_id = c.exp_id LEFT JOIN users u ON u.user_id = c.owner_id WHERE c.is_active", "communications", "expedientes", "users"))
def file_communications(spark, folder) -> DataFrame:
    """Active communications of each file, oldest first."""
    c = R.scan_active(T.communications(spark, folder)).join(T.expedientes(spark, folder).select("exp_id"), "exp_id", "left_semi")
    named = R.enrich(c, [(T.users(spark, folder).select("user_id", "user_name"), "owner_id", "user_id")])
    return named.select("exp_id", "comm_id", "subject", "received", "user_name").orderBy("received", "comm_id")


@query(with_tables("""SELECT * FROM (SELECT e.exp_id, e.kind, e.state, a.level, a.created, row_number() OVER (PARTITION BY e.exp_id ORDER BY a.created DESC NULLS LAST) AS k
    FROM expedientes e LEFT JOIN analyses a ON a.exp_id = e.exp_id WHERE e.is_active AND e.state = 'Revisado' AND a.level = 'Alto') WHERE k = 1""".replace("SELECT * FROM (", "SELECT exp_id, kind, state, level, created FROM (", 1), "expedientes", "analyses"))
def file_list_at_level(spark, folder) -> DataFrame:
    """Reviewed files that have any analysis at a level, with the newest such one."""
    e = C.optional_filters(R.scan_active(T.expedientes(spark, folder)).drop("level"), {"state": "Revisado", "kind": None})
    a = C.optional_filters(T.analyses(spark, folder).select("exp_id", "level", "created"), {"level": "Alto"})
    newest = a.groupBy("exp_id", "level").agg(F.max("created").alias("created"))
    return e.join(newest, "exp_id").select("exp_id", "kind", "state", "level", "created")


@query(with_tables("SELECT e.exp_id, e.title, e.number, e.state, n.entity_name, g.group_name, u.user_name FROM expedientes e LEFT JOIN entities n ON n.entity_id = e.entity_id LEFT JOIN groups g ON g.group_id = e.group_id LEFT JOIN users u ON u.user_id = e.owner_id WHERE e.is_active", "expedientes", "entities", "groups", "users"))
def file_detail(spark, folder) -> DataFrame:
    e = R.scan_active(T.expedientes(spark, folder))
    named = R.enrich(e, [(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id", "entity_id"), (T.groups(spark, folder).select("group_id", "group_name"), "group_id", "group_id"), (T.users(spark, folder).select("user_id", "user_name"), "owner_id", "user_id")])
    return named.select("exp_id", "title", "number", "state", "entity_name", "group_name", "user_name")


_LEVELS = ", ".join(f"count(*) FILTER (lower(l.level) = '{v}') AS {n}" for n, v in (("high", "alto"), ("medium", "medio"), ("low", "bajo")))


def _levels() -> dict:
    return {"total": F.lit(True)} | {n: F.lower("level") == v for n, v in (("high", "alto"), ("medium", "medio"), ("low", "bajo"))}


@query(with_tables(f", {_LATEST} SELECT entity_name, count(*) AS total, {_LEVELS} FROM expedientes e JOIN entities n ON n.entity_id = e.entity_id LEFT JOIN l ON l.exp_id = e.exp_id WHERE e.is_active GROUP BY 1 ORDER BY total DESC, entity_name LIMIT 8", "expedientes", "entities", "analyses"))
def library_top_entities(spark, folder) -> DataFrame:
    """The eight entities with most files, by the level of each file's latest analysis."""
    e = R.scan_active(T.expedientes(spark, folder)).select("exp_id", "entity_id").join(_latest(T.analyses(spark, folder)).select("exp_id", "level"), "exp_id", "left")
    named = e.join(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id")
    return R.top_k(R.count_where(named, ["entity_name"], _levels()), 8, F.desc("total"), F.asc("entity_name"))


@query(with_tables("SELECT count(*) AS files, count(*) FILTER (e.is_active) AS active, count(v.vec_id) AS embedded, count(*) FILTER (EXISTS (SELECT 1 FROM analyses a WHERE a.exp_id = e.exp_id)) AS analysed FROM expedientes e LEFT JOIN embeddings v ON v.vec_id = e.exp_id", "expedientes", "analyses"))
def library_summary(spark, folder) -> DataFrame:
    e = R.has_child(T.expedientes(spark, folder).select("exp_id", "is_active"), T.analyses(spark, folder), "exp_id", "has_analysis")
    e = R.has_child(e, T.read(spark, folder, "embeddings").select(F.col("vec_id").alias("exp_id")), "exp_id", "has_vector")
    return R.count_where(e, [], {"files": F.lit(True), "active": F.col("is_active"), "embedded": F.col("has_vector"), "analysed": F.col("has_analysis")})


# ---------------------------------------------------------------------------------------------------------- contracts


@query(with_tables("SELECT a.audit_id, a.state, a.created, t.title, e.entity_name, u.user_name FROM audits a JOIN templates t ON a.template_id = t.template_id JOIN entities e ON a.entity_id = e.entity_id JOIN users u ON a.created_by = u.user_id", "audits", "templates", "entities", "users"))
def contract_audits(spark, folder) -> DataFrame:
    """Audits with template, party and author, newest first; an audit that lacks one of them isn't shown."""
    a = T.audits(spark, folder).join(T.templates(spark, folder).select("template_id", "title"), "template_id").join(T.entities(spark, folder).select("entity_id", "entity_name"), "entity_id")
    return a.join(T.users(spark, folder).select(F.col("user_id").alias("created_by"), "user_name"), "created_by").select("audit_id", "state", "created", "title", "entity_name", "user_name").orderBy(F.desc("created"))


@query(with_tables("SELECT t.template_id, t.title, count(a.audit_id) AS audits FROM templates t LEFT JOIN audits a ON a.template_id = t.template_id WHERE t.is_active GROUP BY 1, 2", "templates", "audits"))
def contract_templates(spark, folder) -> DataFrame:
    return R.with_child_counts(R.scan_active(T.templates(spark, folder)).select("template_id", "title"), "template_id", {"audits": T.audits(spark, folder)}).orderBy("title")


# ------------------------------------------------------------------------------------------- cases, rulings, durations


def _ratio(total: str, n: str, unit: str) -> str:
    return f"CAST({total} AS DOUBLE) / nullif({n}, 0) / {unit}"


@query(with_tables("SELECT CAST(date_trunc('month', c.received) AS DATE) AS month, count(*) AS n, " + _ratio("sum(epoch_us(a.created) // 1000 - epoch_us(CAST(c.received AS TIMESTAMP)) // 1000)", "count(*)", "3600000.0::DOUBLE") + " AS mean_hours FROM cases c JOIN actions a ON a.case_id = c.case_id WHERE a.action LIKE 'click%' GROUP BY 1", "cases", "actions"))
def operational_latency(spark, folder, pattern: str = "click%") -> DataFrame:
    """Mean hours from a case's reception to its log rows of a pattern, by month of reception."""
    a = T.actions(spark, folder).where(F.col("action").like(pattern)).select("case_id", "created")
    timed = a.join(T.cases(spark, folder).select("case_id", "received"), "case_id").withColumn("month", F.trunc("received", "month"))
    return R.mean_duration(timed, F.col("received").cast("timestamp"), F.col("created"), "hours", ["month"], name="mean_hours").orderBy("month")


_AGE = "sum(date_diff('day', created, answered)) FILTER (priority = '{0}')"


@query(with_tables("SELECT group_name, count(*) AS total, count(answered) AS answered, " + ", ".join(f"CAST({_AGE.format(p)} AS DOUBLE) / nullif(count(answered) FILTER (priority = '{p}'), 0) AS {n}" for p, n in (("Alta", "mean_high"), ("Media", "mean_medium"), ("Baja", "mean_low"))) + ", CAST(sum(date_diff('day', created, answered)) AS DOUBLE) / nullif(count(answered), 0) AS mean_days FROM requests r JOIN groups g ON r.group_id = g.group_id GROUP BY 1", "requests", "groups"))
def response_time_pivot(spark, folder) -> DataFrame:
    """Mean days from request to answer by group, over all priorities and for each of them."""
    r = T.requests(spark, folder).withColumn("took", F.datediff("answered", "created").cast("long"))
    levels = (("high", "Alta"), ("medium", "Media"), ("low", "Baja"))
    sums = [f(F.when(F.col("priority") == p, F.col("took"))).alias(f"{k}_{n}") for n, p in levels for k, f in (("days", F.sum), ("n", F.count))]
    per = r.groupBy("group_id").agg(_count("total"), F.count("answered").alias("answered"), F.sum("took").alias("days"), *sums).join(T.groups(spark, folder), "group_id")
    return per.select("group_name", "total", "answered", *(C.mean_of(f"days_{n}", f"n_{n}").alias(f"mean_{n}") for n, _ in levels), C.mean_of("days", "answered").alias("mean_days"))


_CLEAN = "coalesce(nullif(trim({0}), ''), '{1}')"


@query(with_tables(f"SELECT {_CLEAN.format('ruling', 'Sin fallo')} AS ruling_label, {_CLEAN.format('invoked_right', 'No clasificado')} AS right_label, {_CLEAN.format('court', 'No identificado')} AS court_label, count(*) AS total, count(*) FILTER (ruling = 'Favorable') AS won, count(*) FILTER (ruling = 'Desfavorable') AS lost FROM cases WHERE is_active GROUP BY 1, 2, court", "cases"))
def ruling_detail(spark, folder) -> DataFrame:
    """By cleaned ruling and right and the raw court."""
    c = R.scan_active(T.cases(spark, folder)).select(C.clean_label("ruling", "Sin fallo").alias("ruling_label"), C.clean_label("invoked_right", "No clasificado").alias("right_label"), "court", "ruling")
    g = R.count_where(c, ["ruling_label", "right_label", "court"], {"total": F.lit(True), "won": F.col("ruling") == "Favorable", "lost": F.col("ruling") == "Desfavorable"})
    return g.select("ruling_label", "right_label", C.clean_label("court", "No identificado").alias("court_label"), "total", "won", "lost")


_RULED = "count(*) FILTER (ruling IS NOT NULL AND ruling <> '')"
_WON = "count(*) FILTER (ruling = 'Favorable')"


def _rulings(df: DataFrame, by: str) -> DataFrame:
    ruled = F.col("ruling").isNotNull() & (F.col("ruling") != "")
    return R.count_where(df, [by], {"total": F.lit(True), "won": F.col("ruling") == "Favorable", "lost": F.col("ruling") == "Desfavorable", "ruled": ruled})


@query(with_tables(f"SELECT {_CLEAN.format('invoked_right', 'No clasificado')} AS right_label, count(*) AS total, {_WON} AS won, count(*) FILTER (ruling = 'Desfavorable') AS lost, count(*) - {_RULED} AS unruled, {_rate(_WON, _RULED)} AS success_rate FROM cases WHERE is_active GROUP BY 1", "cases"))
def ruling_by_right(spark, folder) -> DataFrame:
    c = R.scan_active(T.cases(spark, folder)).withColumn("right_label", C.clean_label("invoked_right", "No clasificado"))
    return _rulings(c, "right_label").select("right_label", "total", "won", "lost", (F.col("total") - F.col("ruled")).alias("unruled"), C.rate("won", "ruled").alias("success_rate")).orderBy(F.desc("total"))


@query(with_tables(f"SELECT {_CLEAN.format('court', 'No identificado')} AS court_label, count(*) AS total, {_WON} AS won, count(*) FILTER (ruling = 'Desfavorable') AS lost, {_rate(_WON, _RULED)} AS success_rate FROM cases WHERE is_active GROUP BY court", "cases"))
def ruling_by_court(spark, folder) -> DataFrame:
    """By the raw court, shown by its label."""
    g = _rulings(R.scan_active(T.cases(spark, folder)), "court")
    return g.select(C.clean_label("court", "No identificado").alias("court_label"), "total", "won", "lost", C.rate("won", "ruled").alias("success_rate")).orderBy(F.desc("total"))


@query(with_tables("SELECT u.user_name, count(c.case_id) AS active, count(*) FILTER (c.due < DATE '1998-06-01') AS overdue FROM (SELECT user_id, 'Abogado ' || (user_id % 40) AS user_name FROM users) u LEFT JOIN cases c ON c.owner_id = u.user_id AND c.state <> 'Respondida' AND c.is_active GROUP BY 1", "users", "cases"))
def workload_by_name(spark, folder) -> DataFrame:
    """Open cases by display name: homonyms are one row."""
    u = T.users(spark, folder).select("user_id", F.concat(F.lit("Abogado "), (F.col("user_id") % 40).cast("string")).alias("user_name"))
    own = T.cases(spark, folder).withColumnRenamed("owner_id", "user_id").select("user_id", "case_id", "due", "state", "is_active")
    joined = R.left_join_where(u, own, "user_id", (F.col("state") != "Respondida") & F.col("is_active"))
    return R.count_where(joined, ["user_name"], {"active": F.col("case_id").isNotNull(), "overdue": F.col("due") < F.lit(AS_OF).cast("date")})


@query(with_tables("SELECT c.case_id, m.turn, m.text AS argument FROM cases c JOIN messages m ON m.conv_id = c.case_id WHERE m.kind = 'enviada' AND c.is_active", "cases", "messages"))
def case_arguments(spark, folder) -> DataFrame:
    """The arguments of active cases in order; sent messages stand for them."""
    m = T.messages(spark, folder).where("kind = 'enviada'").select(F.col("conv_id").alias("case_id"), "turn", F.col("text").alias("argument"))
    return m.join(R.scan_active(T.cases(spark, folder)).select("case_id"), "case_id", "left_semi").orderBy("case_id", "turn")


@query(with_tables("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, (SELECT string_agg(action, ',' ORDER BY action) FROM (SELECT DISTINCT action FROM actions)) AS facets FROM actions WHERE action ILIKE '%li%' OR details ILIKE '%li%'", "actions"))
def audit_log_totals(spark, folder) -> DataFrame:
    """Rows and pages of a search, and the distinct actions of the whole log."""
    a = T.actions(spark, folder)
    return R.page_info(C.search(a, ["action", "details"], "li"), 20, a, "action")


@query(with_tables("SELECT action_id, user_id, action, created FROM actions WHERE user_id = 7", "actions"))
def notifications_of_user(spark, folder) -> DataFrame:
    """One user's notifications, newest first."""
    return T.actions(spark, folder).where("user_id = 7").select("action_id", "user_id", "action", F.col("created").cast("timestamp_ntz").alias("created")).orderBy(F.desc("created"), "action_id")


# --------------------------------------------------------------------------------------------------- teams and grants

_ATTAINED = "d AS (SELECT user_id, CAST(sum(weight) AS BIGINT) AS done FROM actions GROUP BY 1)"


@query(with_tables(f", {_ATTAINED} SELECT g.team_id, u.user_name, g.goal_id, g.target, coalesce(done, 0) AS done, CASE WHEN g.target <> 0 THEN coalesce(done, 0) * 100 / g.target END AS percent FROM goals g JOIN users u ON u.user_id = g.user_id LEFT JOIN d ON d.user_id = g.user_id", "goals", "users", "actions"))
def goals_by_team(spark, folder) -> DataFrame:
    """Each team's goals with their owner and what is done."""
    g = R.attainment(T.goals(spark, folder), T.actions(spark, folder), ["user_id"])
    return g.join(T.users(spark, folder).select("user_id", "user_name"), "user_id").select("team_id", "user_name", "goal_id", "target", "done", "percent").orderBy("team_id", "user_name", "goal_id")


@query(with_tables("SELECT g.goal_id, a.action_id, a.action, a.weight, a.created FROM goals g JOIN actions a ON a.user_id = g.user_id", "goals", "actions"))
def goal_actions(spark, folder) -> DataFrame:
    """The actions of each goal, newest first."""
    a = T.actions(spark, folder).select("user_id", "action_id", "action", "weight", F.col("created").cast("timestamp_ntz").alias("created"))
    return T.goals(spark, folder).select("goal_id", "user_id").join(a, "user_id").drop("user_id").orderBy("goal_id", F.desc("created"))


@query(with_tables(f", {_ATTAINED}, p AS (SELECT g.team_id, (1000 * coalesce(done, 0)) // nullif(target, 0) AS m FROM goals g LEFT JOIN d ON d.user_id = g.user_id) SELECT team_id, CAST((2 * sum(m) + 10 * count(m)) // (20 * count(m)) AS BIGINT) AS percent FROM p GROUP BY 1 HAVING count(m) > 0", "goals", "actions"))
def goal_percent_global(spark, folder) -> DataFrame:
    """The mean attainment of each team's goals in whole per cent, halves up; goals with a target of 0 have none."""
    p = R.attainment(T.goals(spark, folder), T.actions(spark, folder), ["user_id"]).withColumn("m", F.expr("(1000 * done) div nullif(target, 0)"))
    return p.groupBy("team_id").agg(F.count("m").alias("n"), F.sum("m").alias("s")).where("n > 0").select("team_id", F.expr("(2 * s + 10 * n) div (20 * n)").alias("percent"))


@query(with_tables("SELECT user_id, user_name, team_id FROM users WHERE user_id % 7 <> 0 AND role <> 'BUILDING'", "users"))
def user_directory(spark, folder) -> DataFrame:
    """Active and approved users by name."""
    u = T.users(spark, folder).withColumn("is_active", F.col("user_id") % 7 != 0).withColumn("approved", F.col("role") != "BUILDING")
    return R.scan_active(u).where("approved").select("user_id", "user_name", "team_id").orderBy("user_name")


_GRANTS = "grants AS (SELECT user_id, 'casos' AS module, 'view' AS action FROM users WHERE user_id % 3 = 0 UNION ALL SELECT user_id, 'pagos', 'click' FROM users WHERE user_id % 4 = 0)"


def _grants(spark, folder) -> DataFrame:
    u = T.users(spark, folder).select("user_id")
    grant = lambda n, module, action: u.where(F.col("user_id") % n == 0).select("user_id", F.lit(module).alias("module"), F.lit(action).alias("action"))
    return grant(3, "casos", "view").unionByName(grant(4, "pagos", "click"))


@query(with_tables(f", {_GRANTS} SELECT user_id, string_agg(module || ':' || action, ',' ORDER BY module, action) AS grants FROM grants GROUP BY 1", "users"))
def my_grants(spark, folder) -> DataFrame:
    """Every user's grants by module and action."""
    g = _grants(spark, folder).groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat("module", F.lit(":"), "action"))).alias("g"))
    return g.select("user_id", F.array_join("g", ",").alias("grants"))


@query(with_tables(f", {_GRANTS}, asked AS (SELECT action_id, user_id, CASE WHEN action_id % 2 = 0 THEN 'casos' ELSE 'pagos' END AS module, action FROM actions) SELECT a.action_id, a.user_id, a.module, a.action FROM asked a JOIN users u ON u.user_id = a.user_id WHERE u.role = 'BUILDING' OR EXISTS (SELECT 1 FROM grants g WHERE g.user_id = a.user_id AND g.module = a.module AND g.action = a.action)", "users", "actions"))
def permitted_actions(spark, folder) -> DataFrame:
    """Administrators may do everything, others what a grant for user, module and action allows."""
    asked = T.actions(spark, folder).select("action_id", "user_id", F.when(F.col("action_id") % 2 == 0, "casos").otherwise("pagos").alias("module"), "action")
    admins = T.users(spark, folder).where("role = 'BUILDING'").select("user_id")
    known = asked.join(T.users(spark, folder).select("user_id"), "user_id", "left_semi").select(*asked.columns)
    return K.grants_filter(known, _grants(spark, folder), admins)


# -------------------------------------------------------------------------------------------------- changes, knowledge


@query(with_tables(", k AS (SELECT DISTINCT exp_id, norm FROM analyses WHERE level = 'Alto'), f AS (SELECT DISTINCT exp_id, norm FROM analyses WHERE level <> 'Alto') SELECT * FROM k UNION ALL (SELECT * FROM f EXCEPT SELECT * FROM k)", "analyses"))
def accumulated_norms(spark, folder) -> DataFrame:
    """Norms of further analyses are added to those that a file has."""
    a = T.analyses(spark, folder).select("exp_id", "norm", "level")
    base = a.where("level = 'Alto'").select("exp_id", "norm").distinct()
    return M.accumulate(base, a.where("level <> 'Alto'").select("exp_id", "norm"), ["exp_id", "norm"])


@query(with_tables("SELECT exp_id, coalesce(title, '') || CASE WHEN exp_id % 3 = 0 THEN ' | anexo' ELSE '' END AS body, CASE WHEN exp_id % 3 = 0 THEN '1,3,2' ELSE '1,2,3' END AS parts FROM expedientes", "expedientes"))
def appended_sections(spark, folder) -> DataFrame:
    """Every third file gets a section more; its number moves to the end of the list."""
    e = T.expedientes(spark, folder).select("exp_id", F.coalesce("title", F.lit("")).alias("body"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("parts"))
    out = M.append_section(e, e.where("exp_id % 3 = 0").select("exp_id", F.lit(" | anexo").alias("p"), F.lit(2).alias("n")), "exp_id", "body", "parts", "p", "n")
    return out.select("exp_id", "body", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query(with_tables("SELECT entity_name AS name, CASE WHEN entity_id % 3 = 0 THEN entity_id % 2 = 0 OR entity_id % 6 = 3 ELSE entity_id % 2 = 0 END AS is_active FROM entities UNION ALL SELECT 'Nueva ' || entity_id, true FROM entities WHERE entity_id % 10 = 0", "entities"))
def reactivated_entities(spark, folder) -> DataFrame:
    """Names asked for again: inactive ones become active, absent ones are added."""
    e = T.entities(spark, folder)
    base = e.select(F.col("entity_name").alias("name"), (F.col("entity_id") % 2 == 0).alias("is_active"))
    asked = e.where("entity_id % 3 = 0").select(F.col("entity_name").alias("name")).unionByName(e.where("entity_id % 10 = 0").select(F.concat(F.lit("Nueva "), F.col("entity_id").cast("string")).alias("name")))
    return M.insert_or_reactivate(base, asked, "name")[0]


@query(with_tables("SELECT user_id, CAST(9 AS BIGINT) AS wished, team_id AS has FROM users WHERE user_id % 5 = 0 AND team_id <> 9", "users"))
def rejected_assignments(spark, folder) -> DataFrame:
    """Wishes for a team of users who are in another one."""
    u = T.users(spark, folder).select("user_id", "team_id")
    _, rejected = M.assign_exclusive(u, u.where("user_id % 5 = 0").select("user_id", F.lit(9).cast("long").alias("team_id")), "user_id", "team_id")
    return rejected.withColumnRenamed("team_id", "wished").join(u.withColumnRenamed("team_id", "has"), "user_id").select("user_id", "wished", "has")


@query(with_tables("SELECT file_id, CASE WHEN file_id % 2 = 0 AND length(text) > 0 THEN 'analisis' ELSE 'contenido' END AS origin, CAST(least(1500, length(text)) AS BIGINT) AS chars FROM files WHERE text IS NOT NULL", "files"))
def embedding_inputs(spark, folder) -> DataFrame:
    """The one text of each file that is embedded: at most 1,500 characters, of its analysis rather than its content."""
    f = T.files(spark, folder).where("text is not null").select(F.col("file_id").alias("key"), "text")
    given = f.withColumn("origin", F.lit("contenido")).unionByName(f.where("key % 2 = 0").withColumn("origin", F.lit("analisis")))
    return K.embedding_upsert(given, "key", "text", "origin", ["analisis", "contenido"]).select(F.col("key").alias("file_id"), "origin", F.length("text").cast("long").alias("chars"))


@query(with_tables("SELECT c.case_id, f.category, CAST(length(f.text) AS BIGINT) AS chars FROM cases c JOIN files f ON f.file_id = c.case_id WHERE c.ruling = 'Favorable' AND c.state = 'Respondida' AND length(trim(f.text)) > 0 AND c.case_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')", "cases", "files"))
def promotable_answers(spark, folder) -> DataFrame:
    """Answers that go to the knowledge base: favourable, with a text, not promoted yet; they inherit their file's category."""
    return _promotable(spark, folder).select("case_id", "category", F.length("text").cast("long").alias("chars"))


def _promotable(spark, folder) -> DataFrame:
    answers = T.cases(spark, folder).where("state = 'Respondida'").join(T.files(spark, folder).select(F.col("file_id").alias("case_id"), "category", "text"), "case_id")
    done = T.read(spark, folder, "events").where("event_type = 'error'").select(F.col("event_id").alias("case_id"))
    return K.promotable(answers, done, "case_id", "ruling", "Favorable", "text")


@query()
def promoted_chunks(spark, folder) -> DataFrame:
    """The chunks of promoted answers, titled; each carries the key that its embedding is stored under."""
    return K.promote(_promotable(spark, folder), "case_id", "text", F.concat(F.lit("Respuesta "), F.col("case_id").cast("string")))


# --------------------------------------------------------------------------------------------------- deadline alerts

_ALERT = "CASE WHEN {0} <= 0 THEN 'vence hoy o vencida' WHEN {0} = 1 THEN 'vence mañana' WHEN {0} = 3 THEN 'vence en 3 días' ELSE 'vence en 5 días' END"
_LEFT = f"date_diff('day', {_TODAY}, {{0}})"


@query(with_tables(f"SELECT exp_id AS id, owner_id, {_LEFT.format('due')} AS days, {_ALERT.format(_LEFT.format('due'))} AS alert FROM expedientes WHERE is_active AND state <> 'Archivado' AND owner_id IS NOT NULL AND {_LEFT.format('due')} <= 5", "expedientes"))
def file_alerts(spark, folder) -> DataFrame:
    """Files that are due within five days or overdue, with the text of the day's threshold."""
    from casewright.streaming import alerts

    return alerts.threshold_alerts(T.expedientes(spark, folder), "exp_id", AS_OF, alerts.FILE_THRESHOLDS, ["Archivado"])


@query(with_tables(f"SELECT DISTINCT e.exp_id AS id, e.owner_id, {_LEFT.format('p.asked')} AS days, {_ALERT.format(_LEFT.format('p.asked'))} AS alert FROM payments p JOIN expedientes e ON e.exp_id = p.contract_id WHERE e.is_active AND p.is_active AND e.owner_id IS NOT NULL AND p.state = 'solicitado' AND {_LEFT.format('p.asked')} <= 5", "payments", "expedientes"))
def payment_alerts(spark, folder) -> DataFrame:
    """Pending payments of active files, by the owner of the file."""
    from casewright.streaming import alerts

    e = R.scan_active(T.expedientes(spark, folder)).select("exp_id", "owner_id")
    p = T.payments(spark, folder).select(F.col("contract_id").alias("exp_id"), F.col("asked").alias("due"), "state", "is_active").join(e, "exp_id")
    return alerts.threshold_alerts(p, "exp_id", AS_OF, alerts.FILE_THRESHOLDS, ["aprobado", "rechazado"]).distinct()
