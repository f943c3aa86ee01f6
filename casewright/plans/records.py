"""Queries over catalogs, knowledge, changes, grants and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import changes as M
from casewright.operators import records as K
from casewright.operators import relational as R
from casewright.operators import text as X
from casewright.operators import vectors as V
from casewright.plans.corpus import _ASKED, _RANKED, _SIM
from casewright.plans.registry import query
from casewright.sources import tables as T
from casewright.sources.store import stored
from casewright.sources.tables import AS_OF, with_tables

_VOTES = "votes AS (SELECT f.file_id, f.category, f.kind, CAST(coalesce(sum(delta), 0) AS BIGINT) AS feedback FROM files f LEFT JOIN (SELECT event_id // 10 AS ref, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS delta FROM events) v ON f.file_id = v.ref GROUP BY 1, 2, 3)"


def _voted(spark, folder) -> DataFrame:
    votes = T.read(spark, folder, "events").select(F.expr("event_id div 10").alias("file_id"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("delta"))
    total = votes.groupBy("file_id").agg(F.sum("delta").alias("feedback"))
    found = T.files(spark, folder).select("file_id", "category", "kind").join(total, "file_id", "left")
    return found.withColumn("feedback", F.coalesce("feedback", F.lit(0).cast("long")))


@query(with_tables(f", {_VOTES} SELECT category, count(feedback) AS n, round(avg(feedback), 2) AS mean, min(feedback) AS least, max(feedback) AS most FROM votes GROUP BY 1", "files"))
def kb_effectiveness(spark, folder) -> DataFrame:
    return K.score_stats(_voted(spark, folder), ["category"], "feedback")


@query(with_tables(f", {_VOTES} SELECT count(*) AS n, count(*) FILTER (feedback >= 3) AS very_useful, count(*) FILTER (feedback <= -3) AS to_remove, round(avg(feedback), 2) AS mean FROM votes", "files"))
def kb_totals(spark, folder) -> DataFrame:
    v, f = _voted(spark, folder), F.col("feedback")
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(f >= 3).alias("very_useful"), F.count_if(f <= -3).alias("to_remove"), F.round(F.avg(f), 2).alias("mean"))


@query(with_tables(f", {_VOTES} SELECT category, count(*) FILTER (feedback >= 3) AS very_useful, count(*) FILTER (feedback <= -3) AS to_remove FROM votes GROUP BY 1", "files"))
def kb_candidates(spark, folder) -> DataFrame:
    return R.count_where(_voted(spark, folder), ["category"], {"very_useful": F.col("feedback") >= 3, "to_remove": F.col("feedback") <= -3})


@query(with_tables(f", {_VOTES}, x AS (SELECT 'best' AS side, * FROM (SELECT file_id, feedback FROM votes ORDER BY feedback DESC, file_id LIMIT 10) UNION ALL SELECT 'worst', * FROM (SELECT file_id, feedback FROM votes ORDER BY feedback, file_id LIMIT 10)) SELECT * FROM x", "files"))
def kb_extremes(spark, folder) -> DataFrame:
    """The ten files with most and with least feedback."""
    v = _voted(spark, folder).select("file_id", "feedback")
    side = lambda name, order: R.top_k(v, 10, order, F.asc("file_id")).select(F.lit(name).alias("side"), "file_id", "feedback")
    return side("best", F.desc("feedback")).unionByName(side("worst", F.asc("feedback")))


@query(with_tables(", p AS (SELECT category, kind, count(*) AS n FROM files GROUP BY 1, 2 ORDER BY n DESC, category NULLS LAST, kind NULLS LAST LIMIT 60) SELECT category, CAST(sum(n) AS BIGINT) AS total, coalesce(string_agg(kind || ':' || n, ',' ORDER BY kind), '') AS parts FROM p GROUP BY 1", "files"))
def recurrent_pairs(spark, folder) -> DataFrame:
    """The 60 most frequent pairs of category and kind, rolled up by category."""
    nested = K.nest_children(T.files(spark, folder), "category", "kind", 60)
    shown = F.array_join(F.transform("children", lambda c: F.concat(c["kind"], F.lit(":"), c["n"].cast("string"))), ",")
    return nested.select("category", "total", shown.alias("parts"))


@query(with_tables("SELECT state, round(avg(CASE WHEN state = 'Respondida' THEN due ELSE DATE '1998-06-01' END - received), 0) AS mean_age FROM cases GROUP BY 1", "cases"))
def mean_age_by_state(spark, folder) -> DataFrame:
    """Closed cases age until they were due, open ones until the day of the report."""
    end = F.when(F.col("state") == "Respondida", F.col("due")).otherwise(F.lit(AS_OF).cast("date"))
    return K.mean_age_days(T.cases(spark, folder), ["state"], "received", end)


@query(with_tables(", l AS (SELECT case_id, max(line) AS m FROM requests WHERE state = 'Respondido' GROUP BY 1) SELECT r.case_id, r.created, r.priority, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY r.case_id ORDER BY r.created, r.line, r.group_id, r.priority) AS BIGINT) AS line FROM requests r LEFT JOIN l ON r.case_id = l.case_id WHERE r.state = 'Pendiente'", "requests"))
def renumbered_requests(spark, folder) -> DataFrame:
    """Open requests of a case numbered on from its answered ones."""
    r = T.requests(spark, folder)
    out = K.renumber_append(r.where("state = 'Pendiente'"), r.where("state = 'Respondido'"), "case_id", "line", [F.asc("created"), F.asc("line"), F.asc("group_id"), F.asc("priority")])
    return out.select("case_id", "created", "priority", F.col("line").cast("long").alias("line"))


@query(with_tables(", b AS (SELECT DISTINCT team_id FROM users WHERE team_id < 10 AND role = 'BUILDING' AND user_id % 50 = 0) SELECT g.goal_id, NOT (g.team_id < 10 AND g.team_id NOT IN (SELECT team_id FROM b)) AS is_active FROM goals g", "users", "goals"))
def archived_goals(spark, folder) -> DataFrame:
    """Goals after ten teams were asked to be archived; teams with an approved member are not."""
    teams = T.groups(spark, folder).select(F.col("group_id").alias("team_id"), F.lit(True).alias("is_active"))
    members = T.users(spark, folder).select("user_id", "team_id", F.coalesce((F.col("role") == "BUILDING") & (F.col("user_id") % 50 == 0), F.lit(False)).alias("approved"))
    goals = T.goals(spark, folder).select("goal_id", "user_id", F.lit(True).alias("is_active"))
    return K.archive_team(teams, members, goals, teams.where("team_id < 10"), "team_id", "user_id")[1].select("goal_id", "is_active")


@query(with_tables(""", g AS (SELECT 'BUILDING' AS role, 'casos' AS module, 'view' AS action UNION ALL SELECT 'MACHINERY', 'pagos', 'click' UNION ALL SELECT 'MACHINERY', 'ninguno', 'view')
    SELECT DISTINCT u.user_id, m.module_id, k.action_id FROM users u JOIN g ON u.role = g.role JOIN (SELECT 1 AS module_id, 'casos' AS module UNION ALL SELECT 2, 'pagos') m ON g.module = m.module
    JOIN (SELECT action, min(action_id) AS action_id FROM actions GROUP BY 1) k ON g.action = k.action""", "users", "actions"))
def expanded_grants(spark, folder) -> DataFrame:
    """Grants by role and names as rows of ids; an unknown module gives nothing."""
    grants = spark.createDataFrame([("BUILDING", "casos", "view"), ("MACHINERY", "pagos", "click"), ("MACHINERY", "ninguno", "view")], "role string, module string, action string")
    modules = spark.createDataFrame([(1, "casos"), (2, "pagos")], "module_id int, module string")
    actions = T.actions(spark, folder).groupBy("action").agg(F.min("action_id").alias("action_id"))
    return K.expand_grants(T.users(spark, folder).select("user_id", "role"), grants, modules, actions)


@query(with_tables("SELECT case_id, CASE WHEN case_id IN (SELECT contract_id FROM payments WHERE state = 'rechazado') THEN false ELSE is_active END AS is_active FROM cases", "cases", "payments"))
def deactivated_cases(spark, folder) -> DataFrame:
    hit = T.payments(spark, folder).where("state = 'rechazado'").select(F.col("contract_id").alias("case_id"))
    return M.set_active(T.cases(spark, folder), hit, "case_id", False).select("case_id", "is_active")


@query(with_tables(", b AS (SELECT DISTINCT case_id, user_id FROM actions) SELECT case_id, user_id FROM b WHERE case_id % 10 <> 0 UNION ALL SELECT DISTINCT case_id, CAST(0 AS BIGINT) FROM b WHERE case_id % 10 = 0", "actions"))
def replaced_members(spark, folder) -> DataFrame:
    """Every tenth case gets a new set of members."""
    bridge = T.actions(spark, folder).select("case_id", "user_id").distinct()
    new = bridge.where("case_id % 10 = 0").select("case_id", F.lit(0).cast("long").alias("user_id")).distinct()
    return M.replace_set(bridge, new, "case_id")


@query(with_tables("SELECT c.case_id, CASE WHEN u.user_id % 2 = 0 THEN u.user_id + 1000000 END AS owner_id FROM cases c LEFT JOIN users u ON c.owner_id = u.user_id", "cases", "users"))
def remapped_owners(spark, folder) -> DataFrame:
    """Owners through a mapping by name to new ids; owners whose name has no new id become null."""
    old = T.users(spark, folder).select("user_name", "user_id")
    new = old.where("user_id % 2 = 0").select("user_name", (F.col("user_id") + 1000000).alias("new_id"))
    mapping = M.build_mapping(old, new, ["user_name"], "user_id", "new_id")
    return M.remap_fk(T.cases(spark, folder).select("case_id", "owner_id"), mapping, "owner_id", "user_id", "new_id")


@query(with_tables("SELECT case_id, CASE WHEN owner_id IN (SELECT user_id FROM users WHERE role = 'BUILDING') THEN owner_id END AS owner_id FROM cases", "cases", "users"))
def cleared_orphans(spark, folder) -> DataFrame:
    parents = T.users(spark, folder).where("role = 'BUILDING'").select(F.col("user_id").alias("owner_id"))
    return M.null_orphans(T.cases(spark, folder).select("case_id", "owner_id"), parents, "owner_id")


@query(with_tables("SELECT case_id, count(*) AS n FROM requests WHERE case_id IN (SELECT case_id FROM cases WHERE is_active) GROUP BY 1", "requests", "cases"))
def purged_requests(spark, folder) -> DataFrame:
    kept = M.purge_orphans(T.requests(spark, folder), R.scan_active(T.cases(spark, folder)), "case_id")
    return kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("SELECT case_id, 'received' AS event, received AS day FROM cases WHERE received IS NOT NULL UNION ALL SELECT case_id, 'due', due FROM cases WHERE due IS NOT NULL", "cases"))
def case_dates(spark, folder) -> DataFrame:
    return M.columns_to_rows(T.cases(spark, folder).select("case_id", "received", "due"), ["case_id"], ["received", "due"], "event", "day")


@query(with_tables("SELECT case_id, CASE WHEN invoked_right IN ('1-URGENT', '2-HIGH') THEN invoked_right ELSE 'Media' END AS invoked_right FROM cases", "cases"))
def defaulted_rights(spark, folder) -> DataFrame:
    return M.default_domain(T.cases(spark, folder).select("case_id", "invoked_right"), "invoked_right", ["1-URGENT", "2-HIGH"], "Media")


@query(with_tables("SELECT case_id, CASE WHEN case_id % 2 = 0 AND ruling IS NULL THEN 'Pendiente de fallo' ELSE ruling END AS ruling FROM cases", "cases"))
def filled_rulings(spark, folder) -> DataFrame:
    c = T.cases(spark, folder).select("case_id", "ruling")
    return M.fill_merge(c, c.where("case_id % 2 = 0").select("case_id", F.lit("Pendiente de fallo").alias("ruling")), "case_id", ["ruling"])


@query(with_tables("SELECT DISTINCT user_id, action FROM actions", "actions"))
def inserted_pairs(spark, folder) -> DataFrame:
    """Pairs of user and action of the first half, and those of the second half that it lacks."""
    a = T.actions(spark, folder)
    first = a.where("action_id % 2 = 0").select("user_id", "action").distinct()
    return M.insert_missing(first, a.where("action_id % 2 = 1").select("user_id", "action").distinct(), ["user_id", "action"])


@query(with_tables("SELECT user_id, action, action_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, action ORDER BY action_id) AS k FROM actions) WHERE k = 1", "actions"))
def first_of_each_action(spark, folder) -> DataFrame:
    return M.dedupe_keep_one(T.actions(spark, folder), ["user_id", "action"], [F.asc("action_id")]).select("user_id", "action", "action_id")


@query(with_tables(", b AS (SELECT min(file_id) AS base_id, sha256(text) AS h, sha256(lower(text)) AS c FROM files WHERE text IS NOT NULL GROUP BY 2, 3) SELECT DISTINCT f.file_id, b.base_id FROM files f JOIN b ON (sha256(f.text) = b.h OR sha256(lower(f.text)) = b.c) WHERE f.file_id <> b.base_id", "files"))
def duplicate_links(spark, folder) -> DataFrame:
    """Files whose bytes or lower-case text equal those of an earlier one."""
    f = T.files(spark, folder).where("text is not null").select("file_id", F.sha2("text", 256).alias("h"), F.sha2(F.lower("text"), 256).alias("c"))
    base = f.groupBy("h", "c").agg(F.min("file_id").alias("base_id"))
    return R.find_duplicates(f, base, ["h", "c"], "file_id", "base_id").where("file_id <> base_id")


_LINES = "SELECT conv_id, lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS canonical FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS p FROM messages WHERE kind = '{}')"
_SIDES = " UNION ALL ".join(f"SELECT *, '{side}' AS side FROM (({_LINES.format(a)}) EXCEPT ALL ({_LINES.format(b)})) WHERE canonical <> ''" for side, a, b in (("removed", "recibida", "enviada"), ("added", "enviada", "recibida")))


@query(with_tables(f"SELECT conv_id, canonical, side FROM ({_SIDES})", "messages"))
def message_line_delta(spark, folder) -> DataFrame:
    """Multiset difference of the lines of received and sent messages of each conversation."""
    lines = lambda kind: X.paragraphs(T.messages(spark, folder).where(F.col("kind") == kind), "conv_id", "text", "\n")
    return X.paragraph_delta(lines("recibida"), lines("enviada"), "conv_id")


@query(with_tables("SELECT invoked_right, count(*) FILTER (ruling = 'Favorable') AS favourable, count(*) FILTER (ruling = 'Desfavorable') AS warnings FROM cases GROUP BY 1", "cases"))
def precedent_summary(spark, folder) -> DataFrame:
    return R.count_where(T.cases(spark, folder), ["invoked_right"], {"favourable": F.col("ruling") == "Favorable", "warnings": F.col("ruling") == "Desfavorable"})


_HYBRID = f"""{_RANKED}, s AS (SELECT q.vec_id AS query, e.vec_id, v.category, round(0.55::DOUBLE * coalesce({_SIM}, 0) + 0.35::DOUBLE * coalesce(r.rank, 0) + 0.10::DOUBLE * greatest(0, least(v.feedback, 10)) / 10, 4) AS score
    FROM embeddings e JOIN votes v ON v.file_id = e.vec_id LEFT JOIN r ON r.file_id = e.vec_id, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id)"""
_TOPPED = """, t AS (SELECT *, CASE WHEN {0} THEN 0 ELSE 1 END AS tier FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY query, tier ORDER BY score DESC, vec_id) AS k FROM t),
    c AS (SELECT *, count(*) FILTER (tier = 0) OVER (PARTITION BY query) AS found FROM b WHERE k <= 8), d AS (SELECT * FROM c WHERE tier = 0 OR found < 3)
    SELECT query, vec_id, category, score, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, vec_id) AS place FROM d) WHERE place <= 8"""


def _context(spark, folder, category: str) -> DataFrame:
    """The best knowledge rows for every hundredth vector by cosine, text rank and feedback, the last two known before rows meet queries."""
    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding")
    ranks = X.text_rank(T.files(spark, folder), "file_id", F.col("text"), _ASKED).withColumnRenamed("file_id", "vec_id")
    known = e.join(_voted(spark, folder).withColumnRenamed("file_id", "vec_id"), "vec_id").join(ranks, "vec_id", "left")
    known = stored(known.select("vec_id", "embedding", "category", "rank", "feedback"))
    best = K.best_with_topup(e.where("vec_id % 100 = 0"), known, "vec_id", F.col("category") == category, 8, ["category"])
    return best.select("query", "vec_id", "category", "score", "tier")


@query(with_tables(f", {_VOTES}, {_HYBRID}{_TOPPED.format("category = 'en'")}", "files"))
def legal_context(spark, folder) -> DataFrame:
    """The eight best knowledge rows of a category for each query by hybrid score, topped up from others if they are under three."""
    return _context(spark, folder, "en")


@query(with_tables(f", {_VOTES}, {_HYBRID}{_TOPPED.format("category = 'xx'")}", "files"))
def legal_context_topped_up(spark, folder) -> DataFrame:
    """The same for a category without any row."""
    return _context(spark, folder, "xx")


@query(f"SELECT q.vec_id AS query, e.vec_id, {_SIM} AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.label = q.label AND e.vec_id <> q.vec_id")
def similarity_to_list(spark, folder) -> DataFrame:
    """Each query's similarity to the list of the rows with its label."""
    e = T.read(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return V.similarities(e.where("vec_id % 100 = 0"), e, on="label")


@query("SELECT count(*) FILTER (vec_id > 450) AS newer, count(*) FILTER (vec_id > 450) >= 10 OR count(*) FILTER (label = 0) = 0 AS stale FROM embeddings")
def cluster_staleness(spark, folder) -> DataFrame:
    """Ids above 450 stand for the embeddings that came after the last run."""
    e = T.read(spark, folder, "embeddings")
    return K.needs_recalculate(e, e.where("label = 0"), e, "vec_id", 450)


@query(with_tables("SELECT conv_id, turn, kind FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, kind) AS k FROM messages) WHERE k = 1", "messages"))
def kb_documents(spark, folder) -> DataFrame:
    """The newest part of each thread."""
    return R.latest_per_key(T.messages(spark, folder), ["conv_id"], [F.desc_nulls_last("turn"), F.asc("kind")]).select("conv_id", "turn", "kind")


@query(with_tables("SELECT a.case_id, a.action_id, a.action, u.user_name FROM actions a LEFT JOIN users u ON a.user_id = u.user_id", "actions", "users"))
def case_history(spark, folder) -> DataFrame:
    return R.enrich(T.actions(spark, folder), [(T.users(spark, folder).select("user_id", "user_name"), "user_id", "user_id")]).select("case_id", "action_id", "action", "user_name")


@query(with_tables("SELECT user_id, action AS module, count(*) AS n, count(*) FILTER (weight = 0) AS unread FROM actions GROUP BY 1, 2", "actions"))
def notification_counts(spark, folder) -> DataFrame:
    return R.count_where(T.actions(spark, folder).withColumnRenamed("action", "module"), ["user_id", "module"], {"n": F.lit(True), "unread": F.col("weight") == 0})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parsed_details(spark, folder) -> DataFrame:
    """Log details from their JSON text."""
    return T.read(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_PETITION = "CASE case_id % 4 WHEN 0 THEN 'Radicado No. 2024-' || (100000 + case_id) || '. ' WHEN 1 THEN 'ref 11001400' || (1000 + case_id) || ' ' ELSE '' END || CASE WHEN case_id % 3 = 0 THEN 'Juzgado ' || (case_id % 40 + 1) || '  Civil Municipal de Bogotá, ' WHEN case_id % 3 = 1 THEN 'JUZGADO 5 penal del circuito.' ELSE '' END || CASE WHEN case_id % 5 = 0 THEN 'Accionante: María  López identificada con cc 1' WHEN case_id % 5 = 1 THEN 'Yo, Juan Pérez, identificado con cc 2' WHEN case_id % 5 = 2 THEN 'Demandante: Ana Ruiz. the token' ELSE 'sin datos' END"
_STEPS = {
    "docket": "coalesce(regexp_replace(nullif(regexp_extract(p, '(?i)(?:radicado|radicación|rad\\.?)\\s*(?:no\\.?|nro\\.?|número\\.?)?\\s*[:-]?\\s*([0-9\\s.-]{8,25})', 1), ''), '[\\s.-]', '', 'g'), nullif(regexp_extract(p, '(?:^|[^A-Za-z0-9_])([0-9]{11,23})(?:$|[^A-Za-z0-9_])', 1), ''), 'POR DEFINIR')",
    "court": "coalesce(upper(trim(regexp_replace(nullif(regexp_extract(p, '(?i)(juzgado\\s+[0-9A-Za-z_°.]+\\s+(?:municipal|circuito|promiscuo|administrativo|penal|civil|familia|laboral|ejecuci[oó]n)[^,.\\n]{0,60})', 1), ''), '\\s+', ' ', 'g'))), 'PENDIENTE IDENTIFICAR')",
    "claimant": "CASE WHEN case_id % 5 = 0 THEN 'MARÍA LÓPEZ' WHEN case_id % 5 = 1 THEN 'JUAN PÉREZ' WHEN case_id % 5 = 2 THEN 'ANA RUIZ' ELSE 'PENDIENTE IDENTIFICAR' END",
}


def _petitions(spark, folder) -> DataFrame:
    """Petitions with dockets, courts and names in several spellings, one a case."""
    n = F.col("case_id")
    docket = F.when(n % 4 == 0, F.concat(F.lit("Radicado No. 2024-"), (n + 100000).cast("string"), F.lit(". "))).when(n % 4 == 1, F.concat(F.lit("ref 11001400"), (n + 1000).cast("string"), F.lit(" "))).otherwise("")
    court = F.when(n % 3 == 0, F.concat(F.lit("Juzgado "), (n % 40 + 1).cast("string"), F.lit("  Civil Municipal de Bogotá, "))).when(n % 3 == 1, "JUZGADO 5 penal del circuito.").otherwise("")
    name = F.when(n % 5 == 0, "Accionante: María  López identificada con cc 1").when(n % 5 == 1, "Yo, Juan Pérez, identificado con cc 2").when(n % 5 == 2, "Demandante: Ana Ruiz. the token").otherwise("sin datos")
    return T.cases(spark, folder).select("case_id", "received", F.concat(docket, court, name).alias("text"))


@query(with_tables(f", t AS (SELECT case_id, {_PETITION} AS p FROM cases) SELECT case_id, " + ", ".join(f"{v} AS {k}" for k, v in _STEPS.items()) + " FROM t", "cases"))
def extracted_fields(spark, folder) -> DataFrame:
    return X.extract_fields(_petitions(spark, folder), "text").select("case_id", "docket", "court", "claimant")


@query(
    with_tables(
        f""", t AS (SELECT case_id, received, {_PETITION} AS p FROM cases), x AS (SELECT case_id, received, {_STEPS['docket']} AS d, p FROM t),
        k AS (SELECT CASE WHEN d = 'POR DEFINIR' THEN 'SIN-' || case_id ELSE d END AS docket, case_id, received, CASE WHEN p ILIKE '%token%' THEN 'tecnico' WHEN p ILIKE '%identificad%' THEN 'persona' END AS keyword_class FROM x),
        days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '1990-01-01', DATE '2010-01-01', INTERVAL 1 DAY) q(d)), o AS (SELECT day, dayofweek(day) NOT IN (0, 6) AS b, sum(CAST(dayofweek(day) NOT IN (0, 6) AS INTEGER)) OVER (ORDER BY day) AS n FROM days),
        u AS (SELECT *, row_number() OVER (PARTITION BY docket ORDER BY case_id DESC) AS r FROM k)
        SELECT docket, case_id, keyword_class, x.day AS due FROM u LEFT JOIN o f ON u.received = f.day LEFT JOIN o x ON x.b AND x.n = f.n + 10 WHERE r = 1""",
        "cases",
    )
)
def ingested_cases(spark, folder) -> DataFrame:
    """Petitions as cases: cleaned, fields extracted, classified, due after ten business days; of one docket the last petition stays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1990-01-01").cast("date"), F.lit("2009-12-31").cast("date"))).alias("day"))
    calendar = R.business_calendar(days, days.where("false"))
    p = _petitions(spark, folder).withColumn("text", X.repair_layout(X.clean_text(F.col("text"), [r"[#*$%&]{3}"])))
    found = X.classify_keywords(X.extract_fields(p, "text"), "text", [("tecnico", ["token"]), ("persona", ["identificado", "identificada"])])
    keyed = found.withColumn("docket", F.when(F.col("docket") == X.NO_DOCKET, F.concat(F.lit("SIN-"), F.col("case_id").cast("string"))).otherwise(F.col("docket")))
    dated = R.business_due_date(R.latest_per_key(keyed, ["docket"], [F.desc("case_id")]), "received", F.lit(10), calendar, "due").select("docket", "case_id", "keyword_class", "due")
    return M.upsert(dated.limit(0), dated, "docket", ["case_id", "keyword_class", "due"])


@query()
def ingested_knowledge(spark, folder) -> DataFrame:
    """Cleaned files as titled knowledge chunks."""
    cleaned = T.files(spark, folder).select("file_id", X.clean_text(F.coalesce("text", F.lit("")), [r"[#*$%&]{3}"]).alias("text"))
    chunks = X.chunk_documents(cleaned, "file_id", "text", 1500, 300, r"\n")
    return K.titled_chunks(chunks, "file_id", F.concat(F.lit("archivo "), F.col("file_id").cast("string")))
