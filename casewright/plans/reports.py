"""Operational reports over cases, requests, payments, actions and goals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import relational as R
from casewright.plans.registry import ORACLE_SQL as QUERIES_SQL
from casewright.plans.registry import query
from casewright.sources import tables as T
from casewright.sources.tables import AS_OF, with_tables

CLOSED = ["Respondida"]
RATE = "CASE WHEN {whole} > 0 THEN CAST((2000 * {part} + {whole}) // (2 * {whole}) AS DOUBLE) / 10 END"


def _rate(part: str, whole: str) -> str:
    return RATE.format(part=part, whole=whole)


@query(
    with_tables(
        """, r AS (SELECT case_id, count(*) AS open_requests FROM requests WHERE state <> 'Respondido' GROUP BY 1),
        a AS (SELECT case_id, count(*) AS n_actions FROM actions GROUP BY 1),
        f AS (SELECT c.case_id, c.due, coalesce(date_diff('day', DATE '1998-06-01', c.due), 0) AS days, c.priority,
                     coalesce(open_requests, 0) AS open_requests, coalesce(n_actions, 0) AS n_actions
              FROM cases c LEFT JOIN r ON c.case_id = r.case_id LEFT JOIN a ON c.case_id = a.case_id WHERE c.state <> 'Respondida'),
        s AS (SELECT *, CAST(least(100, CASE WHEN days <= 0 THEN 40 WHEN days <= 1 THEN 35 WHEN days <= 3 THEN 25 WHEN days <= 7 THEN 15 WHEN days <= 15 THEN 5 ELSE 0 END
                + CASE priority WHEN 'Alta' THEN 30 WHEN 'Media' THEN 15 ELSE 0 END + least(7 * open_requests, 20)
                + CASE WHEN n_actions = 0 THEN 10 WHEN n_actions <= 2 THEN 5 ELSE 0 END) AS BIGINT) AS score FROM f)
        SELECT case_id, due, CAST(days AS BIGINT) AS days, open_requests, n_actions, score, CASE WHEN score >= 70 THEN 'Alto' WHEN score >= 40 THEN 'Medio' ELSE 'Bajo' END AS level FROM s""",
        "cases", "requests", "actions",
    )
)
def case_risk_score(spark, folder) -> DataFrame:
    """Points for days to the deadline, priority, open requests and missing activity, 100 at most."""
    open_cases = T.cases(spark, folder).where(~F.col("state").isin(CLOSED))
    found = R.with_child_counts(open_cases, "case_id", {"open_requests": T.requests(spark, folder).where("state <> 'Respondido'"), "n_actions": T.actions(spark, folder)})
    days = F.coalesce(C.due_days("due", AS_OF), F.lit(0).cast("long"))
    steps = reduce(lambda out, x: out.when(F.col("days") <= x[0], x[1]), [(1, 35), (3, 25), (7, 15), (15, 5)], F.when(F.col("days") <= 0, 40)).otherwise(0)
    urgency = F.when(F.col("priority") == "Alta", 30).when(F.col("priority") == "Media", 15).otherwise(0)
    idle = F.when(F.col("n_actions") == 0, 10).when(F.col("n_actions") <= 2, 5).otherwise(0)
    scored = found.withColumn("days", days).withColumn("score", F.least(F.lit(100).cast("long"), steps + urgency + F.least(F.col("open_requests") * 7, F.lit(20).cast("long")) + idle))
    level = F.when(F.col("score") >= 70, "Alto").when(F.col("score") >= 40, "Medio").otherwise("Bajo")
    return scored.select("case_id", "due", "days", "open_requests", "n_actions", "score", level.alias("level"))


@query(with_tables("SELECT invoked_right, coalesce(nullif(trim(court), ''), 'Sin juzgado') AS court_label, count(*) AS cases, count(*) FILTER (ruling = 'Favorable') AS won, " + _rate("count(*) FILTER (ruling = 'Favorable')", "count(ruling)") + " AS success_rate FROM cases GROUP BY 1, court", "cases"))
def ruling_patterns(spark, folder) -> DataFrame:
    """Success by right and raw court: padded or empty courts stay rows of their own, though they show the same label."""
    g = T.cases(spark, folder).groupBy("invoked_right", "court").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("ruling") == "Favorable").alias("won"), F.count("ruling").alias("ruled"))
    return g.select("invoked_right", C.clean_label("court", "Sin juzgado").alias("court_label"), "cases", "won", C.rate("won", "ruled").alias("success_rate"))


@query(with_tables("SELECT u.user_id, u.user_name, count(c.case_id) AS total, count(*) FILTER (c.state = 'Respondida') AS done, " + _rate("count(*) FILTER (c.state = 'Respondida')", "count(c.case_id)") + " AS done_rate, min(CASE WHEN c.state <> 'Respondida' THEN c.due END) AS next_due FROM users u LEFT JOIN cases c ON c.owner_id = u.user_id AND c.is_active GROUP BY 1, 2 HAVING count(c.case_id) > 0", "users", "cases"))
def workload_by_owner(spark, folder) -> DataFrame:
    """Active cases of each owner, with the next deadline; owners without a case are left out."""
    own = T.cases(spark, folder).withColumnRenamed("owner_id", "user_id")
    per = R.left_join_where(T.users(spark, folder), own, "user_id", F.col("is_active"))
    g = per.groupBy("user_id", "user_name").agg(F.count("case_id").alias("total"), F.count_if(F.col("state") == "Respondida").alias("done"), F.min(F.when(F.col("state") != "Respondida", F.col("due"))).alias("next_due"))
    return g.where("total > 0").select("user_id", "user_name", "total", "done", C.rate("done", "total").alias("done_rate"), "next_due")


@query(with_tables("SELECT group_name, count(answered) AS answered, CAST(sum(date_diff('day', created, answered)) AS DOUBLE) / count(answered) AS mean_days, CAST(sum(date_diff('day', created, answered)) FILTER (priority = 'Alta') AS DOUBLE) / nullif(count(answered) FILTER (priority = 'Alta'), 0) AS mean_high FROM requests r JOIN groups g ON r.group_id = g.group_id GROUP BY 1", "requests", "groups"))
def response_time_by_group(spark, folder) -> DataFrame:
    """Mean days from request to answer by group; the group's mean is over all its answers, not over priorities."""
    r = T.requests(spark, folder).withColumn("took", F.datediff("answered", "created").cast("long"))
    high = F.col("priority") == "Alta"
    per = r.groupBy("group_id").agg(F.count("answered").alias("answered"), F.sum("took").alias("days"), F.sum(F.when(high, F.col("took"))).alias("high_days"), F.count(F.when(high, F.col("answered"))).alias("high"))
    return per.join(T.groups(spark, folder), "group_id").select("group_name", "answered", C.mean_of("days", "answered").alias("mean_days"), C.mean_of("high_days", "high").alias("mean_high"))


@query(with_tables("SELECT count(*) AS n, CAST(sum(amount) AS DECIMAL(25,2)) AS total, count(*) FILTER (state = 'aprobado') AS approved, count(*) FILTER (state = 'rechazado') AS rejected, CAST(sum(amount) FILTER (state = 'solicitado') AS DECIMAL(25,2)) AS pending FROM payments WHERE is_active", "payments"))
def payment_kpis(spark, folder) -> DataFrame:
    state = F.col("state")
    p = R.scan_active(T.payments(spark, folder))
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(25,2)").alias("total"), F.count_if(state == "aprobado").alias("approved"), F.count_if(state == "rechazado").alias("rejected"), F.sum(F.when(state == "solicitado", F.col("amount"))).cast("decimal(25,2)").alias("pending"))


@query(with_tables("SELECT strftime(asked, '%Y-%m') AS month, count(*) AS n, CAST(sum(amount) AS DECIMAL(25,2)) AS total FROM payments WHERE is_active GROUP BY 1", "payments"))
def payment_trend(spark, folder) -> DataFrame:
    return R.scan_active(T.payments(spark, folder)).groupBy(F.date_format("asked", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(25,2)").alias("total"))


@query(with_tables("SELECT contract_id, line, amount, p.state, entity_name, group_name FROM payments p LEFT JOIN entities e ON creditor_id = entity_id LEFT JOIN groups g ON e.group_id = g.group_id WHERE asked BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'", "payments", "entities", "groups"))
def payment_list(spark, folder) -> DataFrame:
    """Payments of a date range with their creditor and its group; the range reaches the scan."""
    p = C.date_range(T.payments(spark, folder), "asked", "1996-01-01", "1996-03-31")
    full = R.enrich(p, [(T.entities(spark, folder), "creditor_id", "entity_id"), (T.groups(spark, folder), "group_id", "group_id")])
    return full.select("contract_id", "line", "amount", "state", "entity_name", "group_name")


@query(with_tables("SELECT p.contract_id, p.line, p.state, a.action, a.created FROM payments p JOIN actions a ON p.contract_id = a.case_id WHERE p.state = 'rechazado'", "payments", "actions"))
def payment_trace(spark, folder) -> DataFrame:
    p = T.payments(spark, folder).where("state = 'rechazado'").select("contract_id", "line", "state")
    return p.join(T.actions(spark, folder).select(F.col("case_id").alias("contract_id"), "action", "created"), "contract_id")


@query(with_tables("SELECT kind, count(*) AS n, count(DISTINCT conv_id) AS threads, count(*) FILTER (turn = 0) AS openings FROM messages GROUP BY 1", "messages"))
def message_kpis(spark, folder) -> DataFrame:
    return T.messages(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("threads"), F.count_if(F.col("turn") == 0).alias("openings"))


_DONE = "d AS (SELECT user_id, CAST(sum(weight) AS BIGINT) AS done FROM actions GROUP BY 1), g AS (SELECT goals.*, coalesce(done, 0) AS done FROM goals LEFT JOIN d ON goals.user_id = d.user_id)"


def _goals(spark, folder) -> DataFrame:
    return R.attainment(T.goals(spark, folder), T.actions(spark, folder), ["user_id"])


@query(with_tables(f", {_DONE} SELECT goal_id, target, done, CASE WHEN target <> 0 THEN done * 100 / target END AS percent FROM g", "goals", "actions"))
def goal_attainment_individual(spark, folder) -> DataFrame:
    return _goals(spark, folder).select("goal_id", "target", "done", "percent")


@query(with_tables(f", {_DONE} SELECT team_id, target, CAST(sum(done) AS BIGINT) AS done, count(*) AS members FROM g GROUP BY 1, 2", "goals", "actions"))
def goal_attainment_team(spark, folder) -> DataFrame:
    """Goals of one team with equal targets merge."""
    return _goals(spark, folder).groupBy("team_id", "target").agg(F.sum("done").alias("done"), F.count(F.lit(1)).alias("members"))


@query(with_tables(f", {_DONE}, p AS (SELECT team_id, (1000 * done) // nullif(target, 0) AS permille FROM g) SELECT team_id, count(permille) AS goals, CAST(sum(permille) AS DOUBLE) / nullif(count(permille), 0) AS mean_permille FROM p GROUP BY 1", "goals", "actions"))
def goal_attainment_global(spark, folder) -> DataFrame:
    """Mean over goals of each goal's ratio; goals with a target of 0 have none."""
    p = _goals(spark, folder).withColumn("permille", F.expr("(1000 * done) div nullif(target, 0)"))
    return p.groupBy("team_id").agg(F.count("permille").alias("goals"), F.sum("permille").alias("s")).select("team_id", "goals", C.mean_of("s", "goals").alias("mean_permille"))


@query(with_tables("SELECT g.team_id, strftime(a.created, '%Y-%m') AS month, count(a.action_id) AS n, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight FROM goals g LEFT JOIN actions a ON g.user_id = a.user_id GROUP BY 1, 2", "goals", "actions"))
def goal_history_team(spark, folder) -> DataFrame:
    """By month of action; goals without any have a null month."""
    per = T.actions(spark, folder).groupBy("user_id", F.date_format("created", "yyyy-MM").alias("month")).agg(F.count("action_id").alias("n"), F.sum("weight").alias("weight"))
    return T.goals(spark, folder).join(per, "user_id", "left").groupBy("team_id", "month").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.sum("weight"), F.lit(0).cast("long")).alias("weight"))


@query(with_tables("SELECT gr.group_name AS team, u.user_name, g.goal_id, g.target, a.action_id, a.action, a.weight FROM groups gr JOIN users u ON u.team_id = gr.group_id JOIN goals g ON g.user_id = u.user_id LEFT JOIN actions a ON a.user_id = u.user_id WHERE gr.group_id = 3", "groups", "users", "goals", "actions"))
def team_export(spark, folder) -> DataFrame:
    """Flat rows team, member, goal, action of one team."""
    team = T.groups(spark, folder).where("group_id = 3").select(F.col("group_id").alias("team_id"), F.col("group_name").alias("team"))
    members = T.users(spark, folder).join(team, "team_id").select("user_id", "user_name", "team")
    goals = members.join(T.goals(spark, folder).select("user_id", "goal_id", "target"), "user_id")
    return goals.join(T.actions(spark, folder).select("user_id", "action_id", "action", "weight"), "user_id", "left").select("team", "user_name", "goal_id", "target", "action_id", "action", "weight")


@query(with_tables("SELECT c.case_id, c.state, c.priority, CASE WHEN len(m.owners) > 0 THEN array_to_string(m.owners, ',') ELSE CAST(c.owner_id AS VARCHAR) END AS owners FROM cases c LEFT JOIN (SELECT case_id, list_sort(list_distinct(list(user_id))) AS owners FROM actions GROUP BY 1) m ON c.case_id = m.case_id", "cases", "actions"))
def case_list(spark, folder) -> DataFrame:
    """Cases with their team, or else their single owner."""
    found = R.collapse_bridge(T.cases(spark, folder), T.actions(spark, folder), "case_id", "user_id", "members")
    owners = F.when(F.size("members") > 0, F.array_join(F.transform("members", lambda x: x.cast("string")), ",")).otherwise(F.col("owner_id").cast("string"))
    return found.select("case_id", "state", "priority", owners.alias("owners"))


@query(with_tables("SELECT strftime(received, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (state = 'Respondida') AS resolved FROM cases GROUP BY 1 ORDER BY 1 LIMIT 6", "cases"))
def case_monthly(spark, folder) -> DataFrame:
    """The first six months; the state that counts as resolved is a parameter of the report."""
    g = T.cases(spark, folder).groupBy(F.date_format("received", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "Respondida").alias("resolved"))
    return R.top_k(g, 6, F.asc("month"))


@query(with_tables("SELECT count(*) AS cases, CAST(count(*) AS DOUBLE) * 100 / 60 AS hours, CAST(count(*) AS DOUBLE) * 100 / 60 * 50 AS saved FROM cases WHERE is_active", "cases"))
def roi(spark, folder, minutes: int = 100, hourly: int = 50) -> DataFrame:
    n = F.col("cases").cast("double") * minutes / 60
    return R.scan_active(T.cases(spark, folder)).agg(F.count(F.lit(1)).alias("cases")).select("cases", n.alias("hours"), (n * hourly).alias("saved"))


@query(with_tables("SELECT u.role, count(c.case_id) AS active, count(*) FILTER (c.due < DATE '1998-06-01') AS overdue FROM users u LEFT JOIN cases c ON c.owner_id = u.user_id AND c.state <> 'Respondida' AND c.is_active GROUP BY 1", "users", "cases"))
def active_workload(spark, folder) -> DataFrame:
    own = T.cases(spark, folder).withColumnRenamed("owner_id", "user_id").select("user_id", "case_id", "due", "state", "is_active")
    open_ = (F.col("state") != "Respondida") & F.col("is_active")
    joined = R.left_join_where(T.users(spark, folder), own, "user_id", open_)
    return R.count_where(joined, ["role"], {"active": F.col("case_id").isNotNull(), "overdue": F.col("due") < F.lit(AS_OF).cast("date")})


@query(with_tables("SELECT r.case_id, r.line, g.group_name, r.priority, CAST(CASE r.priority WHEN 'Alta' THEN 1 WHEN 'Media' THEN 2 ELSE 3 END AS INTEGER) AS urgency, r.created FROM requests r JOIN groups g ON r.group_id = g.group_id WHERE r.state = 'Pendiente' ORDER BY urgency, r.created DESC, r.case_id, r.line, g.group_name LIMIT 200", "requests", "groups"))
def request_queue(spark, folder) -> DataFrame:
    """The 200 most urgent open requests: priority, then newest."""
    r = T.requests(spark, folder).where("state = 'Pendiente'").join(T.groups(spark, folder), "group_id")
    return R.top_k(r.select("case_id", "line", "group_name", "priority", C.rank_label("priority", ["Alta", "Media", "Baja"]).alias("urgency"), "created"), 200, F.asc("urgency"), F.desc("created"), F.asc("case_id"), F.asc("line"), F.asc("group_name"))


@query(with_tables("SELECT a.action_id, a.action, c.case_id, c.state FROM actions a LEFT JOIN cases c ON a.action = 'click' AND CAST(a.case_id AS VARCHAR) = CAST(c.case_id AS VARCHAR)", "actions", "cases"))
def audit_log(spark, folder) -> DataFrame:
    """Log rows with the case they are about; only rows of one kind refer to cases."""
    log = T.actions(spark, folder).select("action_id", "action", F.col("case_id").alias("ref"))
    return R.poly_join(log, T.cases(spark, folder).select("case_id", "state"), "action", "click", "ref", "case_id").select("action_id", "action", "case_id", "state")


@query(with_tables("SELECT action_id, user_id, action FROM actions WHERE action ILIKE '%li%' OR details ILIKE '%li%' ORDER BY created DESC, action_id LIMIT 20 OFFSET 20", "actions"))
def audit_log_page(spark, folder) -> DataFrame:
    found = C.search(T.actions(spark, folder), ["action", "details"], "li")
    return R.page(found, [F.desc("created"), F.asc("action_id")], 2, 20).select("action_id", "user_id", "action")


@query(with_tables("SELECT action_id, user_id, action FROM actions ORDER BY created DESC, action_id LIMIT 20 OFFSET 9960", "actions"))
def audit_log_deep_page(spark, folder) -> DataFrame:
    """A late page of the whole log, newest first, from a table whose pages are found by their first keys."""
    from casewright.operators import paging
    from casewright.sources.store import scratch_folder

    log = T.actions(spark, folder).select((-F.unix_micros("created")).alias("newest"), "action_id", "user_id", "action")
    paging.write_paged(log, at := scratch_folder(spark), ["newest", "action_id"], 20)
    return paging.read_page(spark, at, ["newest", "action_id"], 499).select("action_id", "user_id", "action")


@query(with_tables("SELECT action_id, user_id, action FROM actions WHERE user_id = 7 ORDER BY created DESC, action_id LIMIT 10", "actions"))
def my_recent_actions(spark, folder) -> DataFrame:
    return R.top_k(T.actions(spark, folder).where("user_id = 7").select("action_id", "user_id", "action", "created"), 10, F.desc("created"), F.asc("action_id")).drop("created")


@query(with_tables("SELECT user_id, action_id, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC NULLS LAST, action_id) AS k FROM actions) WHERE k = 1", "actions"))
def latest_action_per_user(spark, folder) -> DataFrame:
    return R.latest_per_key(T.actions(spark, folder), ["user_id"], [F.desc_nulls_last("created"), F.asc("action_id")]).select("user_id", "action_id", "action")


@query(with_tables("SELECT 'caso' AS kind, CAST(case_id AS VARCHAR) AS id FROM cases WHERE NOT is_active UNION ALL SELECT 'archivo', CAST(file_id AS VARCHAR) FROM files WHERE NOT is_active", "cases", "files"))
def trash(spark, folder) -> DataFrame:
    a = R.scan_trash(T.cases(spark, folder)).select(F.lit("caso").alias("kind"), F.col("case_id").cast("string").alias("id"))
    return a.unionByName(R.scan_trash(T.files(spark, folder)).select(F.lit("archivo").alias("kind"), F.col("file_id").cast("string").alias("id")))


@query(with_tables("SELECT file_id, kind, category, risk FROM files WHERE is_active AND kind = 'src3' AND category IN ('en', 'fr')", "files"))
def file_list(spark, folder) -> DataFrame:
    found = C.optional_filters(R.scan_active(T.files(spark, folder)), {"kind": "src3", "category": ["en", "fr"], "risk": None})
    return found.select("file_id", "kind", "category", "risk")


@query(with_tables("SELECT kind, count(*) AS files, count(*) FILTER (risk = 'Alto') AS high, count(*) FILTER (risk = 'Medio') AS medium, count(*) FILTER (risk = 'Bajo') AS low, " + _rate("count(*) FILTER (risk = 'Alto')", "count(risk)") + " AS high_rate FROM files WHERE is_active GROUP BY 1", "files"))
def file_dashboard(spark, folder) -> DataFrame:
    g = R.count_where(R.scan_active(T.files(spark, folder)), ["kind"], {"files": F.lit(True), "high": F.col("risk") == "Alto", "medium": F.col("risk") == "Medio", "low": F.col("risk") == "Bajo", "judged": F.col("risk").isNotNull()})
    return g.select("kind", "files", "high", "medium", "low", C.rate("high", "judged").alias("high_rate"))


@query(with_tables("SELECT state, count(*) AS n, count(*) FILTER (due < DATE '1998-06-01' AND state <> 'Respondida') AS overdue FROM cases GROUP BY 1", "cases"))
def overdue_by_state(spark, folder) -> DataFrame:
    return R.count_where(T.cases(spark, folder), ["state"], {"n": F.lit(True), "overdue": C.is_overdue("due", "state", CLOSED, AS_OF)})


@query(with_tables("SELECT kind, count(*) AS files, count(risk) AS judged, mode(risk ORDER BY risk) AS usual_risk, count(DISTINCT category) AS categories FROM files GROUP BY 1", "files"))
def library_stats(spark, folder) -> DataFrame:
    return T.files(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.count("risk").alias("judged"), F.expr("mode() WITHIN GROUP (ORDER BY risk)").alias("usual_risk"), F.countDistinct("category").alias("categories"))


@query(with_tables("SELECT team_id, group_name, count(*) AS members FROM users JOIN groups ON team_id = group_id GROUP BY 1, 2", "users", "groups"))
def team_sizes(spark, folder) -> DataFrame:
    per = T.users(spark, folder).groupBy("team_id").agg(F.count(F.lit(1)).alias("members"))
    return per.join(T.groups(spark, folder).select(F.col("group_id").alias("team_id"), "group_name"), "team_id").select("team_id", "group_name", "members")


@query(with_tables("SELECT c.case_id FROM cases c WHERE EXISTS (SELECT 1 FROM requests r WHERE r.case_id = c.case_id AND r.priority = 'Alta') AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.case_id = c.case_id)", "cases", "requests", "actions"))
def cases_without_activity(spark, folder) -> DataFrame:
    """Cases with an urgent request (semi join) and no action (anti join)."""
    urgent = T.requests(spark, folder).where("priority = 'Alta'")
    return T.cases(spark, folder).join(urgent, "case_id", "left_semi").join(T.actions(spark, folder), "case_id", "left_anti").select("case_id")


@query(with_tables("SELECT c.case_id, EXISTS (SELECT 1 FROM actions a WHERE a.case_id = c.case_id) AS has_actions FROM cases c", "cases", "actions"))
def case_activity_flags(spark, folder) -> DataFrame:
    return R.has_child(T.cases(spark, folder).select("case_id"), T.actions(spark, folder), "case_id", "has_actions")


@query(with_tables("SELECT DISTINCT u.user_id, u.role, a.action FROM users u JOIN actions a ON u.user_id = a.user_id WHERE u.role = 'BUILDING' OR a.action = 'view'", "users", "actions"))
def granted_actions(spark, folder) -> DataFrame:
    """Users of one role may do everything, others only what is granted to them."""
    asked = T.actions(spark, folder).select("user_id", "action").distinct().join(T.users(spark, folder).select("user_id", "role"), "user_id")
    grants = asked.select("action").where("action = 'view'").distinct()
    admin = asked.where("role = 'BUILDING'")
    return admin.unionByName(asked.where("role <> 'BUILDING' or role is null").join(grants, "action", "left_semi").select(*admin.columns)).select("user_id", "role", "action")


@query(with_tables("SELECT c.case_id, CAST(c.amount_rank AS BIGINT) AS n_payments, t.mean_payments FROM (SELECT c.case_id, count(p.line) AS amount_rank FROM cases c LEFT JOIN payments p ON p.contract_id = c.case_id GROUP BY 1) c, (SELECT CAST(count(*) AS DOUBLE) / count(DISTINCT contract_id) AS mean_payments FROM payments) t", "cases", "payments"))
def payments_against_mean(spark, folder) -> DataFrame:
    """Each case's payments beside the mean of all contracts, as a scalar column."""
    p = T.payments(spark, folder)
    per = R.with_child_counts(T.cases(spark, folder).select("case_id"), "case_id", {"n_payments": p.withColumnRenamed("contract_id", "case_id")})
    mean = p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("contract_id").alias("k")).select(C.mean_of("n", "k").alias("mean_payments"))
    return R.with_scalar(per, mean)


@query(with_tables("""SELECT case_id, priority, CASE WHEN priority = 'Alta' AND due - received > 20 THEN 'late_high;' ELSE '' END || CASE WHEN ruling IS NULL THEN 'no_ruling;' ELSE '' END AS errors
    FROM cases WHERE (priority = 'Alta' AND due - received > 20) OR ruling IS NULL""", "cases"))
def rejected_cases(spark, folder) -> DataFrame:
    rules = {"late_high": ~((F.col("priority") == "Alta") & (F.datediff("due", "received") > 20)), "no_ruling": F.col("ruling").isNotNull()}
    _, bad = C.validate_rows(T.cases(spark, folder), rules)
    return bad.select("case_id", "priority", F.concat(F.array_join("errors", ";"), F.lit(";")).alias("errors"))


@query(with_tables("""SELECT c.case_id, CASE WHEN c.case_id % 3 = 0 AND c.case_id % 4 <> 0 THEN 'Respondida' ELSE c.state END AS state,
    CASE WHEN c.case_id % 3 = 0 AND c.case_id % 4 <> 0 THEN false ELSE c.is_active END AS is_active FROM cases c""", "cases"))
def applied_transitions(spark, folder) -> DataFrame:
    from casewright.operators.changes import apply_transitions

    c = T.cases(spark, folder)
    out, _, _ = apply_transitions(c, c.where("case_id % 3 = 0 AND case_id % 4 <> 0").select("case_id", F.lit("Respondida").alias("state")), "case_id", CLOSED)
    return out.select("case_id", "state", "is_active")


@query(with_tables("SELECT case_id, state AS old_state, 'Respondida' AS new_state FROM cases WHERE case_id % 3 = 0 AND case_id % 4 <> 0 AND state <> 'Respondida'", "cases"))
def transition_audit(spark, folder) -> DataFrame:
    from casewright.operators.changes import apply_transitions

    c = T.cases(spark, folder)
    _, audit, _ = apply_transitions(c, c.where("case_id % 3 = 0 AND case_id % 4 <> 0").select("case_id", F.lit("Respondida").alias("state")), "case_id", CLOSED)
    return audit


@query(with_tables("SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN upper(entity_name) ELSE entity_name END AS entity_name, group_id FROM entities", "entities"))
def patched_entities(spark, folder) -> DataFrame:
    from casewright.operators.changes import patch_merge

    e = T.entities(spark, folder)
    patch = e.select("entity_id", F.when(F.col("entity_id") % 2 == 0, F.upper("entity_name")).alias("entity_name"))
    return patch_merge(e, patch, "entity_id", ["entity_name"])


@query(with_tables("SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'nuevo' ELSE role END AS role FROM users UNION ALL SELECT user_id + 10000000, 'nuevo' FROM users WHERE user_id % 5 = 0", "users"))
def upserted_users(spark, folder) -> DataFrame:
    from casewright.operators.changes import upsert

    base = T.users(spark, folder).select("user_id", "role")
    new = base.where("user_id % 5 = 0").select("user_id", F.lit("nuevo").alias("role"))
    return upsert(base, new.unionByName(new.withColumn("user_id", F.col("user_id") + 10000000)), "user_id", ["role"])


@query(with_tables(", d AS (SELECT role, row_number() OVER (ORDER BY role) AS role_id FROM (SELECT DISTINCT role FROM users WHERE role IS NOT NULL)) SELECT user_id, user_name, role_id FROM users LEFT JOIN d ON users.role = d.role", "users"))
def normalised_roles(spark, folder) -> DataFrame:
    from casewright.operators.changes import extract_dimension

    _, out = extract_dimension(T.users(spark, folder).select("user_id", "user_name", "role"), "role", "role_id")
    return out.select("user_id", "user_name", "role_id")


@query(with_tables("SELECT creditor_id, state, count(*) AS n FROM payments WHERE creditor_id IN (SELECT entity_id FROM entities WHERE group_id < 5) GROUP BY 1, 2 HAVING count(*) >= 3", "payments", "entities"))
def payments_of_groups(spark, folder) -> DataFrame:
    p = T.payments(spark, folder).join(T.entities(spark, folder).where("group_id < 5").select(F.col("entity_id").alias("creditor_id")), "creditor_id", "left_semi")
    return p.groupBy("creditor_id", "state").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(with_tables("SELECT case_id, owner_id, date_diff('day', DATE '1998-06-01', due) AS days, CASE WHEN date_diff('day', DATE '1998-06-01', due) <= 0 THEN 'vence hoy o vencida' WHEN date_diff('day', DATE '1998-06-01', due) = 1 THEN 'vence mañana' ELSE 'vence pronto' END AS alert FROM cases WHERE is_active AND state <> 'Respondida' AND date_diff('day', DATE '1998-06-01', due) <= 3", "cases"))
def deadline_alerts(spark, folder) -> DataFrame:
    from casewright.streaming import alerts

    return alerts.deadline_alerts(T.cases(spark, folder), AS_OF)


@query(with_tables(""", days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d)),
    cal AS (SELECT day, dayofweek(day) NOT IN (0, 6) AND NOT (month(day) = 1 AND dayofmonth(day) = 1) AS b FROM days),
    o AS (SELECT day, b, sum(CAST(b AS INTEGER)) OVER (ORDER BY day) AS k FROM cal)
    SELECT c.case_id, c.received, x.day AS reply_by FROM cases c JOIN o f ON c.received = f.day LEFT JOIN o x ON x.b AND x.k = f.k + 10""", "cases"))
def business_due_date(spark, folder) -> DataFrame:
    """Ten business days after reception; weekends and New Year's days don't count."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-30").cast("date"))).alias("day"))
    holidays = days.where("month(day) = 1 and dayofmonth(day) = 1")
    calendar = R.business_calendar(days, holidays)
    return R.business_due_date(T.cases(spark, folder).select("case_id", "received"), "received", F.lit(10), calendar, "reply_by").select("case_id", "received", "reply_by")


@query(
    QUERIES_SQL["case_risk_score"] + " ORDER BY score DESC, due NULLS LAST, case_id LIMIT 50"
)
def riskiest_cases(spark, folder) -> DataFrame:
    """The 50 cases with most points; among equals the earlier deadline comes first."""
    return R.top_k(case_risk_score(spark, folder), 50, F.desc("score"), F.asc_nulls_last("due"), F.asc("case_id"))
