"""Case-management tables: schemas, and the adapters that bind them to the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that predicates such as "overdue" refer to.
AS_OF = "1998-06-01"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """Document source: plain text files (one row a file), JSON lines or Parquet; other kinds are refused."""
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if kind in ("json", "parquet"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"unknown document kind: {kind}")


def cases(spark, folder) -> DataFrame:
    o = read(spark, folder, "orders")
    status, level = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("owner_id"),
        F.when(status == "F", "Respondida").when(status == "O", "Pendiente").otherwise("En Proceso").alias("state"),
        F.when(level.isin("1", "2"), "Alta").when(level == "3", "Media").otherwise("Baja").alias("priority"),
        day.alias("received"),
        F.date_add(day, (F.col("o_orderkey") % 30 + 1).cast("int")).alias("due"),
        F.when(F.col("o_orderkey") % 7 < 2, "Favorable").when(F.col("o_orderkey") % 7 == 2, "Desfavorable").alias("ruling"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Juzgado "), (F.col("o_custkey") % 10).cast("string"))).alias("court"),
        F.col("o_orderpriority").alias("invoked_right"),
        (F.col("o_orderkey") % 11 != 0).alias("is_active"),
    )


def requests(spark, folder) -> DataFrame:
    li, s = read(spark, folder, "lineitem"), read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    day, line = F.to_date("l_shipdate"), F.col("l_linenumber") % 3
    joined = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.when(F.col("l_linestatus") == "F", "Respondido").otherwise("Pendiente").alias("state"),
        F.when(line == 0, "Alta").when(line == 1, "Media").otherwise("Baja").alias("priority"),
        day.alias("created"),
        F.when(F.col("l_linestatus") == "F", F.date_add(day, F.col("l_quantity").cast("int"))).alias("answered"),
        F.col("s_nationkey").cast("long").alias("group_id"),
    )


def payments(spark, folder) -> DataFrame:
    flag = F.col("l_returnflag")
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("contract_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("amount"),
        F.when(flag == "A", "aprobado").when(flag == "R", "rechazado").otherwise("solicitado").alias("state"),
        F.to_date("l_shipdate").alias("asked"),
        F.col("l_suppkey").alias("creditor_id"),
        F.col("l_partkey").alias("project_id"),
        (F.col("l_linestatus") == "O").alias("is_active"),
    )


def actions(spark, folder) -> DataFrame:
    return read(spark, folder, "events").select(
        F.col("event_id").alias("action_id"),
        F.col("user_id"),
        (F.col("event_id") % 4000).alias("case_id"),
        F.col("event_type").alias("action"),
        F.col("ts").cast("timestamp").alias("created"),
        (F.col("event_id") % 5).alias("weight"),
        F.col("props").alias("details"),
    )


def users(spark, folder) -> DataFrame:
    c = read(spark, folder, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_nationkey").cast("long").alias("team_id"), F.col("c_mktsegment").alias("role"))


def entities(spark, folder) -> DataFrame:
    s = read(spark, folder, "supplier")
    return s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), F.col("s_nationkey").cast("long").alias("group_id"))


def groups(spark, folder) -> DataFrame:
    n = read(spark, folder, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("group_name"), F.col("n_regionkey").cast("long").alias("area_id"))


def goals(spark, folder) -> DataFrame:
    u = users(spark, folder)
    return u.select(F.col("user_id").alias("goal_id"), "user_id", "team_id", (F.col("user_id") % 20).alias("target"))


def files(spark, folder) -> DataFrame:
    d, lab = read(spark, folder, "documents"), read(spark, folder, "labels")
    risk = F.when(F.col("toxic") == 1, "Alto").when(F.col("quality") == 0, "Medio").when(F.col("quality") == 1, "Bajo")
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("file_id"), F.col("source").alias("kind"), F.col("lang").alias("category"), F.col("text"), risk.alias("risk"), (F.col("doc_id") % 9 != 0).alias("is_active"))


def file_texts(spark, folder) -> DataFrame:
    """The columns of `files` that need no label: texts meet no other table."""
    return read(spark, folder, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("kind"), F.col("lang").alias("category"), F.col("text"))


def messages(spark, folder) -> DataFrame:
    c = read(spark, folder, "conversations")
    kind = F.when(F.col("role") == "user", "recibida").when(F.col("role") == "assistant", "enviada").otherwise("interna")
    return c.select("conv_id", "turn", kind.alias("kind"), "text")


def expedientes(spark, folder) -> DataFrame:
    """Environmental files."""
    o = read(spark, folder, "orders")
    key, day, level = F.col("o_orderkey"), F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    return o.select(
        key.alias("exp_id"),
        F.when(key % 17 != 0, F.concat(F.lit("Expediente "), key.cast("string"))).alias("title"),
        F.concat(F.lit("N-"), key.cast("string")).alias("number"),
        F.col("o_orderpriority").alias("kind"),
        F.when(key % 4 == 0, "Pendiente").when(key % 4 == 1, "Analizado").when(key % 4 == 2, "Revisado").otherwise("Archivado").alias("state"),
        (key % 8).alias("entity_id"),
        F.when(key % 6 != 0, key % 25).alias("group_id"),
        F.col("o_custkey").alias("owner_id"),
        F.when(key % 19 != 0, day).alias("dated"),
        F.when(key % 5 != 0, F.date_add(day, (key % 400).cast("int"))).alias("due"),
        (key % 11 != 0).alias("is_active"),
        level.cast("int").alias("level"),
    )


def analyses(spark, folder) -> DataFrame:
    """Analyses of environmental files, several for most of them."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    level = F.when(flag == "R", "Crítico").when(flag == "A", "Alto").when(status == "F", "Medio").otherwise("Bajo")
    return read(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("analysis_id"),
        F.col("l_orderkey").alias("exp_id"),
        level.alias("level"),
        F.concat(F.lit("Hallazgo de "), F.col("l_quantity").cast("int").cast("string")).alias("finding"),
        F.concat(F.lit("Ley "), (F.col("l_partkey") % 40).cast("string")).alias("norm"),
        F.to_date("l_shipdate").alias("created"),
    )


def communications(spark, folder) -> DataFrame:
    e = read(spark, folder, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("comm_id"),
        F.concat(F.lit("Asunto "), kind).alias("subject"),
        F.when(kind == "view", "respondida").when(kind == "click", "pendiente").otherwise("en_tramite").alias("state"),
        F.when(F.col("event_id") % 2 == 0, "recibida").otherwise("enviada").alias("kind"),
        F.when(F.col("event_id") % 23 != 0, F.col("user_id") % 8).alias("entity_id"),
        F.col("user_id").alias("owner_id"),
        F.to_date("ts").alias("received"),
        F.date_add(F.to_date("ts"), (F.col("event_id") % 30).cast("int")).alias("due"),
        (F.col("event_id") % 7 != 0).alias("is_active"),
        (F.col("event_id") % 4000).alias("exp_id"),
    )


def communication_groups(spark, folder) -> DataFrame:
    """The groups of each communication; some links stand there twice."""
    e = read(spark, folder, "events").select(F.col("event_id").alias("comm_id"))
    one, two = e.withColumn("group_id", F.col("comm_id") % 25), e.where("comm_id % 3 = 0").withColumn("group_id", (F.col("comm_id") * 7) % 25)
    return one.unionByName(two)


def conformities(spark, folder) -> DataFrame:
    flag = F.col("l_returnflag")
    return read(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("conf_id"),
        F.concat(F.lit("Concepto "), (F.col("l_partkey") % 50).cast("string")).alias("concept"),
        F.when(flag == "A", "liberado").when(flag == "R", "rechazado").otherwise("pendiente").alias("state"),
        F.to_date("l_shipdate").alias("asked"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("amount"),
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_partkey").alias("project_id"),
        F.col("l_orderkey").alias("contract_id"),
        (F.col("l_partkey") % 1000).alias("asked_by"),
        (F.col("l_suppkey") % 50).alias("owner_id"),
        (F.col("l_linestatus") == "O").alias("is_active"),
    )


def audits(spark, folder) -> DataFrame:
    """Contract audits against standard templates."""
    k = F.col("p_partkey")
    return read(spark, folder, "part").select(
        k.alias("audit_id"),
        F.col("p_size").cast("long").alias("template_id"),
        F.when(k % 7 != 0, k % 8).alias("entity_id"),
        (k % 1000).alias("created_by"),
        F.when(k % 3 == 0, "Cerrado").when(k % 3 == 1, "En Seguimiento").otherwise("Abierto").alias("state"),
        F.date_add(F.lit("1997-01-01").cast("date"), (k % 900).cast("int")).alias("created"),
    )


def templates(spark, folder) -> DataFrame:
    size = F.col("p_size").cast("long")
    return read(spark, folder, "part").groupBy(size.alias("template_id")).agg(F.count(F.lit(1)).alias("uses")).select(
        "template_id", F.concat(F.lit("Minuta "), F.col("template_id").cast("string")).alias("title"), (F.col("template_id") % 10 != 0).alias("is_active")
    )


#: The same adapters as DuckDB common table expressions.
SQL = {
    "cases": """SELECT o_orderkey AS case_id, o_custkey AS owner_id,
        CASE o_orderstatus WHEN 'F' THEN 'Respondida' WHEN 'O' THEN 'Pendiente' ELSE 'En Proceso' END AS state,
        CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'Alta' WHEN o_orderpriority[1] = '3' THEN 'Media' ELSE 'Baja' END AS priority,
        CAST(o_orderdate AS DATE) AS received, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 + 1 AS INTEGER) AS DATE) AS due,
        CASE WHEN o_orderkey % 7 < 2 THEN 'Favorable' WHEN o_orderkey % 7 = 2 THEN 'Desfavorable' END AS ruling,
        CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'Juzgado ' || CAST(o_custkey % 10 AS VARCHAR) END AS court,
        o_orderpriority AS invoked_right, o_orderkey % 11 <> 0 AS is_active FROM orders""",
    "requests": """SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) AS line,
        CASE WHEN l_linestatus = 'F' THEN 'Respondido' ELSE 'Pendiente' END AS state,
        CASE l_linenumber % 3 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Media' ELSE 'Baja' END AS priority,
        CAST(l_shipdate AS DATE) AS created,
        CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_shipdate AS DATE) + CAST(floor(l_quantity) AS INTEGER) AS DATE) END AS answered,
        CAST(s_nationkey AS BIGINT) AS group_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "payments": """SELECT l_orderkey AS contract_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_extendedprice AS DECIMAL(15,2)) AS amount,
        CASE l_returnflag WHEN 'A' THEN 'aprobado' WHEN 'R' THEN 'rechazado' ELSE 'solicitado' END AS state,
        CAST(l_shipdate AS DATE) AS asked, l_suppkey AS creditor_id, l_partkey AS project_id, l_linestatus = 'O' AS is_active FROM lineitem""",
    "actions": """SELECT event_id AS action_id, user_id, event_id % 4000 AS case_id, event_type AS action, ts AS created,
        event_id % 5 AS weight, props AS details FROM events""",
    "users": "SELECT c_custkey AS user_id, c_name AS user_name, CAST(c_nationkey AS BIGINT) AS team_id, c_mktsegment AS role FROM customer",
    "entities": "SELECT s_suppkey AS entity_id, s_name AS entity_name, CAST(s_nationkey AS BIGINT) AS group_id FROM supplier",
    "groups": "SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS group_name, CAST(n_regionkey AS BIGINT) AS area_id FROM nation",
    "goals": "SELECT c_custkey AS goal_id, c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS team_id, c_custkey % 20 AS target FROM customer",
    "files": """SELECT d.doc_id AS file_id, source AS kind, lang AS category, text,
        CASE WHEN toxic = 1 THEN 'Alto' WHEN quality = 0 THEN 'Medio' WHEN quality = 1 THEN 'Bajo' END AS risk, d.doc_id % 9 <> 0 AS is_active
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "expedientes": """SELECT o_orderkey AS exp_id, CASE WHEN o_orderkey % 17 <> 0 THEN 'Expediente ' || o_orderkey END AS title, 'N-' || o_orderkey AS number, o_orderpriority AS kind,
        CASE o_orderkey % 4 WHEN 0 THEN 'Pendiente' WHEN 1 THEN 'Analizado' WHEN 2 THEN 'Revisado' ELSE 'Archivado' END AS state,
        o_orderkey % 8 AS entity_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 25 END AS group_id, o_custkey AS owner_id,
        CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS dated,
        CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS DATE) END AS due,
        o_orderkey % 11 <> 0 AS is_active, CAST(o_orderpriority[1] AS INTEGER) AS level FROM orders""",
    "analyses": """SELECT l_orderkey * 10 + l_linenumber AS analysis_id, l_orderkey AS exp_id,
        CASE WHEN l_returnflag = 'R' THEN 'Crítico' WHEN l_returnflag = 'A' THEN 'Alto' WHEN l_linestatus = 'F' THEN 'Medio' ELSE 'Bajo' END AS level,
        'Hallazgo de ' || CAST(floor(l_quantity) AS INTEGER) AS finding, 'Ley ' || (l_partkey % 40) AS norm, CAST(l_shipdate AS DATE) AS created FROM lineitem""",
    "communications": """SELECT event_id AS comm_id, 'Asunto ' || event_type AS subject, CASE event_type WHEN 'view' THEN 'respondida' WHEN 'click' THEN 'pendiente' ELSE 'en_tramite' END AS state,
        CASE WHEN event_id % 2 = 0 THEN 'recibida' ELSE 'enviada' END AS kind, CASE WHEN event_id % 23 <> 0 THEN user_id % 8 END AS entity_id, user_id AS owner_id,
        CAST(ts AS DATE) AS received, CAST(CAST(ts AS DATE) + CAST(event_id % 30 AS INTEGER) AS DATE) AS due, event_id % 7 <> 0 AS is_active, event_id % 4000 AS exp_id FROM events""",
    "communication_groups": "SELECT event_id AS comm_id, event_id % 25 AS group_id FROM events UNION ALL SELECT event_id, (event_id * 7) % 25 FROM events WHERE event_id % 3 = 0",
    "conformities": """SELECT l_orderkey * 10 + l_linenumber AS conf_id, 'Concepto ' || (l_partkey % 50) AS concept,
        CASE l_returnflag WHEN 'A' THEN 'liberado' WHEN 'R' THEN 'rechazado' ELSE 'pendiente' END AS state, CAST(l_shipdate AS DATE) AS asked,
        CAST(l_extendedprice AS DECIMAL(15,2)) AS amount, l_suppkey AS entity_id, l_partkey AS project_id, l_orderkey AS contract_id,
        l_partkey % 1000 AS asked_by, l_suppkey % 50 AS owner_id, l_linestatus = 'O' AS is_active FROM lineitem""",
    "audits": """SELECT p_partkey AS audit_id, CAST(p_size AS BIGINT) AS template_id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 8 END AS entity_id, p_partkey % 1000 AS created_by,
        CASE p_partkey % 3 WHEN 0 THEN 'Cerrado' WHEN 1 THEN 'En Seguimiento' ELSE 'Abierto' END AS state, CAST(DATE '1997-01-01' + CAST(p_partkey % 900 AS INTEGER) AS DATE) AS created FROM part""",
    "templates": "SELECT DISTINCT CAST(p_size AS BIGINT) AS template_id, 'Minuta ' || p_size AS title, p_size % 10 <> 0 AS is_active FROM part",
    "messages": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'recibida' WHEN 'assistant' THEN 'enviada' ELSE 'interna' END AS kind, text FROM conversations",
}


def with_tables(sql: str, *names: str) -> str:
    """`sql` (a SELECT, or further CTEs and a SELECT that begin with a comma) over the adapters named."""
    views = ", ".join(f"\"{n}\" AS ({SQL[n]})" for n in names)
    return f"WITH {views}{sql}" if sql.lstrip().startswith(",") else f"WITH {views} {sql}"


#: Catalogs by name: the adapter and the column that sorts them.
CATALOGS = {"entidades": (entities, "entity_name"), "grupos": (groups, "group_name"), "areas": (groups, "group_name"), "minutas": (templates, "title")}


def read_catalog(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A catalog by its whitelisted name, active rows only, sorted by its display column; areas with their members' number."""
    if name not in CATALOGS:
        raise ValueError(f"unknown catalog: {name}")
    load, shown = CATALOGS[name]
    found = load(spark, folder)
    if "is_active" in found.columns:
        found = found.where("is_active")
    if name == "areas":
        members = users(spark, folder).groupBy(F.col("team_id").alias("group_id")).agg(F.count("user_id").alias("members"))
        found = found.join(members, "group_id", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))
    return found.orderBy(shown)
