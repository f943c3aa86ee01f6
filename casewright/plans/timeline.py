"""The cross-module timeline: six modules as rows of one shape, each with the filters that it knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import relational as R
from casewright.plans.registry import query
from casewright.sources import tables as T
from casewright.sources.tables import with_tables

COMMON = {"id": "string", "title": "string", "state": "string", "day": "date", "amount": "decimal(15,2)", "entity": "string", "owner": "string"}

#: The filters that each module has, by the column that they hold for; a module ignores the others.
FILTERS = {
    "pagos": {"entity_id": "creditor_id", "project_id": "project_id", "state": "state"},
    "comunicaciones": {"entity_id": "entity_id", "owner_id": "owner_id", "state": "state"},
    "conformidades": {"entity_id": "entity_id", "project_id": "project_id", "contract_id": "contract_id", "owner_id": "owner_id", "state": "state"},
    "tutelas": {"owner_id": "owner_id", "state": "state"},
    "ambiental": {"entity_id": "entity_id", "group_id": "group_id", "owner_id": "owner_id", "state": "state"},
    "contratos": {"entity_id": "entity_id", "state": "state"},
}
DATES = {"pagos": "asked", "comunicaciones": "received", "conformidades": "asked", "tutelas": "received", "ambiental": "dated", "contratos": "created"}


def _rows(spark, folder, module: str) -> DataFrame:
    """Active rows of a module with their title."""
    if module == "pagos":
        return R.scan_active(T.payments(spark, folder)).withColumn("title", F.concat_ws("-", F.col("contract_id").cast("string"), F.col("line").cast("string"))).withColumn("id", F.col("title"))
    if module == "comunicaciones":
        return R.scan_active(T.communications(spark, folder)).withColumn("title", F.col("subject")).withColumn("id", F.col("comm_id"))
    if module == "conformidades":
        return R.scan_active(T.conformities(spark, folder)).withColumn("title", F.col("concept")).withColumn("id", F.col("conf_id"))
    if module == "tutelas":
        return R.scan_active(T.cases(spark, folder)).withColumn("title", C.first_label(F.nullif(F.trim("court"), F.lit("")), F.col("invoked_right"))).withColumn("id", F.col("case_id"))
    if module == "ambiental":
        return R.scan_active(T.expedientes(spark, folder)).withColumn("title", C.first_label("title", "number")).withColumn("id", F.col("exp_id"))
    return T.audits(spark, folder).join(T.templates(spark, folder).select("template_id", "title"), "template_id").withColumn("id", F.col("audit_id")).withColumn("owner_id", F.col("created_by"))


def timeline(spark, folder, wanted: dict | None = None, names: bool = True) -> DataFrame:
    """Rows of the asked modules, newest first, rows without a date last; without `names` entities and owners stay null.

    `wanted` may have modules (a list; unknown names are dropped), first and last (days, both included), group_id,
    and the keys of FILTERS. A module is filtered before the union, by what it knows.
    """
    wanted = wanted or {}
    parts = []
    for module in wanted.get("modules") or FILTERS:
        if module not in FILTERS:
            continue
        df = C.optional_filters(_rows(spark, folder, module), {column: wanted.get(name) for name, column in FILTERS[module].items()})
        df = C.date_range(df, DATES[module], wanted.get("first"), wanted.get("last"))
        if module == "comunicaciones" and wanted.get("group_id") is not None:
            linked = T.communication_groups(spark, folder).where(F.col("group_id") == wanted["group_id"])
            df = df.join(linked, "comm_id", "left_semi")
        lookups = []
        if "entity_id" in FILTERS[module]:
            lookups.append((T.entities(spark, folder).select("entity_id", "entity_name"), FILTERS[module]["entity_id"], "entity_id"))
        if "owner_id" in df.columns:
            lookups.append((T.users(spark, folder).select("user_id", "user_name"), "owner_id", "user_id"))
        named = R.enrich(df, lookups if names else [])
        mapping = {"id": "id", "title": "title", "state": "state", "day": DATES[module]}
        mapping |= {name: column for name, column in (("amount", "amount"), ("entity", "entity_name"), ("owner", "user_name")) if column in named.columns}
        parts.append(C.to_common(named, module, mapping, COMMON))
    return reduce(DataFrame.unionByName, parts)


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("day"), "module", "id")


_NAMES = "LEFT JOIN entities e ON e.entity_id = x.{0} LEFT JOIN users u ON u.user_id = x.owner_id"
_PARTS = {
    "pagos": "SELECT 'pagos' AS module, contract_id || '-' || line AS id, contract_id || '-' || line AS title, state, asked AS day, amount, entity_name AS entity, CAST(NULL AS VARCHAR) AS owner FROM payments x LEFT JOIN entities e ON e.entity_id = x.creditor_id WHERE is_active",
    "comunicaciones": f"SELECT 'comunicaciones', CAST(comm_id AS VARCHAR), subject, state, received, NULL, entity_name, user_name FROM communications x {_NAMES.format('entity_id')} WHERE is_active",
    "conformidades": f"SELECT 'conformidades', CAST(conf_id AS VARCHAR), concept, state, asked, amount, entity_name, user_name FROM conformities x {_NAMES.format('entity_id')} WHERE is_active",
    "tutelas": "SELECT 'tutelas', CAST(case_id AS VARCHAR), coalesce(nullif(trim(court), ''), invoked_right), state, received, NULL, NULL, user_name FROM cases x LEFT JOIN users u ON u.user_id = x.owner_id WHERE is_active",
    "ambiental": f"SELECT 'ambiental', CAST(exp_id AS VARCHAR), coalesce(title, number), state, dated, NULL, entity_name, user_name FROM expedientes x {_NAMES.format('entity_id')} WHERE is_active",
    "contratos": f"SELECT 'contratos', CAST(audit_id AS VARCHAR), title, state, created, NULL, entity_name, user_name FROM (SELECT *, created_by AS owner_id FROM audits) x JOIN (SELECT template_id, title FROM templates) t ON t.template_id = x.template_id {_NAMES.format('entity_id')} WHERE true",
}
_TABLES = ("payments", "communications", "communication_groups", "conformities", "cases", "expedientes", "audits", "templates", "entities", "users")


def _union(extra: dict[str, str] | None = None) -> str:
    """The union in SQL, with further conditions by module (None: all modules, else only those given)."""
    return " UNION ALL ".join(_PARTS[m] + (extra or {}).get(m, "") for m in _PARTS if extra is None or m in extra)


def _select(extra: dict[str, str] | None, rest: str) -> str:
    head = "" if extra is None or "pagos" in extra else "SELECT CAST(NULL AS VARCHAR) AS module, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS DATE) AS day, CAST(NULL AS DECIMAL(15,2)) AS amount, CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS owner WHERE false UNION ALL "
    return with_tables(f", t AS ({head}{_union(extra)}) {rest}", *_TABLES)


@query(_select(None, "SELECT * FROM t"))
def cross_module_timeline(spark, folder) -> DataFrame:
    return newest_first(timeline(spark, folder))


@query(_select(None, "SELECT module, count(*) AS n, count(DISTINCT state) AS states, min(day) AS first_day, max(day) AS last_day FROM t GROUP BY 1"))
def timeline_totals(spark, folder) -> DataFrame:
    return timeline(spark, folder, names=False).groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("state").alias("states"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(_select(None, "SELECT * FROM t ORDER BY day DESC NULLS LAST, module, id, title, state, amount, entity, owner LIMIT 100"))
def timeline_newest(spark, folder) -> DataFrame:
    rest = [F.asc_nulls_last(c) for c in ("module", "id", "title", "state", "amount", "entity", "owner")]
    return R.top_k(timeline(spark, folder), 100, F.desc_nulls_last("day"), *rest)


@query(_select({"pagos": " AND x.creditor_id = 3", "comunicaciones": " AND x.entity_id = 3", "conformidades": " AND x.entity_id = 3", "tutelas": "", "ambiental": " AND x.entity_id = 3", "contratos": " AND x.entity_id = 3"}, "SELECT * FROM t"))
def timeline_of_entity(spark, folder) -> DataFrame:
    """One entity's rows; cases have no entity and all stay."""
    return timeline(spark, folder, {"entity_id": 3})


@query(_select({"comunicaciones": " AND x.owner_id = 7", "conformidades": " AND x.owner_id = 7", "tutelas": " AND x.owner_id = 7", "ambiental": " AND x.owner_id = 7", "contratos": ""}, "SELECT * FROM t"))
def timeline_of_owner(spark, folder) -> DataFrame:
    """One owner's rows of five modules; contracts ignore owners, an unknown module is dropped."""
    return timeline(spark, folder, {"owner_id": 7, "modules": ["comunicaciones", "conformidades", "tutelas", "ambiental", "contratos", "desconocido"]})


@query(_select({"comunicaciones": " AND EXISTS (SELECT 1 FROM communication_groups g WHERE g.comm_id = x.comm_id AND g.group_id = 4)", "ambiental": " AND x.group_id = 4 AND dated BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", "pagos": " AND asked BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"}, "SELECT * FROM t WHERE module <> 'comunicaciones' OR day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def timeline_of_group(spark, folder) -> DataFrame:
    """A group's communications and files of three years; payments have no group and all stay."""
    return timeline(spark, folder, {"group_id": 4, "modules": ["comunicaciones", "ambiental", "pagos"], "first": "1996-01-01", "last": "1998-12-31"})


@query(_select({m: " AND x.state IN ('Pendiente', 'pendiente')" for m in _PARTS}, "SELECT * FROM t"))
def timeline_of_state(spark, folder) -> DataFrame:
    return timeline(spark, folder, {"state": ["Pendiente", "pendiente"]})
