"""Catalogs, nested results, roll-ups, numbering, grants and knowledge search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """An array of floats from its literal `[x, y, ...]`; null where it isn't one."""
    return F.from_json(text, "array<float>")


def vector_text(vector: Column) -> Column:
    """The literal of an array of floats."""
    return F.to_json(vector)


def config_map(df: DataFrame, key: str, value: str, name: str = "config") -> DataFrame:
    """One row with all pairs of a key/value table as a map; of a repeated key the largest value stays."""
    once = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    return once.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def explode_analysis(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row for each struct of the array `column`, numbered from 1; rows with an empty array keep one with nulls."""
    at = df.select(*keys, F.posexplode_outer(column).alias("_at", "_item"))
    return at.select(*keys, (F.col("_at") + 1).alias("position"), "_item.*")


def score_stats(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Rows, mean (two decimals), least and greatest score of each group."""
    aggs = [F.count(score).alias("n"), F.round(F.avg(score), 2).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most")]
    return df.groupBy(*by).agg(*aggs)


def nest_children(df: DataFrame, parent: str, child: str, k: int) -> DataFrame:
    """The k most frequent (parent, child) pairs rolled up by parent: total and the children with their counts.

    A null child adds to the total only. At most k rows are gathered into lists.
    """
    pairs = df.groupBy(parent, child).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(parent), F.asc_nulls_last(child)).limit(k)
    item = F.when(F.col(child).isNotNull(), F.struct(F.col(child), F.col("n")))
    return pairs.groupBy(parent).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(item)).alias("children"))


def mean_age_days(df: DataFrame, by: list[str], start: str, end: Column, name: str = "mean_age") -> DataFrame:
    """Mean whole days from start to end, rounded to days."""
    return df.groupBy(*by).agg(F.round(F.avg(F.datediff(end, F.col(start))), 0).alias(name))


def renumber_append(new: DataFrame, base: DataFrame, key: str, number: str, order: list[Column]) -> DataFrame:
    """New rows numbered on from the greatest number that their key has in base."""
    last = base.groupBy(key).agg(F.max(number).alias("_last"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("_at", at).join(last, key, "left").withColumn(number, F.col("_at") + F.coalesce("_last", F.lit(0))).drop("_at", "_last")


def archive_team(teams: DataFrame, members: DataFrame, goals: DataFrame, asked: DataFrame, team: str, member: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(teams, goals, blocked): asked teams and their members' goals become inactive, unless an approved member remains."""
    wanted = asked.select(team).distinct()
    blocked = wanted.join(members.where("approved"), team, "left_semi")
    going = wanted.join(blocked, team, "left_anti").withColumn("_go", F.lit(True))
    closed = lambda df: df.withColumn("is_active", F.when(F.col("_go"), F.lit(False)).otherwise(F.col("is_active"))).drop("_go")
    leaving = members.join(going, team).select(member, "_go").distinct()
    return closed(teams.join(going, team, "left")), closed(goals.join(leaving, member, "left")), blocked


def expand_grants(users: DataFrame, grants: DataFrame, modules: DataFrame, actions: DataFrame) -> DataFrame:
    """(user_id, module_id, action_id) of grants by role, module name and action name; unknown names give nothing."""
    named = grants.join(modules, "module").join(actions, "action")
    return users.join(named, "role").select("user_id", "module_id", "action_id").distinct()


def grants_filter(asked: DataFrame, grants: DataFrame, admins: DataFrame) -> DataFrame:
    """Requests (user_id, module, action, ...) of administrators, and those that a grant for all three keys allows."""
    others = asked.join(admins.select("user_id").distinct(), "user_id", "left_anti")
    allowed = others.join(grants.select("user_id", "module", "action").distinct(), ["user_id", "module", "action"], "left_semi")
    return asked.join(admins.select("user_id").distinct(), "user_id", "left_semi").select(*asked.columns).unionByName(allowed.select(*asked.columns))


def search_with_topup(scored: DataFrame, query: str, key: str, score: str, within: Column, k: int, least: int = 3) -> DataFrame:
    """For each query the k best rows for which `within` holds; if they are fewer than `least`, the best others follow them.

    The rank within (query, tier) is pruned before the shuffle, so a query's rows are never gathered.
    """
    tiers = scored.withColumn("tier", F.when(F.coalesce(within, F.lit(False)), 0).otherwise(1))
    order = [F.desc_nulls_last(score), F.asc(key)]
    best = tiers.withColumn("_at", F.row_number().over(Window.partitionBy(query, "tier").orderBy(*order))).where(F.col("_at") <= k)
    found = F.sum(F.when(F.col("tier") == 0, 1).otherwise(0)).over(Window.partitionBy(query))
    kept = best.withColumn("_found", found).where((F.col("tier") == 0) | (F.col("_found") < least))
    return kept.withColumn("_at", F.row_number().over(Window.partitionBy(query).orderBy("tier", *order))).where(F.col("_at") <= k).drop("_at", "_found")


def best_with_topup(queries: DataFrame, rows: DataFrame, key: str, within: Column, k: int, carry: list[str], least: int = 3) -> DataFrame:
    """(query, key, score, tier, carried columns): `search_with_topup` of the hybrid scores of all rows for each query vector.

    rows: one a key with embedding, rank and feedback. Only the k best of each query and tier leave the blocks that queries
    and rows meet in.
    """
    from casewright.operators.vectors import COSINE_WEIGHT, best_by_score, hybrid_parts

    add, more = hybrid_parts(F.col("rank"), F.col("feedback"))
    known = rows.withColumns({"add": add, "more": more, "tier": F.when(F.coalesce(within, F.lit(False)), 0).otherwise(1)})
    best = best_by_score(queries, known, k, key, weight=COSINE_WEIGHT, carry=carry)
    return search_with_topup(best.drop("rank"), "query", key, "score", F.col("tier") == 0, k, least)


def best_chunks(rows: DataFrame, document: str, key: str, rank: str) -> DataFrame:
    """Of each document the chunk with the highest text rank, the smallest key among equals; chunks without a rank have 0.

    Chunks that aren't successful or have no vector are left out before, so a document may have none.
    """
    usable = rows.where(F.coalesce("successful", F.lit(False)) & F.col("embedding").isNotNull())
    best = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce(F.col(rank), F.lit(0.0)), -F.col(key)))
    return usable.groupBy(document).agg(best.alias("row")).select("row.*")


def understood_chunks(rows: DataFrame, document: str, key: str) -> DataFrame:
    """`best_chunks` with the comprehension vector in place of the chunk's own, where there is one."""
    return best_chunks(rows, document, key, "rank").withColumn("embedding", F.coalesce("comprehension", "embedding"))


def knowledge_scores(queries: DataFrame, rows: DataFrame, document: str, key: str) -> DataFrame:
    """(query, document, key, category, score) of every document's best chunk for each query vector.

    rows: one a chunk with document, key, category, embedding, comprehension (a vector or null), successful, feedback and
    rank. A comprehension vector stands in for the chunk's own. All that a query doesn't decide is done before rows meet
    queries, so each document meets each query once.
    """
    from casewright.operators.vectors import hybrid_score, rounded, similarities

    best = understood_chunks(rows, document, key)
    near = similarities(queries.select(key, "embedding"), best, key, carry=[document, "category", "rank", "feedback"])
    return near.select("query", document, key, "category", rounded(hybrid_score(F.col("similarity"), F.col("rank"), F.col("feedback"))).alias("score"))


def embedding_upsert(given: DataFrame, key: str, text: str, origin: str, preferred: list[str], most: int = 1500) -> DataFrame:
    """One row a key to be embedded: the text of its most preferred origin, cut to `most` characters (the embedding's own bound)."""
    rank = F.coalesce(*(F.when(F.col(origin) == o, i) for i, o in enumerate(preferred)), F.lit(len(preferred)))
    usable = given.where(F.length(text) > 0).withColumn("_rank", rank)
    first = Window.partitionBy(key).orderBy("_rank", text)
    kept = usable.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at", "_rank")
    rest = given.join(kept.select(key), key, "left_anti").dropDuplicates([key])
    return kept.unionByName(rest).withColumn(text, F.substring(text, 1, most))


def promotable(answers: DataFrame, done: DataFrame, key: str, result: str, good: str, text: str) -> DataFrame:
    """Answers with a good result and a text that aren't in the knowledge base yet."""
    fit = answers.where((F.col(result) == good) & (F.length(F.trim(text)) > 0))
    return fit.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def promote(answers: DataFrame, key: str, text: str, title: Column, size: int = 1500, overlap: int = 300) -> DataFrame:
    """Knowledge rows of promoted answers: titled chunks, each with the key of its embedding, and the answer's other columns."""
    from casewright.operators.text import chunk_documents

    chunks = titled_chunks(chunk_documents(answers, key, text, size, overlap), key, title)
    keyed = chunks.withColumn("embedding_key", F.sha2(F.concat_ws(":", F.col(key).cast("string"), "number"), 256))
    return keyed.join(answers.drop(text), key)


def needs_recalculate(embeddings: DataFrame, clusters: DataFrame, points: DataFrame, stamp: str, last, most: int = 10) -> DataFrame:
    """One row: embeddings newer than the last run, and whether clusters and points are stale."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = count(embeddings.where(F.col(stamp) > last), "newer").crossJoin(count(clusters, "_c")).crossJoin(count(points, "_p"))
    return row.select("newer", ((F.col("_c") == 0) | (F.col("_p") == 0) | (F.col("newer") >= most)).alias("stale"))


def titled_chunks(chunks: DataFrame, key: str, title: Column) -> DataFrame:
    """Chunks (key, number, chunk) with titles `title (i/n)`."""
    of = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_of"))
    name = F.concat(title, F.lit(" ("), F.col("number").cast("string"), F.lit("/"), F.col("_of").cast("string"), F.lit(")"))
    return chunks.join(of, key).withColumn("title", name).drop("_of")


def write_snapshot(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Overwrites the table at path, and one row about its computation beside it."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    spark.range(1).select(*(F.lit(v).alias(k) for k, v in meta.items())).write.mode("overwrite").parquet(f"{path}_meta")


def append_log(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows to a log: the keys as columns, all other columns as one JSON text."""
    rest = [c for c in df.columns if c not in keys]
    df.select(*keys, F.to_json(F.struct(*rest)).alias("details")).write.mode("append").parquet(path)
