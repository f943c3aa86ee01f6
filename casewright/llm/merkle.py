"""Merkle manifest of a dataset: trees per source under one root, and each row's proof by pointer jumping.

A row's leaf is the digest of its columns. Rows are numbered within their source in one distributed sort, and every
`fan` consecutive nodes form a run, whose digest is a node of the next level, until a source has one node, its subroot;
the subroots form a tree in the same way, whose last node is the root.

Proofs: each run points to the run that holds its digest, and holds the sibling segment towards it. A self-join on the
pointers doubles the distance to the ancestor that a run points to and appends the ancestor's segment, so that after
log2(height) joins every run's segments reach the root. A leaf's proof is its own siblings and its run's segments.

The table's rows are shuffled twice as digests, never as texts; no step gathers a source. At most 16 runs point to one
at distance 1 and 256 at distance 2; farther ancestors are few, and are broadcast once they are counted.

Edge cases: leaves of one source and id ascend by their digests, so repeated rows are leaves of their own beside each
other; null ids come first, and a null source is a source of its own that comes first; a row that is alone under the
root is the root and its proof is empty; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import ascii_lower, bounded_join, materialise, scratch
from casewright.operators.numbering import number_rows

#: Consecutive nodes of a run, and hexadecimal characters of a digest.
FAN, HEX = 16, 64
#: Ancestors (of about a kilobyte for each level above them) that are broadcast at most.
ANCESTORS = 10_000
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(digest: Column, path: Column) -> Column:
    """The digest of an ancestor from a node's own digest and the siblings towards it."""
    return F.aggregate(path, digest, lambda known, step: F.sha2(F.concat(step["left"], known, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _siblings(joined: Column, slot: Column) -> Column:
    """(left, right): the digests of a run before and after a slot."""
    at = slot.cast("int")
    return F.struct(F.substring(joined, F.lit(1), at * HEX).alias("left"), F.substring(joined, (at + 1) * HEX + 1, F.length(joined)).alias("right"))


def _key(top: bool, source, level, run) -> Column:
    """What names a run: whether it is in the tree over all sources, else its source, its level and its number there."""
    return F.struct(F.lit(top).alias("top"), source.alias("source"), level.cast("int").alias("level"), run.cast("long").alias("run"))


def _runs(nodes: DataFrame, level: int, top: bool) -> DataFrame:
    """Runs of `FAN` of nodes (source, position, size, height, digest, ...), with the members in order and what they carry.

    `size` is how many nodes the run's level has, `above` the run and the slot that hold its digest on the next level.
    """
    member = F.struct((F.col("position") % FAN).alias("slot"), *(c for c in nodes.columns if c not in ("source", "position", "size", "height")))
    grouped = nodes.groupBy("source", F.floor(F.col("position") / FAN).cast("long").alias("run")).agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.ceil(F.max("size") / FAN).cast("long").alias("size"), (F.max("height") + 1).alias("height")
    )
    run = F.col("run")
    return grouped.withColumn("joined", F.array_join(F.transform("members", lambda m: m["digest"]), "")).select(
        _key(top, F.col("source"), F.lit(level), run).alias("key"), "members", "size", "height", "joined", F.sha2("joined", 256).alias("digest"),
        F.when(F.col("size") > 1, _key(top, F.col("source"), F.lit(level + 1), F.floor(run / FAN))).alias("to"), F.when(F.col("size") > 1, run % FAN).alias("slot"),
    )


def _trees(nodes: DataFrame, most: int, top: bool, keep) -> list[DataFrame]:
    """The runs of each level of trees whose lowest level is `nodes`; the largest tree has `most` nodes there."""
    levels = []
    while most > 1:
        levels.append(keep(_runs(nodes.where("size > 1"), len(levels), top)))
        nodes = levels[-1].select("key.source", F.col("key.run").alias("position"), "size", "height", "digest")
        most = -(-most // FAN)
    return levels


def _pointed(runs: DataFrame, keep) -> DataFrame:
    """Runs (key, height, to) with `path`, the siblings towards the run that each points to: none at the root."""
    held = runs.select(F.col("key").alias("to"), F.col("joined").alias("held"))
    below = runs.where("to is not null").join(held, "to").select("key", "height", "to", F.array(_siblings(F.col("held"), F.col("slot"))).cast(PATH).alias("path"))
    return keep(below.unionByName(runs.where("to is null").select("key", "height", "to", F.array().cast(PATH).alias("path"))))


def _jumped(runs: DataFrame, height: int, keep) -> DataFrame:
    """Runs (key, height, to, path) with the path from each to the root, by pointer jumping over `height` levels.

    In a round a run appends the path of the ancestor that it points to, and points where that one does; so the distance
    doubles. An ancestor is pointed to by at most FAN ** distance runs.
    """
    distance = 1
    while distance < height:
        held = runs.where(F.col("height") >= distance - 1).select(F.col("key").alias("to"), F.col("to").alias("farther"), F.col("path").alias("further"))
        met = bounded_join(runs.where("to is not null"), held, "to", "inner", ANCESTORS)
        moved = met.select("key", "height", F.col("farther").alias("to"), F.concat("path", "further").alias("path"))
        runs = keep(moved.unionByName(runs.where("to is null")))
        distance *= 2
    return runs


def merkle_paths(leaves: DataFrame, keep=materialise) -> DataFrame:
    """leaves (source, id, leaf, ...) with `subroot`, `root` and `path`: siblings (left, right) level by level up to the root.

    `leaves` must give the same rows whenever it is read. On a level where a run has one member its siblings are empty.
    """
    numbers = number_rows(leaves, ["id", "leaf"], ["source"], size="size", keep=keep).withColumn("height", F.lit(-1)).withColumnRenamed("leaf", "digest")
    levels = _trees(numbers, numbers.agg(F.max("size")).first()[0] or 0, False, keep)
    carried = [c for c in numbers.columns if c not in ("source", "position", "size", "height")]
    # a source that has one row is its own subroot: a run on no level, without a digest of its own
    lone = numbers.where("size = 1").select(
        _key(False, F.col("source"), F.lit(-1), F.lit(0)).alias("key"), F.array(F.struct(F.lit(0).cast("long").alias("slot"), *carried)).alias("members"),
        "size", "height", F.lit("").alias("joined"), "digest", F.lit(None).cast(_key_type(numbers)).alias("to"), F.lit(None).cast("long").alias("slot"),
    )
    lowest = keep(lone.unionByName(levels[0]) if levels else lone)
    runs = reduce(DataFrame.unionByName, (df.drop("members") for df in [lowest, *levels[1:]]))
    subroots = keep(number_rows(runs.where("size = 1").select("key", "height", "digest", F.col("key.source").alias("source")), ["source"], size="size", keep=keep))
    sources = subroots.count()
    upper = _trees(subroots.select(F.lit(None).cast("string").alias("source"), "position", "size", "height", "digest"), sources, True, keep)
    highest = (upper[-1] if upper else subroots).select("digest", "height").first()
    root, height = highest if highest else ("", -1)
    if sources > 1:  # subroots point into the tree over all sources
        place = subroots.select("key", _key(True, F.lit(None).cast("string"), F.lit(0), F.floor(F.col("position") / FAN)).alias("in_run"), (F.col("position") % FAN).alias("in_slot"))
        placed = bounded_join(runs, place, "key", "left", 100_000)
        runs = placed.withColumns({"to": F.coalesce("in_run", "to"), "slot": F.coalesce("in_slot", "slot")}).drop("in_run", "in_slot")
    runs = reduce(DataFrame.unionByName, (df.drop("members") for df in upper), runs)
    paths = _jumped(_pointed(runs, keep), height + 1, keep).where("not key.top and key.level <= 0").select("key", "path")

    inside = reduce(lambda a, b: a + b, ((F.col("size") > FAN**k).cast("int") for k in range(15)))
    met = lowest.select("key", "members", "size", "joined", "digest").join(paths, "key")
    each = met.select("key", "joined", "path", fold(F.col("digest"), F.slice("path", F.lit(1), inside)).alias("subroot"), F.explode("members").alias("member"))
    own = F.when(F.col("key.level") < 0, F.array().cast(PATH)).otherwise(F.array(_siblings(F.col("joined"), F.col("member.slot"))).cast(PATH))
    others = [F.col(f"member.{c}").alias("leaf" if c == "digest" else c) for c in carried]
    return each.select(F.col("key.source").alias("source"), *others, "subroot", F.lit(root).alias("root"), F.concat(own, "path").alias("path"))


def _key_type(nodes: DataFrame) -> str:
    return f"struct<top: boolean, source: {nodes.schema['source'].dataType.simpleString()}, level: int, run: bigint>"


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", source_col: str = "source", presented: dict[str, Column] | None = None, where: Column | None = None, keep=materialise) -> DataFrame:
    """id, leaf, subroot, root and path of each row, and `shown`: the leaf of the row as it is presented.

    Rows that `where` picks present other values of some columns; a verifier folds `shown` along the path and compares.
    """
    shown = F.lit(None).cast("string")
    if presented and where is not None:
        shown = F.when(where, leaf_of([presented.get(c, F.col(c)) for c in columns]))
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), leaf_of([F.col(c) for c in columns]).alias("leaf"), shown.alias("shown"))
    paths = merkle_paths(keep(rows), keep)
    return paths.select("id", "leaf", "subroot", "root", "path", F.coalesce("shown", "leaf").alias("shown"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, proofs checked: every fifth id, by its checksum, presents its text in lower case."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    with scratch(docs.sparkSession) as keep:
        found = manifest(docs, columns, presented={"text": ascii_lower(F.col("text"))}, where=tampered, keep=keep)
        folded = fold(F.col("shown"), F.col("path"))
        out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
        return materialise(out.withColumn("verified", F.col("folded_root") == F.col("root")))
