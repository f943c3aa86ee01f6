"""The corpus queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import bpe, decontaminate, exact_dedup, hard_negatives, html_extract, language_id, lm_score, merkle, near_dedup, quality, secrets, sentence_piece, substring_dedup
from casewright.llm.common import table

#: The vocabulary of op7; the folder of public vocabularies isn't part of the repository.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


#: The model of op12.
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def fold(parts: int):
    """crc32 of the id, as text, modulo the number of folds."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.train(docs.where(fold(4) != 2))
    return language_id.identify(docs, models).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def quality_network(spark: SparkSession, sf_dir: str) -> quality.Network:
    """The network of op5 and of the pipeline's first stage."""
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", "quality")
    return quality.train(table(spark, sf_dir, "documents"), labels)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_network(spark, sf_dir))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE, whole=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=0.8)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.encode_pieces(table(spark, sf_dir, "documents"), PIECE_BPE, whole=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql(levels: int, upper: int) -> str:
    """The manifest of op13 for up to 16 ** levels rows a source and 16 ** upper sources: each level's runs, then each leaf's way through them."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, e: CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384) ELSE xor(c, e) >> 1 END), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, source AS tree, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lower)} END AS shown FROM documents)",
        "l0 AS (SELECT *, coalesce(shown, leaf) AS folded, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d)",
        "n0 AS (SELECT tree, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM l0)",
    ]

    def climb(k: int, rest: str) -> None:
        parts.append(f"r{k} AS (SELECT tree, place // 16 AS run, list(digest ORDER BY place) AS members, any_value(size) AS size FROM n{k} WHERE size > 1 GROUP BY 1, 2)")
        parts.append(f"n{k + 1} AS (SELECT tree, run AS place, sha256(array_to_string(members, '')) AS digest, (size + 15) // 16 AS size FROM r{k} UNION ALL SELECT tree, place, digest, size FROM n{k} WHERE size = 1)")
        before, after = "array_to_string(members[1:place % 16], '')", "array_to_string(members[place % 16 + 2:], '')"
        parts.append(
            f"l{k + 1} AS (SELECT {rest}, l.tree, CASE WHEN members IS NULL THEN folded ELSE sha256({before} || folded || {after}) END AS folded, "
            f"CASE WHEN members IS NULL THEN proof ELSE proof || {before} || {after} END AS proof, place // 16 AS place FROM l{k} l LEFT JOIN r{k} r ON l.tree IS NOT DISTINCT FROM r.tree AND l.place // 16 = r.run)"
        )

    for k in range(levels):
        climb(k, "doc_id, leaf")
    top = levels + 1
    parts.append(f"s AS (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM n{levels})")
    parts.append(f"n{top} AS (SELECT 0 AS tree, place, subroot AS digest, size FROM s)")
    parts.append(f"l{top} AS (SELECT doc_id, leaf, subroot, 0 AS tree, folded, proof, s.place FROM l{levels} l JOIN s ON l.tree IS NOT DISTINCT FROM s.source)")
    for k in range(top, top + upper):
        climb(k, "doc_id, leaf, subroot")
    end = top + upper
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM l{end}, n{end}"


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_decontaminate, op3_substring_dedup, op4_language_id, op5_quality_classifier, op6_lm_score, op7_bpe, op8_secret_scan, op9_minhash_near_dedup, op10_exact_dedup, op11_hard_negatives, op12_sentence_piece, op13_merkle_manifest)}

ORACLE_SQL = {
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.vector, b.vector)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY rank <= 3""",
    "op13_merkle_manifest": _merkle_sql(6, 3),
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256({_NORMAL}) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY {_NORMAL})""",
}
