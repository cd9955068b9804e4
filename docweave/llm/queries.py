"""Queries over the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import lookalikes, packing, pairs, splitting, stuffing, tokenizer
from docweave.session import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, root, "answers"))


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Defective pairs per defect and month, of all pairs of the month."""
    answers = table(spark, root, "answers", ["answer_id", "created_at"]).groupBy("answer_id").agg(F.min("created_at").alias("created_at"))
    joined = answers.join(p1_found(spark, root), "answer_id", "left")
    return joined.groupBy(F.date_trunc("month", "created_at").alias("month"), F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("pairs"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.oversized_items(table(spark, root, "blocks"), table(spark, root, "chunk_configs"))


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All pieces of the oversized blocks, a block delivered twice once."""
    pieces = splitting.split_oversized(table(spark, root, "blocks"), table(spark, root, "chunk_configs"))
    return pieces.where("n_pieces > 1").withColumn("piece_hash", F.xxhash64("piece")).drop("piece").distinct()


def p2_joined(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of each oversized block put together again: text, tokens, and whether every piece keeps the limit and the overlap."""
    blocks, limits = table(spark, root, "blocks"), table(spark, root, "chunk_configs")
    pieces = splitting.split_oversized(blocks, limits).where("n_pieces > 1").distinct()
    settings = blocks.select("block_id", "config_name").distinct().join(limits, "config_name")
    kept = (F.col("n_tokens") <= F.col("max_tokens")) & (F.col("n_overlap") == F.when(F.col("piece_no") == 0, 0).otherwise(F.least("overlap_tokens", F.col("n_tokens"))))
    own = F.substr("piece", F.col("own") - F.col("start") + 1)
    joined = pieces.join(settings, "block_id").withColumns({"_kept": kept, "_own": own})
    texts = F.array_sort(F.collect_list(F.struct("piece_no", "_own")))
    return joined.groupBy("block_id").agg(
        F.md5(F.array_join(F.transform(texts, lambda x: x["_own"]), "")).alias("md5"), F.sum(F.col("n_tokens") - F.col("n_overlap")).cast("long").alias("n_tokens"), F.min("_kept").alias("kept")
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, root, "blocks"))


def p4_classes(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of every class of look-alikes, with the number of blocks that hold another string."""
    return lookalikes.lookalike_classes(table(spark, root, "blocks")).drop("class_id", "string_id")


def p4_consistent(spark: SparkSession, root: str) -> DataFrame:
    """Text and markdown of every block in the consistent form, as delivered."""
    blocks = table(spark, root, "blocks", ["block_id", "ingested_at", "text", "markdown"])
    return lookalikes.normalize_columns(blocks, ["markdown", "text"])


def p5_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, root, "documents"))


def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    """Number of ids of each document."""
    documents = table(spark, root, "documents", ["doc_id", "text"])
    return tokenizer.count_tokens(documents)


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents"))


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return packing.container_report(packing.pack_documents(table(spark, root, "documents")))


def p6_plan(spark: SparkSession, root: str) -> DataFrame:
    """Containers that each way of planning needs for the documents, and what the least-squares solution contributes."""
    sizes = tokenizer.count_tokens(table(spark, root, "documents", ["doc_id", "text"]))
    return spark.createDataFrame(packing.plan_report(sizes, "n_tokens"), "way string, containers long, least long, planned long, planned_share double")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return stuffing.stuffed_ids(table(spark, root, "documents"))


def p7_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Characters of every document by kind, its bits per word class, and the verdict."""
    return stuffing.stuffed_documents(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_joined": p2_joined,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p4_consistent": p4_consistent,
    "p5_ids": p5_ids,
    "p5_counts": p5_counts,
    "p6_packed": p6_packed,
    "p6_report": p6_report,
    "p6_plan": p6_plan,
    "p7_found": p7_found,
    "p7_verdicts": p7_verdicts,
}

_TOKENS = r"len(regexp_extract_all(b.markdown, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t\n\x0B\f\r\x{85}]'))"

# Letters of the shape of a Latin letter, written for the SQL by themselves, below the Latin letters.
_OTHERS = "АВЕЅІЈКМНОРСТУХҮѴԚԜԀаеорсухѕіјһԁԛԝѵӏӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϹϲϳͿ"
_LETTERS = "ABESIJKMHOPCTYXYVQWDaeopcyxsijhdqwvlIABEZHIKMNOPTYXovCcjJ"


def _looks() -> str:
    """SQL of what a text ``x`` looks like, for the characters of the test data: wide forms, ligatures, spaces, ignorables, letters of one shape."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    x = "x"
    for ligature, letters in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        x = f"replace({x}, '{ligature}', '{letters}')"
    x = f"translate({x}, '{wide}', '{plain}')"
    x = rf"regexp_replace(regexp_replace({x}, '\p{{Zs}}', ' ', 'g'), '\p{{Cf}}', '', 'g')"
    # Letters come before composition, so that an accent composes with the Latin letter.
    return f"nfc_normalize(translate({x}, '{_OTHERS}', '{_LETTERS}'))"


_MIXED = f"""WITH v AS (SELECT DISTINCT block_id, 'text' AS field, text AS x FROM blocks WHERE text IS NOT NULL UNION ALL SELECT DISTINCT block_id, 'markdown', markdown FROM blocks WHERE markdown IS NOT NULL),
        k AS (SELECT block_id, field, x, {_looks()} AS look FROM v),
        m AS (SELECT field, look FROM k GROUP BY ALL HAVING count(DISTINCT x) > 1),
        c AS (SELECT k.* FROM k JOIN m USING (field, look))"""

ORACLE: dict[str, str] = {
    "p4_found": f"""{_MIXED}
        SELECT DISTINCT a.block_id AS block_id_a, b.block_id AS block_id_b, a.field FROM c a JOIN c b ON a.field = b.field AND a.look = b.look AND a.block_id < b.block_id AND a.x <> b.x""",
    "p4_classes": f"""{_MIXED}
        SELECT block_id, field, count(*) OVER (PARTITION BY field, look) - count(*) OVER (PARTITION BY field, look, x) AS links FROM c""",
    "p2_joined": f"""
        SELECT DISTINCT b.block_id, md5(b.markdown) AS md5, {_TOKENS}::BIGINT AS n_tokens, true AS kept FROM blocks b JOIN chunk_configs c ON b.config_name = c.config_name
        WHERE {_TOKENS} > c.max_tokens""",
    "p2_found": f"""
        SELECT DISTINCT b.block_id FROM blocks b JOIN chunk_configs c ON b.config_name = c.config_name
        WHERE {_TOKENS} > c.max_tokens""",
}
