"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import leak, mixture, names, neardup, pieces, quality, sentences, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spelling_pairs(names.link_names(_table(spark, sf_dir, "papers")))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(_table(spark, sf_dir, "papers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leak.find_leaks(_table(spark, sf_dir, "papers"), _table(spark, sf_dir, "golden"))
    return leaks.select(F.col("id").alias("doc_id"), F.col("item").alias("qid"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.split_oversized(pieces.items_of(_table(spark, sf_dir, "papers")))
    return cut.where("piece = 1").select(F.col("id").alias("doc_id"), "pos").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(pieces.items_of(_table(spark, sf_dir, "papers"))).withColumnRenamed("id", "doc_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _table(spark, sf_dir, "papers")
    units = sentences.split(papers, sentences.learn(papers))
    return units.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts")).select(F.col("id").alias("doc_id"), F.explode("starts").alias("start_char"))


def p4_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentences.learn(_table(spark, sf_dir, "papers"))
    return model.select("lang", "kind", "word", "follower", F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.group_near_duplicates(_table(spark, sf_dir, "papers"), count_links=False)
    return neardup.duplicate_pairs(groups).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_near_duplicates(_table(spark, sf_dir, "papers")).withColumnRenamed("id", "doc_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets")).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets")).shares


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.outlier_scores(quality.document_statistics(_table(spark, sf_dir, "documents")))
    return quality.not_prose(scored).select(F.col("id").alias("doc_id")).distinct()


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.outlier_scores(quality.document_statistics(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
    return scored.withColumns({name: F.round(name, 2 if unit == 0.01 else 4) for name, _, unit, _ in quality.STATISTICS})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_entities, p2_found, p3_found, p3_pieces, p4_found, p4_model, p5_found, p5_groups, p6_ids, p7_mixture, p7_shares, p8_found, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT DISTINCT doc_id, pos FROM (
                SELECT doc_id, s.pos AS pos, s.body AS body FROM (SELECT doc_id, unnest(sections) AS s FROM papers)
                UNION ALL
                SELECT doc_id, CAST(-1 AS INTEGER), text FROM papers WHERE sections IS NULL OR len(sections) = 0
            ) WHERE length(body) > 900""",
    }
