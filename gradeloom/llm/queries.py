"""Registered queries of the training-data operators: each reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import calibration, defects, leaks, mixing, neardup, packing, textform
from gradeloom.llm.language import language
from gradeloom.session import spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "dm_large_train").select("train_idx", "question", "answer"))


def _capacity(spark: SparkSession, d: str) -> int:
    return table(spark, d, "context_limit").where("limit_name = 'train'").agg(F.max("capacity_tokens")).first()[0]


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    @F.pandas_udf("string")
    def spoken(texts):
        return texts.map(language)

    asked = table(spark, d, "dm_large_train").where("train_idx is not null").select(F.lit("dm_large").alias("arm"), F.col("train_idx").alias("schedule_idx"), spoken("question").alias("language"))
    asked = asked.groupBy("arm", "schedule_idx").agg(F.min("language").alias("language"))
    return mixing.mix(table(spark, d, "schedule_manifest"), table(spark, d, "mix_target"), asked)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report.where("not reachable").select("arm", "source")


def p1_mixed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of every row of the mixture."""
    return _mix(spark, d).rows()


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    plan = _mix(spark, d)
    return plan.shares(plan.rows())


def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    """What each source, topic and language was raked to, and how far it is from its goal."""
    return _mix(spark, d).margins


def _calibration(spark: SparkSession, d: str) -> calibration.Calibration:
    rows = table(spark, d, "schedule_manifest").where("arm = 'dm_large' and repeat_id = 0")
    return calibration.calibrate(rows, table(spark, d, "sample_target"), "schedule_idx", ["topic", "difficulty_bucket", "solution_token_decile", "prompt_token_decile"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _calibration(spark, d).report.where("unmet").select("dimension", "category")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled rows with their categories."""
    return _calibration(spark, d).sample()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target with what is eligible, expected and sampled."""
    plan = _calibration(spark, d)
    return plan.sampled_report(plan.sample())


def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Every document piece with its training sequence and its place in it."""
    return packing.pack_texts(_docs(spark, d), _capacity(spark, d))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and fill of each training sequence."""
    return packing.fills(p5_sequences(spark, d), _capacity(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(_pairs(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_pairs(spark, d).drop("answer"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its group, and the recorded question hash that its group's other records don't share."""
    groups = neardup.near_duplicates(_pairs(spark, d).drop("answer"))
    recorded = table(spark, d, "schedule_manifest").where("arm = 'dm_large'").groupBy(F.col("schedule_idx").alias("train_idx")).agg(F.min("source_question_hash").alias("source_question_hash"))
    return groups.join(recorded, "train_idx", "left")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document and test item it leaks, with the tiles and the coverage of the item."""
    return leaks.leaks(_docs(spark, d), table(spark, d, "internal_dev"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).where(F.col("longest") >= leaks.TILE_WORDS).select("doc_id", "idx").distinct()


def p7_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its text in the common form."""
    docs = _docs(spark, d)
    return textform.normalize_texts(docs).select("doc_id", "text_form", (~F.col("text").eqNullSafe(F.col("text_form"))).alias("changed"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its look, how many documents share it and in how many stored forms."""
    return textform.look_groups(_docs(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.look_alike_pairs(_docs(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_mixed_rows, p1_shares, p1_margins, p2_found, p3_found, p3_sample, p3_report, p4_found, p4_groups, p5_sequences, p5_fill, p6_found, p6_leaks, p7_found, p7_normalized, p7_groups)
}
