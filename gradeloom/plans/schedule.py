"""The schedule pipeline: strata of the prepared corpus, nested selections, exposures, replay, shuffle and audits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import difficulty_bucket
from gradeloom.operators import audit, sampling
from gradeloom.operators import schedule as S
from gradeloom.operators.ordering import global_rank, seeded_shuffle, token_deciles
from gradeloom.operators.stats import distribution_gap
from gradeloom.session import materialize

STRATA = ["topic", "difficulty_bucket", "solution_token_decile", "prompt_token_decile"]


def with_strata(prepared: DataFrame, low: float = 4.0, high: float = 8.0) -> DataFrame:
    """Rows of the difficulty range [low, high) with their bucket and both token deciles."""
    rows = prepared.where((F.col("difficulty") >= low) & (F.col("difficulty") < high))
    rows = token_deciles(rows, "assistant_tokens", "row_hash", "solution_token_decile")
    rows = token_deciles(rows, "prompt_tokens", "row_hash", "prompt_token_decile")
    return materialize(rows.withColumn("difficulty_bucket", difficulty_bucket(F.col("difficulty"))), "strata")


def checked_strata(prepared: DataFrame, held_out: DataFrame, low: float = 4.0, high: float = 8.0, longest: int = 2048) -> DataFrame:
    """``with_strata`` of a corpus that is proved fit for it; what isn't raises with examples.

    Rows, questions and families come once each, token counts are positive and not over ``longest``, and neither a
    question nor a family of the range is among the held-out items.
    """
    tokens = ["prompt_tokens", "assistant_tokens", "train_tokens"]
    audit.require_columns(prepared, ["row_hash", "question_hash", "family_hash", "difficulty", "topic", *tokens])
    audit.require_empty(audit.uniqueness(prepared, ["row_hash", "question_hash", "family_hash"]).where("not is_unique"), "repeated rows, questions or families")
    audit.require_empty(audit.out_of_range(prepared, tokens, low=1), "token counts that are missing or not positive")
    audit.require_empty(audit.out_of_range(prepared, ["train_tokens"], high=longest), "rows over the limit")
    rows = prepared.where((F.col("difficulty") >= low) & (F.col("difficulty") < high))
    for c in ("question_hash", "family_hash"):
        audit.require_empty(audit.shared_keys(rows, held_out, c, c), f"held-out items in the corpus by {c}")
    return with_strata(prepared, low, high)


def replay_families(replay: DataFrame, manifest: DataFrame) -> DataFrame:
    """The replay pool with the family of each row, as recorded in a schedule."""
    known = manifest.where("source_family_hash is not null").groupBy(F.col("source_row_hash").alias("row_hash")).agg(F.min("source_family_hash").alias("family_hash"))
    return replay.join(known, "row_hash", "left")


@dataclass
class Schedules:
    """``master`` has the rows of the large arm, flagged ``in_nested_small``."""

    master: DataFrame
    small: DataFrame
    large: DataFrame
    gaps: DataFrame
    budget: DataFrame
    replay: DataFrame

    def both(self) -> DataFrame:
        return self.small.unionByName(self.large, allowMissingColumns=True)


def build_schedules(prepared: DataFrame, replay: DataFrame, master_rows: int, small_rows: int, exposures: int, replay_rows: int, seed: int = 42, selector: Callable[[DataFrame, int], DataFrame] | None = None) -> Schedules:
    """Both arms: a master selection, a subset nested in it, equal exposures of each and the same replay rows.

    Both arms have one length, so the seeded shuffle puts the replay rows into the same slots of both. ``selector``
    picks the subset from the master; it is the nested take with repaired quotas unless another is given.
    """
    select = selector or (lambda rows, n: sampling.nested_take(rows, n, STRATA))
    rows = with_strata(prepared)
    master = materialize(sampling.proportional_take(rows, master_rows, STRATA, "metadata-master-v1").drop("position"), "master")
    small = materialize(select(master, small_rows).drop("position"), "small")
    audit.require_rows(small, exactly=small_rows, what="the subset")
    audit.require_empty(audit.key_difference(small, master, "row_hash").where("side = 'missing'"), "rows of the subset outside the master")
    gaps = distribution_gap(small, master, STRATA)
    pool = materialize(S.deduplicate_replay(replay), "pool")
    kept = pool.where("outcome = 'kept'").drop("outcome")
    common = materialize(S.replay_exposures(kept, replay_rows), "common")

    def arm(name: str, chosen: DataFrame) -> DataFrame:
        tokens = ["prompt_tokens", "assistant_tokens", "train_tokens"]
        own = S.expand_exposures(chosen, exposures, f"corpus_{name}").select("source", F.col("row_hash").alias("source_row_hash"), "repeat_id", *tokens)
        again = common.select("source", F.col("row_hash").alias("source_row_hash"), F.col("question_hash").alias("source_question_hash"), F.col("family_hash").alias("source_family_hash"), "repeat_id", "exposure", *tokens)
        rows = S.union_sources(own.withColumn("_part", F.lit(0)), again.withColumn("_part", F.lit(1)))
        listed = global_rank(rows, ["_part", "exposure", "repeat_id", "source_row_hash"], "_place")
        numbered = seeded_shuffle(listed, "_place", seed).drop("_place", "_part", "exposure")
        return materialize(numbered.withColumn("split", F.lit("train")).withColumn("arm", F.lit(f"dm_{name}")), "arm")

    s, g = arm("small", small), arm("large", master)
    return Schedules(audit.flag_members(master, small, "row_hash", "in_nested_small"), s, g, gaps, S.token_budget(s.unionByName(g)), S.replay_audit(pool))


def corpus_sizes(rows: int, low: float, high: float, ladder: tuple[tuple[int, int, int], ...] = ((20_000, 4_000, 20_000), (10_000, 2_000, 10_000)), narrow: tuple[float, float] = (5.0, 7.0)) -> tuple[str, int, int]:
    """(status, small, large): the sizes that a profile of so many rows of a difficulty range allows.

    The first step (rows needed, small, large) of the ladder that is reached decides; a narrow range that misses the
    first step is to be widened before smaller sizes are taken.
    """
    for i, (least, small, large) in enumerate(ladder):
        if i == 1 and (low, high) == narrow:
            return "widen the range", 0, 0
        if rows >= least:
            return "ready", small, large
    return "too few rows", 0, 0
