"""Training schedules: replay deduplication, exposure expansion, cyclic replay and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.ordering import stable_order
from gradeloom.operators.pairs import join_hot
from gradeloom.session import materialize


def deduplicate_replay(pool: DataFrame, order: str = "input_pos", question: str = "question_hash", family: str = "family_hash") -> DataFrame:
    """Add ``outcome``: ``kept``, ``dropped_exact`` (a kept question came before) or ``dropped_family``.

    The first row of a family in input order is kept; a question determines its family, so a later row is an exact
    repeat if its question is that of the kept row. A row without family stands for its question alone, one without
    both for itself. The order must be unique. Families are reduced to their first row before rows meet it.
    """
    group = F.coalesce(F.col(family), F.col(question))
    rows = pool.withColumn("_family", group)
    firsts = rows.groupBy("_family").agg(F.min(F.struct(F.col(order).alias("_at"), F.col(question).alias("_question"))).alias("_first"))
    keyed = join_hot(rows.where("_family is not null"), materialize(firsts.where("_family is not null"), "firsts"), ["_family"])
    outcome = F.when(F.col(order).eqNullSafe(F.col("_first._at")), "kept").when(F.col(question).eqNullSafe(F.col("_first._question")), "dropped_exact").otherwise("dropped_family")
    kept = keyed.withColumn("outcome", outcome).select(*pool.columns, "outcome")
    return kept.unionByName(pool.where(F.col(family).isNull() & F.col(question).isNull()).withColumn("outcome", F.lit("kept")))


def replay_audit(deduplicated: DataFrame) -> DataFrame:
    """One row of counts; kept, dropped_exact and dropped_family add up to the input rows."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    return deduplicated.agg(
        F.count("*").alias("input_rows"), n("kept").alias("kept_rows"), n("dropped_exact").alias("dropped_exact"), n("dropped_family").alias("dropped_family"),
        F.countDistinct(F.when(F.col("outcome") == "kept", F.col("question_hash"))).alias("kept_questions"),
    ).withColumn("closed", F.col("input_rows") == F.col("kept_rows") + F.col("dropped_exact") + F.col("dropped_family"))


def expand_exposures(rows: DataFrame, total: int, source: str) -> DataFrame:
    """Every row total / n times, with ``source`` and ``repeat_id``; n must divide the total."""
    n = rows.count()
    if not n or total % n:
        raise ValueError(f"{total} exposures of {source} are not a multiple of {n} rows")
    return rows.withColumn("source", F.lit(source)).withColumn("repeat_id", F.explode(F.sequence(F.lit(0), F.lit(total // n - 1))))


def replay_exposures(pool: DataFrame, total: int, source: str = "math_replay", key: str = "row_hash", salt: str = "replay-v1") -> DataFrame:
    """``total`` rows that run through the pool in its salted order again and again, with ``exposure`` and ``repeat_id``."""
    ordered = materialize(stable_order(pool, salt, [key], to="_place"), "replay")
    n = ordered.count()
    if not n:
        raise ValueError("empty replay pool")
    last = F.floor((F.lit(total - 1) - F.col("_place")) / n)
    turns = ordered.where(F.col("_place") < total).withColumn("repeat_id", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return turns.withColumn("source", F.lit(source)).withColumn("exposure", F.col("_place") + F.col("repeat_id").cast("long") * n).drop("_place")


def union_sources(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name of tables whose columns differ; what a table lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| over the larger of both and 1."""
    return F.abs(a - b) / F.greatest(F.lit(1), a, b)


def token_budget(schedule: DataFrame, small: str = "dm_small", large: str = "dm_large", limit: float = 0.02) -> DataFrame:
    """(kind, small, large, gap, within): token sums of both arms and their relative gap."""
    kinds = ("assistant_tokens", "prompt_tokens", "train_tokens")
    total = lambda c, arm: F.coalesce(F.sum(F.when(F.col("arm") == arm, F.col(c))), F.lit(0))
    sums = schedule.agg(*[total(c, arm).alias(f"{c}_{side}") for c in kinds for side, arm in (("small", small), ("large", large))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(f"{c}_small").alias("small"), F.col(f"{c}_large").alias("large")) for c in kinds]))
    out = sums.select(rows.alias("r")).select("r.*")
    return out.withColumn("gap", relative_gap(F.col("small"), F.col("large"))).withColumn("within", F.col("gap") <= limit + 1e-12)


def schedule_report(schedule: DataFrame, train: DataFrame, position: str = "schedule_idx", train_position: str = "train_idx", replay: str = "math_replay") -> DataFrame:
    """(check, value): what a validator of one arm recounts from the rows; checks named ``bad_...`` must be 0.

    Rows delivered again count once. The positions are 0 .. n-1 without a gap, each with one row and its training
    row; replayed rows name their source, question and family, and a source row always the same ones.
    """
    rows = schedule.distinct()
    replayed = F.col("source").eqNullSafe(F.lit(replay))
    identity = [F.coalesce(F.col(c), F.lit("")) for c in ("source_row_hash", "source_question_hash", "source_family_hash")]
    unnamed = replayed & ((identity[0] == "") | (identity[1] == "") | (identity[2] == ""))
    known = replayed & ~unnamed
    tokens = ["assistant_tokens", "prompt_tokens", "train_tokens"]
    one = rows.agg(
        F.count("*").alias("rows"), F.countDistinct(position).alias("_positions"), (F.max(position) + 1).alias("_end"), F.count_if(replayed).alias("replay_rows"), F.count_if(unnamed).alias("bad_replay_identity"),
        F.countDistinct(F.when(known, identity[0])).alias("replay_sources"), F.countDistinct(F.when(known, F.concat_ws(",", *identity))).alias("_identities"),
        F.countDistinct(F.when(known, identity[1])).alias("replay_questions"), F.countDistinct(F.when(known, identity[2])).alias("replay_families"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens],
    )
    places = rows.select(F.col(position).alias("k"), F.lit(1).alias("side")).unionByName(train.select(F.col(train_position).alias("k"), F.lit(2).alias("side")))
    sides = places.groupBy("k").agg(F.bit_or("side").alias("sides")).agg(F.count_if(F.col("sides") == 1).alias("bad_without_training_row"), F.count_if(F.col("sides") == 2).alias("bad_without_schedule_row"))
    one = one.crossJoin(F.broadcast(sides)).withColumn("bad_repeated_positions", F.col("rows") - F.col("_positions")).withColumn("bad_gaps", F.coalesce(F.col("_end"), F.lit(0)) - F.col("_positions"))
    one = one.withColumn("bad_replay_drift", F.col("_identities") - F.col("replay_sources"))
    names = ["rows", "replay_rows", "replay_sources", "replay_questions", "replay_families", *tokens, "bad_repeated_positions", "bad_gaps", "bad_without_training_row", "bad_without_schedule_row", "bad_replay_identity", "bad_replay_drift"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("value")) for n in names])).alias("r")).select("r.*")


def recorded_differences(report: DataFrame, recorded: dict[str, int]) -> DataFrame:
    """(check, value, recorded): recounted values that differ from those of a summary, a missing one as null."""
    spark = report.sparkSession
    known = spark.createDataFrame(sorted(recorded.items()), "check string, recorded long")
    both = report.join(F.broadcast(known), "check", "full_outer")
    return both.where(F.col("recorded").isNotNull() & ~F.col("value").eqNullSafe(F.col("recorded"))).select("check", "value", "recorded")
