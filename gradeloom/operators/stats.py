"""Statistics of selections and of paired evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import has_repetition_loop
from gradeloom.operators.audit import duplicate_keys, require_empty


def distribution(rows: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, field, value, count, fraction) of the values of each field as strings, null as ``None``; one pass."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value")) for f in fields])
    counts = rows.select(*by, F.explode(cells).alias("c")).groupBy(*by, "c.field", "c.value").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by, "field"))  # every row has one value of each field
    return counts.withColumn("fraction", F.col("count") / total)


def distribution_gap(a: DataFrame, b: DataFrame, fields: Sequence[str], limit: float = 0.03) -> DataFrame:
    """(field, gap, within): the largest difference of the fractions of a value; a value one side lacks has 0."""
    x = distribution(a, fields).select("field", "value", F.col("fraction").alias("x"))
    y = distribution(b, fields).select("field", "value", F.col("fraction").alias("y"))
    gaps = x.join(y, ["field", "value"], "full_outer").groupBy("field").agg(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))).alias("gap"))
    return gaps.withColumn("within", F.col("gap") <= limit + 1e-12)


def record_metrics(rows: DataFrame, by: Sequence[str] = (), text: str | None = None) -> DataFrame:
    """Accuracies, format gap, mean and exact median tokens, hit-limit and loop rates of evaluation records.

    A group without rows has no metrics. A missing hit flag counts 0. A strict answer must be a fallback answer:
    ``contract_violations`` counts the rows that break it.
    """
    mean = lambda c: F.sum(F.col(c)) / F.count("*")
    aggs = [
        F.count("*").alias("n"), mean("strict_correct").alias("strict_acc"), mean("fallback_correct").alias("fallback_acc"),
        ((F.sum("fallback_correct") - F.sum("strict_correct")) / F.count("*")).alias("format_gap"),
        (F.sum("generated_tokens") / F.count("*")).alias("mean_tokens"), F.median("generated_tokens").alias("median_tokens"),
        (F.sum(F.coalesce("hit_max", F.lit(0))) / F.count("*")).alias("hit_max_rate"),
        F.count_if((F.col("strict_correct") == 1) & (F.col("fallback_correct") == 0)).alias("contract_violations"),
    ]
    if "parse_fail" in rows.columns:
        aggs.append(mean("parse_fail").alias("parse_fail_rate"))
    if text:
        rows = rows.withColumn("_loop", has_repetition_loop(F.col(text)).cast("int"))
        aggs.append(mean("_loop").alias("repetition_loop_rate"))
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs).where("n > 0")


def correct_of_k(rows: DataFrame, key: str, order: str = "sample_id", correct: str = "fallback_correct") -> DataFrame:
    """(key, k, correct, outcomes in the order of the samples)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, correct))), lambda x: x[correct])
    return rows.groupBy(key).agg(F.count("*").alias("k"), F.sum(correct).alias("correct"), ordered.alias("outcomes"))


def mcnemar_p(improved: Column, regressed: Column) -> Column:
    """Exact two-sided p of a paired comparison: min(1, 2 P[X <= min]) under Bin(d, 1/2); 1 without differences.

    Sums the log-binomials of the tail scaled by its largest, the last, from the last to the first term.
    """
    d, tail = (improved + regressed).cast("double"), F.least(improved, regressed).cast("int")
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), tail)), F.lit(0.0), lambda a, k: a + F.when(k <= tail, F.log((d - k + 1) / k)).otherwise(0.0))
    # ratio of term k-1 to term k is k / (d - k + 1)
    scaled = F.aggregate(
        F.sequence(F.greatest(F.lit(1), tail), F.lit(1), F.lit(-1)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, k: F.struct(
            F.when(k <= tail, a["term"] * k / (d - k + 1)).otherwise(F.lit(0.0)).alias("term"),
            (a["sum"] + F.when(k <= tail, a["term"] * k / (d - k + 1)).otherwise(F.lit(0.0))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    p = F.least(F.lit(1.0), 2 * F.exp(logs + F.log(scaled) - d * F.log(F.lit(2.0))))
    return F.when(d == 0, F.lit(1.0)).otherwise(p)


def paired_outcomes(pairs: DataFrame, base: str, treat: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, base_acc, treat_acc, delta, improved, regressed, discordant, p) of 0/1 outcomes of the same items."""
    aggs = [
        F.count("*").alias("n"), (F.sum(base) / F.count("*")).alias("base_acc"), (F.sum(treat) / F.count("*")).alias("treat_acc"),
        (F.sum(F.col(treat) - F.col(base)) / F.count("*")).alias("delta"),
        F.count_if((F.col(base) == 0) & (F.col(treat) == 1)).alias("improved"), F.count_if((F.col(base) == 1) & (F.col(treat) == 0)).alias("regressed"),
    ]
    out = pairs.groupBy(*by).agg(*aggs) if by else pairs.agg(*aggs)
    return out.withColumn("discordant", F.col("improved") + F.col("regressed")).withColumn("p", mcnemar_p(F.col("improved"), F.col("regressed")))


def paired_runs(base: DataFrame, runs: DataFrame, key: str, outcome: str, question: str | None = None, seed: str = "seed") -> DataFrame:
    """(key, seed, base, treat): every run's outcome beside the base's, after the keys are proved equal.

    Each seed must have exactly the items of the base, once each, and where ``question`` is given the same value of
    it; what doesn't close raises with examples.
    """
    require_empty(duplicate_keys(base, [key]), "repeated items of the base")
    require_empty(duplicate_keys(runs, [seed, key]), "repeated items of a run")
    seeds = runs.select(seed).distinct()
    wanted = base.select(key).crossJoin(F.broadcast(seeds))  # a seed is one run: a handful
    require_empty(wanted.join(runs, [seed, key], "left_anti"), "items a run lacks")
    require_empty(runs.join(base, key, "left_anti"), "items the base lacks")
    asked = [F.col(question).alias("_asked")] if question else []
    joined = runs.select(key, seed, F.col(outcome).alias("treat"), *[F.col(question).alias("_answered")] * bool(question)).join(base.select(key, F.col(outcome).alias("base"), *asked), key)
    if question:
        require_empty(joined.where(~F.col("_asked").eqNullSafe(F.col("_answered"))), "questions that differ")
    return joined.select(key, seed, "base", "treat")


def clusters(deltas: DataFrame, key: str, delta: str = "delta") -> DataFrame:
    """(key, value, place): the mean over the seeds of each item, in the order of its key as a string."""
    from gradeloom.operators.ordering import global_rank

    return global_rank(deltas.groupBy(key).agg(F.avg(delta).alias("value")), [F.col(key).cast("string")], "place")


def hash_bootstrap(values: DataFrame, reps: int, seed: int, value: str = "value", place: str = "place") -> DataFrame:
    """(estimate, ci95_low, ci95_high, n, reps): percentile interval of the mean under resampling of whole items.

    Draw i of replicate r takes the item at place (first 32 bits of md5 "r,i,seed") mod n, so any engine can repeat
    it. Counts per replicate and place are made by a partial aggregate before they meet the values.
    """
    spark = values.sparkSession
    n = values.count()
    if not n:
        raise ValueError("empty bootstrap data")
    numbers = spark.range(reps * n)
    rep, i = F.floor(F.col("id") / n), F.col("id") % n
    drawn = F.conv(F.substring(F.md5(F.concat_ws(",", rep.cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % n
    counts = numbers.select(rep.alias("rep"), drawn.alias(place)).groupBy("rep", place).agg(F.count("*").alias("times"))
    means = counts.join(values.select(place, value), place).groupBy("rep").agg((F.sum(F.col("times") * F.col(value)) / n).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit(0.025)).alias("ci95_low"), F.percentile("mean", F.lit(0.975)).alias("ci95_high"))
    estimate = values.agg(F.sum(value)).first()[0] / n
    return ends.select(F.lit(estimate).alias("estimate"), "ci95_low", "ci95_high", F.lit(n).alias("n"), F.lit(reps).alias("reps"))


def gate(comparison: DataFrame, least: float = 0.01) -> DataFrame:
    """Add ``passed``: treat_acc - base_acc >= ``least`` in doubles, and ``passed_exactly`` in whole numbers."""
    exact = (F.col("improved") - F.col("regressed")) >= F.ceil(F.lit(least) * F.col("n") - 1e-9)
    return comparison.withColumn("passed", (F.col("treat_acc") - F.col("base_acc")) >= least).withColumn("passed_exactly", exact)


def decision(per_seed: DataFrame, interval: DataFrame, least: float = 0.02) -> DataFrame:
    """One row: all seeds better, mean gain at least ``least`` and the interval above 0."""
    seeds = per_seed.agg(F.min("delta").alias("worst_delta"), F.avg("delta").alias("mean_delta"))
    low, high = interval.select("ci95_low", "ci95_high").first()
    both = seeds.withColumn("ci95_low", F.lit(low)).withColumn("ci95_high", F.lit(high))
    return both.withColumn("success", (F.col("worst_delta") > 0) & (F.col("mean_delta") >= least) & (F.col("ci95_low") > 0))


def three_way(base: DataFrame, large: DataFrame, small: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, seed, base, large, small): outcomes of the base and of two arms with a ``seed``, joined on item and seed."""
    b = base.select(key, F.col(outcome).alias("base"))
    x, y = large.select(key, "seed", F.col(outcome).alias("large")), small.select(key, "seed", F.col(outcome).alias("small"))
    return x.join(y, [key, "seed"]).join(b, key)


def diversity_decision(prior_success: bool, interval: DataFrame, least: float = 0.02) -> DataFrame:
    """One row: the earlier success holds, the estimate is at least ``least`` and the interval above 0."""
    ok = F.lit(prior_success) & (F.col("estimate") >= least) & (F.col("ci95_low") > 0)
    return interval.withColumn("success", ok)
