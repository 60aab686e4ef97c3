"""Registered queries of the core operators, each over its whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import boxes, canonical, ruler, text
from gradeloom.operators import audit, ordering, sampling, similarity, stats
from gradeloom.operators import schedule as S
from gradeloom.plans import schedule as plan
from gradeloom.plans import sql
from gradeloom.session import spread, table
from gradeloom.sources import io
from gradeloom.streaming import running

BOX_COMMAND = r"\\(?:boxed|fbox)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    if f.__name__ in sql.SQL:
        SQL[f.__name__] = sql.SQL[f.__name__]
    return f


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "dm_large_train").select("train_idx", "question")).distinct()


def _manifest(spark: SparkSession, d: str, arm: str | None = None) -> DataFrame:
    """Schedule rows, those delivered again once."""
    rows = table(spark, d, "schedule_manifest")
    rows = rows.where(F.col("arm") == arm) if arm else rows
    return rows.drop("arrived_at").distinct()


def _tenth(rows: DataFrame) -> int:
    return rows.count() // 10


@query
def proportional_take(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the corpus, proportional over topic and difficulty bucket, in its salted order."""
    rows = table(spark, d, "prepared_corpus").withColumn("difficulty_bucket", text.difficulty_bucket(F.col("difficulty")))
    return sampling.proportional_take(rows, _tenth(rows), ["topic", "difficulty_bucket"], "metadata-master-v1").select("position", "row_hash", "topic", "difficulty_bucket")


flagship = proportional_take


@query
def hamilton_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepared_corpus").withColumn("difficulty_bucket", text.difficulty_bucket(F.col("difficulty")))
    return sampling.hamilton_quota(rows, _tenth(rows), ["topic", "difficulty_bucket"]).select("stratum", "size", "quota")


@query
def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepared_corpus")
    return sampling.stratified_take(rows, _tenth(rows), ["topic"], "round-v1").select("position", "row_hash", "topic")


@query
def bin_selection(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the corpus by bin quotas; the bin stands for the graded outcome and is made from the difficulty."""
    b = F.when(F.col("difficulty") < 5, "anchor").when(F.col("difficulty") < 6.5, "frontier").otherwise("hard")
    rows = table(spark, d, "prepared_corpus").withColumn("difficulty_bin", b)
    return sampling.select_by_bins(rows, rows.count() // 4, ["topic"]).select("position", "row_hash", "difficulty_bin")


@query
def nested_subset(spark: SparkSession, d: str) -> DataFrame:
    """A subset nested in a master selection, its difficulty quotas repaired by swaps."""
    rows = plan.with_strata(table(spark, d, "prepared_corpus"))
    master = sampling.proportional_take(rows, rows.count() // 2, plan.STRATA, "metadata-master-v1").drop("position")
    return sampling.nested_take(master, rows.count() // 10, plan.STRATA).select("position", "row_hash", "difficulty_bucket", "topic")


@query
def token_deciles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepared_corpus")
    rows = ordering.token_deciles(rows, "assistant_tokens", "row_hash", "solution_token_decile")
    return ordering.token_deciles(rows, "prompt_tokens", "row_hash", "prompt_token_decile").select("row_hash", "solution_token_decile", "prompt_token_decile")


@query
def stable_positions(spark: SparkSession, d: str) -> DataFrame:
    return ordering.stable_order(table(spark, d, "replay_pool"), "replay-v1", ["row_hash"]).select("position", "row_hash")


@query
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return ordering.seeded_shuffle(table(spark, d, "replay_pool").select("row_hash", "input_pos"), "input_pos", 42)


@query
def question_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("train_idx", text.question_hash("question").alias("question_hash"))


@query
def template_families(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each template family, and how many the family has."""
    families = _questions(spark, d).select("train_idx", text.template_hash("question").alias("family_hash"))
    return families.groupBy("family_hash").agg(F.min("train_idx").alias("first_idx"), F.count("*").alias("members"))


@query
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    hashes = question_hashes(spark, d)
    return hashes.groupBy("question_hash").agg(F.count("*").alias("copies"), F.min("train_idx").alias("first_idx")).where("copies > 1")


@query
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    normal = _questions(spark, d).select("train_idx", text.normalize_question("question").alias("t"))
    return normal.select("train_idx", F.size(text.char_ngrams(F.col("t"))).alias("n_grams"))


@query
def nearest_dev_problem(spark: SparkSession, d: str) -> DataFrame:
    dev = spread(table(spark, d, "internal_dev").select("idx", "problem"))
    out = similarity.nearest_match(dev, dev, "idx", "idx", "problem", "problem", other=True)
    return out.select(F.col("probe").alias("idx"), F.round("score", 9).alias("score"), F.col("ref").alias("nearest_idx"))


@query
def similar_questions(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct normalised questions with a Jaccard score of 0.75 or more, each by its first record."""
    rows = spread(table(spark, d, "dm_large_train").select("train_idx", "question")).select("train_idx", text.normalize_question("question").alias("t"))
    firsts = rows.groupBy("t").agg(F.min("train_idx").alias("train_idx"))
    pairs = similarity.similar_pairs(firsts, firsts, "train_idx", "train_idx", "t", "t", 0.75, normal=True)
    return pairs.where("probe < ref").select(F.col("probe").alias("train_idx_a"), F.col("ref").alias("train_idx_b"), F.round("score", 9).alias("score"))


@query
def dev_containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 90 % of the character pieces of a held-out problem."""
    pairs = similarity.similar_pairs(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "internal_dev"), "doc_id", "idx", "text", "problem", 0.9, "containment")
    return pairs.select(F.col("probe").alias("doc_id"), F.col("ref").alias("idx"), F.round("score", 9).alias("score"))


@query
def embedding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five vectors nearest to each vector whose id is divisible by 100, against all vectors."""
    vectors = table(spark, d, "embeddings")
    out = similarity.nearest_vectors(vectors.where("vec_id % 100 = 0"), vectors, 5)
    return out.select("query", "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def _variants(rows: DataFrame, made: dict[str, object]) -> DataFrame:
    """(variant, t): the texts ``t`` as they are and with each change, so that every rule has texts that it holds for."""
    cells = F.array(*[F.struct(F.lit(name).alias("variant"), c.alias("t")) for name, c in {"as is": F.col("t"), **made}.items()])
    return rows.select(F.explode(cells).alias("v")).select("v.*")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers, solutions and documents as ``t``."""
    parts = [table(spark, d, "dm_large_train").select("train_idx", "answer").distinct().select("answer"), table(spark, d, "internal_dev").select("solution"), table(spark, d, "documents").select("text")]
    return spread(parts[0].toDF("t").unionByName(parts[1].toDF("t")).unionByName(parts[2].toDF("t")))


@query
def repetition_loops(spark: SparkSession, d: str) -> DataFrame:
    """How many texts loop, as they are and if they came two and three times."""
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = _variants(_texts(spark, d), {"twice": F.concat_ws("\n", t, t), "thrice": F.concat_ws("\n", t, t, t), "thrice in a line": F.concat_ws(" ", t, t, t)})
    return rows.groupBy("variant", text.has_repetition_loop(F.col("t")).alias("loops")).agg(F.count("*").alias("n"))


# What tools leave in texts, one for each kind that the rule knows, and one that is none.
RESIDUE = ("```", "<tool", "</tool>", "tool-call", "Tool output", "Python code", "pythonoutput", "sympy.", "Wolfram", "calculator result", "execution result", "a tool")


@query
def tool_residue(spark: SparkSession, d: str) -> DataFrame:
    """How many texts hold residue of tools, as they are and with a sign of each kind after them."""
    rows = _variants(_texts(spark, d), {sign: F.concat_ws(" ", "t", F.lit(sign)) for sign in RESIDUE})
    return rows.groupBy("variant", text.has_tool_residue(F.col("t")).alias("residue")).agg(F.count("*").alias("n"))


# Ends of questions for which the reject rules hold.
QUESTION_ENDS = {
    "proof": "Prove that it holds.", "choice": "A) 1\nB) 2\nC) 3", "options": "is it (a) or (b) or (c)", "best": "Choose the best value.", "figure": "as shown above", "example": "Give an example.",
    "vary": "Answers may vary.", "cue": "answer: 5", "box": "\\boxed{3}",
}


@query
def question_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Questions by reject reason, as they are, blank and with ends for which the rules hold."""
    asked = _questions(spark, d).select(F.col("question").alias("t")).unionByName(table(spark, d, "internal_dev").select(F.col("problem").alias("t")))
    rows = _variants(asked, {"blank": F.lit(" \n"), **{name: F.concat_ws(" ", "t", F.lit(end)) for name, end in QUESTION_ENDS.items()}})
    return rows.groupBy("variant", F.coalesce(text.question_reject_reason(F.col("t")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def solution_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Solutions by reject reason, as they are and with ends for which the rules hold."""
    rows = table(spark, d, "dm_large_train").select("train_idx", "answer").distinct().select(F.col("answer").alias("t"))
    rows = rows.unionByName(table(spark, d, "internal_dev").select(F.col("solution").alias("t")))
    plain = F.regexp_replace("t", BOX_COMMAND, "")
    ends = {"boxed": "$\\boxed{\\frac{1}{2}}$.", "open": "\\boxed{1", "after": "\\boxed{1} as wished", "twice": "\\boxed{1} \\fbox{2}", "tool": "```x``` \\boxed{1}"}
    made = {name: F.concat_ws(" ", plain, F.lit(end)) for name, end in ends.items()} | {"loop": F.concat_ws("\n", plain, plain, plain, F.lit("\\boxed{1}"))}
    return _variants(spread(rows), made).groupBy("variant", F.coalesce(boxes.solution_reject_reason(F.col("t")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def boxed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, the last one's content, the terminal answer and its source of every answer."""
    rows = table(spark, d, "dm_large_train").select("train_idx", "answer").distinct()
    region = boxes.terminal_region(F.col("answer"))
    return rows.select("train_idx", F.size(boxes.boxed_spans(F.col("answer"))).alias("n_boxes"), boxes.boxed_inner(F.col("answer")).alias("inner"), region["answer"].alias("terminal"), region["source"].alias("source"))


@query
def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every answer against the corpus' final answer of its source row; joined 1:1 on the row's digest."""
    answers = table(spark, d, "dm_large_train").select("train_idx", "answer").distinct()
    source = _manifest(spark, d, "dm_large").select(F.col("schedule_idx").alias("train_idx"), F.col("source_row_hash").alias("row_hash"), "repeat_id")
    gold = table(spark, d, "prepared_corpus").where("final_answer is not null").select("row_hash", "final_answer")
    joined = answers.join(source, "train_idx").join(gold, "row_hash")
    g = ruler.grade(text.gold_boxed(F.regexp_replace("final_answer", r"^\$|\$$", "")), F.col("answer"))
    return joined.select("train_idx", "row_hash", "repeat_id", g.alias("g")).select("train_idx", "row_hash", "repeat_id", "g.*")


@query
def profile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Per source row: graded repeats in order, and the bin: first repeat right, any right, none right."""
    k = stats.correct_of_k(graded_answers(spark, d), "row_hash", "repeat_id")
    b = F.when(F.get("outcomes", F.lit(0)) == 1, "anchor").when(F.col("correct") > 0, "frontier").otherwise("hard")
    return k.withColumn("difficulty_bin", b)


@query
def row_digests(spark: SparkSession, d: str) -> DataFrame:
    columns = ["row_hash", "topic", "difficulty", "final_answer", "prompt_tokens"]
    return table(spark, d, "prepared_corpus").select("row_hash", canonical.row_digest(columns).alias("digest"))


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    p = text.prompt(F.col("question"))
    return _questions(spark, d).select("train_idx", F.sha2(p, 256).alias("prompt_sha256"), text.prompt_version().alias("version"), text.slug(F.col("question")).alias("slug"))


@query
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Truncation and label masks over word lengths that stand for token ids."""
    ids = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), " "), lambda w: F.length(w).cast("long"))
    rows = table(spark, d, "dm_large_train").distinct().select("train_idx", ids(F.col("question")).alias("p"), ids(F.col("answer")).alias("c"))
    return rows.select(
        "train_idx", text.ids_digest(text.keep_last(F.col("p"), 32)).alias("prompt_digest"), text.expected_bos(F.col("p"), 32).alias("expected_bos"),
        text.ids_digest(text.train_ids(F.col("p"), F.col("c"), 96)).alias("ids_digest"), text.ids_digest(text.train_labels(F.col("p"), F.col("c"), 96)).alias("labels_digest"),
        text.stop_position(F.col("c"), [9, 10]).alias("generated"), (F.size("p") + F.size("c") > 96).alias("too_long"),
    )


@query
def truncation_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each arm exceed 256 train tokens, and the first 20 of them (a report of that size)."""
    rows = _manifest(spark, d).where("train_tokens > 256")
    counts = rows.groupBy("arm").agg(F.count("*").alias("affected"))
    first = rows.withColumn("r", F.row_number().over(_by("arm", "schedule_idx"))).where("r <= 20").groupBy("arm").agg(F.array_join(F.array_sort(F.collect_list("schedule_idx")), ",").alias("first_ids"))
    return counts.join(first, "arm")


@query
def box_tails(spark: SparkSession, d: str) -> DataFrame:
    """How many answers over 30 words lose their box if they are cut after the 30th."""
    rows = table(spark, d, "dm_large_train").select("train_idx", "answer").distinct().where("answer is not null")
    words = F.split("answer", " ")
    kept = F.length(F.array_join(F.slice(words, 1, 30), " "))
    return rows.groupBy((F.size(words) > 30).alias("cut"), boxes.box_lost(F.col("answer"), kept).alias("box_lost")).agg(F.count("*").alias("n"))


def _by(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


@query
def difficulty_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepared_corpus").groupBy(text.difficulty_bucket(F.col("difficulty")).alias("bucket")).agg(F.count("*").alias("n"))


@query
def topic_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = stats.distribution(_manifest(spark, d), ["topic", "difficulty_bucket"], ["arm"])
    return out.withColumn("fraction", F.round("fraction", 12))


@query
def distribution_gaps(spark: SparkSession, d: str) -> DataFrame:
    fields = ["topic", "difficulty_bucket", "solution_token_decile", "prompt_token_decile"]
    return stats.distribution_gap(_manifest(spark, d, "dm_small"), _manifest(spark, d, "dm_large"), fields).withColumn("gap", F.round("gap", 12))


@query
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return S.token_budget(_manifest(spark, d)).withColumn("gap", F.round("gap", 12))


@query
def schedule_composition(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).groupBy("arm", "source").agg(F.count("*").alias("n"), F.sum("train_tokens").alias("train_tokens"))


@query
def replay_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    pool = plan.replay_families(table(spark, d, "replay_pool"), table(spark, d, "schedule_manifest"))
    return S.deduplicate_replay(pool).select("row_hash", "input_pos", "outcome")


@query
def replay_audit(spark: SparkSession, d: str) -> DataFrame:
    pool = plan.replay_families(table(spark, d, "replay_pool"), table(spark, d, "schedule_manifest"))
    return S.replay_audit(S.deduplicate_replay(pool))


@query
def replay_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Two and a half runs through the replay pool."""
    pool = table(spark, d, "replay_pool")
    return S.replay_exposures(pool, pool.count() * 5 // 2).select("exposure", "repeat_id", "row_hash")


@query
def exposures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepared_corpus").select("row_hash", "train_tokens")
    return S.expand_exposures(rows, rows.count() * 3, "corpus_large")


@query
def schedule_union(spark: SparkSession, d: str) -> DataFrame:
    """Source composition of expanded and replayed rows whose columns differ."""
    both = S.union_sources(exposures(spark, d), replay_cycle(spark, d).withColumn("source", F.lit("math_replay")))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("train_tokens").alias("with_tokens"), F.count("exposure").alias("with_exposure"))


@query
def built_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Both arms of a schedule built from the whole corpus and the replay pool."""
    prepared = table(spark, d, "prepared_corpus")
    n = prepared.count()
    small, large = n // 10, n // 10 * 5
    pool = plan.replay_families(table(spark, d, "replay_pool"), table(spark, d, "schedule_manifest"))
    return plan.build_schedules(prepared, pool, large, small, large * 2, large // 2).both()


@query
def corpus_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How many question and family digests the corpus, the replay pool, the held-out items and the questions share."""
    p, r, v = (table(spark, d, t) for t in ("prepared_corpus", "replay_pool", "internal_dev"))
    r = plan.replay_families(r, table(spark, d, "schedule_manifest"))
    v = v.withColumn("family_hash", text.template_hash("problem"))
    q = _questions(spark, d).select(text.question_hash("question").alias("question_hash"), text.template_hash("question").alias("family_hash"))
    out = None
    for name, a, b in (("prepared-replay", p, r), ("prepared-dev", p, v), ("replay-dev", r, v), ("prepared-train", p, q)):
        for kind in ("question_hash", "family_hash"):
            one = audit.overlap(a, b, kind, kind).select(F.lit(name).alias("between"), F.lit(kind).alias("kind"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query
def key_differences(spark: SparkSession, d: str) -> DataFrame:
    """Training rows without schedule row and the other way round, and source rows that no schedule uses."""
    train = table(spark, d, "dm_large_train").select(F.col("train_idx").cast("string").alias("k"))
    rows = _manifest(spark, d, "dm_large").select(F.col("schedule_idx").cast("string").alias("k"))
    used = _manifest(spark, d).select(F.col("source_row_hash").alias("k"))
    known = table(spark, d, "prepared_corpus").select(F.col("row_hash").alias("k")).unionByName(table(spark, d, "replay_pool").select(F.col("row_hash").alias("k")))
    small = _manifest(spark, d, "dm_small").select(F.col("source_row_hash").alias("k"))
    out = None
    for what, a, b in (("train-schedule", train, rows), ("schedule-corpus", used, known), ("small-corpus", small, known), ("small-large", small, _manifest(spark, d, "dm_large").select(F.col("source_row_hash").alias("k")))):
        one = audit.key_difference(a, b, "k").withColumn("what", F.lit(what))
        out = one if out is None else out.unionByName(one)
    return out


@query
def question_drift(spark: SparkSession, d: str) -> DataFrame:
    """Records whose normalised question hash isn't the one recorded in the schedule, and those whose family hash isn't the question's."""
    now = question_hashes(spark, d)
    recorded = _manifest(spark, d, "dm_large").where("source_question_hash is not null").select(F.col("schedule_idx").alias("train_idx"), F.col("source_question_hash").alias("question_hash"))
    families = _manifest(spark, d, "dm_large").where("source_family_hash is not null").select(F.col("schedule_idx").alias("train_idx"), F.col("source_family_hash").alias("question_hash"))
    part = lambda other, name: audit.mismatches(now, other, "train_idx", "question_hash").select("train_idx", F.lit(name).alias("against"))
    return part(recorded, "question").unionByName(part(families, "family"))


@query
def repeat_completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = _manifest(spark, d)
    return audit.group_completeness(rows, ["arm", "source_row_hash"], "repeat_id").groupBy("arm", "complete").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))


@query
def source_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return audit.not_determined(_manifest(spark, d), "source_row_hash", ["source_question_hash", "source_family_hash"])


@query
def arm_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions at which the arms differ in source row or size."""
    slim = lambda arm: _manifest(spark, d, arm).groupBy("schedule_idx").agg(F.min("source_row_hash").alias("h"), F.min("train_tokens").alias("t"))
    return audit.positional_difference(slim("dm_small"), slim("dm_large"), "schedule_idx", ["h", "t"])


@query
def constant_drift(spark: SparkSession, d: str) -> DataFrame:
    out = audit.constant_drift(_manifest(spark, d), {"split": "train", "arm": "dm_large", "repeat_id": 0})
    return out.select("column", "expected", "wrong_rows", F.array_join("wrong_values", ",").alias("wrong_values"))


@query
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.null_counts(table(spark, d, "schedule_manifest"), ["arm", "source", "topic", "difficulty", "source_question_hash", "split"])


@query
def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return audit.uniqueness(table(spark, d, "prepared_corpus"), ["row_hash", "question_hash", "family_hash"])


@query
def duplicate_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, d, "schedule_manifest"), ["arm", "schedule_idx"])


@query
def token_limits(spark: SparkSession, d: str) -> DataFrame:
    tokens = ["prompt_tokens", "assistant_tokens", "train_tokens"]
    return audit.out_of_range(table(spark, d, "prepared_corpus"), tokens, 1, 300).select("row_hash", "train_tokens")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records: a user's last event of a type stands for an item's result in an arm."""
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("idx"), F.col("event_type").alias("arm")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return last.withColumn("parse_fail", (F.col("v") < 5).cast("int")).select(
        "parse_fail",
        "idx", "arm", (F.col("v") > 10).cast("int").alias("fallback_correct"), (F.col("v") > 20).cast("int").alias("strict_correct"),
        F.floor(F.col("v") * 10).alias("generated_tokens"), (F.col("v") > 60).cast("int").alias("hit_max"),
    )


@query
def record_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = stats.record_metrics(_records(spark, d), ["arm"])
    return out.select("arm", "n", "median_tokens", "contract_violations", *[F.round(c, 9).alias(c) for c in ("strict_acc", "fallback_acc", "format_gap", "mean_tokens", "hit_max_rate", "parse_fail_rate")])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """(idx, seed, base, treat): every arm but the base stands for a seed."""
    r = _records(spark, d).select("idx", "arm", "fallback_correct")
    base = r.where("arm = 'view'").select("idx", F.col("fallback_correct").alias("base"))
    return r.where("arm <> 'view'").select("idx", F.col("arm").alias("seed"), F.col("fallback_correct").alias("treat")).join(base, "idx")


@query
def arm_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Accuracies, exact McNemar test and gate of each arm against the base."""
    out = stats.gate(stats.paired_outcomes(_pairs(spark, d), "base", "treat", ["seed"]))
    return out.select("seed", "n", "improved", "regressed", "discordant", "passed", "passed_exactly", *[F.round(c, 9).alias(c) for c in ("base_acc", "treat_acc", "delta", "p")])


def _interval(spark: SparkSession, d: str) -> DataFrame:
    deltas = _pairs(spark, d).select("idx", (F.col("treat") - F.col("base")).alias("delta"))
    return stats.hash_bootstrap(stats.clusters(deltas, "idx"), 10_000, 20260714)


@query
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return _interval(spark, d).select("n", "reps", *[F.round(c, 9).alias(c) for c in ("estimate", "ci95_low", "ci95_high")])


@query
def decision(spark: SparkSession, d: str) -> DataFrame:
    per_seed = stats.paired_outcomes(_pairs(spark, d), "base", "treat", ["seed"])
    return stats.decision(per_seed, _interval(spark, d)).select("success", *[F.round(c, 9).alias(c) for c in ("worst_delta", "mean_delta", "ci95_low", "ci95_high")])


@query
def diversity(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the gain of one arm over another on the same items, and the decision on it."""
    r = _records(spark, d).select("idx", "arm", "fallback_correct")
    arm = lambda name: r.where(F.col("arm") == name).withColumn("seed", F.lit(42))
    three = stats.three_way(r.where("arm = 'view'"), arm("click"), arm("purchase"), "idx", "fallback_correct")
    deltas = three.select("idx", (F.col("large") - F.col("small")).alias("delta"))
    out = stats.diversity_decision(True, stats.hash_bootstrap(stats.clusters(deltas, "idx"), 10_000, 20260716))
    return out.select("n", "reps", "success", *[F.round(c, 9).alias(c) for c in ("estimate", "ci95_low", "ci95_high")])


@query
def level_selection(spark: SparkSession, d: str) -> DataFrame:
    return io.load_levels(table(spark, d, "internal_dev"), "4", 42).select("position", "idx", "type")


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = running.tumbling(table(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def streamed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Running totals by source after streaming all schedule rows."""
    return running.run_available(spark, f"{d}/schedule_manifest.parquet", running.running_totals)


@query
def streamed_identities(spark: SparkSession, d: str) -> DataFrame:
    """How many source rows keep one question and family while all schedule rows stream by."""
    build = lambda rows: running.single_valued(rows, "source_row_hash", ("source_question_hash", "source_family_hash"))
    return running.run_available(spark, f"{d}/schedule_manifest.parquet", build).groupBy("consistent").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))


@query
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """``event_windows`` as a stream."""
    out = running.run_available(spark, f"{d}/events.parquet", running.tumbling)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def nested_membership(spark: SparkSession, d: str) -> DataFrame:
    """Source rows of the large arm by whether the small arm has them, per source."""
    large = _manifest(spark, d, "dm_large")
    flagged = audit.flag_members(large, _manifest(spark, d, "dm_small"), "source_row_hash", "in_small")
    return flagged.groupBy("source", "in_small").agg(F.count("*").alias("n"))


@query
def bin_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each topic, and how many of them are in each difficulty bin."""
    b = F.when(F.col("difficulty") < 5, "anchor").when(F.col("difficulty") < 6.5, "frontier").otherwise("hard")
    return audit.conditional_counts(table(spark, d, "prepared_corpus").withColumn("bin", b), ["topic"], "bin", ["anchor", "frontier", "hard"])


@query
def raw_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values that training and held-out tables share, exactly as stored."""
    train, dev, docs = (table(spark, d, t) for t in ("dm_large_train", "internal_dev", "documents"))
    corpus, manifest = table(spark, d, "prepared_corpus"), table(spark, d, "schedule_manifest")
    pairs = {"question-problem": (train, dev, "question", "problem"), "answer-solution": (train, dev, "answer", "solution"), "text-solution": (docs, dev, "text", "solution"), "origin-row": (docs, corpus, "origin_hash", "row_hash"), "schedule-row": (manifest, corpus, "source_row_hash", "row_hash")}
    out = None
    for name, args in pairs.items():
        one = audit.overlap(*args).select(F.lit(name).alias("between"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query
def single_values(spark: SparkSession, d: str) -> DataFrame:
    """Whether both arms were made for one and the same split, and for one arm."""
    arms = {a: _manifest(spark, d, a) for a in ("dm_small", "dm_large")}
    part = lambda c: audit.single_across(arms, c).withColumn("column", F.lit(c))
    return part("split").unionByName(part("arm")).unionByName(part("repeat_id"))


@query
def record_provenance(spark: SparkSession, d: str) -> DataFrame:
    """What breaks the provenance of the schedule rows."""
    rows = _manifest(spark, d)
    return audit.provenance(rows, {"split": "train", "arm": "dm_large", "ruler_version": "v2"}, ["split", "source"], ["source_row_hash", "topic", "source_question_hash"])


@query
def schedule_report(spark: SparkSession, d: str) -> DataFrame:
    """What a validator recounts from the large arm and its training rows."""
    return S.schedule_report(_manifest(spark, d, "dm_large"), table(spark, d, "dm_large_train").select("train_idx").distinct())


@query
def profile_closure(spark: SparkSession, d: str) -> DataFrame:
    """How the source rows close over the corpus, their first exposure and their further ones, of which there should be one."""
    rows = _manifest(spark, d, "dm_large").select(F.col("source_row_hash").alias("row_hash"), "repeat_id")
    sampled = rows.where("repeat_id > 0").withColumn("repeat_id", F.col("repeat_id") - 1)
    return audit.profile_closure(table(spark, d, "prepared_corpus").select("row_hash"), rows.where("repeat_id = 0"), sampled, "row_hash", "repeat_id", 1)


@query
def held_out_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the held-out items have their registered number and no question of the replay pool."""
    return audit.closed_set(table(spark, d, "replay_pool"), table(spark, d, "internal_dev"), 500, "question_hash")


@query
def corpus_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Status and sizes that the corpus allows, for several ranges of difficulty and a ladder of a tenth of the usual size."""
    rows = table(spark, d, "prepared_corpus")
    ladder = ((2_000, 400, 2_000), (1_000, 200, 1_000))
    lines = []
    for low, high in ((4.0, 8.0), (5.0, 7.0), (0.0, 10.0), (9.0, 10.0)):
        n = rows.where((F.col("difficulty") >= low) & (F.col("difficulty") < high)).count()
        lines.append((low, high, n, *plan.corpus_sizes(n, low, high, ladder)))
    return spark.createDataFrame(lines, "low double, high double, n long, status string, small int, large int")


@query
def first_items(spark: SparkSession, d: str) -> DataFrame:
    """The four held-out items that come first (a sample for a trial run)."""
    return audit.first_rows(table(spark, d, "internal_dev").select("idx", "level", "type"), ["idx"], 4)


@query
def embedding_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose cosine with a vector whose id is divisible by 100 is 0.3 or more, with the nearest of these."""
    vectors = table(spark, d, "embeddings")
    out = similarity.near_any(vectors, vectors.where("vec_id % 100 = 0"), 0.3)
    return out.select("vec_id", "nearest", F.round("cosine", 6).alias("cosine"))


@query
def question_nearest_dev(spark: SparkSession, d: str) -> DataFrame:
    """The held-out problem nearest to each distinct question, by shared character pieces."""
    firsts = _questions(spark, d).groupBy("question").agg(F.min("train_idx").alias("train_idx"))
    out = similarity.nearest_match(firsts, table(spark, d, "internal_dev"), "train_idx", "idx", "question", "problem")
    return out.select(F.col("probe").alias("train_idx"), F.round("score", 9).alias("score"), F.col("ref").alias("idx"))


@query
def whole_batches(spark: SparkSession, d: str) -> DataFrame:
    """What a run resumed after an interruption keeps of its records and has still to do, in batches of 64."""
    items = table(spark, d, "dm_large_train").select("train_idx").distinct()
    saved = io.whole_batches(items.where("train_idx % 3 <> 1"), ["train_idx"], 64)
    done, left = saved.agg(F.count("*").alias("kept"), F.max("train_idx").alias("last_kept")), io.remaining(items, saved, "train_idx").agg(F.count("*").alias("remaining"))
    return done.crossJoin(F.broadcast(left))
