"""Stratified selection: largest-remainder quotas, proportional and round-robin takes, nested subsets and repair."""

from __future__ import annotations

import functools
import heapq
from collections import defaultdict
from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.canonical import canonical_json, canonical_tuple
from gradeloom.operators.ordering import WINDOW_ROWS, digest_share, global_rank, rank_within, stable_key, stable_order
from gradeloom.operators.pairs import join_hot
from gradeloom.session import materialize

#: Most rows of a selection whose quota repair is planned on the driver (ids and strata only); more are swapped as tables.
REPAIR_ROWS = 200_000


def stratum(fields: Sequence[str]) -> Column:
    return canonical_tuple(*[F.col(f) for f in fields])


def hamilton_quota(rows: DataFrame, n: int, fields: Sequence[str]) -> DataFrame:
    """(fields, stratum, size, quota): n places apportioned to the strata by largest remainders.

    A quota is floor(n size / N); what is left goes to the largest fractions, ties to the larger canonical key.
    """
    sizes = materialize(rows.groupBy(*fields).agg(F.count("*").alias("size")).withColumn("stratum", stratum(fields)), "sizes")
    strata, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > total:
        raise ValueError(f"cannot take {n} rows from {total}")
    exact = F.lit(float(n)) * F.col("size") / F.lit(float(max(1, total)))
    sizes = sizes.withColumn("_base", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    order = [F.desc("_rest"), F.desc("stratum")]
    if strata <= WINDOW_ROWS:  # one short row each
        placed = sizes.withColumn("_place", F.row_number().over(Window.orderBy(*order))).withColumn("_given", F.sum("_base").over(Window.partitionBy(F.lit(0))))
    else:
        placed = global_rank(sizes, order, "_place", 1).withColumn("_given", F.lit(sizes.agg(F.sum("_base")).first()[0]))
    return placed.withColumn("quota", F.col("_base") + F.when(F.col("_place") <= n - F.col("_given"), 1).otherwise(0)).drop("_base", "_rest", "_place", "_given")


def _firsts(rows: DataFrame, quota: DataFrame, key: str, salt: Column) -> tuple[list[DataFrame], int]:
    """(two ways to the rows of each stratum ``_s`` that are first in its salted order, ``_q`` of them with their ``_r`` from 1; their number).

    ``quota`` has (_s, _size, _q). Digests are evenly spread, so the first way drops rows far beyond the quota's share
    before any are ordered; should that leave a stratum short, the second looks at all.
    """
    strata, largest, wanted = quota.agg(F.count("*"), F.coalesce(F.max("_q"), F.lit(0)), F.coalesce(F.sum(F.least("_q", "_size")), F.lit(0))).first()
    keyed = join_hot(rows, quota.where("_q > 0"), ["_s"], known=strata).withColumn("_k", stable_key(salt, F.col(key)))
    bound = (F.col("_q") + 8 * F.sqrt(F.col("_q").cast("double")) + 30) / F.col("_size")
    return [rank_within(near, "_s", ["_k", key], largest, "_r").where("_r <= _q").drop("_k", "_q", "_size") for near in (keyed.where(digest_share("_k") <= bound), keyed)], wanted


def proportional_take(rows: DataFrame, n: int, fields: Sequence[str], salt: str, key: str = "row_hash") -> DataFrame:
    """n rows, each stratum with its quota of the rows first in its salted order, and their final ``position``."""
    quota = hamilton_quota(rows, n, fields).select(F.col("stratum").alias("_s"), F.col("size").alias("_size"), F.col("quota").alias("_q"))
    ways, wanted = _firsts(rows.withColumn("_s", stratum(fields)), quota, key, F.concat(F.lit(salt + ":"), F.col("_s")))
    for chosen in ways:
        out = stable_order(chosen.drop("_s", "_r"), salt + ":final", [key])
        if out.count() == wanted:
            break
    return out


def stratified_take(rows: DataFrame, n: int, fields: Sequence[str], salt: str, key: str = "row_hash") -> DataFrame:
    """n rows round-robin over the strata in the order of their canonical keys, with their ``position``."""
    keyed = rows.withColumn("_s", stratum(fields))
    sizes = materialize(keyed.groupBy("_s").agg(F.count("*").alias("_size")), "sizes")
    reached = before = high = 0  # turns in which n rows are reached; n rows have fewer than sqrt(2 n) different sizes
    found = sizes.groupBy("_size").count().sort("_size").collect()
    left = sum(strata for _, strata in found)
    for size, strata in found:
        high = size
        if reached + left * (size - before) >= n:
            high = before + -(-(n - reached) // left)
            break
        reached, before, left = reached + left * (size - before), size, left - strata
    ways, wanted = _firsts(keyed, sizes.withColumn("_q", F.least("_size", F.lit(high))), key, F.lit(salt))
    for turns in ways:
        out = global_rank(turns, ["_r", "_s"], "position")
        if out.count() == wanted:
            break
    return out.where(F.col("position") < n).drop("_s", "_r")


def bin_quotas(available: dict[str, int], target: int) -> dict[str, int]:
    """Places of the anchor, frontier and hard bins: at most 20 % hard, 60 % frontier, the rest anchor.

    What a bin cannot fill goes to the frontier and then to the anchor, never to the hard bin.
    """
    hard, frontier = target // 5, target * 3 // 5
    want = {"hard": hard, "frontier": frontier, "anchor": target - hard - frontier}
    got = {name: min(n, available.get(name, 0)) for name, n in want.items()}
    for name in ("frontier", "anchor"):
        got[name] += min(target - sum(got.values()), available.get(name, 0) - got[name])
    if sum(got.values()) < target:
        raise ValueError(f"cannot fill {target} from {available} with at most a fifth hard")
    return got


def select_by_bins(rows: DataFrame, target: int, fields: Sequence[str], bin_field: str = "difficulty_bin", salt: str = "master", key: str = "row_hash") -> DataFrame:
    """``target`` rows by bin quotas, proportional inside each bin, with their ``position``."""
    sizes = {r[0]: r[1] for r in rows.where(F.col(bin_field).isin("anchor", "frontier", "hard")).groupBy(bin_field).count().collect()}
    quotas = bin_quotas(sizes, target)
    parts = None
    for name in ("anchor", "frontier", "hard"):
        part = proportional_take(rows.where(F.col(bin_field) == name), quotas[name], fields, f"{salt}-{name}", key).drop("position")
        parts = part if parts is None else parts.unionByName(part)
    return stable_order(parts, f"{salt}-final", [key])


def _order(salt: str, row_hash: str) -> str:
    return sha256(f"{salt}\0{row_hash}".encode()).hexdigest()


def plan_repair(inside: Sequence[tuple], outside: Sequence[tuple], want: dict[str, int]) -> tuple[set[str], set[str]]:
    """(hashes to add, hashes to remove) so that the bucket counts of ``inside`` become ``want``.

    Rows are (hash, bucket, topic, decile, decile). Each swap serves the smallest bucket that lacks rows and the
    smallest that has too many, and prefers rows that share topic and deciles, then rows that share the topic.
    """
    have: dict[str, int] = defaultdict(int)
    pools = {"in": defaultdict(list), "out": defaultdict(list)}
    strata: dict[tuple[str, str], dict[str, set]] = {}
    live: dict[tuple[str, str], int] = {}
    row_of = {}

    def enter(side: str, row: tuple) -> None:
        h, bucket, topic, *deciles = row
        row_of[h] = row
        live[side, h] = 1
        action = "remove" if side == "in" else "add"
        for key, salt in (((bucket, (topic, *deciles)), f"metadata-swap-{action}"), ((bucket, topic), f"metadata-swap-{action}-topic")):
            heapq.heappush(pools[side][key], (_order(salt, h), h))
            strata.setdefault((side, bucket), {"full": set(), "topic": set()})["full" if isinstance(key[1], tuple) else "topic"].add(key[1])

    def peek(side: str, key) -> str | None:
        heap = pools[side][key]
        while heap and not live.get((side, heap[0][1])):
            heapq.heappop(heap)
        return heap[0][1] if heap else None

    for row in inside:
        have[row[1]] += 1
        enter("in", row)
    for row in outside:
        enter("out", row)
    none = {"full": set(), "topic": set()}
    first = {row[0] for row in inside}
    now = set(first)
    for _ in range(len(inside)):
        lack = min((b for b in want if have[b] < want[b]), default=None)
        if lack is None:
            break
        spare = min((b for b in have if have[b] > want.get(b, 0)), default=None)
        if spare is None:
            raise ValueError("the quotas cannot be reached by swaps")
        for kind, name in (("full", canonical_json), ("topic", str)):
            shared = strata.get(("out", lack), none)[kind] & strata.get(("in", spare), none)[kind]
            shared = [s for s in sorted(shared, key=name) if peek("out", (lack, s)) and peek("in", (spare, s))]
            if shared:
                come, go = peek("out", (lack, shared[0])), peek("in", (spare, shared[0]))
                break
        else:
            raise ValueError(f"no shared topic to swap {spare} for {lack}")
        live["out", come] = live["in", go] = 0
        enter("in", row_of[come])
        enter("out", row_of[go])
        now.add(come)
        now.discard(go)
        have[lack] += 1
        have[spare] -= 1
    return now - first, first - now


def plan_repair_as_tables(inside: DataFrame, outside: DataFrame, want: dict[str, int], key: str, bucket: str, group: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """``plan_repair`` for any number of rows: (rows to add, rows to remove), each with the key.

    While two buckets are the smallest that lack and have too many rows, their swaps run through the shared strata in
    order, so the counts of the strata say how many rows each gives, and the rows are those ranked first. Rows that
    came in or went out are never swapped again. The driver sees counts by bucket and stratum.
    """
    topic = group[0]
    named = lambda df: materialize(df.withColumn("_full", stratum(group)).withColumn("_topic", F.coalesce(F.col(topic).cast("string"), F.lit("None"))).select(key, bucket, "_full", "_topic"), "side")
    left = {"in": named(inside), "out": named(outside)}
    counts = {side: defaultdict(int, {(b, s, t): n for b, s, t, n in df.groupBy(bucket, "_full", "_topic").count().collect()}) for side, df in left.items()}
    have: dict[str, int] = defaultdict(int)
    for (b, _, _), n in counts["in"].items():
        have[b] += n
    moved: dict[str, list[DataFrame]] = {"in": [], "out": []}
    while True:
        lack = min((b for b in want if have[b] < want[b]), default=None)
        if lack is None:
            break
        spare = min((b for b in have if have[b] > want.get(b, 0)), default=None)
        if spare is None:
            raise ValueError("the quotas cannot be reached by swaps")
        open_swaps = min(want[lack] - have[lack], have[spare] - want.get(spare, 0))
        done = 0
        for column, at, suffix in (("_full", 1, ""), ("_topic", 2, "-topic")):
            sizes = {side: defaultdict(int) for side in counts}
            for side, b in (("out", lack), ("in", spare)):
                for k, n in counts[side].items():
                    if k[0] == b:
                        sizes[side][k[at]] += n
            takes = {}
            for s in sorted(sizes["out"].keys() & sizes["in"].keys()):
                n = min(sizes["out"][s], sizes["in"][s], open_swaps - done)
                if n:
                    takes[s] = n
                    done += n
            if not takes:
                continue
            quota = inside.sparkSession.createDataFrame(sorted(takes.items()), f"{column} string, _q long")
            for side, b, action in (("out", lack, "add"), ("in", spare, "remove")):
                keyed = join_hot(left[side].where(F.col(bucket) == b), quota, [column]).withColumn("_k", stable_key(f"metadata-swap-{action}{suffix}", F.col(key)))
                chosen = materialize(rank_within(keyed, column, ["_k", key], sum(sizes[side].values()), "_r").where("_r <= _q").select(key, "_full", "_topic"), "swapped")
                moved[side].append(chosen.select(key))
                for s, t, n in chosen.groupBy("_full", "_topic").count().collect():
                    counts[side][b, s, t] -= n
                left[side] = materialize(left[side].join(chosen.select(key), key, "left_anti"), "side")
        if not done:
            raise ValueError(f"no shared topic to swap {spare} for {lack}")
        have[lack] += done
        have[spare] -= done
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts) if parts else None
    return union(moved["out"]), union(moved["in"])


def repair_quota(master: DataFrame, selected: DataFrame, target: int, bucket: str = "difficulty_bucket", group: Sequence[str] = ("topic", "solution_token_decile", "prompt_token_decile"), key: str = "row_hash") -> DataFrame:
    """``selected`` after swaps with other rows of ``master`` that make its bucket counts proportional.

    The swaps depend on one another: up to ``REPAIR_ROWS`` rows (ids and strata) are planned on the driver, more as
    tables with the same result; only the buckets that lack or have too many rows are looked at.
    """
    want = {r[bucket]: r["quota"] for r in hamilton_quota(master, target, [bucket]).collect() if r["quota"]}
    have = {r[0]: r[1] for r in selected.groupBy(bucket).count().collect()}
    lacking = [b for b in want if have.get(b, 0) < want[b]]
    spare = [b for b in have if have[b] > want.get(b, 0)]
    if not lacking:
        return selected
    columns = [key, bucket, *group]
    inside = materialize(selected.where(F.col(bucket).isin(spare + lacking)).select(*columns), "inside")
    outside = materialize(master.where(F.col(bucket).isin(lacking + spare)).join(selected.select(key), key, "left_anti").select(*columns), "outside")
    goals = {b: want.get(b, 0) for b in lacking + spare}
    if inside.count() + outside.count() > REPAIR_ROWS:
        add, remove = plan_repair_as_tables(inside, outside, goals, key, bucket, group)
        return selected.join(remove, key, "left_anti").unionByName(master.join(add, key, "left_semi"), allowMissingColumns=True)
    add, remove = plan_repair([tuple(r) for r in inside.collect()], [tuple(r) for r in outside.collect()], goals)
    swaps = [master.sparkSession.createDataFrame([(h,) for h in sorted(x)], f"{key} string") for x in (add, remove)]
    return selected.join(F.broadcast(swaps[1]), key, "left_anti").unionByName(master.join(F.broadcast(swaps[0]), key, "left_semi"), allowMissingColumns=True)


def nested_take(master: DataFrame, target: int, fields: Sequence[str], salt: str = "metadata-small-v1", bucket: str = "difficulty_bucket", key: str = "row_hash") -> DataFrame:
    """A nested subset: a proportional take whose bucket counts are then repaired, with its ``position``."""
    base = proportional_take(master, target, fields, salt, key).drop("position")
    group = ("topic", "solution_token_decile", "prompt_token_decile")
    return stable_order(repair_quota(master, base, target, bucket, group, key), "metadata-small-final", [key])
