import random
from collections import defaultdict

import numpy as np

from gradeloom.functions.questions import normal_question
from gradeloom.llm import neardup as N


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(n))


def brute(rows):
    texts = sorted({normal_question(t) for _, t in rows})
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if a and b and N.alike(a, b):
                up[root(a)] = root(b)
    groups = defaultdict(set)
    for k, t in rows:
        groups[root(normal_question(t))].add((k, normal_question(t)))
    return {(min(a[0], b[0]), max(a[0], b[0])) for g in groups.values() for a in g for b in g if a[1] != b[1] and a[0] != b[0]}


def test_against_brute_force(frame):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = sentence(rng, 30)
        rows.append((10 * i, base))
        for j in range(rng.randrange(3)):
            words = base.split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "".join(rng.choices("xyz", k=4))
            rows.append((10 * i + j + 1, " ".join(words)))
    rows += [(9001, rows[0][1].upper()), (9002, "  " + rows[0][1]), (9003, ""), (9004, None), (9005, "abc"), rows[0]]
    df = frame([(*r, 1) for r in rows], "train_idx long, question string, text_id int")
    got = {tuple(r) for r in N.near_duplicate_pairs(df).collect()}
    assert got == brute(rows) and got
    groups = {r.train_idx: r.group for r in N.near_duplicates(df).collect()}
    assert groups[0] == groups[9001] == groups[9002] and groups[9003] == groups[9004] != groups[9005]


def test_a_chain_is_one_group_and_a_hot_text_counts_once(frame):
    rng = random.Random(9)
    words = sentence(rng, 40).split()
    chain = []
    for i in range(12):
        words = words[:]
        words[3 * i % 40] = f"new{i}word"
        chain.append((i, " ".join(words)))
    rows = chain + [(100 + i, chain[0][1]) for i in range(50)]
    df = frame(rows, "train_idx long, question string")
    assert len({r.group for r in N.near_duplicates(df).collect()}) == 1
    assert {tuple(r) for r in N.near_duplicate_pairs(df).collect()} == brute(rows)
    assert N.near_duplicate_pairs(df.limit(0)).count() == 0


def test_filters_lose_no_pair():
    rng = random.Random(2)
    for _ in range(200):
        a = sentence(rng, 25)
        words = a.split()
        words[rng.randrange(25)] = "edit"
        b = " ".join(words)
        h, o = N.pieces([a, b])
        p = N.fingerprints(h, o, 2)
        hp, op = N.pieces([sentence(rng, 25)])
        d = N.pivot_distances(p, N.fingerprints(hp, op, 1)).astype(int)
        apart = int(np.bitwise_count(p[0] ^ p[1]).sum())
        assert abs(d[0, 0] - d[1, 0]) <= apart <= len({a[i : i + 5] for i in range(len(a) - 4)} ^ {b[i : i + 5] for i in range(len(b) - 4)})


def test_few_rows_and_a_key_with_several_texts(frame):
    rng = random.Random(4)
    a, b = sentence(rng, 30), sentence(rng, 30)
    rows = [(1, a), (1, b), (2, a.replace(a.split()[3], "edit")), (3, b.replace(b.split()[5], "edit")), (4, sentence(rng, 30))]
    df = frame(rows, "train_idx long, question string")
    assert {tuple(r) for r in N.near_duplicate_pairs(df).collect()} == {(1, 2), (1, 3)}
    groups = {(r.train_idx, r.text_id): r.group for r in N.near_duplicates(df).collect()}
    assert len(groups) == 5 and len(set(groups.values())) == 3


def test_filters_are_counted(spark, frame):
    texts = [sentence(random.Random(i), 30) for i in range(6)] + ["x" * 500]
    h, o = N.pieces(texts)
    p = N.fingerprints(h, o, 7)
    d = np.ascontiguousarray(N.pivot_distances(p, N.pivot_prints(texts[:3])))
    rows = [(i, *map(int, (N.distinct_pieces(h, o, 7)[i], *p.view(np.int64)[i], *d.view(np.int64)[i]))) for i in range(7)]
    signed = frame(rows, "node long, n int, " + ", ".join(f"{c} long" for c in N.PRINTS + N.DISTANCES))
    out = {(r.a, r.b): (r.by_pivots, r.by_distance) for r in N.filtered(frame([(0, 1), (0, 6), (2, 2)], "a long, b long"), signed).collect()}
    assert out[2, 2] == (True, True) and out[0, 6] == (False, None) and not out[0, 1][1]


def test_bands_of_very_short_and_long_texts():
    h, o = N.pieces(["abc", "abcdefgh", "x" * 100_000, "ab" * 50_000])
    assert N.bands(h, o, 4).shape == (4, N.BANDS)
