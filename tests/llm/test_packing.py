import random
from collections import Counter, defaultdict

import pytest

from gradeloom.llm import packing as P

TEXTS = [(1, "hello world"), (2, None), (3, ""), (4, "a b c " * 900), (5, "x y " * 40), (5, "x y " * 40), (None, "zz")]


def check(rows, sizes, capacity):
    fill, pieces = Counter(), defaultdict(list)
    for r in rows:
        fill[r.sequence_id] += r.n_tokens
        pieces[r.doc_id].append((r.token_start, r.n_tokens))
        assert r.n_tokens > 0
    assert max(fill.values(), default=0) <= capacity
    for doc, n in sizes.items():
        at = 0
        for start, k in sorted(pieces.pop(doc)):
            assert start == at
            at += k
        assert at == n
        assert n > capacity or len([1 for r in rows if r.doc_id == doc]) == 1
    assert not pieces
    return fill


def test_whole_texts_in_few_sequences(frame):
    rng = random.Random(1)
    sizes = {i: rng.choice([rng.randrange(1, 400), rng.randrange(1, 3000)]) for i in range(700)}
    df = frame(list(sizes.items()), "doc_id long, n_tokens long")
    fill = check(P.pack(df, "doc_id", 1000, block_items=100).collect(), sizes, 1000)
    assert len(fill) <= -(-sum(sizes.values()) // 1000) * 1.02 + 1


@pytest.mark.parametrize(("size", "n", "sequences"), [(600, 200, 200), (400, 201, 101), (1, 1500, 2)])
def test_sizes_that_do_not_fill_a_sequence(frame, size, n, sequences):
    sizes = dict.fromkeys(range(n), size)
    fill = check(P.pack(frame(list(sizes.items()), "doc_id long, n_tokens long"), "doc_id", 1000, block_items=20).collect(), sizes, 1000)
    assert len(fill) == sequences


def test_edges(frame):
    df = frame([(*t, "q") for t in TEXTS], "doc_id long, text string, n_tokens string")
    rows = P.pack_texts(df, 500).collect()
    assert {r.doc_id for r in rows} == {1, 4, 5}
    assert P.pack_texts(df.limit(0), 500).count() == 0
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) > 500 and max(r.n_tokens for r in rows) <= 500
    with pytest.raises(ValueError):
        P.pack(frame([], "doc_id long, n_tokens long"), "doc_id", 0)


def test_local_search_empties_bins_that_best_fit_leaves():
    sizes = [6, 5, 5, 4, 4, 3, 3]
    start = [[0, 5], [1, 3], [2, 4], [6]]
    bins = P.local_search(start, sizes, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))
    assert all(sum(sizes[i] for i in b) <= 10 for b in bins)


def test_local_search_keeps_items_and_capacity_at_random():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(40)]
        start = [[i] for i in range(40)]
        bins = P.local_search(start, sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(40)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(P.best_fit(sizes, 100)) + 2


def test_local_search_ends_where_no_step_is_left():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(100, 701) for _ in range(rng.randrange(40, 91))]
        bins = P.local_search(P.best_fit(sizes, 1000), sizes, 1000)
        fill = [sum(sizes[i] for i in b) for b in bins]
        open_bins = [k for k, f in enumerate(fill) if f < 1000]
        assert len(bins) == -(-sum(sizes) // 1000) or not any(P._improve(k, open_bins, bins, fill, sizes, 1000) for k in open_bins)


def test_token_sizes_are_those_of_whole_texts(frame):
    long = "word " * 30_000
    got = {r[0]: r[1] for r in P.token_sizes(frame([(1, long), (2, "\ud83d".encode("utf-8", "ignore").decode() + "é")], "doc_id long, text string"), "doc_id", "text", P.TOKENIZER).collect()}
    assert got[1] == len(P.encoder(P.TOKENIZER).encode_ordinary(long))
