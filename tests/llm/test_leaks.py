import random

from gradeloom.llm.leaks import _maximal, equal_parts, leaks, plain_words, tile, word_hashes, words_of

WORDS = [f"w{i}" for i in range(200)]


def brute(docs, items, k):
    found = set()
    for d, text in docs:
        w = plain_words([text or ""])[0].split()
        for i, *parts in items:
            for part in parts:
                p = plain_words([part or ""])[0].split()
                runs = {tuple(p[x : x + k]) for x in range(len(p) - k + 1)}
                if any(tuple(w[x : x + k]) in runs for x in range(len(w) - k + 1)):
                    found.add((d, i))
    return found


def test_markup_of_any_length_is_no_words(frame):
    tags = ['<span style="' + "color: red; " * 40 + '">', "<a\n  href='x?a=1&b=2'\n  class=wide\n>", '<img alt="a > b" src="data:image/png;base64,' + "Ab9/" * 500 + '" />', "</span\n>"]
    for tag in tags:
        assert plain_words([f"one {tag} two"])[0].split() == ["one", "two"]
    prose = "if a <b, c = 2 and " + "so it goes on " * 30 + "until d> 3"
    assert plain_words([prose])[0] == prose
    item = " ".join(WORDS[:14])
    docs = [(n, " ".join([*WORDS[:7], tag, *WORDS[7:14]]), "t", 0) for n, tag in enumerate(tags)]
    found = leaks(frame(docs, "doc_id long, text string, source string, n int"), frame([(1, item, "")], "idx long, problem string, solution string"))
    assert {r.doc_id for r in found.where("longest >= 12").collect()} == set(range(len(tags)))


def test_against_brute_force(frame):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, text(30), text(20)) for i in range(20)]
    docs = []
    for d in range(80):
        words = text(60).split()
        for _ in range(rng.randrange(3)):
            part = rng.choice(rng.choice(items)[1:]).split()
            n = rng.choice([10, 11, 12, 13, 20])
            at = rng.randrange(max(1, len(part) - n))
            words[10:10] = part[at : at + n]
        docs.append((d, " ".join(words)))
    got = leaks(frame(docs, "doc_id long, text string"), frame(items, "idx long, problem string, solution string"), block_words=60)
    assert {(r.doc_id, r.idx) for r in got.collect()} == brute(docs, items, 12)


def test_disguises_order_and_coverage(frame):
    item = " ".join(WORDS[:40])
    half = " ".join(WORDS[20:40]).upper() + " ... " + " ".join(WORDS[:20])
    marked = " ".join(f"**{w}**​" for w in WORDS[:40])
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item)
    docs = [(1, item), (2, half), (3, marked), (4, wide), (5, " ".join(WORDS[:11]) + " x " + " ".join(WORDS[12:23])), (6, None), (7, ""), (8, "> " + item.replace(" ", "\n> ", 5))]
    rows = {r.doc_id: r for r in leaks(frame([(*d, "c") for d in docs], "doc_id long, text string, tiles string"), frame([(7, item, None)], "idx long, problem string, solution string")).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 8]
    assert rows[1].longest == 40 and rows[1].whole
    assert rows[2].tiles == 2 and rows[2].covered_words == 40 and rows[2].whole


def test_empty_and_long(frame):
    docs, items = frame([(1, "a " * 200_000)], "doc_id long, text string"), frame([(1, None, ""), (None, "x", "y")], "idx long, problem string, solution string")
    assert leaks(docs, items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0
    assert leaks(docs.limit(0), items).count() == 0


def test_tiles_do_not_overlap():
    tiles = tile([(0, 0, 20), (10, 5, 20), (40, 0, 12)], 4)
    a = [x for i, _, n in tiles for x in range(i, i + n)]
    b = [x for _, p, n in tiles for x in range(p, p + n)]
    assert len(a) == len(set(a)) and len(b) == len(set(b)) and tiles[0][2] == 20


def test_word_hashes_ignore_dress():
    x, y = word_hashes(["The  CAT, sat!"])[0], word_hashes(["the cat\nsat"])[0]
    assert x.tolist() == y.tolist() and len(x) == 3


def test_rectangles_are_all_their_seeds():
    rng = random.Random(7)
    for _ in range(50):
        rectangles = [(rng.randrange(30), rng.randrange(1, 6), rng.randrange(30), rng.randrange(1, 6)) for _ in range(4)]
        singles = [(i + x, 1, p + y, 1) for i, a, p, b in rectangles for x in range(a) for y in range(b)]
        assert sorted(_maximal(rectangles, 4)) == sorted(_maximal(singles, 4))


def test_words_that_repeat_thousands_of_times(frame):
    docs = [(1, "na " * 6000 + "batman"), (2, "na " * 11), (3, " ".join(WORDS[:14]))]
    out = leaks(frame(docs, "doc_id long, text string"), frame([(1, "na " * 4000, "")], "idx long, problem string, solution string")).collect()
    assert [(r.doc_id, r.longest, r.covered_words) for r in out] == [(1, 4000, 4000)]


def test_matches_are_checked_word_by_word():
    a, b = list("abcdefgh"), list("abcdxfgh")
    assert equal_parts((0, 0, 8), a, b, 3) == [(0, 0, 4), (5, 5, 3)] and equal_parts((0, 0, 4), a, b, 3) == [(0, 0, 4)]
    for text in ("The  CAT, sat!", "", "x² 1½ é_ß", "你好 мир-7"):
        assert len(words_of(plain_words([text])[0])) == len(word_hashes([text])[0])
