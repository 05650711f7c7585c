"""The trie of shared heads against a plain one in Python, and list ranking against walking."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from larder.llm import prefix_trie as t
from larder.llm.listrank import prefix_sums

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """rows (conv_id, turn, role, text) -> {(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)}"""
    own = {}
    for c, k, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((k is not None, k, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # as SQL has it for negative ids
        built[c] = said if base == c else own.get(base, [])[:h] + said[h:]
    members = {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    saved = {n: (len(m) - 1) * (len(n[-1][1]) if n else 0) for n, m in members.items()}
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def below(n):
        stack, out = [n], []
        while stack:
            out.append(stack.pop())
            stack += kids.get(out[-1], [])
        return out
    return {(min(m), len(n)): (min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])),
                               sum(x not in kids for x in below(n)), sum(saved[x] for x in below(n)),
                               hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest())
            for n, m in members.items()}


def trie(conversations, finish=8):
    found = t.prefix_trie(*t.shared_heads(t.conversation_turns(conversations)), finish=finish)
    return found.collect()


def check(conversations, finish=300):
    got = trie(conversations, finish)
    want = brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    wrong = [(r, want.get((r["conv_id"], r["depth"]))) for r in got if tuple(r)[2:8] != want.get((r["conv_id"], r["depth"]))]
    assert not wrong[:3] and len(got) == len(want)
    return got


def talk(seed, convs, words=3):
    rng = random.Random(seed)
    return [(c, k, rng.choice(["user", "assistant"]), f"w{rng.randrange(words)}" * rng.randrange(4)) for c in convs for k in range(rng.randrange(9))]


def test_equal_to_brute_force_and_the_tour_nests(spark):
    got = check(spark.createDataFrame(talk(1, range(260)), TURNS))
    spans = sorted((r["enter"], r["leave"]) for r in got)
    assert sorted(x for s in spans for x in s) == list(range(2 * len(got)))
    open_ends = []
    for enter, leave in spans:
        while open_ends and open_ends[-1] < enter:
            open_ends.pop()
        assert not open_ends or leave < open_ends[-1]
        open_ends.append(leave)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 0, "user", ""), (0, 0, "user", ""), (0, 1, None, "é\U0001F600" * 30), (None, 1, "user", "x"), (5, 3, "user", "x"),
            (5, None, "user", "y"), (7, 1, "", None), (7, 2, "user", "long " * 20000), (100, 0, "a", "1:bc"), (101, 0, "a1", ":bc"), (250, 9, "user", "z"),
            (-7, 0, "user", "z"), (-107, 0, "user", "z"), *[(k, 0, "user", "only") for k in range(300, 340)], *talk(2, range(400, 420), 1)]
    odd = spark.createDataFrame(rows, TURNS)
    for c in ("depth", "order", "place", "row", "digest", "base", "h", "_range", "a", "pa", "x", "root", "n_convs"):
        odd = odd.withColumn(c, F.lit("mine"))
    check(odd)
    assert trie(odd.limit(0)) == []


def test_a_hot_conversation_and_a_hot_first_turn_go_over_ranges(spark):
    """A conversation with most of the rows, its equal turns too, and a hundred that begin alike and end alike."""
    rows = [(100, k // 3, "user", f"t{k % 7}") for k in range(150)]
    rows += [(200, 0, "user", "hello")] + [(c, 0, "user", "hello") for c in range(1001, 1100)] + [(c, 0, "user", f"u{c}") for c in range(1600, 1650)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark.createDataFrame(rows, TURNS), finish=1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("finish", [20, 10_000])
def test_list_ranking(spark, finish):
    rng = random.Random(finish)
    ids = rng.sample(range(10**12), 700)
    ends = {399, 400, 699}  # three lists, one of them a single element
    items = [(i, None if k in ends else ids[k + 1], rng.randrange(-5, 50), rng.randrange(3)) for k, i in enumerate(ids)]
    got = {r["id"]: (r["w"], r["v"]) for r in prefix_sums(spark.createDataFrame(items, "id long, next long, w long, v long"), ["w", "v"], finish).collect()}
    want, sums = {}, (0, 0)
    for k, (i, _, w, v) in enumerate(items):
        want[i] = sums
        sums = (0, 0) if k in ends else (sums[0] + w, sums[1] + v)
    assert [(i, got.get(i), w) for i, w in want.items() if got.get(i) != w][:3] == [] and len(got) == len(want)


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(t, "PIECE", 3)
    ends = spark.createDataFrame([(1, 2, 3, c) for c in range(50)] + [(0, 0, 0, 7)], "depth long, a long, b long, conv_id long")
    got = {r["depth"]: r["ends_sha256"] for r in t._digest_ends(ends).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest(), 0: hashlib.sha256(b"7").hexdigest()}
