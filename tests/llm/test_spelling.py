"""Spelling variants against comparing all pairs of words, and the filters on their own."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import spelling as s


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(n, times=10):
    """{word: n} -> {word: (n, n_near, form, form_n, root)}"""
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def variants(frame, **kw):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in s.group_variants(frame, **kw).collect()}


def vocabulary(seed, size, letters="abéz×", least=3, most=8):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))): int(10 ** rng.uniform(0, 5)) for _ in range(size)}


@pytest.mark.parametrize("most", [s.MAX_BLOCKS, 40])
def test_equal_to_brute_force_in_one_pass_and_in_many(spark, most):
    n = vocabulary(1, 900)
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    assert variants(frame, most=most) == brute(n)
    if most == 40:
        assert len(s.passes(s.shard_sizes(frame), most)) > 5


def test_chains_ties_and_words_alone(spark):
    n = {"aaaaaaa": 100_000, "aaaaaab": 1000, "aaaaabb": 10, "aaaabbb": 1, "zzzzzzz": 100, "zzzzzzy": 10, "zzzzzyz": 100, "lonelyword": 5,
         "aaaaaaaa": 100_000, "é" * 300: 20, "é" * 299: 2, "漢字漢字漢字漢": 30, "漢字漢字漢字": 3}
    frame = spark.createDataFrame([*n.items(), (None, 7)], "word string, n long")
    for c in ("a", "b", "root", "form", "n_near", "m", "x", "_at", "moved"):
        frame = frame.withColumn(c, F.lit("mine"))
    got = variants(frame)
    assert got == brute(n)
    assert got["aaaabbb"][4] == "aaaaaaa" and got["lonelyword"] == (5, 0, None, None, "lonelyword")
    assert variants(frame.limit(0)) == {}
    with pytest.raises(ValueError):
        s.group_variants(frame, times=1)


def test_words_given_twice_count_together(spark):
    frame = spark.createDataFrame([("abcdefg", 6), ("abcdefg", 14), ("abcdefh", 2)], "word string, n long")
    assert variants(frame) == brute({"abcdefg": 20, "abcdefh": 2})


def count(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: k for w, k in out.items() if len(w) >= 7 and k >= 2}


def test_counts_of_odd_documents(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Straße", "ÉCOLEÉCOLE", "naïveté", "hyphen-ated", "x", "Wörterbuch", "can't", "seven77seven", "×÷×÷×÷×", "ŁódźŁódź", "commonword"]
    docs = [(k if k % 7 else None, " ".join(rng.choice(words) for _ in range(60))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "w" * 50_000 + " " + "w" * 50_000), (504, "commonword " * 20_000), (504, "commonword")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(9))
    want = count(docs)
    assert {r["word"]: r["n"] for r in s.count_words(frame).collect()} == want and len(want) > 10
    monkeypatch.setattr(s, "MAX_COUNTED", 5)
    assert {r["word"]: r["n"] for r in s.count_words(frame).collect()} == want
    assert s.count_words(frame.limit(0)).count() == 0


def test_a_filter_holds_all_its_words_and_few_others():
    words = sorted({w for w in vocabulary(3, 30_000, "abcdefgh", 7, 10)})
    sizes = {n: -(-k * s.BITS // 64) for n, k in Counter(map(len, words)).items()}
    bloom = s.Filter(sizes, s.passes(sizes)[0])
    for n, at in s._by_length(words):
        h = s._mix(s._sum(s._codes([words[k] for k in at])))
        np.bitwise_or.at(bloom.bits[n], s._block(h, sizes[n]), s._mask(h))
        assert bloom.has(n, h).all()
    others = sorted({w.upper() for w in words})
    wrong = sum(bloom.has(n, s._mix(s._sum(s._codes([others[k] for k in at])))).sum() for n, at in s._by_length(others))
    assert wrong < len(others) / 500


def test_hashes_of_edits_are_those_of_the_strings():
    word = "wörterbuch"
    code, power = s._codes([word])[0], s._powers(len(word))
    terms = code * power
    for k in range(len(word)):
        gone = terms[:k].sum(dtype=np.uint64) + terms[k + 1:].sum(dtype=np.uint64) * s._UNBASE
        assert gone == s._sum(s._codes([word[:k] + word[k + 1:]]))[0]
