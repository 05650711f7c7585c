"""The lattice against enumerating all readings, and the sieve against decoding everything."""

import random

import pytest
from pyspark.sql import functions as F

from larder.llm import toxicity as t

SF = "/root/testdata/sf0.01"
DISGUISED = ["1d1ot", "i.d.i.o.t", "idiiiiot", "you l 0 s e r now", "m-o-r-o-n", "$tupid", "IDIOT!!", "stuupiid", "iiddiioott", "10$3!r", "(lown", "|oser",
             "up,idiot", "idiot,loser", "stupid/idiot", "idiot...you", "a s t u p i d", "s t u p i d i d i o t", "id iot", "stu pid you", "i d ! o t", "!d!iot",
             "s(tup!d", "s+u+p!d", "l!o!s!e!r", "i!!!d!!!i!!!o!!!t", "t r a s h", "w0rthl355", "ｉｄｉｏｔ", "lóser", "p4+h371c", "tr@$h", "(sc(um)", "£oser", "mo  r  on",
             "idi", "ot", "xidiotx", "an idiom", "", " ", "!!!", "(1) + (2) = $3", "$5! (a) |b| @c", "loose losers", "réeuxer réeux" * 9]


@pytest.fixture(scope="module")
def scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return t.fit(docs, t.train_labels(spark.read.parquet(f"{SF}/labels.parquet"), "toxic"))


def all_readings(token, cost, gap):
    """(cost, reading) of every path through a token's lattice."""
    paths = [(0.0, 0, 0, "")]
    for i in range(len(token)):
        paths = [(c + price + (cost[a][b][k := t._char_class(emit)] if emit else 0), b if emit else a, k if emit else b, said + emit)
                 for c, a, b, said in paths for emit, price in t._options(token, i, gap)]
    return [(c + cost[a][b][0], said) for c, a, b, said in paths]


def test_decoding_finds_the_likeliest_of_all_readings(scorer):
    rng = random.Random(5)
    tokens = ["1d10t", "i-d!t", "l0o$e", "aa..b", "!l|1(", "i d i", "a\nb c", "+o0p$"] + ["".join(rng.choice("ilo013!.-s$e (") for _ in range(5)) for _ in range(60)]
    for token in tokens:
        for gap in (1.0, -2.0):
            found = all_readings(token, scorer.cost, gap)
            least = min(c for c, _ in found)
            assert t.decode(token, scorer.cost, gap) in {said for c, said in found if c < least + 1e-9}, token


def weights():
    words = ["idiot", "loser", "stupid", "moron", "clown", "trash", "scum", "worthless", "pathetic", "it's", "b00k"]
    return {**{w: 3.0 + k / 7 for k, w in enumerate(words)}, "idio*2": 1.0, "stup*%": 2.0, "réeu*%": 1.5, "réeux*3": 0.5, "lose*%": 0.7}


def both(scorer, texts):
    sieve, memo, known = scorer.sieve(), {}, {}
    for x in texts:
        plain = scorer.score(t.restored_words(x, scorer.cost, {}), {})
        assert scorer.score_text(x, sieve, memo, known) == plain, x
        yield plain


def test_the_sieve_changes_no_score(spark, scorer):
    """On every disguise, on tokens made of all that a disguise may hold, and on whole documents."""
    own = t.Scorer(scorer.cost, weights(), -2.0)
    assert sum(x > 0.5 for x in both(own, DISGUISED)) > 20
    rng = random.Random(6)
    stems = ["idiot", "loser", "stup", "id", "ot", "réeuxa", "b00k", "clown"]
    made = []
    for _ in range(700):
        text = "".join(rng.choice([rng.choice(stems), rng.choice("1!|0$5@(+3£. -'i "), " ", "the "]) for _ in range(rng.randrange(3, 14)))
        made.append(text)
        made.append("".join(c + rng.choice(["", "", c, ".", " ", "!", "("]) for c in rng.choice(stems)) + " " + text)
    list(both(own, made))
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0").collect()]
    list(both(scorer, docs))
    list(both(t.Scorer(scorer.cost, scorer.weight | weights(), scorer.bias), docs))


def test_a_weighted_string_without_letters_or_with_marks_is_found(scorer):
    own = t.Scorer(scorer.cost, {"...": 5.0, "c(d": 4.0, "ab": 1.0}, -1.0)
    assert own.sieve().all
    list(both(own, DISGUISED + ["...", "c(d ab", "a b"]))
    assert list(both(t.Scorer(scorer.cost, {}, 0.25), ["x", "", None])) == [1 / (1 + 2.718281828459045 ** -0.25)] * 3


def test_rare_toxic_labels_are_learnt_end_to_end(spark):
    """Two in a hundred are toxic, and a word that half of the toxic and some of the others hold misleads."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randrange(3, 9))) for _ in range(500)]
    rows = []
    for k in range(1500):
        words = [rng.choice(vocabulary) for _ in range(40)]
        toxic = k % 50 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grubling", "snotface"])
        if k % 100 == 0 or k % 37 == 0:
            words.append("however")
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    s = t.fit(docs.select("doc_id", "text"), t.train_labels(docs, "label"))
    got = t.toxicity_scores(docs, s, "score").select("label", (F.col("score") >= 0.5).cast("int").alias("said")).collect()
    assert all(r["label"] == r["said"] for r in got)
