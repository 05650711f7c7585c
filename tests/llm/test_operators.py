"""Each operator against a brute-force version, and on nulls, empties, repeats, long texts and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import chat, decontaminate, embeddings, html, mixing, quality, sharding, simhash, substring, toxicity
from larder.llm.components import components
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, equal texts, repeated rows."""
    long = prose(1, 6000)
    rows = [(1, prose(2, 200)), (2, prose(2, 200)), (3, None), (4, ""), (5, " \t\n "), (6, long), (6, long), (7, long + " tail"),
            (None, prose(3, 120)), (None, prose(2, 200)), (8, "One two"), (9, "one TWO"), (10, prose(4, 70) + " " + prose(2, 200)), (11, "é ü 漢字 x")]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, DOCS).cache()


def clash(df):
    """The same rows with columns called like the operators' own."""
    for c in ("mix", "sharding", "contamination", "score", "n_words", "n_hit", "row", "ord", "hits", "k_hash", "llm_size", "fp", "llm_score",
              "_llm_place", "_llm_one", "_llm_ahead", "_llm_rows", "_llm_id", "_llm_row", "_llm_kept", "_llm_key", "_llm_t", "_llm_s", "_llm_text",
              "_llm_keep", "llm_n", "llm_ahead", "llm_place", "llm_of_0", "llm_of_1", "llm_one", "llm_target", "llm_of", "llm_text", "llm_kept",
              "llm_row", "llm_cut", "llm_key", "llm_rows", "llm_id", "llm_order", "g", "n", "h", "found", "label", "component_id", "fingerprint"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    both = {frozenset(x) for x in links if None not in x}
    want = brute.components(sorted({x for p in links if None not in p for x in p}), lambda a, b: frozenset((a, b)) in both)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op 1
def test_shards_equal_brute_force(odd):
    d = sharding.shard_rows(clash(odd), shards=4)
    assert d.columns == [*odd.columns, *[c for c in clash(odd).columns if c not in odd.columns and c != "sharding"], "sharding"]
    got = sorted(((r["doc_id"], r["sharding"]["size"], r["sharding"]["text_crc32"], r["sharding"]["shard"], r["sharding"]["slot"])
                  for r in d.collect()), key=str)
    assert got == brute.shards([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], 4)


def test_shards_spread_a_hot_source(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"),
                                    F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    per = sharding.shard_rows(rows, shards=7).groupBy("sharding.shard").agg(
        F.count("*").alias("n"), F.sum((F.col("source") == "hot").cast("int")).alias("hot"), F.max("sharding.slot").alias("last")).collect()
    assert max(r["n"] for r in per) - min(r["n"] for r in per) <= 1 and all(r["last"] == r["n"] - 1 for r in per)
    assert all(abs(r["hot"] - r["n"] * 2 / 3) <= 8 for r in per)


# ---- op 2
def test_decoding_restores_disguises(spark):
    rows = spark.createDataFrame([(k, "the idiot was a loser and the moron said idiot stupid loser moron " * 3) for k in range(4)], "doc_id long, text string")
    cost = toxicity.log_model(toxicity.char_model(rows)).tolist()
    for seen in ("1d1ot", "i.d.i.o.t", "idiiiiot", "l0s3r", "m-o-r-o-n", "$tupid", "IDIOT!!"):
        assert toxicity.restore_token(toxicity.fold(seen), cost) in ("idiot", "loser", "moron", "stupid"), seen
    assert "loser" in toxicity.restored_words("you l 0 s e r now", cost, {})
    assert toxicity.restore_token("was", cost) == "was"


def test_toxicity_learns_and_handles_odd_rows(spark, odd):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        ws = prose(1000 + k, rng.randrange(20, 120)).split()
        if k % 4 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["zork", "blag", "z0rk", "bl4g"])
        rows.append((k, " ".join(ws), int(k % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    scorer = toxicity.fit(d.select("doc_id", "text"), d.where("doc_id < 200").select("doc_id", "label"))
    out = {r["doc_id"]: (r["s"], r["label"]) for r in toxicity.toxicity_scores(d, scorer, "s").collect()}
    right = [(s >= 0.5) == bool(y) for i, (s, y) in out.items() if i >= 200]
    assert np.mean(right) >= 0.95
    odd_out = toxicity.toxicity_scores(clash(odd), scorer, "score").collect()
    assert len(odd_out) == odd.count() and all(0 <= r["score"] <= 1 for r in odd_out)
    none = toxicity.fit(odd.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, label int"))
    assert all(r["score"] == pytest.approx(0.5) for r in toxicity.toxicity_scores(odd, none, "score").collect())
    assert toxicity.toxicity_scores(odd.limit(0), scorer).count() == 0


@pytest.fixture(scope="module")
def cost(spark):
    """A character model of sf0.001 and of plain prose with the words that are disguised below."""
    plain = ("you are an idiot and a loser, he is a clown. such a stupid moron! hello to the good people of all the books, "
             "she called off the meeting too soon and we will see them at school or at home. i was there to look for it. ") * 40
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").union(spark.createDataFrame([(plain,)] * 40, "text string"))
    return toxicity.log_model(toxicity.char_model(d)).tolist()


@pytest.mark.parametrize("seen, said", [
    ("up,idiot", "up idiot"), ("idiot,loser", "idiot loser"), ("stupid/idiot", "stupid idiot"), ("idiot-loser", "idiot loser"),
    ("idiot...you", "idiot you"), ("idiot…you", "idiot you"), ("idiot—moron", "idiot moron"), ("clown;loser", "clown loser"),
    ("i.d.i.o.t", "idiot"), ("mo-ron", "moron"), ("s_t_u_p_i_d", "stupid")])
def test_separators_part_words_or_letters(cost, seen, said):
    assert set(said.split()) <= toxicity.restored_words(f"well {seen} then", cost, {})


@pytest.mark.parametrize("seen, said", [
    ("stuupiid", "stupid"), ("idioot", "idiot"), ("iiddiioott", "idiot"), ("mmoorroonn", "moron"), ("10$3!", "lose"), ("(lown", "clown"),
    ("|oser", "loser"), ("!diot", "idiot"), ("l0$er!", "loser"), ("(idiot)", "idiot"), ("idiot|moron", "idiot moron"),
    ("stupid$$$", "stupid")])
def test_disguises_that_pass_for_plain(cost, seen, said):
    assert set(said.split()) <= toxicity.restored_words(f"well {seen} then", cost, {})


@pytest.mark.parametrize("seen, said", [
    ("a s t u p i d", "stupid"), ("i a m a s t u p i d", "stupid"), ("s t u p i d i d i o t", "stupid idiot"), ("s t u p i d  m o r o n", "stupid moron"),
    ("l 0 s e r", "loser"), ("id iot", "idiot"), ("lo ser", "loser"), ("then. well lo ser", "loser"), ("stu p id", "stupid"), ("i di ot", "idiot"), ("m o r o n", "moron"),
    ("  ".join(" ".join(w) for w in ["hello", "people", "school"] * 8 + ["stupid", "idiot"] * 3 + ["good", "books"] * 8), "stupid idiot"),
    (" ".join("you are an idiot and he is a clown such a stupid moron ".replace(" ", "") * 3), "idiot stupid moron")])
def test_spaced_out_words(cost, seen, said):
    assert set(said.split()) <= toxicity.restored_words(f"well, {seen}, then", cost, {})


def test_long_tokens_are_decoded_whole(cost):
    assert {"idiot", "moron"} <= toxicity.restored_words("-".join(["idiot", "moron"] * 40), cost, {})
    assert toxicity.decode("x.y." * 50_000, cost)


def test_plain_words_and_numbers_stay(cost):
    plain = "hello good books school off 455 $100 1,000.50 12:30 2024-05-01 see"
    assert set(plain.split()) <= toxicity.restored_words(plain.replace("see", "see!"), cost, {})
    assert toxicity.restored_words("in 1984 for 455 or $107", cost, {}).isdisjoint(("ass", "lot", "slot"))


def test_a_common_imprecise_word_does_not_end_the_fit():
    """1.5% label 1; 'half' stands in all of these and in as many others, each rare word in a few of them alone."""
    rows = [(1, [0, 1 + k % 3]) for k in range(30)] + [(0, [0])] * 30
    weight, _ = toxicity._logistic(rows, 30, 2000, ["half", "bad0", "bad1", "bad2"])
    assert set(weight) == {"bad0", "bad1", "bad2"}


# ---- op 3
def test_substrings_equal_brute_force(spark, odd):
    passage = prose(77, 63)
    extra = [(20, passage), (21, prose(78, 30) + " " + passage + " " + prose(79, 33)), (22, passage[3:] + " " + prose(80, 10)),
             (23, prose(81, 49)), (24, prose(81, 49)), (25, prose(82, 50)), (26, "x " + prose(82, 50)), (27, prose(1, 6000)[:9000]),
             (28, " ".join(["same"] * 130)), (29, " ".join(["same"] * 51))]
    d = odd.union(spark.createDataFrame([(i, t, None, None, None) for i, t in extra], DOCS))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(clash(d)).collect()}
    want = brute.repeated(texts(d))
    assert {k: v for k, v in got.items() if k is not None} == want
    assert substring.dedup_substrings(d).count() == d.count()
    cut = {r["doc_id"]: r["text"] for r in substring.cut_texts(d).where("doc_id is not null").collect()}
    for i, (_, removed, sha) in want.items():
        if removed:
            assert hashlib.sha256(cut[i].encode()).hexdigest() == sha
        else:
            assert cut[i] == texts(d)[i]
    assert substring.dedup_substrings(d.limit(0)).count() == 0


def test_a_passage_of_a_third_of_all_documents(spark):
    """Crowded hashes, at one place and at any, are settled in the packs and between them alike."""
    passage, rng = prose(90, 70), random.Random(9)
    rows = []
    for k in range(240):
        before = prose(2000 + k, (50, rng.randrange(60))[k % 2])
        rows.append((k * 7919 % 1009, {0: f"{before} {passage} {prose(3000 + k, 20)}", 1: prose(91, 90), 2: prose(4000 + k, 80)}[k % 3]))
    rows += [(2000 + k, passage + f" end{k}") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.repeated(dict(rows))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(d).collect()}
    assert got == want


def test_settled_hashes_are_what_the_whole_gives(spark):
    """Sent and known hashes of packs, put together, give the hits of all hashes at once."""
    rng = np.random.default_rng(4)
    h, o, m = rng.integers(0, 40, 4000).astype(np.uint64), rng.integers(-50, 300, 4000), rng.random(4000) < 0.1
    o = np.where(rng.random(4000) < 0.05, substring._NAMELESS + o, o)

    def hits(h, o, m, both):
        found = set()
        for x in np.unique(h):
            at = h == x
            named = o[at & m & (o < substring._NAMELESS)]
            for i, marked in zip(o[at], m[at] & (o[at] < substring._NAMELESS)):
                if (len(named) and i > named.min()) or (both and marked and i < o[at].max()):
                    found.add((int(x), int(i)))
        return found

    for both in (True, False):
        sent, known = [], set()
        for at in np.array_split(np.arange(4000), 7):
            s, k = substring._settle(h[at], o[at], m[at], both)
            sent.append(at[s])
            known |= set(zip(h[at][k].tolist(), o[at][k].tolist()))
        sent = np.concatenate(sent)
        assert len(sent) < 4000 and known
        assert hits(h[sent], o[sent], m[sent], both) | known == hits(h, o, m, both)


def test_null_ids_lose_what_named_documents_hold_and_remove_nothing(spark):
    d = spark.createDataFrame([(None, prose(1, 80)), (None, prose(2, 80)), (3, prose(1, 80)), (None, prose(2, 80))], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring.dedup_substrings(d).collect())
    assert got == [(-1, 0), (-1, 0), (-1, 80), (3, 0)]


# ---- op 4
def test_simhash_equals_brute_force(spark, odd):
    base = prose(50, 300).split()
    near = []
    for k in range(12):
        ws = list(base)
        ws[k * 7] = f"other{k}"
        near.append((100 + k, " ".join(ws), None, None, None))
    d = odd.where("doc_id is not null").union(spark.createDataFrame(near, DOCS))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(clash(d)).collect()}
    assert got == brute.simhash_components(texts(d))


def test_covering_finds_every_pair_and_hot_buckets_agree(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(rng.randrange(1, 5)):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = dict(enumerate(sorted(fps)))
    reps = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "id long, fp long")
    want = brute.components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    for bucket in (4096, 1):
        got = {r["node"]: r["root"] for r in components(simhash.near_links(reps, 3, bucket)).collect()}
        assert got == {k: v for k, v in want.items() if k != v}


def test_keep_one_keeps_each_group_and_rows_without_id(odd):
    kept = simhash.keep_one(clash(odd))
    want = brute.simhash_components(texts(odd))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()})
    assert ids.count(None) == 2 and kept.columns == clash(odd).columns
    assert simhash.keep_one(odd.limit(0)).count() == 0


# ---- op 5
@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_contamination_equals_brute_force(spark, odd, block_words):
    items = [(1, prose(2, 40)), (2, prose(4, 14)), (None, prose(1, 30)), (4, "one two"), (5, None), (6, ""), (7, "!!"), (1, prose(2, 40)), (8, prose(999, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(clash(odd), bench, block_words=block_words)
    for r in got.collect():
        n, hit, found = brute.contamination(r["text"], items)
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], sorted(c["hit_items"])) == (n, hit, found), r["doc_id"]
        assert (c["longest_match"] > 0) == (hit > 0)
    kept = decontaminate.decontaminate(clash(odd), bench)
    want = [r["doc_id"] for r in odd.collect() if not brute.contaminated(*brute.contamination(r["text"], items)[:2])]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want)) and kept.columns == clash(odd).columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, empty).count() == odd.count()
    assert decontaminate.decontaminate(odd.limit(0), bench).count() == 0


def test_longest_match_and_its_place():
    q = decontaminate.suffixes([("a", prose(5, 30).encode())], 13)
    ws = prose(5, 30).split()
    doc = " ".join(["x", "y", *ws[4:24], "z"]).encode()
    ids = np.array([q.vocab.get(w, 0) for w in decontaminate.words_of(doc)])
    hits = decontaminate.match_shard([ids], q)
    assert (hits.longest[0], hits.longest_at[0], hits.spans[0]) == (20, 2, [2, 22])


# ---- op 6
def test_blocks():
    page = ("<!doctype html><head><title>T</title><style>p{}</style><script>if (a<b) '</p>'</script></head><body><!-- <p>no</p> -->"
            "<article><h1>A &amp;\n b</h1><p>one <b>two</b>&nbsp;three<br>four<p>five<ul><li>six<li>seven</ul></article><footer>&copy; x</footer><p class=\"cut")
    assert [(b.text, b.path[-1]) for b in html.blocks(page)] == [
        ("T", "title"), ("A & b", "h1"), ("one two three four", "p"), ("five", "p"), ("six", "li"), ("seven", "li"), ("© x", "footer")]
    assert html.blocks(None) == html.blocks("") == html.blocks("<p> </p>") == []


def _page(k, rng):
    main = [prose(10 * k + j, rng.randrange(3, 40)) + "." for j in range(rng.randrange(1, 8))]
    page = (f"<html><head><title>{main[0]}</title></head><body><nav><ul><li><a href=/a>{prose(k + 7000, 2)}</a></li></ul></nav>"
            f"<div class=\"ad\">{prose(k + 8000, 6)}</div><article><h1>{main[0]}</h1>" + "".join(f"<p>{p}</p>" for p in main)
            + f"</article><footer>&copy; {prose(k + 9000, 4)}</footer></body></html>")
    return page, "\n".join([main[0], *main])


def test_extraction(spark):
    rng = random.Random(2)
    made = [_page(k, rng) for k in range(90)]
    rows = [(k, f"u{k}", p, "mine") for k, (p, _) in enumerate(made)] + [(200, None, None, None), (201, "u", "", "mine"), (202, "u", "<nav>x</nav>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    labeller = html.fit(pages.where("page_id < 60"), sample_pages=60)
    got = {r["page_id"]: r["text"] for r in html.extract(pages, labeller).collect()}
    assert np.mean([got[k] == t for k, (_, t) in enumerate(made) if k >= 60]) >= 0.9
    assert got[200] == got[201] == got[202] == ""
    long = "<body><article>" + "<p>said so.</p>" * 3000 + "</article></body>"
    whole = html.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string"), labeller).first()
    assert whole["text"].count("said so.") == 3000
    assert html.fit(pages.limit(0)) is None and html.extract(pages.limit(0), None).count() == 0
    assert {r["text"] for r in html.extract(pages, None).collect()} == {""}


# ---- op 7
def test_mix_equals_brute_force(odd):
    rows = odd.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.space_words(r["text"]))
    want = brute.targets(sizes)
    for r in mixing.plan_mix(clash(odd)).collect():
        m = r["mix"]
        assert (m["source_size"], m["target"]) == (sizes[r["source"]], pytest.approx(want[r["source"]]))
        assert m["copies"] == brute.copies(r["doc_id"], r["text"], r["source"], sizes, want) and m["copies"] <= 3
        assert m["taken"] == m["size"] * m["copies"]
    mixed = mixing.mix_sources(clash(odd))
    assert mixed.columns == clash(odd).columns
    assert mixed.count() == sum(r["mix"]["copies"] for r in mixing.plan_mix(odd).collect())
    assert mixing.plan_mix(odd.limit(0)).count() == 0


def test_targets_share_all_and_stop_at_the_cap(spark):
    rng = random.Random(9)
    for _ in range(3):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 400, 90_000]) for k in range(11)} | {None: 77}
        got = {r["source"]: r["target"] for r in mixing.source_targets(
            spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == {k: pytest.approx(v) for k, v in brute.targets(sizes).items()}
        assert sum(got.values()) == pytest.approx(sum(sizes.values())) and all(got[s] <= 3 * sizes[s] + 1e-6 for s in sizes)


# ---- op 8
@pytest.mark.parametrize("bucket", [2048, 8])
def test_vectors_against_brute_force(spark, bucket):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(40):
        v = rng.normal(size=32)
        for _ in range(rng.integers(1, 6)):
            rows.append((k, (v + rng.normal(size=32) * 0.12).tolist(), int(k % 2 == 0)))
            k += 1
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, rows[0][1], None), (903, None, 1), (904, [0.0] * 32, 1),
             (905, [float("nan")] + [1.0] * 31, 1), (906, [None] + [1.0] * 31, 1), (907, [1.0] * 5, 1), (908, [2.0] * 5, 1), (909, [], 1),
             (910, [float("inf")] + [1.0] * 31, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("mine"))
    got = {r["vec_id"]: r for r in embeddings.link_vectors(d, bucket=bucket).collect()}
    good = {i: (np.array(e), y) for i, e, y in rows if y is not None and e and None not in e and np.isfinite(e).all() and any(e)}

    def linked(a, b):
        (x, p), (y, q) = good[a], good[b]
        return p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    n = {a: sum(linked(a, b) for b in good if b != a) for a in good}
    assert sum(got[a]["n_links"] for a in good) >= 0.9 * sum(n.values()) and all(got[a]["n_links"] <= n[a] for a in good)
    assert got[900]["component_id"] == got[0]["component_id"] and got[908]["component_id"] == 907
    for i in (902, 903, 904, 905, 906, 909, 910):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.link_vectors(d.limit(0)).count() == 0


# ---- op 9
def test_templates():
    def says(t, messages=(), **known):
        return "".join(x for x, _ in chat.compile_template(t, **known)(messages))
    m = [{"role": "user", "text": "hi"}, {"role": "x", "text": None}]
    assert says("{% for m in messages %}{{ m.role | upper }}:{{ m.text }};{% endfor %}", m) == "USER:hi;X:;"
    assert says("{% if a == 'b' + 'c' and not d %}1{% elif e %}2{% else %}3{% endif %}", a="bc", d=False, e=True) == "1"
    assert [p for p in chat.compile_template("a{% generation %}b{% endgeneration %}c")([])] == [("a", False), ("b", True), ("c", False)]
    assert chat.fold_nodes(chat.parse("{{ a + 'x' }}y{% if false %}no{% endif %}"), {"a": 1}) == [chat.Out(chat.Const("1xy"))]
    for bad in ("{% for x %}", "{{ a.__class__ }}", "{{ open('x') }}", "{{ 1 +}}", "{% if a %}", "{{ a | eval }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice([*chat.CONTROL, "\\", "\n", "n", "<", ">", "/", "s", "]", "é"]) for _ in range(rng.randrange(9)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)


def test_conversations_round_trip(spark):
    rows = [(1, 0, "system", "be\nkind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>\\[INST] ok"), (1, 2, "assistant", None),
            (2, 0, None, "x"), (2, None, "tool", "<|role|>assistant\nno"), (3, 0, "user", "a " * 40_000), (None, 0, "assistant", ""), (1, 2, "assistant", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_digests(d).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    pieces = chat.format_pieces(d).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r["conv_id"]: r["n"] for r in pieces} == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.format_digests(d.limit(0)).count() == 0


# ---- op 10
def test_quality_learns_from_positives_and_unlabelled(spark, odd):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        good = k % 5 > 0
        ws = [rng.choice("river stone walk light under over green the and of to".split()) for _ in range(rng.randrange(10, 90))]
        rows.append((k, " ".join(ws) + "." if good else " ".join(w.upper() + "$$$" for w in ws), int(good)))
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    net = quality.fit(d.select("doc_id", "text"), d.where("doc_id < 250").select("doc_id", "label"))
    out = quality.quality_scores(d, net, "s").where("doc_id >= 250").collect()
    assert np.mean([(r["s"] >= 0.3) == bool(r["label"]) for r in out]) >= 0.95
    got = quality.quality_scores(clash(odd), net, "score").collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    empty = spark.createDataFrame([], "doc_id long, label int")
    assert quality.fit(odd.select("doc_id", "text"), empty) == 0.5
    assert quality.quality_scores(odd.limit(0), net).count() == 0


# ---- shared helpers, names and samples
def test_columns_of_the_operators_own_names_pass_through(odd):
    """Filters, cuts and mixes leave every other column as it is, whatever it is called."""
    docs = clash(odd)
    extra = [c for c in docs.columns if c not in odd.columns]
    bench = odd.sparkSession.createDataFrame([(1, prose(2, 200))], "item_id long, text string")
    for out in (simhash.keep_one(docs), substring.cut_texts(docs), mixing.mix_sources(docs), decontaminate.decontaminate(docs, bench)):
        assert out.columns == docs.columns
        assert 0 < out.count() == out.where(" and ".join(f"`{c}` = 'mine'" for c in extra)).count()
    plain = decontaminate.decontaminate(odd, bench)
    assert sorted(str(r["doc_id"]) for r in decontaminate.decontaminate(docs, bench).collect()) == sorted(str(r["doc_id"]) for r in plain.collect())


@pytest.mark.parametrize("partitions", [1, 60])
def test_first_by_hash_is_the_sorted_head_of_the_distinct_rows(spark, partitions):
    from larder.llm.common import first_by_hash
    rows = spark.range(3000).select((F.col("id") % 900).alias("x"), (F.col("id") % 900 % 7).cast("string").alias("y")).repartition(partitions)
    order = F.xxhash64("x", "y")
    for n in (1, 40, 500, 5000):
        want = [tuple(r) for r in rows.distinct().orderBy(order, "x", "y").limit(n).collect()]
        assert [tuple(r) for r in first_by_hash(rows, order, n, "t").collect()] == want
    assert first_by_hash(rows.limit(0), order, 5, "t").count() == 0
    same = spark.range(500).select(F.lit(1).alias("x"))
    assert first_by_hash(same, F.xxhash64("x"), 10, "t").count() == 1


def test_training_pages_are_distinct_and_read_to_the_end(spark, monkeypatch):
    """Thousands of equal pages count once; the windows of a long page hold its first and last blocks."""
    seen = []
    monkeypatch.setattr(html, "train", lambda pages, labels, seed=6: seen.append(pages))
    body = "<html><body><div class='post'>" + "".join(f"<p>word {k}</p>" for k in range(1000)) + "</div><div class='tail'>end</div></body></html>"
    rows = [("<p>same</p>",)] * 2000 + [(f"<div>{k}</div>",) for k in range(30)] + [(body,), (None,), ("",)]
    html.fit(spark.createDataFrame(rows, "html string"), sample_pages=40)
    texts = [[b.text for b in p] for p in seen[0]]
    assert sum(t == ["same"] for t in texts) == 1 and sum(t == ["3"] for t in texts) == 1
    assert any(t and t[0] == "word 0" for t in texts) and any(t and t[-1] == "end" for t in texts)
    assert max(map(len, texts)) <= 2 * html.TRAIN_BLOCKS


def test_a_page_with_a_named_article_has_no_main_text_outside_it(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html, "train", lambda pages, labels, seed=6: seen.append((pages, labels)))
    html.fit(spark.createDataFrame([("<div class='post'><p>in</p></div><div><p>out</p></div>",)], "html string"))
    first = {b.text: bool(y) for b, y in zip(seen[0][0][0], seen[0][1][0])}
    assert first == {"in": True, "out": False}


def test_recall_of_vectors_by_band():
    """The share of pairs that meet in a table, by cosine, where nothing helps: vectors uniform on the sphere, a rotation
    learnt on others. The README states these figures; tables with structure do better."""
    rng = np.random.default_rng(3)
    for dims in (64, 384):
        base = rng.normal(size=(3000, dims))
        base /= np.linalg.norm(base, axis=1)[:, None]
        r = embeddings.learn_rotation(base[:2000])
        for low, least in ((0.93, 0.85), (0.94, 0.88), (0.95, 0.92), (0.96, 0.95), (0.97, 0.97), (0.98, 0.99)):
            c = rng.uniform(low, low + 0.01, 6000)
            x = rng.normal(size=(6000, dims))
            x /= np.linalg.norm(x, axis=1)[:, None]
            z = rng.normal(size=x.shape)
            z -= (z * x).sum(axis=1)[:, None] * x
            z /= np.linalg.norm(z, axis=1)[:, None]
            y = c[:, None] * x + np.sqrt(1 - c * c)[:, None] * z
            a, b = ((v @ r >= 0).reshape(len(x), embeddings.PARTS, -1) for v in (x, y))
            met = (a == b).all(axis=2).sum(axis=1) >= embeddings.PARTS_OF_KEY
            assert met.mean() >= least, (dims, low, met.mean())
