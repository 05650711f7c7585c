"""SentencePiece ids against the sentencepiece library and against plain merging, on odd texts and rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from larder.llm import pieces
from larder.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  gaps   three ", "a</s> [INST] <s> <0x41> <unk>", "▁ marks ▁▁ in the text", "tab\tline\r\n\x00end",
       "漢字かな 한국어 đ😀🏳️‍🌈 ﬁ Å", "x" * 5000, " " * 3000 + "a" + " " * 47, "ab" * 4000, "\U0010ffff￿ é"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


@pytest.fixture(scope="module")
def merges(model):
    return pieces.compile_merges(model)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def merged(text, model, merges):
    """Plain merging of the whole text: the cheapest pair, of equal ones the first, until none is left."""
    parts = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        cost = [(merges.made[merges.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in merges.ids]
        if not cost:
            break
        k = min(cost)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    out = []
    for t in parts:
        i = merges.ids.get(t, len(model.texts))
        out += [i] if i < len(model.texts) else [model.byte_ids[b] for b in t.encode()]
    return [*out, model.end_id]


def test_ids_equal_the_library_and_plain_merging(model, merges, library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("  abtheingsß▁é漢\t0<>/") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(model.texts[rng.randrange(259, 32000)].replace("▁", " ") for _ in range(6)) for _ in range(1500)]
    encoder, decoder = pieces.Encoder(model, merges), pieces.Decoder(model)
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t, add_eos=True), t[:80]
        assert decoder.decode(ids) == library.decode(ids)
        if len(t) < 200:
            assert ids == merged(t, model, merges), t


def test_any_ids_decode_as_the_library_does(model, library):
    rng, decoder = random.Random(4), pieces.Decoder(model)
    for _ in range(3000):
        ids = [rng.randrange(0, 300) if rng.random() < 0.6 else rng.randrange(32000) for _ in range(rng.randrange(12))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_each_prefix_has_its_own_encodings_last_token(model, merges, library):
    encoder = pieces.Encoder(model, merges)
    for chunk in ("▁internationalisation", "▁▁▁▁return", "▁" * 40, "Donaudampfschifffahrt"):
        for end, token in enumerate(encoder.last_tokens(chunk)):
            assert encoder._ids(chunk[:end + 1])[-1] == token
    assert encoder.pairs > 50


def test_full_memos_change_nothing(model, merges, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_CHUNKS", 3)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 3)
    encoder = pieces.Encoder(model, merges)
    for t in ODD:
        assert encoder.encode(t) == library.encode(t, add_eos=True)


def test_rows_nulls_repeats_and_clashing_names(spark, model, library):
    rows = [(1, None, "mine"), (2, "", "mine"), (3, "one two", None), (3, "one two", None), (None, "x", "y")] + [(10 + k, t, "z") for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, llm_ids string")
    docs = docs.withColumn("llm_text", F.lit("own")).withColumn("ids", F.lit("old")).withColumn("llm_said", F.lit(2))
    out = pieces.decode_ids(pieces.encode_texts(docs, model), model)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    got = sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in out.collect()), key=str)
    assert got == sorted(((i, t, library.encode(t or "", add_eos=True), library.decode(library.encode(t or ""))) for i, t, _ in rows), key=str)
    assert out.where("llm_text = 'own' and llm_said = 2").count() == len(rows)
    assert pieces.encode_texts(docs.limit(0), model).count() == 0
    empty = spark.createDataFrame([(None,), ([],), ([None, 5],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode_ids(empty, model).collect()] == ["", "", library.decode([5])]


def test_other_models_are_refused(tmp_path):
    (tmp_path / "unigram.model").write_bytes(b"\x0a\x05\x0a\x03abc")
    with pytest.raises(ValueError, match="not a BPE model"):
        pieces.read_model(str(tmp_path / "unigram.model"))


def test_query_equals_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_sentencepiece"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        assert got[r["doc_id"]] == (len(ids), *sha)
