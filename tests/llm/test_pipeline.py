"""The pipeline against brute-force stages, and the registered queries against their oracle SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import toxicity
from larder.llm.oracle import ORACLE
from larder.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.fit(docs, toxicity.train_labels(spark.read.parquet(f"{SF}/labels.parquet"), "toxic"))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    rows = {i: r for i, r in rows.items() if scorer.score(toxicity.restored_words(r["text"], scorer.cost, {}), {}) < 0.5}
    roots = {c for _, c in brute.simhash_components({i: r["text"] for i, r in rows.items()}).values()}
    rows = {i: rows[i] for i in roots}
    rows = {i: r for i, r in rows.items() if not brute.contaminated(*brute.contamination(r["text"], bench)[:2])}
    sizes = {}
    for r in rows.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.space_words(r["text"]))
    target = brute.targets(sizes)
    mixed = [(i, r["text"], r["source"]) for i, r in rows.items() for _ in range(brute.copies(i, r["text"], r["source"], sizes, target))]
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=str)
    assert got == brute.shards(mixed)


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_neardup", "decontamination", "source_mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = ", ".join(sorted(got.columns))
    want = con.sql(f"select {columns} from ({ORACLE[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=str) == sorted(want, key=str)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def _folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_on_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls everywhere, blanks, repeats, a long text; only copies and the benchmark's passage go."""
    rows = [(k, f"text number {k} with words {k * k} and {k * 7}", None if k % 4 == 0 else f"s{k % 3}") for k in range(20)]
    rows += [(None, "no id here", "s1"), (None, None, None), (50, None, "s1"), (51, "", "s2"), (52, " \t", None), (53, "say one two three", "s1"),
             (54, "w " * 30_000, "s1"), (3, rows[3][1], "s0"), (3, rows[3][1], "s0"), (60, rows[5][1], "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("lang", "sharding", "mix", "contamination", "llm_toxicity", "llm_text", "fp", "component_id", "_llm_text", "score"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = corpus_pipeline.run(spark, _folder(spark, tmp_path, docs)).collect()
    ids = {r["doc_id"] for r in got}
    # 50, 51 and 52 have no words and fingerprint zero: one component, named by 50, whose size of 0 words the mix doesn't limit.
    assert ids - {50} >= set(range(20)) and not ids & {51, 52, 53, 60}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.run(spark, _folder(spark, tmp_path, docs))
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() == 0
