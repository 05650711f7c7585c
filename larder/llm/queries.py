"""The registered queries of the operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from larder.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of equal row counts, each a like mixture of sources."""
    from larder.llm.sharding import shard_rows
    d = shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return d.select("doc_id", "sharding.size", "sharding.text_crc32", F.lit("rows").alias("law"), "sharding.shard",
                    "sharding.slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark every document holds, and whether that makes it contaminated."""
    from larder.llm.decontaminate import find_contamination, is_contaminated
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = find_contamination(docs, table(spark, sf_dir, "benchmark"), window=13)
    items = F.sha2(F.array_join(F.array_sort("contamination.hit_items"), ","), 256)
    return d.select("doc_id", "contamination.n_words", "contamination.n_hit",
                    F.size("contamination.hit_items").cast("long").alias("n_items"), items.alias("items_sha256"),
                    is_contaminated().alias("contaminated"))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    from larder.llm.mixing import plan_mix
    d = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the rows that are not held out."""
    from larder.llm import toxicity as t
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = t.fit(docs, t.train_labels(table(spark, sf_dir, "labels"), "toxic"))
    return t.toxicity_scores(docs, scorer, "score").select(
        "doc_id", t.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the rows that are not held out."""
    from larder.llm import quality as q
    from larder.llm.toxicity import held_out, train_labels
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = q.fit(docs, train_labels(table(spark, sf_dir, "labels"), "quality"))
    return q.quality_scores(docs, network, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a repeated window of 50 words covers."""
    from larder.llm.substring import dedup_substrings
    return dedup_substrings(table(spark, sf_dir, "documents"), window=50, block=25)


@query
def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    from larder.llm.embeddings import link_vectors
    return link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    from larder.llm.chat import format_digests
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*probe.columns)
    return format_digests(rows.unionByName(probe))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a labeller trained on a sample of them."""
    from larder.llm import html
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text that they decode to, as digests."""
    import public_tokenizers

    from larder.llm import pieces
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    ids = pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return pieces.decode_ids(ids, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations, each rebuilt on the head of a common one."""
    from larder.llm import prefix_trie as t
    turns = t.conversation_turns(table(spark, sf_dir, "conversations"))
    return t.prefix_trie(*t.shared_heads(turns, every=100, most=6)).drop("enter", "leave")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, usual forms and roots."""
    from larder.llm import spelling
    words = spelling.count_words(table(spark, sf_dir, "documents"), drop=31, length=7, least=2)
    return spelling.group_variants(words, times=10).select("word", "form", "root", "n", "n_near", "form_n")
