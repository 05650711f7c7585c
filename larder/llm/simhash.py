"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a non-zero vector m(i) of r + 1 bits. For each
non-zero v there is a table that keys a fingerprint by its bits with
<m(i), v> = 1. The vectors of up to r differing bits leave some v orthogonal to
them all, so two fingerprints at most r bits apart agree in that table's key:
2^(r+1) - 1 tables find every link, none is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import as_bytes, fresh, materialise, tasks
from larder.llm.components import components
from larder.llm.runs import forest, pairs, whole_runs

SEED = 42
#: Fingerprints in a bucket before it is keyed again on its free bits.
BUCKET = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 of all word shingles, as a signed long."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        n = len(words) - shingle + 1
    else:
        grams, n = iter([b" ".join(words)]), 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = h[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, shingle) for t in as_bytes(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """One mask over the bit positions `bits` for each table, as signed longs."""
    n = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << b for k, b in enumerate(bits) if ((k % n + 1) & v).bit_count() % 2)
        masks.append(m)
    return masks


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _keys(fp: Column, masks: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k"))
                               for t, m in masks]))


def near_links(reps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """`reps(id, fp)` with distinct fp -> links (a, b) that join all within `radius` bits.

    Each bucket gives a spanning forest of its links, at most a row per member.
    A bucket of more than `bucket` members is keyed once more by a covering of
    the bits its key leaves free. For radius 3 that leaves 14 free bits, so it
    then holds 2^14 distinct fingerprints at most, whatever the input.
    """
    first = list(enumerate(covering_masks(list(range(64)), radius)))
    n = len(first)
    keyed = reps.select("id", "fp", _keys(F.col("fp"), first).alias("x")).select("id", "fp", "x.t", "x.k")
    hot = keyed.groupBy("t", "k").count().where(F.col("count") > bucket).select("t", "k")
    hot = materialise(hot, "hot")
    if hot.isEmpty():
        all_keys = keyed
    else:
        again = []
        for t, m in first:
            free = [b for b in range(64) if not m >> b & 1]
            again.append([(n + t * n + u, m | x) for u, x in enumerate(covering_masks(free, radius))])
        flagged = keyed.join(hot.withColumn("h", F.lit(True)), ["t", "k"], "left")
        cold = flagged.where("h is null").select("id", "fp", "t", "k")
        per_table = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in row])
                              for row in again])
        warm = (flagged.where("h").select("id", "fp", F.explode(F.get(per_table, F.col("t"))).alias("x"))
                .select("id", "fp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("k")))
        all_keys = cold.unionByName(warm)
    dealt = (all_keys.repartition(tasks(reps.sparkSession), "t", "k").sortWithinPartitions("t", "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(batches, ["t", "k"]):
            fp, ids = t.column("fp").to_numpy().view(np.uint64), t.column("id").to_numpy()
            found = list(pairs(runs, lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= radius))
            root = ids[forest(len(ids), found, ids)]
            far = root != ids
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of `docs(doc_id, text)`.

    Equal fingerprints are one vertex, named by its smallest doc_id, so copies
    are never paired. Null and empty texts have fingerprint zero and link like
    any other. A null doc_id takes the component of its fingerprint and names
    none (null if only null ids have it). Rows with the same doc_id each count.
    An empty table gives an empty result; other columns are not read.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null")
    links = near_links(reps, radius)
    roots = components(links)
    named = (reps.join(roots, reps.id == roots.node, "left")
             .select("fp", F.coalesce("root", "id").alias("component_id")))
    named = materialise(named, "named")  # so that the next join stands alone and AQE can split a hot fingerprint
    return (fps.join(named, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """`docs` with one document of each component: the one that names it.

    Rows without a doc_id cannot be named and stay. Of rows that repeat the
    naming doc_id one stays. Columns are unchanged, whatever they are called.
    """
    found = simhash_components(docs.select("doc_id", "text"), shingle, radius)
    rows, own = fresh(["llm_rows", "llm_id"], docs.columns)
    named = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(rows))
    kept = docs.join(named, F.col("doc_id") == F.col(own))
    one = kept.where(F.col(rows) == 1)
    more = kept.where(F.col(rows) > 1).dropDuplicates(["doc_id"])
    return one.unionByName(more).select(*docs.columns).unionByName(docs.where("doc_id is null"))
