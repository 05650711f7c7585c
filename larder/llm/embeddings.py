"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a sample so that the signs of rotated vectors are
balanced binary codes close to the vectors. Tables key a code by parts of its
bits; vectors of one label that agree in a table's key are compared by cosine
in double precision. A pair counts only in the first table that finds it, so
links can be counted where they are found, and no pair leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import first_by_hash, materialise, tasks
from larder.llm.components import components
from larder.llm.runs import forest, pairs, whole_runs

#: Vectors that the rotation is learnt from.
SAMPLE = 8_192
#: Bits of a code, parts that it is cut into, and parts that make up a table's key.
BITS, PARTS, PARTS_OF_KEY = 64, 8, 2
#: Vectors of a bucket that are compared in one task; a larger bucket is cut into chunks, compared pair by pair.
BUCKET = 2_048
_NAMELESS = 1 << 62  # ids are below this


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 8) -> np.ndarray:
    """ITQ: principal directions, then alternately the signs and the rotation nearest to them.

    Where there are fewer directions than bits, the rotation has more columns
    than rows (random orthonormal blocks, each refined alike).
    """
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
    top = vectors[:, np.argsort(-values)]
    blocks = []
    for at in range(0, bits, d):
        k = min(d, bits - at)
        p = top[:, :k]
        v = x @ p
        r = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        blocks.append(p @ r)
    return np.hstack(blocks)


def _unit(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of a list column whose lists are all as long, and which have a length."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None], n > 0


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, e) of the vectors that can link: a label, and finite components that aren't all 0."""
    e = F.col("embedding").cast("array<double>")
    ok = (F.col("label").isNotNull() & e.isNotNull()
          & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
          & F.exists(e, lambda v: v != 0))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("e"))


def link_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, parts: int = PARTS,
                 parts_of_key: int = PARTS_OF_KEY, bucket: int = BUCKET) -> DataFrame:
    """One row per row of `vectors(vec_id, embedding, label)`: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their cosine in
    double precision is at least `threshold`, and the codes meet in a table;
    vectors with equal components always link. A vector that is null, all zero
    or holds a null or non-finite component links with nothing, nor do vectors
    of unequal lengths. A null vec_id links but names no component. Rows that
    repeat are vectors each. An empty table gives an empty result; other
    columns are not read. The rotation is learnt on the `sample` vectors first
    by a hash; every vector is indexed, compared and reranked in full.

    `parts_of_key` parts of the code agree exactly for a pair to meet: 28
    tables of 16-bit keys by default. For more vectors per label than about
    2^16 buckets hold well, raise `parts_of_key`.
    """
    valid = _valid(vectors).withColumn("label", F.col("label").cast("string")).withColumn("dims", F.size("e"))
    # Equal vectors are one vertex, named by the smallest id, counted as often as they occur.
    ids = materialise(valid.select("vec_id", F.xxhash64("label", "dims", "e").alias("h1"), F.sha2(F.to_json(F.struct("label", "e")), 256).alias("h2")), "vec_ids")
    distinct = (valid.withColumn("h1", F.xxhash64("label", "dims", "e")).withColumn("h2", F.sha2(F.to_json(F.struct("label", "e")), 256))
                .groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"),
                                         F.first("dims").alias("dims"), F.first("e").alias("e")))
    # Vectors of which no row has an id get a number above all ids, so it names a component only of such.
    nameless = F.lit(_NAMELESS) + F.shiftrightunsigned("h1", 3)
    reps = materialise(distinct.withColumn("id", F.coalesce("id", nameless)), "vec_reps")
    found = materialise(_links(reps, threshold, sample, parts, parts_of_key, bucket), "vec_links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.select("a", "b").where("b is not null"))
    per_rep = (reps.join(counts, reps.id == counts.a, "left").join(roots, F.col("id") == F.col("node"), "left")
               .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
                       F.coalesce("root", "id").alias("component_id")))
    per_rep = materialise(per_rep, "vec_named")
    linked = (ids.join(per_rep, ["h1", "h2"], "left")
              .select("vec_id", "n_links", F.when(F.col("component_id") < _NAMELESS, F.col("component_id")).alias("component_id")))
    alone = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
             .where(~_is_valid())
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _is_valid() -> F.Column:
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda v: v != 0), F.lit(False))


def _links(reps: DataFrame, threshold: float, sample: int, parts: int, parts_of_key: int, bucket: int) -> DataFrame:
    """(a, n, b): per rep and table its number of links there, and a link of a spanning forest (null: none)."""
    spark = reps.sparkSession
    width = BITS // parts
    tables = list(combinations(range(parts), parts_of_key))
    part_mask = [((1 << width) - 1) << (width * k) for k in range(parts)]
    masks = np.array([sum(part_mask[k] for k in t) for t in tables], dtype=np.uint64)
    # Bounded: at most `sample` vectors, those first by a hash.
    drawn = first_by_hash(reps.select("id", "h1", "e"), F.xxhash64("h1", "id"), sample, "vec_sample").select("e").collect()
    by_dims: dict[int, list] = {}
    for r in drawn:
        by_dims.setdefault(len(r["e"]), []).append(r["e"])
    rotations = {}
    for dims, rows in by_dims.items():
        x = np.array(rows)
        rotations[dims] = learn_rotation(x / np.linalg.norm(x, axis=1)[:, None])
    shared = spark.sparkContext.broadcast(rotations)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            code = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, _ = _unit(b.column("e").take(pa.array(at)))
                r = shared.value.get(int(d))
                r = r if r is not None else learn_rotation(np.eye(int(d)))
                code[at] = np.packbits(x @ r >= 0, axis=1).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "copies", "label", "dims", "e")], pa.array(code)],
                                             names=["id", "copies", "label", "dims", "e", "code"])

    coded = reps.select("id", "copies", "label", "dims", "e").mapInArrow(
        encode, "id long, copies long, label string, dims int, e array<double>, code long")
    signed = [int(m) - (1 << 64) if int(m) >= 1 << 63 else int(m) for m in masks]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(t), "label", "dims", F.col("code").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)]))
    coded = materialise(coded, "vec_codes")
    hot = (coded.select(keys.alias("k")).groupBy("k").count().where(F.col("count") > bucket)
           .select("k", F.ceil(F.col("count") / (bucket // 2)).cast("int").alias("chunks")))
    hot = materialise(hot, "vec_hot")
    keyed = coded.select("id", "copies", "label", "e", "code", F.posexplode(F.array(*[
        F.xxhash64(F.lit(t), "label", "dims", F.col("code").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])).alias("t", "k"))
    # A hot bucket of c chunks becomes c * (c + 1) / 2 cells, each of two chunks at most.
    c, own = F.coalesce("chunks", F.lit(1)), F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int")
    cells = F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.shiftleft(F.least(own, j).cast("long"), 32) + F.greatest(own, j))
    dealt = (keyed.join(hot, "k", "left").withColumn("own", own).withColumn("cell", F.explode(cells))
             .select("id", "copies", "label", "e", "code", "t", "k", "own", "cell")
             .repartition(tasks(spark), "k", "cell").sortWithinPartitions("k", "cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(batches, ["k", "cell"]):
            ids, copies, table = (t.column(x).to_numpy() for x in ("id", "copies", "t"))
            code, own_, cell = t.column("code").to_numpy().view(np.uint64), t.column("own").to_numpy(), t.column("cell").to_numpy()
            label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            lists = t.column("e").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            norm = np.sqrt(np.add.reduceat(flat * flat, at)) if len(flat) else np.zeros(0)
            cross = cell >> 32 != cell & 0xFFFFFFFF

            def keep(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = (label[i] == label[j]) & (sizes[i] == sizes[j]) & (~cross[i] | (own_[i] != own_[j]))
                same = (code[i][:, None] ^ code[j][:, None]) & masks[None] == 0
                ok &= same[np.arange(len(i)), table[i]] & (same.argmax(axis=1) == table[i])  # not met in an earlier table
                for d in np.unique(sizes[i[ok]]):
                    k = np.flatnonzero(ok & (sizes[i] == d))
                    for part in range(0, len(k), 8192):
                        q = k[part:part + 8192]
                        a, b = (flat[at[x[q]][:, None] + np.arange(d)] for x in (i, j))
                        ok[q] = np.einsum("ij,ij->i", a, b) / (norm[i[q]] * norm[j[q]]) >= threshold
                return ok

            found = list(pairs(runs, keep))
            if not found:
                continue
            i, j = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            root = ids[forest(len(ids), [(i, j)], ids)]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(n[some]), pa.array(root[some], mask=root[some] == ids[some])], names=["a", "n", "b"])

    return dealt.mapInArrow(run, "a long, n long, b long")
