"""Spelling variants by Bloom-guided neighbourhoods.

Every word's edits are made as 64-bit hashes, which follow from its prefix
sums without building the strings, and are looked up in blocked Bloom filters
of the vocabulary, one shard for each word length. Only the few that are found
become strings and meet the vocabulary in a join, which removes what the
filters let through wrongly. A pair is looked for from one end: by a deletion
from the longer word, by a replacement with a greater character from the
smaller one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import materialise, release

# Fixed by the contract.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Filter bits for each word, and bits that a word sets in its block of 64.
BITS, HASHES = 32, 5
#: Blocks of 64 bits (16 MB) broadcast at once; a larger filter goes in several passes.
MAX_BLOCKS = 1 << 21
#: Distinct words that a task counts before it passes their counts on.
MAX_COUNTED = 200_000
#: Words whose edits are made at once.
WORDS = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that a power can be divided out
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def document_words(doc_id: int | None, text: str | None, drop: int = 31) -> Counter:
    """The lower-cased runs of letters of a text; one in `drop`, by a hash with the doc_id, loses a character."""
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        out[run.translate(LOWER)] += n
    changed: Counter = Counter()
    for run, n in out.items():
        h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        changed[run] += n
    return changed


def count_words(docs: DataFrame, drop: int = 31, length: int = 7, least: int = 2) -> DataFrame:
    """(word, n) over all `docs(doc_id, text)` of words of `length` characters that occur `least` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for word, n in document_words(i, text.as_py(), drop).items():
                    if len(word) >= length:
                        counts[word] += n
                if len(counts) >= MAX_COUNTED:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)[:n]


def _sum(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads the sums over 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _mask(h: np.ndarray) -> np.ndarray:
    """The bits that a hash sets in its block: six of its low bits each name one."""
    out = np.zeros(len(h), dtype=np.uint64)
    for k in range(HASHES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a hash, from its high 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        yield int(n), np.flatnonzero(size == n)


def shard_sizes(vocabulary: DataFrame) -> dict[int, int]:
    """Blocks of the filter of each word length: BITS for each of its words."""
    counts = vocabulary.groupBy(F.length("word").alias("length")).count().collect()  # a row for each length
    return {r["length"]: -(-r["count"] * BITS // 64) for r in counts}


def passes(sizes: dict[int, int], most: int = MAX_BLOCKS) -> list[dict[int, tuple[int, int]]]:
    """The shards cut into passes of at most `most` blocks: the range of blocks of each length in each pass."""
    out: list[dict[int, tuple[int, int]]] = []
    room = 0
    for length, blocks in sorted(sizes.items()):
        at = 0
        while at < blocks:
            if not room:
                out.append({})
                room = most
            end = min(blocks, at + room)
            out[-1][length] = (at, end)
            room -= end - at
            at = end
    return out


class Filter:
    """The blocks of one pass: for each length those from `first` on, of `blocks` in all."""

    def __init__(self, sizes: dict[int, int], span: dict[int, tuple[int, int]]) -> None:
        self.span = {n: (a, b, sizes[n]) for n, (a, b) in span.items()}
        self.bits = {n: np.zeros(b - a, dtype=np.uint64) for n, (a, b) in span.items()}

    def has(self, length: int, h: np.ndarray) -> np.ndarray:
        """Whether hashes of words of `length` may be in the part of the vocabulary held here."""
        first, end, blocks = self.span[length]
        at = _block(h, blocks)
        inside = (at >= first) & (at < end)
        mask = _mask(h)
        return inside & (self.bits[length][np.where(inside, at - first, 0)] & mask == mask)


def build_filter(vocabulary: DataFrame, sizes: dict[int, int], span: dict[int, tuple[int, int]]) -> Filter:
    """The filter of a pass; its blocks, at most MAX_BLOCKS, are put together by Spark and come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            for n, at in _by_length(words):
                if n in span:
                    h = _mix(_sum(_codes([words[k] for k in at])))
                    block = _block(h, sizes[n])
                    inside = (block >= span[n][0]) & (block < span[n][1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(inside.sum(), n)), pa.array(block[inside] - span[n][0]),
                                                      pa.array(_mask(h[inside]).view(np.int64))], names=["length", "block", "bits"])

    found = vocabulary.select("word").mapInArrow(run, "length long, block long, bits long").groupBy("length", "block").agg(F.bit_or("bits").alias("bits"))
    out = Filter(sizes, span)
    for b in found.toArrow().to_batches():
        n, block, bits = (b.column(c).to_numpy() for c in ("length", "block", "bits"))
        for length in np.unique(n):
            out.bits[int(length)][block[n == length]] = bits[n == length].view(np.uint64)
    return out


def _probe(words: list[str], alphabet: np.ndarray, bloom: Filter) -> Iterator[tuple[int, str]]:
    """(index, edit) of the edits that the filter may hold: deletions, and replacements by a greater character."""
    for n, group in _by_length(words):
        power = _powers(n)
        for at in range(0, len(group), WORDS):
            rows = group[at:at + WORDS]
            codes = _codes([words[k] for k in rows])
            terms = codes * power
            whole = terms.sum(axis=1, dtype=np.uint64)
            if n - 1 in bloom.bits:
                before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                after = (whole[:, None] - before - terms) * _UNBASE
                hit = bloom.has(n - 1, _mix((before + after).ravel())).reshape(before.shape)
                for r, k in zip(*np.nonzero(hit)):
                    w = words[rows[r]]
                    yield rows[r], w[:k] + w[k + 1:]
            if n in bloom.bits:
                step = alphabet[None, None, :] - codes[:, :, None]
                r, k, c = np.nonzero(alphabet[None, None, :] > codes[:, :, None])
                h = _mix(whole[r] + step[r, k, c] * power[k])
                for x in np.flatnonzero(bloom.has(n, h)):
                    w = words[rows[r[x]]]
                    yield rows[r[x]], w[:k[x]] + chr(alphabet[c[x]]) + w[k[x] + 1:]


def near_pairs(vocabulary: DataFrame, most: int = MAX_BLOCKS) -> DataFrame:
    """`vocabulary(word, n)` of distinct words -> (a, n_a, b, n_b), each pair one edit apart once."""
    sizes = shard_sizes(vocabulary)
    chars = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''")
    alphabet = np.array(sorted(ord(r["c"]) for r in chars.collect()), dtype=np.uint64)  # the characters that words are made of
    found = None
    for span in passes(sizes, most):
        shared = vocabulary.sparkSession.sparkContext.broadcast(build_filter(vocabulary, sizes, span))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, n = b.column("word").to_pylist(), b.column("n")
                hits = dict.fromkeys(_probe(words, alphabet, shared.value))  # deletions in a run of equal letters are one
                at = pa.array([k for k, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("word").take(at), n.take(at), pa.array([e for _, e in hits], pa.string())],
                                                 names=["a", "n_a", "b"])

        part = vocabulary.select("word", "n").mapInArrow(run, "a string, n_a long, b string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b")).limit(0)
    return found.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def group_variants(vocabulary: DataFrame, times: int = 10, most: int = MAX_BLOCKS) -> DataFrame:
    """`vocabulary(word, n)` with n_near, form, form_n and root.

    Two words are near that differ by one inserted, deleted or replaced
    character. `form` is the near word of largest n, of equal ones the smallest,
    if it has `times` the word's n, which must be more than 1; `root` follows the
    forms to the last. A word without near words has n_near 0, no form and
    itself as its root; null words are left out, words given twice count
    together, other columns are not read. An empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("a form must have more occurrences than its word")
    words = materialise(vocabulary.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    pairs = materialise(near_pairs(words, most), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("form")))
    near = materialise(both.groupBy("a").agg(F.count("*").alias("n_near"), F.max("n_a").alias("n"), best.alias("x"))
                       .select(F.col("a").alias("word"), "n_near", F.when(-F.col("x.m") >= times * F.col("n"), F.col("x.form")).alias("form"),
                               F.when(-F.col("x.m") >= times * F.col("n"), -F.col("x.m")).alias("form_n")), "near")
    release(pairs)
    roots = _roots(near.where("form is not null").select("word", F.col("form").alias("root")))
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", F.col("n").cast("long").alias("n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
                    F.coalesce("root", "word").alias("root")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) with every root its own last: steps doubled until none moves.

    A form has at least twice its word's count, so a chain is no longer than
    the bits of a count and this ends.
    """
    now = materialise(forms, "roots")
    while True:
        step = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        after = materialise(now.join(step, F.col("root") == F.col("_at"), "left")
                            .select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "roots")
        release(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")
