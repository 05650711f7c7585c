"""Substring dedup by fixed-block anchors.

Two equal windows of `window` words hold an equal block of `block` words that
starts at a multiple of `block` in either one, as 2 * block - 1 <= window. So:

1. Anchors. The non-overlapping blocks of every document are the index; every
   rolling window of `block` words probes it. A document learns which of its
   blocks a later document holds, and which of its rolling windows an earlier
   document has as a block.
2. Extension. Only windows of `window` words around such hits are compared, by
   a 64-bit hash within the range of a second one: those that start in an
   earlier document too are removed. Joined, they are the maximal repeats.

Both exchanges send no text: a task packs the hashes of a batch of documents
by hash range, so a window costs 5 (then 8) bytes and no row of its own. A pack
sends copies of a text once, and settles what its own documents decide about a
hash that many of them share, so a hot passage is reduced before the exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import as_bytes, fresh, materialise, slices, tasks

WINDOW, BLOCK = 50, 25
#: Words of documents whose hashes are packed together.
PACK_WORDS = 500_000
#: Documents of a pack that share a hash from which on the pack settles what it can by itself.
CROWD = 8
_NO_ID = np.iinfo(np.int64).max
_NAMELESS = 1 << 62  # ids are below this

_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd, so they have inverses
_MEMO = 200_000


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, as far as asked."""

    def __init__(self, mult: np.uint64):
        self.mult, self.inverse = int(mult), pow(int(mult), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.mult, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Hash of every run of `length` words, from the hashes of the words, by prefix sums."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = powers.to(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return _mix((sums[length:] - sums[:-length]) * down[:n - length + 1])


def word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) >= _MEMO:
                memo.clear()
            h = memo[w] = xxhash.xxh64_intdigest(w, 7)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _rows(docs: DataFrame) -> DataFrame:
    """A row key, the number that orders documents (null ids above all others) and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    nameless = F.lit(_NAMELESS) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    return d.select(F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", nameless).alias("ord"), "text")


_PACKED = "bucket int, docs binary, hashes binary, marks binary"


def _small(x: np.ndarray) -> bytes:
    """Integers in the fewest whole bytes that hold them all, that number first."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(x) or (x.min() >= 0 and x.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    return bytes([8]) + x.astype(np.int64).tobytes()


def _large(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[b[0]], offset=1).astype(np.int64)


def _settle(h: np.ndarray, ord_: np.ndarray, mark: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes of a pack must be sent, and which are known to be hits (see `_answer`) without.

    Of a hash that more than CROWD windows of the pack have, the other packs
    need the smallest marked and (`both`) the largest ord; a hit stays one
    whatever they hold. So only these two and the open ones are sent.
    """
    send, known = np.ones(len(h), bool), np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
    size = np.diff(np.r_[start, len(h)])
    order, size = order[np.repeat(size > CROWD, size)], size[size > CROWD]
    if len(order):
        start = np.cumsum(size) - size
        o = ord_[order]
        m = mark[order] & (o < _NAMELESS)
        least = np.repeat(np.minimum.reduceat(np.where(m, o, _NO_ID), start), size)
        most = np.repeat(np.maximum.reduceat(o, start), size)
        hit, edge = o > least, m & (o == least)
        if both:
            hit |= m & (o < most)
            edge |= o == most
        known[order] = hit & ~edge
        send[order] = ~hit | edge
    return send, known


def _pack(docs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], buckets: int, width: int,
          both: bool) -> Iterator[pa.RecordBatch]:
    """One row per bucket: the documents, how many hashes each has there, and the hashes.

    docs: ord, and hash, bucket hash and mark of each window. `width` low bytes
    of a hash are sent. Rows without `docs` hold known hits, a row per bucket of
    ords: the hashes, and their ords as `marks`.
    """
    docs = sorted(docs, key=lambda x: x[0])
    ords = np.array([d[0] for d in docs], np.int64)
    h, b, m = (np.concatenate([d[k] for d in docs]) for k in (1, 2, 3))
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[1]) for d in docs])
    if not len(h):
        return
    send, known = _settle(h, ords[doc], m, both)
    if known.any():
        row, low = ords[doc[known]], h[known] & np.uint64((1 << 8 * width) - 1)
        to = row % buckets
        order = np.lexsort((low, row, to))
        row, low, to = row[order], low[order], to[order]
        edge = np.searchsorted(to, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edge))
        cut = [slice(edge[k], edge[k + 1]) for k in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.nulls(len(some), pa.binary()), pa.array([low[x].tobytes() for x in cut], pa.binary()),
             pa.array([row[x].tobytes() for x in cut], pa.binary())], names=["bucket", "docs", "hashes", "marks"])
    h, b, m, doc = h[send], b[send], m[send], doc[send]
    b = (b % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    h, b, m, doc = h[order], b[order], m[order], doc[order]
    edge = np.searchsorted(b, np.arange(buckets + 1))
    cols: list[list] = [[], [], [], []]
    for k in np.flatnonzero(np.diff(edge)):
        at = slice(edge[k], edge[k + 1])
        there, counts = np.unique(doc[at], return_counts=True)
        first, steps = ords[there[:1]].tobytes(), _small(np.diff(ords[there]))
        low = h[at].view(np.uint8).reshape(-1, 8)[:, :width]
        head = first + len(steps).to_bytes(4, "little") + steps + _small(counts)
        for c, v in zip(cols, (int(k), head, low.tobytes(), np.packbits(m[at]).tobytes())):
            c.append(v)
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                         names=["bucket", "docs", "hashes", "marks"])


def _unpack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch | tuple[np.ndarray, ...]]:
    """Known hits as answers, then all hashes of a task's bucket, each with its ord and mark."""
    ords, hashes, marks = [], [], []
    for b in batches:
        known = b.filter(b.column("docs").is_null())
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column(k) for k in ("bucket", "marks", "hashes")], names=["to", "ords", "hits"])
        for d, h, m in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            if d is None:
                continue
            cut = 12 + int.from_bytes(d[8:12], "little")
            mine = np.cumsum(np.r_[np.frombuffer(d[:8], np.int64), _large(d[12:cut])])
            low = np.frombuffer(h, np.uint8).reshape(-1, width)
            full = np.zeros((len(low), 8), np.uint8)
            full[:, :width] = low
            hashes.append(full.view(np.uint64).ravel())
            ords.append(np.repeat(mine, _large(d[cut:])))
            marks.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(low)).astype(bool))
    if hashes:
        yield tuple(map(np.concatenate, (hashes, ords, marks)))


def _answer(packed: DataFrame, n: int, width: int, both: bool) -> DataFrame:
    """(ord, hits): the distinct hashes that a document shares with a marked one of an earlier document.

    `both`: documents with a marked hash that a later one has are told it too.
    Which these are hangs on ord and hash alone, so rows with equal ids share an answer.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _unpack(batches, width):
            if isinstance(got, pa.RecordBatch):
                yield got
            else:
                yield from compare(*got)

    def compare(h: np.ndarray, ord_: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h)
        h, ord_, mark = h[order], ord_[order], mark[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        some = np.repeat(size > 1, size)  # a hash that stands alone is shared with none
        h, ord_, mark = h[some], ord_[some], mark[some] & (ord_[some] < _NAMELESS)
        if not len(h):
            return
        size = size[size > 1]
        start = np.cumsum(size) - size
        hit = ord_ > np.repeat(np.minimum.reduceat(np.where(mark, ord_, _NO_ID), start), size)
        if both:
            hit |= mark & (ord_ < np.repeat(np.maximum.reduceat(ord_, start), size))
        h, row = h[hit], ord_[hit]
        to = row % n
        order = np.lexsort((row, to))
        h, row, to = h[order], row[order], to[order]
        edge = np.searchsorted(to, np.arange(n + 1))
        for k in np.flatnonzero(np.diff(edge)):
            at = slice(edge[k], edge[k + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(k)], pa.int32()), pa.array([row[at].tobytes()], pa.binary()),
                 pa.array([h[at].tobytes()], pa.binary())], names=["to", "ords", "hits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(r, np.int64), np.frombuffer(h, np.int64))
               for b in batches for r, h in zip(b.column("ords").to_pylist(), b.column("hits").to_pylist())]
        if not got:
            return
        row, h = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
        row, h = row[new], h[new]
        edge = np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)]
        for at in range(0, len(edge) - 1, 4096):
            part = edge[at:at + 4097]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[part[:-1]]),
                 pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), pa.array(h[part[0]:part[-1]]))],
                names=["ord", "hits"])

    # Packed once more on the way back, by document: a row per pair of tasks, not per document and task.
    answers = packed.repartitionById(n, "bucket").mapInArrow(run, "to int, ords binary, hits binary")
    return answers.repartitionById(n, "to").mapInArrow(merge, "ord long, hits array<long>")


def _near(flag: np.ndarray, before: int, n: int) -> np.ndarray:
    """Which of n places have a flagged place at most `before` after them."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flag)
    np.add.at(edge, np.maximum(at - before, 0), 1)
    np.add.at(edge, np.minimum(at + 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _probe(docs: DataFrame, buckets: int, block: int, window: int) -> DataFrame:
    """Step 1's packed hashes: every rolling block, marked where it is one of the index.

    Of equal texts in a pack the one of the smallest ord is sent: the others go whole, unasked.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, powers = {}, Powers(_MULT[0])
        found, words, seen = [], 0, {}
        for b in slices(batches):
            for o, text in zip(b.column("ord").to_pylist(), as_bytes(b.column("text"))):
                ws = text.split()
                if len(ws) < window:
                    continue
                said = xxhash.xxh3_128_digest(b" ".join(ws))
                at = seen.get(said)
                if at is not None and (o == found[at][0] or min(o, found[at][0]) < _NAMELESS):
                    found[at] = (min(o, found[at][0]), *found[at][1:])
                    continue
                seen[said] = len(found)
                h = rolling(word_hashes(ws, memo), block, powers)
                mark = np.zeros(len(h), bool)
                mark[::block] = True
                found.append((o, h, h >> np.uint64(40), mark))
                words += len(ws)
                if words >= PACK_WORDS:
                    yield from _pack(found, buckets, 5, both=True)
                    found, words, seen = [], 0, {}
        if found:
            yield from _pack(found, buckets, 5, both=True)

    return docs.mapInArrow(run, _PACKED)


def _extend(hit_docs: DataFrame, buckets: int, block: int, window: int) -> DataFrame:
    """Step 2's packed hashes: the windows that hold a hit block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, one, two = {}, Powers(_MULT[0]), Powers(_MULT[1])
        found, words = [], 0
        for b in slices(batches):
            for o, text, hits in zip(b.column("ord").to_pylist(), as_bytes(b.column("text")), b.column("hits")):
                w = word_hashes(text.split(), memo)
                h25 = rolling(w, block, one) & np.uint64((1 << 40) - 1)
                hit = np.isin(h25, hits.values.to_numpy().view(np.uint64))
                h, h2 = rolling(w, window, one), rolling(w, window, two)
                near = _near(hit, window - block, len(h25))[:len(h)]
                found.append((o, h[near], h2[near], np.ones(int(near.sum()), bool)))
                words += int(near.sum())
                if words >= PACK_WORDS:
                    yield from _pack(found, buckets, 8, both=False)
                    found, words = [], 0
        if found:
            yield from _pack(found, buckets, 8, both=False)

    return hit_docs.mapInArrow(run, _PACKED)


def _cut(removed_docs: DataFrame, window: int) -> DataFrame:
    """(row, n_removed, kept) of documents with the hashes of their repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, one = {}, Powers(_MULT[0])
        for b in slices(batches):
            out: list[tuple[int, bytes]] = []
            for text, hits in zip(as_bytes(b.column("text")), b.column("hits")):
                ws = text.split()
                h = rolling(word_hashes(ws, memo), window, one)
                flag = np.zeros(len(ws), bool)
                flag[:len(h)] = np.isin(h, hits.values.to_numpy().view(np.uint64))
                edge = np.zeros(len(ws) + 1, np.int64)
                at = np.flatnonzero(flag)
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                out.append((int(gone.sum()), b" ".join(w for w, g in zip(ws, gone) if not g)))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([n for n, _ in out], pa.int64()),
                 pa.array([t for _, t in out], pa.binary()).cast(pa.string())], names=["row", "n_removed", "kept"])

    return removed_docs.mapInArrow(run, "row long, n_removed long, kept string")


def _words(docs: DataFrame) -> DataFrame:
    """(row, doc_id, ord, n_words, sha): a digest of the words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ws = [t.split() for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("ord"), pa.array([len(w) for w in ws], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in ws])], names=["row", "ord", "n_words", "sha"])

    return docs.mapInArrow(run, "row long, ord long, n_words long, sha string")


def repeated_windows(rows: DataFrame, alone: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(row, ord, text, hits) of the rows of `_rows(docs)` in `alone(ord)` that hold a window of an earlier document."""
    n = tasks(rows.sparkSession)  # hash ranges; each is one task's
    anchors = _answer(_probe(rows, n, block, window), n, 5, both=True).join(alone, "ord")
    hit_docs = materialise(rows.join(anchors, "ord"), "anchored")
    repeats = _answer(_extend(hit_docs, n, block, window), n, 8, both=False)
    return hit_docs.drop("hits").join(repeats, "ord")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of `window` consecutive words over it also starts
    in a document with a smaller doc_id; windows are judged on the input. A
    document whose words all equal an earlier one's goes whole, if it has a
    window, without being compared. Null and empty texts have no words. A null
    doc_id is larger than all others and removes nothing; rows with equal ids
    remove nothing from each other. An empty table gives an empty result, and
    other columns are not read. `cut_texts` gives the texts themselves.
    """
    base, cut = _dedup(docs, window, block)
    cut = cut.select("row", F.col("n_removed").alias("_cut"), F.sha2("kept", 256).alias("kept_sha256"))
    return (base.join(cut, "row", "left")
            .select("doc_id", "n_words",
                    F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("_cut", F.lit(0))).alias("n_removed"),
                    F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")))


def cut_texts(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """`docs` with `text` less its repeated words; texts that lose none stay as they are, null ones too.

    What goes, nulls, ties, repeated rows and an empty table as in
    `dedup_substrings`; other columns stay, whatever they are called.
    """
    base, cut = _dedup(docs.select("doc_id", "text"), window, block)
    row, kept, own = fresh(["llm_row", "llm_cut", "llm_key"], docs.columns)
    gone = base.where("whole").select(F.col("row").alias(row), F.lit("").alias(kept))
    new = gone.union(cut.join(base.where("whole").select("row"), "row", "left_anti").where("n_removed > 0")
                     .select("row", "kept")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("long"), text)
    return (docs.withColumn(own, key).join(new, F.col(own) == F.col(row), "left")
            .withColumn("text", F.coalesce(kept, "text")).select(*docs.columns))


def _dedup(docs: DataFrame, window: int, block: int) -> tuple[DataFrame, DataFrame]:
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block at any offset: 2 * block - 1 <= window")
    rows = _rows(docs)
    base = materialise(_words(rows), "words")
    first = base.where((F.col("n_words") >= window) & (F.col("ord") < _NAMELESS)).groupBy("sha").agg(F.min("ord").alias("first"))
    first = materialise(first, "first")
    base = materialise(
        base.join(first, "sha", "left")
        .select("row", "ord", F.when(F.col("ord") < _NAMELESS, F.col("ord")).alias("doc_id"), "n_words", "sha",
                F.coalesce(F.col("ord") > F.col("first"), F.lit(False)).alias("whole")), "judged")
    alone = base.where("not whole").where(F.col("n_words") >= window).select("ord").distinct()
    found = repeated_windows(rows, alone, window, block)
    cut = materialise(_cut(found, window), "cut")
    return base, cut.dropDuplicates(["row"])
