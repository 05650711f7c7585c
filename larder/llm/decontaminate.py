"""Benchmark decontamination by suffix arrays over the training documents.

Each Arrow batch of documents is a shard: its words become one integer
sequence with a suffix array, and every suffix of every benchmark item is
binary-searched in it, word by word, to its longest verbatim match. Ranges as
long as a window name all the places where that window occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import append_columns, as_bytes, fresh, materialise

# Fixed by the contract: words are runs of bytes outside 00-2F, 3A-60 and 7B-7F after A-Z is lower-cased.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
               for b in range(256))
#: Benchmark words searched at a time; a larger benchmark is searched block by block.
BLOCK_WORDS = 2_000_000
#: Words of a shard; a batch with more is cut between documents.
SHARD_WORDS = 2_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


@dataclass
class Suffixes:
    """The suffixes of a block of benchmark items, as word numbers from 1."""

    vocab: dict[bytes, int]
    words: np.ndarray     # all items' words on end
    start: np.ndarray     # of each suffix
    length: np.ndarray    # words from there to the item's end
    window: np.ndarray    # words of its window: `window`, or a shorter item's all
    item: np.ndarray      # number of its item
    names: list[str]

    @property
    def least(self) -> int:
        return int(self.window.min()) if len(self.window) else 0


def suffixes(items: list[tuple[str, bytes | None]], window: int) -> Suffixes:
    """Suffixes long enough to hold their item's window; an item without words has none."""
    vocab: dict[bytes, int] = {}
    words: list[int] = []
    start, length, win, item, names = [], [], [], [], []
    for name, text in items:
        ws = words_of(text)
        if not ws:
            continue
        w = min(window, len(ws))
        for k in range(len(ws) - w + 1):
            start.append(len(words) + k)
            length.append(len(ws) - k)
            win.append(w)
            item.append(len(names))
        words += [vocab.setdefault(x, len(vocab) + 1) for x in ws]
        names.append(name)
    return Suffixes(vocab, *(np.array(x, dtype=np.int64) for x in (words, start, length, win, item)), names)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions with s > 0 in the order of their first `depth` words, by prefix doubling."""
    rank, k = s.astype(np.int64), 1
    while k < depth:
        ahead = np.zeros_like(rank)
        ahead[:-k or None] = rank[k:]
        key = rank * (rank.max() + 1) + ahead
        _, new = np.unique(key, return_inverse=True)
        if new.max() + 1 == len(s):
            rank = new
            break
        rank, k = new, 2 * k
    order = np.argsort(rank, kind="stable")
    return order[s[order] > 0]


def search(s: np.ndarray, sa: np.ndarray, q: Suffixes) -> tuple[np.ndarray, ...]:
    """Of each suffix: range of its window's matches, length and range of its longest match."""
    n = len(q.start)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    win_lo, win_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest, best_lo, best_hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    padded = np.concatenate([s, np.zeros(1, s.dtype)])
    live, step = np.arange(n), 0
    while len(live):
        word = q.words[q.start[live] + step]
        a, b = lo[live], hi[live]
        low = _bound(padded, sa, a, b, word, step)
        high = _bound(padded, sa, low, b, word + 1, step)
        on = low < high
        live, low, high = live[on], low[on], high[on]
        lo[live], hi[live] = low, high
        step += 1
        longest[live], best_lo[live], best_hi[live] = step, low, high
        at = live[q.window[live] == step]
        win_lo[at], win_hi[at] = lo[at], hi[at]
        live = live[q.length[live] > step]
    return win_lo, win_hi, longest, best_lo, best_hi


def _bound(s: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, step: int) -> np.ndarray:
    """First place in sa[lo:hi] whose suffix has at least `word` at `step`."""
    lo, hi = lo.copy(), hi.copy()
    last = len(s) - 1
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        less = s[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + step, last)] < word
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


@dataclass
class Hits:
    """What a shard's documents contain: spans of hit words, items, longest matches."""

    spans: list[list[int]]
    items: list[list[str]]
    longest: np.ndarray
    longest_at: np.ndarray


def match_shard(docs: list[np.ndarray], q: Suffixes) -> Hits:
    """Search every suffix of `q` in documents given as word numbers (0: not in the benchmark)."""
    out = Hits([[] for _ in docs], [[] for _ in docs], np.zeros(len(docs), np.int32), np.full(len(docs), -1, np.int32))
    s, doc, pos = _matchable(docs, q.least)
    if not len(s):
        return out
    sa = suffix_array(s, int(q.length.max()))
    win_lo, win_hi, longest, best_lo, best_hi = search(s, sa, q)

    hit = np.flatnonzero(win_hi > win_lo)
    if not len(hit):
        return out
    # Equal windows have the same range: mark each range's places once.
    key, which = np.unique(np.stack([win_lo[hit], win_hi[hit], q.window[hit]]), axis=1, return_inverse=True)
    at, of = _spread(key[0], key[1])
    places = sa[at]
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + key[2][of], -1)
    cover = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    begin, end = np.flatnonzero(cover[1:] & ~cover[:-1]), np.flatnonzero(cover[:-1] & ~cover[1:])
    for b, e in zip(begin.tolist(), end.tolist()):
        out.spans[doc[b]] += [int(pos[b]), int(pos[e - 1]) + 1]

    range_item = np.unique(np.stack([which.ravel(), q.item[hit]]), axis=1)
    range_doc = np.unique(np.stack([of, doc[places]]), axis=1)
    first = np.searchsorted(range_item[0], range_doc[0])
    past = np.searchsorted(range_item[0], range_doc[0], side="right")
    k, of_pair = _spread(first, past)
    doc_item = np.unique(np.stack([range_doc[1][of_pair], range_item[1][k]]), axis=1)
    for d, i in doc_item.T.tolist():
        out.items[d].append(q.names[i])

    at, of = _spread(best_lo[hit], best_hi[hit])
    places = sa[at]
    order = np.lexsort((places, -longest[hit][of], doc[places]))
    d = doc[places][order]
    top = order[np.r_[True, d[1:] != d[:-1]]]
    out.longest[doc[places[top]]] = longest[hit][of[top]]
    out.longest_at[doc[places[top]]] = pos[places[top]]
    return out


def _matchable(docs: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' runs of benchmark words of at least `least`, parted by 0, with document and place.

    A window consists of benchmark words alone, so no other word can be in a match.
    """
    size = np.array([len(d) + 1 for d in docs], np.int64)
    if not len(size) or not least:
        return (np.zeros(0, np.int64),) * 3
    s = np.zeros(size.sum(), np.int64)
    begin = np.cumsum(size) - size
    for b, d in zip(begin.tolist(), docs):
        s[b:b + len(d)] = d
    known = np.concatenate([[False], s > 0])
    up, down = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    long = down - up >= least
    at, _ = _spread(up[long], down[long] + 1)  # with the 0 behind each run
    doc = np.searchsorted(begin, at, side="right") - 1
    return s[at], doc, at - begin[doc]


def _merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
           T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
           T.StructField("hit_items", T.ArrayType(T.StringType())),
           T.StructField("longest_match", T.IntegerType()), T.StructField("longest_at", T.IntegerType())]


def _search_block(df: DataFrame, text: str, block: Suffixes, before: list[str] | None) -> tuple[DataFrame, list[str]]:
    """`df` with the finds of one block of items in column `text`, joined to those of the blocks `before`."""
    shared = df.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        q = shared.value
        for b in batches:
            docs, n, part, found = [], [], 0, []
            for one in as_bytes(b.column(text)):
                ws = words_of(one)
                ids = np.fromiter((q.vocab.get(w, 0) for w in ws), np.int64, len(ws)) if q.vocab else np.zeros(0, int)
                n.append(len(ws))
                docs.append(ids)
                part += len(ws)
                if part > SHARD_WORDS:
                    found.append(match_shard(docs, q))
                    docs, part = [], 0
            found.append(match_shard(docs, q))
            spans = [x for f in found for x in f.spans]
            items = [sorted({*x}) for f in found for x in f.items]  # rows of the benchmark may share an item_id
            longest = [int(x) for f in found for x in f.longest]
            places = [int(x) for f in found for x in f.longest_at]
            if before:
                old = [b.column(c).to_pylist() for c in before]
                spans = [_merge(x, y) for x, y in zip(old[2], spans)]
                items = [sorted({*x, *y}) for x, y in zip(old[3], items)]
                places = [p if m > o else w for m, o, p, w in zip(longest, old[4], places, old[5])]
                longest = [max(m, o) for m, o in zip(longest, old[4])]
            n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            yield b, [pa.array(x, t) for x, t in (
                (n, pa.int64()), (n_hit, pa.int64()), (spans, pa.list_(pa.int32())), (items, pa.list_(pa.string())),
                (longest, pa.int32()), (places, pa.int32()))]

    return append_columns(df, _FIELDS, run)


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with a struct column `contamination` of what of `bench(item_id, text)` each text holds.

    n_words, n_hit (words inside an occurring window), hit_spans (word numbers,
    from and past, by turns), hit_items (distinct item_ids as strings),
    longest_match and longest_at (words and first word of the longest verbatim
    match of at least a window; 0 and -1 without one). A window is `window`
    consecutive words of an item, or all words of a shorter one. A null text has
    no words and an item without words no window; a null item_id is listed as
    "null", repeated items once. Empty tables give no rows or no hits. A column
    of `docs` called `contamination` gives way; all others stay as they are.

    The benchmark is the query set: it goes to the tasks in blocks of at most
    `block_words` words (and one item), each searched in all documents. A
    block's finds are written to the shared folder before the next is searched.
    """
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                         F.coalesce("text", F.lit("")).alias("text"))
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0  # no fewer characters than words
    blocks = words // (2 * block_words) + 1
    columns = [c for c in docs.columns if c.lower() != "contamination"]
    text = fresh(["llm_text"], columns)[0]
    out = docs.select(*columns, F.col("text").cast("string").alias(text))
    names: list[str] | None = None
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        block = suffixes([(r[0], r[1].encode()) for r in mine.collect()], window)
        if names:
            out = materialise(out.select(*columns, text, *names), "contamination")
        out, new = _search_block(out, text, block, names)
        names = new
    found = F.struct(*[F.col(n).alias(f.name) for n, f in zip(names, _FIELDS)])
    return out.select(*columns, found.alias("contamination"))


def is_contaminated(found: str = "contamination") -> F.Column:
    """The contract's rule: at least a twentieth of the words, and one, are hit."""
    hit, n = F.col(f"{found}.n_hit"), F.col(f"{found}.n_words")
    return (hit > 0) & (20 * hit >= n)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 13) -> DataFrame:
    """`docs` without the contaminated documents, columns unchanged, one called `contamination` too.

    A null or empty text is not contaminated and stays, as do all rows where
    the benchmark is empty; repeated rows stay or go together.
    """
    kept = fresh(["llm_kept"], docs.columns)[0]
    own = [c for c in docs.columns if c.lower() == "contamination"]
    found = find_contamination(docs.withColumn(kept, F.col(own[0])) if own else docs, bench, window).where(~is_contaminated())
    return found.select(*[F.col(kept).alias(c) if c in own else F.col(c) for c in docs.columns])
