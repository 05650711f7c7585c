"""Pairs inside equal-key runs of a sorted Arrow stream, without emitting them.

Buckets reach a task sorted by key. Runs are compared by offset: all rows with
the row d places on in the same run, d = 1, 2, ... So one numpy call serves
many small buckets, and a large bucket costs memory linear in its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a run of equal `keys` ends, with each row's run number."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]).combine_chunks() if carry is not None else t
        run = _run_ids(t, keys)
        cut = int(np.searchsorted(run, run[-1]))
        carry = t.slice(cut)
        if cut:
            yield t.slice(0, cut), run[:cut]
    if carry is not None and carry.num_rows:
        yield carry, _run_ids(carry, keys)


def _run_ids(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def pairs(run: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one run that `keep` accepts, offset by offset."""
    ends = np.searchsorted(run, run, side="right")
    left = np.flatnonzero(ends - np.arange(len(run)) > 1)
    d = 1
    while len(left):
        for at in range(0, len(left), 65536):
            i = left[at:at + 65536]
            j = i + d
            ok = keep(i, j)
            if ok.any():
                yield i[ok], j[ok]
        d += 1
        left = left[ends[left] - left > d]


def forest(n: int, found: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray) -> np.ndarray:
    """For each of n rows, the row with the least `order` it is linked to by the pairs."""
    rank = np.empty(n, dtype=np.int64)
    by_rank = np.argsort(order, kind="stable")
    rank[by_rank] = np.arange(n)
    if not found:
        return np.arange(n)
    i = rank[np.concatenate([a for a, _ in found])]
    j = rank[np.concatenate([b for _, b in found])]
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    return by_rank[label[rank]]
