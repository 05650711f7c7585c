"""Brute-force versions of the operators, over lists of Python rows."""

import hashlib
import re

import xxhash

_LOWER = {c: c + 32 for c in range(65, 91)}


def space_words(text):
    return (text or "").encode().split()


def simhash(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not words:
        return 0
    grams = [" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    """Smallest key reachable from each."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def simhash_components(docs):
    """docs: {doc_id: text} -> {doc_id: (fingerprint, component)}"""
    fp = {i: simhash(t) for i, t in docs.items()}
    comp = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    return {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def repeated(docs, window=50):
    """docs: {doc_id: text} -> {doc_id: (n_words, n_removed, sha)}"""
    first = {}
    words = {i: space_words(t) for i, t in docs.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def contamination(text, bench, window=13):
    """bench: [(item_id, text)] -> (n_words, n_hit, items)"""
    ws, hit, items = bench_words(text), set(), set()
    for item, t in bench:
        b = bench_words(t)
        n = min(window, len(b))
        grams = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[k:k + n]) in grams:
                hit.update(range(k, k + n))
                items.add("null" if item is None else str(item))
    return len(ws), len(hit), sorted(items)


def contaminated(n_words, n_hit):
    return n_hit > 0 and 20 * n_hit >= n_words


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words} -> {source: target}, by sharing and re-sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] >= most * sizes[s] * w]
        if not over:
            return {**{s: float(c) for s, c in capped.items()}, **{s: left * weight[s] / w for s in free}}
        capped.update({s: most * sizes[s] for s in over})


def copies(doc_id, text, source, sizes, target, seed=7):
    if not sizes[source]:
        return 0
    rate = target[source] / sizes[source]
    key = str(doc_id) if doc_id is not None else (hashlib.md5(text.encode()).hexdigest() if text is not None else "null")
    u = int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
    return int(rate) + (u < rate - int(rate))


def shards(rows, n=16, seed=1):
    """rows: [(doc_id, text, source)] -> sorted [(doc_id, size, crc, shard, slot)]"""
    import zlib
    by = {}
    for doc_id, text, source in rows:
        b = (text or "").encode()
        size, crc = len(b) + 1, zlib.crc32(b)
        h = int(hashlib.md5(f"{seed}|{'null' if doc_id is None else doc_id}|{crc}|{size}".encode()).hexdigest()[:15], 16)
        by.setdefault(source, []).append((h, (doc_id is not None, doc_id or 0), crc, size, doc_id))
    every = []
    for source, own in by.items():
        for k, (h, key, crc, size, doc_id) in enumerate(sorted(own, key=lambda x: x[:4])):
            every.append(((2 * k + 1) / (2 * len(own)), (source is not None, source or ""), h, key, crc, size, doc_id))
    every.sort(key=lambda x: x[:6])
    small, big = divmod(len(every), n)
    out, at = [], 0
    for shard in range(n):
        for slot in range(small + (shard < big)):
            _, _, _, _, crc, size, doc_id = every[at]
            out.append((doc_id, size, crc, shard, slot))
            at += 1
    return sorted(out, key=str)
