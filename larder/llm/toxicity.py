"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. A token that may be
disguised (leetspeak, a letter drawn out, letters spaced or dotted apart)
becomes a lattice: at each character the letters it may stand for, each with
the channel's cost, nothing where it repeats or only separates, or a word end
where it parts two words. Viterbi
finds the likeliest reading under the model. The restored text is scored by a
logistic model over the words, and the beginnings that many words share, that
labelled rows show.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import append_columns, first_by_hash, fresh, materialise, release

#: Classes of the character model: 0 word end, 1-26 letters, 27 any other letter.
CLASSES = 28
# Which letters a leet character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
TOKEN = re.compile(r"\S+")
DOUBLE = re.compile(r"(.)\1")
#: A number, amount or time, which is no disguise.
NUMBER = re.compile(r"[-+$€£(#~<>=|]*\d+(?:[.,:/'’–-]\d+)*[)%$€£+!|]*")
OUTER = ".,;:?\"'’“”„«»()[]{}<>…%&#*=~^`|/\\"
# The outer marks that stand for no letter.
EDGE = "".join(c for c in OUTER if c not in LEET)
#: Channel costs in nats: of a leet substitution, a dropped repeat in a drawn-out run and in a double, a dropped separator, a separator as a word end, a kept non-letter.
COST_LEET, COST_REPEAT, COST_DOUBLE, COST_SEPARATOR, COST_END, COST_KEEP = 1.0, 0.5, 2.0, 0.5, 0.5, 6.0
#: Of a leet character taken as a bracket, bar or mark: dropped, or a word end.
COST_MARK = 3.0
#: Between spaced-out characters: a word end at a narrow gap, one reading for each price; a dropped wide gap.
COSTS_GAP, COST_WIDE = (1.0, 0.0, -1.0, -2.0, -3.0), 4.0
#: Letters of the longest word looked for within a run of groups.
LONGEST = 30
#: Of a gap dropped between two groups of letters.
COST_JOIN = 1.0
#: Characters of a run's own lattice for a narrow and a wide gap.
NARROW, WIDE = " ", "\n"
PREFIXES = (4, 5, 6, 7, 8)
#: Bounds of the fit: labelled rows, and features kept of them.
MAX_LABELLED, MAX_FEATURES = 20_000, 4_000
#: Features that should tell each label-1 text.
COVER = 4
#: Tokens, gaps and words, and lattice places, that a worker remembers.
MEMO, MEMO_OPTIONS = 200_000, 20_000


def fold(text: str) -> str:
    """Lower case; full-width and other compatibility forms as the plain ones."""
    low = text.lower()
    return low if low.isascii() else unicodedata.normalize("NFKC", low)


def _class_table() -> np.ndarray:
    t = np.zeros(0x250, dtype=np.int64)
    for c in range(0xAA, 0x250):
        if chr(c).isalpha():
            t[c] = 27
    t[97:123] = np.arange(1, 27)
    return t


_CLASS = _class_table()


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], 27)


def _char_class(c: str) -> int:
    o = ord(c)
    return int(_CLASS[o]) if o < len(_CLASS) else (27 if c.isalpha() else 0)


def char_model(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts: only CLASSES^3 sums reach the driver.

    Counted per Arrow batch and summed by Spark; a batch's rows are the cells
    that occur in it, so what is shuffled follows the input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros(CLASSES ** 3, dtype=np.int64)
            for text in b.column("text").to_pylist():
                c = np.concatenate([[0, 0], classes(text.lower()), [0, 0]]) if text else np.zeros(0, np.int64)
                if len(c):
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "cell long, n long")
    out = np.zeros(CLASSES ** 3)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(CLASSES, CLASSES, CLASSES)


def log_model(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), trigram interpolated with bigram and unigram."""
    def share(x: np.ndarray) -> np.ndarray:
        s = x.sum(axis=-1, keepdims=True)
        return np.divide(x, s, out=np.zeros_like(x), where=s > 0)

    uni = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + CLASSES)
    return -np.log(0.7 * share(counts) + 0.2 * share(counts.sum(axis=0))[None] + 0.1 * uni[None, None])


def _separates(c: str) -> bool:
    return not c.isalnum() and c not in LEET


def _options(token: str, i: int, gap: float = COSTS_GAP[0]) -> list[tuple[str, float]]:
    """What the character at i may stand for, '' for nothing, ' ' for a word end, with the channel's costs."""
    c = token[i]
    if c == NARROW:
        return [("", 0.0), (" ", gap)]
    if c == WIDE:
        return [("", COST_WIDE), (" ", 0.0)]
    out: list[tuple[str, float]] = []
    if c.isalpha():
        out.append((c, 0.0))
    else:
        out.append((c, COST_KEEP))
    for letter in LEET.get(c, ""):
        out.append((letter, COST_LEET))
    if i and token[i - 1] == c:
        drawn = c == token[i - 2:i - 1] or c == token[i + 1:i + 2]
        out.append(("", COST_REPEAT if drawn or _separates(c) else COST_DOUBLE))
    elif _separates(c):
        out.append(("", COST_SEPARATOR))
    if _separates(c):
        out.append((" ", COST_END))
    elif not c.isalnum():
        out += [("", COST_MARK), (" ", COST_MARK)]
    return out


#: Options with classes by what they depend on: two characters before, the next, and the price of a gap.
_KNOWN_OPTIONS: dict[tuple[str, str, float], list[tuple[str, float, int]]] = {}


def decode(token: str, cost: list, gap: float = COSTS_GAP[0]) -> str:
    """The likeliest reading of a token or a spaced-out run by Viterbi, its words parted by a space.

    The state goes on to the end however long the token is; a reading is kept
    as a chain of what was emitted.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i in range(len(token)):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        around = token[max(0, i - 2):i], token[i:i + 2], gap
        options = _KNOWN_OPTIONS.get(around)
        if options is None:
            if len(_KNOWN_OPTIONS) >= MEMO_OPTIONS:
                _KNOWN_OPTIONS.clear()
            options = _KNOWN_OPTIONS[around] = [(emit, price, _char_class(emit) if emit else 0) for emit, price in _options(token, i, gap)]
        for (a, b), (so_far, chain) in best.items():
            row = cost[a][b]
            for emit, price, k in options:
                if emit:
                    state, total = (b, k), so_far + price + row[k]
                else:
                    state, total = (a, b), so_far + price
                old = after.get(state)
                if old is None or total < old[0]:
                    after[state] = (total, (chain, emit) if emit else chain)
        best = after
    chain = min(((s + cost[a][b][0], c) for (a, b), (s, c) in best.items()), key=lambda x: x[0])[1]
    said: list[str] = []
    while chain is not None:
        chain, emit = chain
        said.append(emit)
    return "".join(reversed(said))


def _drawn_out(w: str) -> bool:
    return any(w[i] == w[i - 1] == w[i - 2] for i in range(2, len(w)))


def _plain(w: str) -> bool:
    """Nothing to decode: letters without a double, a number, or marks alone."""
    if w.isalpha():
        return not DOUBLE.search(w)
    return not any(c.isalpha() or c in LEET for c in w) or NUMBER.fullmatch(w) is not None


def _read(core: str, cost: list) -> str:
    return core if _plain(core) else decode(core, cost)


def restore_token(token: str, cost: list) -> str:
    """A folded token's reading without the marks at its ends; plain words come back as they are."""
    core = token.strip(OUTER)
    while len(core) > 3 and not core[-1].isalnum() and core[-1] == core[-2]:
        core = core.rstrip(core[-1])
    if core.endswith("!"):
        core = core.rstrip("!")
    return _read(core, cost)


class Words(set):
    """All words a text may be read as; `first` has one reading of each token, of which shares are counted."""

    def __init__(self, first: set[str] = frozenset(), more: set[str] = frozenset()) -> None:
        super().__init__(first)
        self.update(more)
        self.first = first


def readings(token: str, cost: list) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words a folded token may be read as: those of its first reading, and more.

    First comes a word of letters as it is, and else what the lattice gives
    without the marks at the ends. More are the lattice's reading of a word with
    doubles, that with the marks that may be letters, and what stands between
    separators.
    """
    core, read = token.strip(OUTER), restore_token(token, cost).split()
    first, more = ([core], read) if core.isalpha() and not _drawn_out(core) else (read, [])
    if not token.isalpha():
        whole = token.strip(EDGE)
        if whole and not (whole[0].isalnum() and whole[-1].isalnum()):
            more = more + _read(whole, cost).split()
        parts = "".join(" " if _separates(c) else c for c in token).split()
        if len(parts) > 1:
            for part in parts:
                if len(part) > 1 and any(c.isalnum() for c in part):
                    more = more + restore_token(part, cost).split()
    return tuple(first), tuple(w for w in dict.fromkeys(more) if w not in first)


def restored_words(text: str | None, cost: list, memo: dict[str, tuple]) -> Words:
    """The distinct words of the restored text; `memo` keeps the readings met so far."""
    if not text:
        return Words()
    text = fold(text)
    tokens = text.split()
    out: set[str] = set()
    others: set[str] = set()
    for w in set(tokens):
        if len(w) == 1:
            continue
        r = memo.get(w)
        if r is None:
            r = _remember(w, cost, memo)
        out.update(r[0])
        if r[1]:
            others.update(r[1])
    for first, more in _runs(text, tokens, cost, memo):
        out.update(first)
        others.update(more)
    return Words(out, others)


def _remember(token: str, cost: list, memo: dict[str, tuple]) -> tuple:
    if len(memo) >= MEMO:
        memo.clear()
    r = memo[token] = readings(token, cost)
    return r


def _single(w: str) -> bool:
    return len(w) == 1 and (w.isalnum() or w in LEET)


def _letter_class(c: str) -> int:
    """The class of a letter or of the first letter that a leet character stands for, 0 for others."""
    return _char_class(LEET[c][0]) if c in LEET and c not in "!|+(" else _char_class(c)


def _joins(left: str, right: str, cost: list) -> bool:
    """Whether the model takes the gap between the ends of two groups of letters for a disguise rather than a word end.

    Only the trigrams that see the gap differ, so two characters on each side decide.
    """
    a, b = [0, 0, *map(_letter_class, left)][-2:]
    c, d = [*map(_letter_class, right), 0, 0][:2]
    if not b or not c:
        return False
    parted = cost[a][b][0] + cost[b][0][c] + cost[0][c][d]
    return cost[a][b][c] + cost[b][c][d] + COST_JOIN < parted


def _spaced(run: list[str], gaps: list[str], cost: list) -> list[str]:
    """Readings of a run's tokens, the likeliest first: with word ends from dear to cheap, and
    with its first or last character apart, which may be a word beside it. A gap wider than the narrowest
    is rather a word end.
    """
    least = min(map(len, gaps))
    whole = run[0] + "".join((WIDE if len(g) > least else NARROW) + w for g, w in zip(gaps, run[1:]))
    out = [decode(whole, cost, gap) for gap in COSTS_GAP]
    if len(run[0]) == 1:
        out.append(decode(whole[2:], cost))
    if len(run[-1]) == 1:
        out.append(decode(whole[:-2], cost))
    return out


def _linked(left: str, right: str, cost: list, memo: dict[str, tuple]) -> bool:
    """Whether a run or a group goes on from one token to the next."""
    return _single(left) and _single(right) or _joined(left, right, cost, memo)


def _joined(left: str, right: str, cost: list, memo: dict[str, tuple]) -> bool:
    known: dict[str, bool] = memo.setdefault("", {})  # no token is empty
    key = left[-2:] + " " + right[:2]
    join = known.get(key)
    if join is None:
        if len(known) >= MEMO:
            known.clear()
        join = known[key] = _joins(left[-2:], right[:2], cost)
    return join


def _runs(text: str, tokens: list[str], cost: list, memo: dict[str, tuple],
          wanted: bytes | None = None) -> Iterator[tuple[list[str], list[str]]]:
    """Words of what is spaced out: the likeliest reading's, which count, and more.

    That is three or more single characters in a row; and groups of letters
    whose gaps the model takes for no word ends, which give no more than more.
    With `wanted`, a byte for each token, only runs and groups that hold a wanted one are read.
    """
    gaps: list[str] = []
    n, single, group = len(tokens), 0, 0
    for i in range(n):
        w = tokens[i]
        after = tokens[i + 1] if i + 1 < n else ""
        if len(w) > 1 or not (_single(w) and _single(after)):
            at, single = single, i + 1
            run = tokens[at:i + 1]
            if len(run) >= 3 and len(set(run)) > 1 and (wanted is None or any(wanted[at:i + 1])):
                gaps = gaps or re.findall(r"\s+", text.strip())
                said = [[x for x in r.split() if len(x) > 1] for r in _spaced(run, gaps[at:i], cost)]
                yield said[0], [x for r in said[1:] for x in r]
        if _joined(w, after, cost, memo):
            continue
        at, group = group, i + 1
        if at == i or wanted is not None and not any(wanted[at:i + 1]):
            continue
        run = tokens[at:i + 1]
        shortest = min(map(len, run))
        if shortest > 1:
            # Each gap is decided; the whole is read as one token, and so are its parts that may be a word.
            wholes = {"".join(run)}
            for k in range(len(run) - 1 if len(run) > 2 else 0):
                part = run[k]
                for x in run[k + 1:]:
                    part += x
                    if len(part) > LONGEST:
                        break
                    wholes.add(part)
            for whole in wholes:
                if not whole.isdigit():
                    yield [], [whole] if _plain(whole) else [x for r in readings(whole, cost) for x in r]
        elif max(map(len, run)) > 1 and not "".join(run).isdigit():
            gaps = gaps or re.findall(r"\s+", text.strip())
            yield [], [x for r in _spaced(run, gaps[at:i], cost) for x in r.split() if len(x) > 1]


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) > n]


def count_features(start: str, n: int, of: int) -> list[str]:
    """What n words beginning with `start` among `of` words show: two, three, or one in a hundred."""
    return [f"{start}*{k}" for k in (2, 3) if n >= k] + ([f"{start}*%"] if 100 * n >= of else [])


def features(words: Words) -> set[str]:
    """The restored words, and the beginnings that many first readings share: a stem under any ending."""
    counts: dict[str, int] = {}
    for w in words.first:
        for start in beginnings(w):
            counts[start] = counts.get(start, 0) + 1
    return words.union(x for start, n in counts.items() for x in count_features(start, n, len(words.first)))


def _alike() -> tuple[np.ndarray, np.ndarray]:
    """What each character is taken as when it stands for a letter, and when leet marks stand for none; 0 is nothing.

    Letters that one leet character may stand for are one, so whatever the
    lattice reads looks like what it is read from.
    """
    as_letter = np.array([c if chr(c).isalnum() else 0 for c in range(0x110000)], dtype=np.uint32)
    first = {}
    for letters in LEET.values():
        for x in letters:
            first[x] = min(first.get(x, x), first.get(letters[0], letters[0]))
    for x, y in first.items():
        as_letter[ord(x)] = ord(y)
    dropped = as_letter.copy()
    for c, letters in LEET.items():
        as_letter[ord(c)] = ord(first[letters[0]])
        dropped[ord(c)] = as_letter[ord(c)] if c.isalnum() else 0
    return as_letter, dropped


class Sieve:
    """Where a text may hold one of some strings in any reading; nothing is decoded to find out.

    Text and strings are reduced alike: characters taken as letters, whatever
    separates left out, repeats made one. A reading substitutes letters that are
    taken alike and drops separators and repeats, so if it holds a string, the
    reduced text holds the reduced string. A leet mark may be a letter or
    nothing: the text is reduced both ways, and where two marks stand so near
    that one word might take them differently, the place is kept.
    """

    def __init__(self, strings: set[str]) -> None:
        import ahocorasick
        self.as_letter, self.dropped = _alike()
        self.automaton, self.longest = ahocorasick.Automaton(), 0
        self.all = False
        for x in strings:
            key = self._reduced(_points(x), self.as_letter)[1]
            self.all |= not key or len(set(x) & LEET.keys() - set("0123456789")) > 0
            if key:
                self.automaton.add_word(key, len(key))
                self.longest = max(self.longest, len(key))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    @staticmethod
    def _reduced(points: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, str]:
        taken = table[points]
        at = np.flatnonzero(taken)
        letters = taken[at]
        if len(at):
            new = np.ones(len(at), dtype=bool)
            new[1:] = letters[1:] != letters[:-1]
            at, letters = at[new], letters[new]
        return at, letters.tobytes().decode("utf-32-le", "surrogatepass")

    def places(self, text: str) -> list[tuple[int, int]]:
        """Spans of a folded text, first and last character, outside of which no reading holds a string."""
        if self.all:
            return [(0, len(text))]
        if self.empty:
            return []
        points, out = _points(text), []
        marks = self.as_letter[points] != self.dropped[points]
        for table in (self.as_letter, self.dropped) if marks.any() else (self.dropped,):
            at, reduced = self._reduced(points, table)
            found = [(end - n + 1, end + 1) for end, n in self.automaton.iter(reduced)]
            if not found:
                continue
            # A word begins at the text's start or after what is no letter or digit. Of equal letters any may be the first.
            plain = self.dropped[points] > 0
            begins = table[points] > 0
            begins[1:] &= ~plain[:-1]
            so_far, at = np.concatenate([[0], np.cumsum(begins)]), np.append(at, len(text) + 1)
            for first, after in found:
                if so_far[min(at[first + 1], len(text))] > so_far[at[first]]:
                    out.append((int(at[first]), int(at[after]) - 1))
        where = np.flatnonzero(marks)
        if len(where) > 1:
            at, _ = self._reduced(points, self.as_letter)
            # Equal marks side by side are one; the rest is measured in letters.
            where = where[np.concatenate([[True], (np.diff(where) > 1) | (points[where[1:]] != points[where[:-1]])])]
            place = np.searchsorted(at, where, side="right") - 1
            near = np.diff(place) <= self.longest + 1
            for k in np.flatnonzero(near):
                low, high = max(0, place[k] - self.longest), min(len(at) - 1, place[k + 1] + self.longest + 1)
                out.append((int(at[low]), int(at[high]) if high < len(at) - 1 else len(text)))
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Scorer:
    """What a fit leaves: the character model and the weight of each feature."""

    cost: list
    weight: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.starts = {x[:x.rindex("*")] for x in self.weight if "*" in x}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def keep(self) -> tuple[Sieve, dict, dict]:
        """The sieve and what is remembered of words, which a worker process keeps from task to task."""
        if "kept" not in self.__dict__:
            self.kept = self.sieve(), {}, {}
        return self.kept

    def sieve(self) -> Sieve:
        return Sieve({x for x in self.weight if "*" not in x} | self.starts)

    def score(self, words: Words, known: dict[str, tuple[str, ...]], common: Callable[[int], bool] | None = None) -> float:
        """`known` keeps which weighted beginnings a word has; `common` says if n first readings are one in a hundred."""
        found, counts = [self.bias], {}
        for w in words:
            if w in self.weight:
                found.append(self.weight[w])
        for w in words.first:
            f = known.get(w)
            if f is None:
                if len(known) >= MEMO:
                    known.clear()
                f = known[w] = tuple(x for x in beginnings(w) if x in self.starts)
            for start in f:
                counts[start] = counts.get(start, 0) + 1
        for start, n in counts.items():
            found += [self.weight[x] for x in count_features(start, n, 0) if x in self.weight and (x[-1] != "%" or (
                common(n) if common else 100 * n >= len(words.first)))]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, math.fsum(found)))))

    def score_text(self, text: str | None, sieve: Sieve, memo: dict[str, tuple], known: dict[str, tuple[str, ...]]) -> float:
        """The score of `restored_words(text)`, but only what the sieve finds is decoded."""
        folded = fold(text) if text else ""
        spans = sieve.places(folded)
        if not spans:
            return self.score(Words(), known)
        tokens, starts = folded.split(), [m.start() for m in TOKEN.finditer(folded)]
        wanted = bytearray(len(tokens))
        for first, last in spans:
            a, b = max(0, bisect_right(starts, first) - 1), bisect_right(starts, last)
            wanted[a:b] = b"\1" * (b - a)
        out, others = set(), set()
        for w in {tokens[k] for k in range(len(tokens)) if wanted[k]}:
            if len(w) > 1:
                r = memo.get(w) or _remember(w, self.cost, memo)
                out.update(r[0])
                others.update(r[1])
        done, n = 0, len(tokens)
        for k in range(n):
            if k < done or not wanted[k]:
                continue
            low = done = k
            while low and _linked(tokens[low - 1], tokens[low], self.cost, memo):
                low -= 1
            while done < n - 1 and _linked(tokens[done], tokens[done + 1], self.cost, memo):
                done += 1
            done += 1
            if done - low > 1:
                part = folded[starts[low]:starts[done - 1] + len(tokens[done - 1])]
                for first, more in _runs(part, tokens[low:done], self.cost, memo, wanted[low:done]):
                    out.update(first)
                    others.update(more)
        least = total = None

        def common(n: int) -> bool:
            """Plain words are read as themselves, so there are as many first readings at least."""
            nonlocal least, total
            if least is None:
                least = sum(len(w) > 1 and w.isalpha() and _plain(w) for w in set(tokens))
            if 100 * n < least:
                return False
            if total is None:
                total = len(restored_words(text, self.cost, memo).first)
            return 100 * n >= total

        return self.score(Words(out, others), known, common)


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Scorer:
    """Learn the character model from all `docs(doc_id, text)` and the weights from `labelled(doc_id, label)`.

    At most `max_labelled` labelled rows, the first by a hash of doc_id, are
    used; texts that are equal count once. Features come from counts over them;
    the `MAX_FEATURES` with the strongest positive association go to the driver,
    with each text's list of them. Without labelled rows of both kinds all
    weights are 0 and the score is the smoothed share of label 1. A doc_id with
    two labels has the larger; null and empty texts teach that no feature stands
    there; rows of a null doc_id or label teach nothing.
    """
    cost = log_model(char_model(docs)).tolist()
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(cost, {}, 0.0))
    known = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = first_by_hash(known, F.xxhash64("doc_id"), max_labelled, "labelled")
    # Broadcast: at most max_labelled rows of 12 bytes.
    texts = (docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
             .join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).select("doc_id", "label", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shared.value.keep()[1]
        for b in batches:
            for i, y, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
                found = sorted(features(restored_words(text, shared.value.cost, memo)))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()),
                                                  pa.array([found], pa.list_(pa.string()))], names=["doc_id", "label", "found"])

    spread = texts.mapInArrow(run, "doc_id long, label int, found array<string>")
    # A text counts once: its copies must not vote for all its words.
    once = spread.groupBy(F.xxhash64("found").alias("h")).agg(F.max("label").alias("label"), F.first("found").alias("found"))
    once = materialise(once, "toxicity")
    n1, n = once.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    prior = (n1 + 1) / (n + 2)
    if not 0 < n1 < n:
        release(once)
        return Scorer(cost, {}, math.log(prior / (1 - prior)))
    counts = (once.select("label", F.explode("found").alias("x")).groupBy("x")
              .agg(F.sum("label").alias("p"), F.count("*").alias("c")).where(f"p >= 3 and p * {n} > c * {2 * n1}"))
    odds = F.col("p") * F.log(F.col("p") * n / (F.col("c") * n1))
    top = counts.orderBy(odds.desc(), "x").limit(MAX_FEATURES).select("x")
    number = {r["x"]: k for k, r in enumerate(top.collect())}
    kept = F.broadcast(top.withColumnRenamed("x", "y"))  # MAX_FEATURES rows at most
    rows = (once.select("h", "label", F.explode("found").alias("x")).join(kept, F.col("x") == F.col("y"))
            .groupBy("h", "label").agg(F.collect_list("x").alias("xs")).select("label", "xs").collect())
    weight, bias = _logistic([(r["label"], [number[x] for x in r["xs"]]) for r in rows], n1, n, list(number))
    release(once)
    return Scorer(cost, weight, bias)


def _logistic(rows: list[tuple[int, list[int]]], n1: int, n: int, names: list[str]) -> tuple[dict[str, float], float]:
    """L2 logistic weights over a cover of features.

    The cover is picked greedily: the feature that tells most of the label-1
    texts told by fewer than COVER features so far, until none tells three. One
    that is too imprecise is passed over. So words that merely come along in
    many near copies of one text get no weight.
    """
    docs_of: list[list[int]] = [[] for _ in names]
    label = np.array([y for y, _ in rows] or [0])
    for d, (_, xs) in enumerate(rows):
        for x in xs:
            docs_of[x].append(d)
    own = [np.array(d, dtype=np.int64) for d in docs_of]
    bad = np.array([int((label[d] == 0).sum()) for d in own])
    told, chosen = np.where(label == 1, 0, COVER), []
    rate = n1 / n
    while True:
        left = np.array([int((told[d] < COVER).sum()) for d in own])
        left[chosen] = 0
        gain = left * np.log((left + 0.5) / (left + bad + 1) / rate)
        gain[(left < 3) | (left < 2 * bad) | (gain < 5)] = -np.inf
        k = int(np.argmax(gain)) if len(gain) else -1
        if k < 0 or gain[k] == -np.inf:
            break
        chosen.append(k)
        told[own[k]] += 1
    m = len(chosen)
    x = np.zeros((len(rows), m + 1))
    for c, k in enumerate(chosen):
        x[own[k], c] = 1
    x[:, m] = 1
    # Texts without any feature are alike: one weighted row for each label.
    x = np.vstack([x, np.zeros((2, m + 1))])
    x[-2:, m] = 1
    y = np.r_[label[:len(rows)], 1, 0]
    seen1 = int(label[:len(rows)].sum())
    w = np.r_[np.ones(len(rows)), n1 - seen1 + 0.5, n - len(rows) - (n1 - seen1) + 0.5]
    beta = np.zeros(m + 1)
    ridge = np.r_[np.full(m, 0.05), 1e-3]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    # A feature never seen without label 1 speaks for itself, with its smoothed precision, where it stands alone.
    own_right = {k: np.log(len(own[k]) + 0.5) - np.log(0.5) - beta[m] for k in chosen if not bad[k]}
    return {names[k]: float(max(beta[c], own_right.get(k, beta[c]))) for c, k in enumerate(chosen)}, float(beta[m])


def toxicity_scores(docs: DataFrame, scorer: Scorer, score: str = "toxicity") -> DataFrame:
    """`docs` with a double column `score` in 0..1, from the whole restored text alone.

    Null and empty texts have the score of a text without any feature. Rows are
    scored one by one, so repeated rows have equal scores; an empty table gives
    an empty result. A column of that name gives way; others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    columns = [c for c in docs.columns if c.lower() != score.lower()]
    text = fresh(["_llm_text"], columns)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        s = shared.value
        sieve, memo, known = s.keep()
        for b in batches:
            out = [s.score_text(t.as_py(), sieve, memo, known) for t in b.column(text)]
            yield b, [pa.array(out, pa.float64())]

    with_text = docs.select(*columns, F.col("text").cast("string").alias(text))
    out, (name,) = append_columns(with_text, [T.StructField("llm_score", T.DoubleType())], run)
    return out.select(*columns, F.col(name).alias(score))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train_labels(labels: DataFrame, of: str) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col(of).alias("label"))
