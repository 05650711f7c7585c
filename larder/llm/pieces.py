"""SentencePiece BPE encoding by a table of each prefix's last token.

The encoding of a prefix is the encoding of a shorter one and one more token,
so each prefix has one last token. An automaton over the vocabulary names the
tokens that end at a place; of these exactly one agrees with the last token of
the prefix before it, that is, merging the two texts side by side leaves both
tokens. Walking back from the end gives the ids. Time is linear in the text
whatever its length; merges are only replayed for pairs of tokens not met yet.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import append_columns, fresh, slices

# Fixed by the model format: the mark for a space, piece types, and the only trainer this reads.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Chunks and token pairs that a task remembers.
MEMO_CHUNKS, MEMO_PAIRS = 400_000, 500_000
#: A character that no piece contains.
_STRANGE = -1


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buf[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    at = 0
    while at < len(buf):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = buf[at:at + n], at + n
        yield key >> 3, value


@dataclass
class PieceModel:
    """Pieces of a model file with scores and types, and the ids of bytes and of the end."""

    texts: list[str]
    scores: list[float]
    types: list[int]
    end_id: int
    byte_ids: list[int] = field(init=False)

    def __post_init__(self) -> None:
        at = {t: i for i, t in enumerate(self.texts) if self.types[i] == BYTE}
        self.byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)]


def read_model(path: str) -> PieceModel:
    """A BPE model with byte fallback and identity normalisation; others raise ValueError."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    trainer, norm = (dict(_fields(next((v for n, v in message if n == k), b""))) for k in (2, 3))
    pieces = [dict(_fields(v)) for n, v in message if n == 1]
    types = [p.get(3, NORMAL) for p in pieces]
    wrong = {"not a BPE model": trainer.get(3, 1) != BPE, "no byte fallback": not trainer.get(35, 0),
             "characters are normalised": bool(norm.get(2)), "no leading space mark": not norm.get(3, 1),
             "spaces are removed": bool(norm.get(4, 1)), "spaces are not escaped": not norm.get(5, 1),
             "the space mark ends words": bool(trainer.get(24, 0)), "user-defined or unused pieces": bool({USER, UNUSED} & set(types))}
    if any(wrong.values()):
        raise ValueError(f"{path}: " + ", ".join(k for k, v in wrong.items() if v))
    return PieceModel([p[1].decode() for p in pieces], [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces],
                      types, trainer.get(42, 2))


@dataclass
class Merges:
    """What merging needs of a model: symbols are its normal pieces and their characters.

    `made[s]` is the cost of the merge that makes a symbol (the less, the
    earlier; -inf for a character) and `halves[s]` the two symbols it merges.
    """

    ids: dict[str, int]
    made: list[float]
    halves: list[tuple[int, int]]
    joins: dict[tuple[int, int], int]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the texts of a and b side by side leaves both.

        Goes back in time over the symbols that met at the seam. The pair that
        met until some merge ended it must not itself have been the next one.
        """
        until_a = until_b = inf
        while True:
            joint = self.joins.get((a, b))
            if joint is not None and self.made[joint] < until_a and self.made[joint] <= until_b:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a > made_b:
                until_a, a = made_a, self.halves[a][1]
            elif made_b > -inf:  # of equal merges the right one came later
                until_b, b = made_b, self.halves[b][0]
            else:
                return True


def compile_merges(model: PieceModel) -> Merges:
    """Symbols in the order of ids, then characters that are no piece.

    A piece that its own text does not merge into can never be the result and
    is left out. Raises ValueError if a piece is made of pieces dearer than it.
    """
    normal = {t: i for i, t in enumerate(model.texts) if model.types[i] == NORMAL}
    ids = dict(normal)
    for c in sorted({c for t in normal for c in t} - normal.keys()):
        ids[c] = len(model.texts) + len(ids) - len(normal)
    made = [-inf] * (len(model.texts) + len(ids) - len(normal))
    for t, i in normal.items():
        made[i] = -model.scores[i] if len(t) > 1 else -inf
    halves, joins = [(-1, -1)] * len(made), {}
    for t, i in normal.items():
        for k in range(1, len(t)):
            a, b = ids.get(t[:k]), ids.get(t[k:])
            if a is not None and b is not None:
                joins[a, b] = i
    kept = {}
    for t, i in ids.items():
        if len(t) > 1:
            last = _last_merge([ids[c] for c in t], joins, made)
            if last is None or joins[last] != i:
                continue
            if max(made[last[0]], made[last[1]]) > made[i]:
                raise ValueError(f"piece {t!r} is made of later pieces")
            halves[i] = last
        kept[t] = i
    return Merges(kept, made, halves, joins)


def _last_merge(symbols: list[int], joins: dict[tuple[int, int], int], made: list[float]) -> tuple[int, int] | None:
    """The pair merged last when a word's symbols are merged, None if more than one symbol is left."""
    pair = None
    while len(symbols) > 1:
        best = min(((made[joins[p]], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in joins), default=None)
        if best is None:
            return None
        k = best[1]
        pair = symbols[k], symbols[k + 1]
        symbols = [*symbols[:k], joins[pair], *symbols[k + 2:]]
    return pair


class _Memo(dict):
    """Numbers of chunks; one that is not known yet is learnt."""

    def __init__(self, learn: Callable[[str], int]) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = self.learn(chunk)
        return k


class _Any(dict):
    """What may follow the start, or a character that no piece contains: every token."""

    def __missing__(self, token: int) -> bool:
        return True


class _Row(dict):
    """Whether each token met so far may follow token `a`."""

    __slots__ = ("a", "encoder")

    def __init__(self, a: int, encoder: Encoder) -> None:
        super().__init__()
        self.a, self.encoder = a, encoder

    def __missing__(self, token: int) -> bool:
        e = self.encoder
        if e.pairs >= MEMO_PAIRS:
            for row in e.rows:
                row.clear()
            e.pairs = 0
        e.pairs += 1
        fits = self[token] = e.merges.compatible(self.a, token)
        return fits


class Encoder:
    """Encodes texts in one task; remembers the ids of chunks and the pairs of tokens that agree."""

    def __init__(self, model: PieceModel, merges: Merges) -> None:
        import ahocorasick
        self.model, self.merges = model, merges
        self.length = [1] * len(merges.made)
        self.automaton = ahocorasick.Automaton()
        for t, i in merges.ids.items():
            self.automaton.add_word(t, (i, len(t) - 1))
            self.length[i] = len(t)
        self.automaton.make_automaton()
        chars = sorted({c for t in merges.ids for c in t})
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        at = {c: k + 1 for k, c in enumerate(chars)}
        self.meet = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for t in merges.ids:
            for a, b in zip(t, t[1:]):
                self.meet[at[a], at[b]] = True
        self.any, self.rows = _Any(), [_Row(i, self) for i in range(len(merges.made))]
        self.pairs = 0
        self._forget()

    def _forget(self) -> None:
        self.chunks = _Memo(self._learn)
        self.tokens, self.starts = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64)

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, the end id last."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end."""
        if len(self.chunks) >= MEMO_CHUNKS:
            self._forget()
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        chunks, first = self._chunks(marked)
        number = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        from_ = self.starts[number]
        count = self.starts[number + 1] - from_
        # The end ids stand between the texts: a text's tokens are put behind those of the texts before it.
        so_far = np.concatenate([[0], np.cumsum(count)])
        offsets = so_far[first] + np.arange(len(texts) + 1)
        out = np.full(offsets[-1], self.model.end_id, dtype=np.int32)
        source = np.arange(so_far[-1]) + np.repeat(from_ - so_far[:-1], count)
        out[np.arange(so_far[-1]) + np.repeat(np.arange(len(texts)), np.diff(so_far[first]))] = self.tokens[source]
        return out, offsets

    def _chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The texts cut between characters that meet in no piece, where nothing can merge; and where each text's chunks begin."""
        whole, ends = "".join(texts), np.cumsum([0, *map(len, texts)])
        k = self.class_of[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        cut = np.ones(len(whole) + 1, dtype=bool)
        cut[1:-1] = ~self.meet[k[:-1], k[1:]]
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        at = cuts.tolist()
        return [whole[a:b] for a, b in zip(at, at[1:])], np.searchsorted(cuts, ends)

    def _learn(self, chunk: str) -> int:
        """Keeps a chunk's ids in `tokens` from `starts[k]` to `starts[k + 1]`; k is its number."""
        ids, k = self._ids(chunk), len(self.chunks)
        if k + 2 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (k + 2))
        at = self.starts[k]
        if at + len(ids) > len(self.tokens):
            self.tokens = np.resize(self.tokens, 2 * (at + len(ids)))
        self.tokens[at:at + len(ids)] = ids
        self.starts[k + 1] = at + len(ids)
        return k

    def last_tokens(self, chunk: str) -> list[int]:
        """The last token of each prefix but the empty one."""
        last, fits = [_STRANGE] * len(chunk), [self.any] * (len(chunk) + 1)
        rows, done = self.rows, -1
        for end, (token, before) in self.automaton.iter(chunk):
            if end != done and fits[end - before][token]:
                last[end], fits[end + 1], done = token, rows[token], end
        return last

    def _ids(self, chunk: str) -> list[int]:
        last, at, back = self.last_tokens(chunk), len(chunk) - 1, []
        while at >= 0:
            token = last[at]
            if 0 <= token < len(self.model.texts):
                back.append(token)
            else:
                back += [self.model.byte_ids[b] for b in reversed(chunk[at].encode("utf-8", "surrogatepass"))]
            at -= self.length[token] if token != _STRANGE else 1
        return back[::-1]


class _Shared:
    """A model as it is broadcast; a worker process keeps one encoder, with what it remembers, for all its tasks."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.merges = model, compile_merges(model)

    def __getstate__(self) -> dict:
        return {"model": self.model, "merges": self.merges}

    def encoder(self) -> Encoder:
        if not hasattr(self, "_encoder"):
            self._encoder = Encoder(self.model, self.merges)
        return self._encoder


class Decoder:
    """Texts of ids: pieces side by side, space marks as spaces but the first, bytes read as UTF-8."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        # The unknown id's surface is fixed by the model format.
        said = {NORMAL: None, UNKNOWN: " ⁇ ", CONTROL: "", BYTE: ""}
        self.said = [t.replace(SPACE, " ") if said[k] is None else said[k] for t, k in zip(model.texts, model.types)]
        self.byte_of = {i: b for b, i in enumerate(model.byte_ids)}

    def decode(self, ids: list[int]) -> str:
        said, byte_of = self.said, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            out = [said[i] for i in ids]
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                    out.append("")
                    continue
                if run:
                    out[-1], run = _utf8(bytes(run)), bytearray()
                out.append(said[i])
            if run:
                out[-1] = _utf8(bytes(run))
        # The mark at the start of the first piece that says something is no space of the text.
        first = next((k for k, s in enumerate(out) if s), None)
        if first is not None and self.model.types[ids[first]] == NORMAL and out[first][0] == " ":
            out[first] = out[first][1:]
        return "".join(out)


def _utf8(run: bytes) -> str:
    """UTF-8 as far as it is valid; each byte that belongs to no character gives U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at:at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_texts(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the ids of each whole `text` as `array<int>`, the end id last.

    Null and empty texts give the end id alone. Rows pass through one by one and
    without a shuffle: repeated rows give equal ids, an empty table an empty
    result. A column called `ids` gives way, others stay whatever their names.
    What is sent to the workers is the model, as large as its vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_Shared(model))
    keep = [c for c in docs.columns if c.lower() != ids.lower()]
    work = fresh(["llm_text"], keep)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        encoder = shared.value.encoder()
        for b in slices(batches, 128):
            values, offsets = encoder.encode_all(b.column(work).to_pylist())
            yield b, [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))]

    given = docs.select(*keep, F.col(text).cast("string").alias(work))
    out, (name,) = append_columns(given, [T.StructField("llm_ids", T.ArrayType(T.IntegerType()))], run)
    return out.select(*keep, F.col(name).alias(ids))


def decode_ids(rows: DataFrame, model: PieceModel, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`rows` with the text of each list of ids as `text`.

    A null list gives an empty text; null ids in it say nothing, and an id that
    the model doesn't have fails the job. A column called `text` gives way.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c.lower() != text.lower()]
    work = fresh(["llm_ids"], keep)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        decoder = Decoder(shared.value)
        for b in slices(batches, 128):
            lists = b.column(work)
            said = [decoder.decode(x.values.drop_null().to_numpy().tolist()) if x.is_valid else "" for x in lists]
            yield b, [pa.array(said, pa.string())]

    given = rows.select(*keep, F.col(ids).cast("array<int>").alias(work))
    out, (name,) = append_columns(given, [T.StructField("llm_said", T.StringType())], run)
    return out.select(*keep, F.col(name).alias(text))
