"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is a vector of its
hashed tag path (tags, classes, ids, roles of all open elements) and its hashed
words; a bidirectional LSTM in numpy reads the whole sequence both ways and
labels every block main text or not.

The labeller is trained on a bounded sample of the table's own pages. Their
labels come from markup that names its purpose (article, nav, footer, class
"comments" ...); each sampled page is also seen with the article in another
container and with boilerplate of other kinds put in, so that a label does not
hang on one page layout.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import append_columns, first_by_hash, fresh

#: Bounds of the fit: distinct pages; blocks of a window, and windows of a longer page, its first and last blocks among them.
SAMPLE_PAGES, TRAIN_BLOCKS, TRAIN_WINDOWS = 300, 96, 8
PATH_DIM, WORD_DIM, HIDDEN = 96, 32, 24
EPOCHS, PAGES_A_STEP, RATE = 10, 24, 0.01

# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output "
                   "progress q ruby rp rt s samp small span strike strong sub sup svg time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe xmp noembed noframes".split())
SAME_CLOSES = frozenset("li dt dd tr td th option thead tbody tfoot".split())
NOT_MAIN_TAGS = frozenset("head nav footer aside form header menu dialog button select fieldset title textarea noscript".split())
MAIN_TAGS = frozenset("article main".split())
NOT_MAIN_NAMES = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "widget footer header masthead cookie cookies consent notice alert popup modal overlay comment comments respond "
    "disqus share social related recommended newsletter subscribe signup login search pagination pager toolbar hidden".split())
MAIN_NAMES = frozenset("content article post entry story main".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_OPEN_END = re.compile(r"<[a-zA-Z/!?][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # "tag" and "tag.name" of every open element, outermost first


@dataclass
class _Open:
    tag: str
    names: list[str] = field(default_factory=list)


def _names(attributes: str) -> list[str]:
    out: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if kind == "style":
            out += ["hidden"] * ("display:none" in value.replace(" ", ""))
        elif kind in ("hidden", "aria-hidden"):
            out += ["hidden"] * (kind == "hidden" or value == "true")
        else:
            out += _NAME.findall(value)
    return out


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: references decoded, white space one space, empty ones left out."""
    if not page:
        return []
    page = _OPEN_END.sub("", page)
    out: list[Block] = []
    stack: list[_Open] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            out.append(Block(text, tuple(x for e in stack for x in [e.tag, *[f"{e.tag}.{n}" for n in e.names]])))

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        held.append(page[at:m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                held.append(" " if tag != "wbr" else "")
            continue
        flush()
        if m.group(1):
            close(tag)
            continue
        if stack and any(e.tag == "p" for e in stack):
            close("p")
        if tag in SAME_CLOSES and stack and stack[-1].tag in SAME_CLOSES:
            close(tag)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag in ("title", "textarea") and end:
                stack.append(_Open(tag, _names(m.group(3))))
                held.append(page[at:end.start()])
                flush()
                stack.pop()
            at = end.end() if end else len(page)
            continue
        if tag not in VOID and not m.group(3).endswith("/"):
            stack.append(_Open(tag, _names(m.group(3))))
    flush()
    return out


# ---- labels from markup ---------------------------------------------------

def named_label(path: tuple[str, ...], scoped: bool) -> bool:
    """Main text, by what the markup calls itself. scoped: the page has an article or main element."""
    inside = False
    for x in path:
        tag, _, name = x.partition(".")
        if name in NOT_MAIN_NAMES or (not name and tag in NOT_MAIN_TAGS and not (tag == "header" and inside)):
            return False
        inside |= tag in MAIN_TAGS or name in MAIN_NAMES
    return inside or not scoped


_CONTAINERS = (("article",), ("main",), ("main", "article"), ("div", "div.content"), ("div", "div.post"), ("div", "div.entry"),
               ("section", "section.story"), ("article", "article.post"))
_EXTRA = (("aside",), ("div", "div.sidebar"), ("div", "div.comments"), ("section", "section.comments", "div", "div.comment"),
          ("article", "div", "div.comments"), ("article", "aside"), ("form",), ("div", "div.cookie", "div.notice"), ("header",),
          ("header", "div", "div.banner"), ("div", "div.ad"), ("article", "div", "div.ad"), ("article", "div", "div.share"),
          ("div", "div.related"), ("footer", "div"), ("div", "div.menu"), ("div", "div.newsletter"), ("article", "form"),
          ("div", "div.alert"), ("div", "div.promo"), ("section", "section.respond"), ("article", "footer"),
          ("article", "section", "section.comments"), ("article", "div", "div.related"), ("article", "nav"), ("article", "aside", "div"))
_INNER = (("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("h2",), ("h3",), ("table", "tr", "td"), ("pre",), ("div",),
          ("figure", "figcaption"), ("dl", "dd"), ("section", "p"), ("div", "p"), ("section", "h2"))


def _varied(page: list[Block], other: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with its article in another container, some paragraphs as other blocks, and boilerplate of other kinds put in."""
    box = _CONTAINERS[rng.integers(len(_CONTAINERS))]
    out = []
    for b in page:
        path: list[str] = []
        for x in b.path:
            path += list(box) if x == "article" else [x]
        if path[-1] == "p" and rng.random() < 0.2:
            path[-1:] = _INNER[rng.integers(len(_INNER))]
        out.append(Block(b.text, tuple(path)))
    for _ in range(rng.integers(1, 4)):
        extra = _EXTRA[rng.integers(len(_EXTRA))]
        said = [other[k].text for k in rng.integers(0, len(other), rng.integers(1, 4))] if other else ["more"]
        at = int(rng.integers(0, len(out) + 1))
        inner = ("ul", "li") if rng.random() < 0.3 else ("p",) if rng.random() < 0.7 else ()
        head = tuple(x for e in extra for x in (box if e == "article" else (e,)))
        out[at:at] = [Block(t, ("html", "body", *head, *inner)) for t in said]
    return out


# ---- vectors --------------------------------------------------------------

def vector(b: Block, memo: dict[tuple[str, ...], np.ndarray]) -> np.ndarray:
    """Hashed tag path (three places for each step, twice for the last), hashed words, and lengths."""
    path = memo.get(b.path)
    if path is None:
        if len(memo) > 50_000:
            memo.clear()
        path = np.zeros(PATH_DIM)
        for x in dict.fromkeys(b.path):
            h = zlib.crc32(x.encode())
            for k in (h % PATH_DIM, (h >> 8) % PATH_DIM, (h >> 16) % PATH_DIM):
                path[k] += 1 if h >> 30 & 1 else -1
        memo[b.path] = path
    words = b.text.split()
    v = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM for w in words], minlength=WORD_DIM) / np.sqrt(len(words))
    return np.concatenate([path, 0.2 * v, [np.log1p(len(words)) / 5, b.text[-1:] in ".!?", 1.0]])


DIM = PATH_DIM + WORD_DIM + 3


# ---- bidirectional LSTM ---------------------------------------------------

@dataclass
class Labeller:
    """Weights of the two directions (input, state, bias) and of the output."""

    w: list[np.ndarray]

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """x: (blocks, pages, DIM), mask: (blocks, pages)."""
        f, _ = _lstm(x, mask, *self.w[0:3])
        b, _ = _lstm(x[::-1], mask[::-1], *self.w[3:6])
        return np.concatenate([f, b[::-1]], axis=2) @ self.w[6] + self.w[7]

    def label(self, pages: list[list[Block]], memo: dict) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            take = order[-max(1, min(256, 20_000 // longest)):]
            order = order[:len(order) - len(take)]
            x, mask = _padded([[vector(b, memo) for b in pages[k]] for k in take])
            z = self.logits(x, mask)
            for c, k in enumerate(take):
                out[k] = z[:len(pages[k]), c] > 0
        return out


def _padded(pages: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), DIM))
    mask = np.zeros(x.shape[:2])
    for c, p in enumerate(pages):
        x[:len(p), c] = p
        mask[:len(p), c] = 1
    return x, mask


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    h = np.zeros((x.shape[1], HIDDEN))
    c = np.zeros_like(h)
    zx = x @ wx + b
    out, tape = np.zeros((*x.shape[:2], HIDDEN)), []
    for t in range(len(x)):
        z = zx[t] + h @ wh
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        c_new = f * c + i * g
        s = np.tanh(c_new)
        tape.append((h, c, i, f, o, g, s, m))
        h, c = m * (o * s) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out, tape


def _lstm_back(d_out: np.ndarray, x: np.ndarray, tape: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
    d_wh = np.zeros_like(wh)
    dh_next = np.zeros(d_out.shape[1:])
    dc_next = np.zeros_like(dh_next)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, s, m = tape[t]
        dh = d_out[t] + dh_next
        dc = m * (dc_next + dh * o * (1 - s * s))
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), m * dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        d_wh += h.T @ dz
        dh_next = dz @ wh.T + (1 - m) * dh
        dc_next = dc * f + (1 - m) * dc_next
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, DIM).T @ flat, d_wh, flat.sum(axis=0)


def train(pages: list[list[Block]], labels: list[np.ndarray], seed: int = 6) -> Labeller:
    """Cross entropy over all blocks of the sample, by Adam."""
    rng = np.random.default_rng(seed)
    w: list[np.ndarray] = []
    for _ in range(2):
        w += [rng.normal(0, 1 / np.sqrt(DIM), (DIM, 4 * HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)),
              np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]]
    w += [rng.normal(0, 1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN), np.zeros(1)]
    memo: dict = {}
    vectors = [[vector(b, memo) for b in p] for p in pages]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    by_size = np.argsort([len(p) for p in pages], kind="stable")
    groups = [by_size[k:k + PAGES_A_STEP] for k in range(0, len(by_size), PAGES_A_STEP)]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 5e-4
        for k in rng.permutation(len(groups)):
            x, mask = _padded([vectors[p] for p in groups[k]])
            y = np.zeros(mask.shape)
            for c, p in enumerate(groups[k]):
                y[:len(labels[p]), c] = labels[p]
            f, tape_f = _lstm(x, mask, *w[0:3])
            b, tape_b = _lstm(x[::-1], mask[::-1], *w[3:6])
            both = np.concatenate([f, b[::-1]], axis=2)
            d = mask * (_sigmoid(both @ w[6] + w[7]) - y) / mask.sum()
            d_both = d[:, :, None] * w[6]
            grad = [*_lstm_back(d_both[:, :, :HIDDEN], x, tape_f, w[1]),
                    *_lstm_back(d_both[::-1, :, HIDDEN:], x[::-1], tape_b, w[4]),
                    np.einsum("tb,tbh->h", d, both), np.array([d.sum()])]
            step += 1
            for q in range(len(w)):
                g = np.clip(grad[q], -1, 1)
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                w[q] = w[q] - rate * (m[q] / (1 - 0.9 ** step)) / (np.sqrt(v[q] / (1 - 0.999 ** step)) + 1e-8)
    return Labeller(w)


def _windows(page: list[Block]) -> list[list[Block]]:
    """A page in windows of TRAIN_BLOCKS at most, whole if it fits; its first and last blocks are in one."""
    if len(page) <= TRAIN_BLOCKS:
        return [page] if page else []
    n = min(TRAIN_WINDOWS, -(-len(page) // TRAIN_BLOCKS))
    return [page[at:at + TRAIN_BLOCKS] for at in np.linspace(0, len(page) - TRAIN_BLOCKS, n).astype(int)]


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, seed: int = 6) -> Labeller | None:
    """Train on at most `sample_pages` distinct pages of `pages(html)`, the first by a hash; None without any block.

    Null pages teach nothing and equal pages count once, however many there
    are. A page of more than TRAIN_BLOCKS blocks is read in windows spread
    evenly from its first block to its last.
    """
    html = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    drawn = first_by_hash(html, F.xxhash64("html"), sample_pages, "pages").collect()
    rng = np.random.default_rng(seed)
    plain = [w for r in drawn for w in _windows(blocks(r["html"]))]
    if not plain:
        return None
    seen, labels = [], []
    for k, p in enumerate(plain):
        scoped = any(tag in MAIN_TAGS or name in MAIN_NAMES for b in p for tag, _, name in (x.partition(".") for x in b.path))
        for q in (p, _varied(p, plain[k - 1], rng), _varied(p, plain[(k - 2) % len(plain)], rng)) if scoped else (p,):
            seen.append(q)
            labels.append(np.array([named_label(b.path, scoped) for b in q]))
    return train(seen, labels)


def extract(pages: DataFrame, labeller: Labeller | None, text: str = "text") -> DataFrame:
    """`pages` with a string column `text`: the blocks labelled main text, joined by line feeds.

    A null or empty page, and one without main text, has an empty text. Pages
    are read whole, whatever their length, cut off or badly nested; repeated
    pages have equal texts. An empty table gives an empty result. A column of
    that name gives way; others stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller)
    columns = [c for c in pages.columns if c.lower() != text.lower()]
    source = fresh(["_llm_html"], columns)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        memo: dict = {}
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(at, 512)
                read = [blocks(p.as_py()) for p in b.column(source)]
                main = shared.value.label(read, memo) if shared.value else [np.zeros(len(p), bool) for p in read]
                yield b, [pa.array(["\n".join(x.text for x, y in zip(p, m) if y) for p, m in zip(read, main)], pa.string())]

    out, (name,) = append_columns(pages.select(*columns, F.col("html").cast("string").alias(source)),
                                  [T.StructField("llm_main", T.StringType())], run)
    return out.select(*columns, F.col(name).alias(text))
