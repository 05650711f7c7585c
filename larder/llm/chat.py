"""Chat formatting by a compiled template.

A small template language (text, `{{ expression }}`, for, if, and generation
blocks) is parsed into a syntax tree, its constants are folded, and the tree
becomes Python closures. There is no eval and no attribute access beyond a
message's fields, so a template can do nothing but render. Rendering streams:
the messages are an iterator and the output is pieces, each marked if it lies
inside a generation block, so a conversation of any length needs one turn at a
time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import tasks

Piece = tuple[str, bool]
Scope = dict[str, object]

# Control strings of the format. Inside texts each is escaped, so these mark turns alone.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>"]
ESCAPE = "\\"

#: The template of the queries.
LLAMA_LIKE = (
    "{{ bos }}{% for m in messages %}"
    "{% if m.role == 'assistant' %}<|role|>assistant\n{% generation %}{{ m.text | escape }}{% endgeneration %}{{ eos }}"
    "{% elif m.role == 'user' %}<|role|>user\n[INST] {{ m.text | escape }} [/INST]{{ eos }}"
    "{% elif m.role == 'system' %}<|role|>system\n<<SYS>> {{ m.text | escape }} <</SYS>>{{ eos }}"
    "{% else %}<|role|>{{ m.role | escape }}\n{{ '' + '' }}{{ m.text | escape }}{{ eos }}{% endif %}"
    "{% endfor %}")

_ESCAPED = re.compile("|".join(re.escape(x) for x in [*CONTROL, ESCAPE, "\n"]))


def escape(text: str) -> str:
    r"""Reversible: a backslash doubles, one stands before each control string's last character, a line feed is \n."""
    def one(m: re.Match) -> str:
        s = m.group()
        return "\\\\" if s == ESCAPE else "\\n" if s == "\n" else s[:-1] + ESCAPE + s[-1]
    return _ESCAPED.sub(one, text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), text, flags=re.S)


class TemplateError(ValueError):
    pass


# ---- syntax tree ----------------------------------------------------------

@dataclass
class Const:
    value: object


@dataclass
class Name:
    path: list[str]


@dataclass
class Binary:
    op: str
    left: "Expr"
    right: "Expr"


@dataclass
class Not:
    value: "Expr"


@dataclass
class Filter:
    name: str
    value: "Expr"


Expr = Const | Name | Binary | Not | Filter


@dataclass
class Out:
    value: Expr


@dataclass
class For:
    var: str
    over: Expr
    body: list["Node"]


@dataclass
class If:
    arms: list[tuple[Expr, list["Node"]]]
    orelse: list["Node"] = field(default_factory=list)


@dataclass
class Generation:
    body: list["Node"]


Node = Out | For | If | Generation

FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(), "length": lambda x: len(_text(x))}
_BINARY: dict[str, Callable[[object, object], object]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: _text(a) + _text(b),
    "in": lambda a, b: _text(a) in _text(b)}


def _text(x: object) -> str:
    return "" if x is None else str(x)


# ---- parsing --------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(\d+)|(==|!=|[+|().])|(\w+))")


def parse(source: str) -> list[Node]:
    """The template's syntax tree; TemplateError where it isn't one."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at:m.start()]))
        parts.append(("out", m.group(1)) if m.group(1) is not None else ("tag", m.group(2).strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    nodes, rest, end = _block(parts, 0, ())
    if end:
        raise TemplateError(f"unexpected {end}")
    return nodes


def _block(parts: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[list[Node], int, str]:
    nodes: list[Node] = []
    while at < len(parts):
        kind, body = parts[at]
        at += 1
        if kind == "text":
            nodes.append(Out(Const(body)))
            continue
        if kind == "out":
            nodes.append(Out(expression(body)))
            continue
        word = body.split(None, 1)[0] if body else ""
        if word in until:
            return nodes, at, body
        if word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", body, re.S)
            if not m:
                raise TemplateError(body)
            inner, at, _ = _block(parts, at, ("endfor",))
            nodes.append(For(m.group(1), expression(m.group(2)), inner))
        elif word == "if":
            arms, orelse, test = [], [], body[2:]
            while True:
                inner, at, end = _block(parts, at, ("elif", "else", "endif"))
                arms.append((expression(test), inner))
                if end.startswith("elif"):
                    test = end[4:]
                    continue
                if end == "else":
                    orelse, at, _ = _block(parts, at, ("endif",))
                break
            nodes.append(If(arms, orelse))
        elif word == "generation":
            inner, at, _ = _block(parts, at, ("endgeneration",))
            nodes.append(Generation(inner))
        else:
            raise TemplateError(f"unknown tag {body!r}")
    if until:
        raise TemplateError(f"missing {until[-1]}")
    return nodes, at, ""


def expression(source: str) -> Expr:
    """or < and < not < comparison < + < filter < name, constant, parentheses."""
    tokens: list[tuple[str, object]] = []
    at = 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(source)
        single, double, number, sign, word = m.groups()
        quoted = single if single is not None else double
        if quoted is not None:
            tokens.append(("const", re.sub(r"\\(.)", lambda k: {"n": "\n", "t": "\t"}.get(k.group(1), k.group(1)), quoted)))
        elif number is not None:
            tokens.append(("const", int(number)))
        else:
            tokens.append(("sign", sign) if sign else ("word", word))
        at = m.end()
    pos = 0

    def peek(value: str) -> bool:
        return pos < len(tokens) and tokens[pos][0] != "const" and tokens[pos][1] == value

    def take() -> tuple[str, object]:
        nonlocal pos
        if pos >= len(tokens):
            raise TemplateError(source)
        pos += 1
        return tokens[pos - 1]

    def chain(ops: tuple[str, ...], below: Callable[[], Expr]) -> Expr:
        left = below()
        while any(peek(o) for o in ops):
            op = str(take()[1])
            left = Binary(op, left, below())
        return left

    def primary() -> Expr:
        kind, value = take()
        if kind == "const":
            return Const(value)
        if value == "(":
            e = either()
            if take()[1] != ")":
                raise TemplateError(source)
            return e
        if kind == "sign":
            raise TemplateError(source)
        if value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[str(value)])
        path = [str(value)]
        while peek("."):
            take()
            kind, value = take()
            if kind != "word" or str(value).startswith("_"):
                raise TemplateError(source)
            path.append(str(value))
        return Name(path)

    def filtered() -> Expr:
        e = primary()
        while peek("|"):
            take()
            name = str(take()[1])
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            e = Filter(name, e)
        return e

    def negated() -> Expr:
        if peek("not"):
            take()
            return Not(negated())
        return chain(("==", "!=", "in"), lambda: chain(("+",), filtered))

    def either() -> Expr:
        return chain(("or",), lambda: chain(("and",), negated))

    e = either()
    if pos != len(tokens):
        raise TemplateError(source)
    return e


# ---- constant folding -----------------------------------------------------

def fold(e: Expr, known: Scope) -> Expr:
    """Evaluate what doesn't depend on messages; `known` names are constants."""
    if isinstance(e, Name):
        return Const(known[e.path[0]]) if len(e.path) == 1 and e.path[0] in known else e
    if isinstance(e, Binary):
        a, b = fold(e.left, known), fold(e.right, known)
        if e.op in ("and", "or") and isinstance(a, Const):
            return b if bool(a.value) == (e.op == "and") else a
        if isinstance(a, Const) and isinstance(b, Const) and e.op in _BINARY:
            return Const(_BINARY[e.op](a.value, b.value))
        return Binary(e.op, a, b)
    if isinstance(e, Not):
        v = fold(e.value, known)
        return Const(not v.value) if isinstance(v, Const) else Not(v)
    if isinstance(e, Filter):
        v = fold(e.value, known)
        return Const(FILTERS[e.name](v.value)) if isinstance(v, Const) else Filter(e.name, v)
    return e


def fold_nodes(nodes: list[Node], known: Scope) -> list[Node]:
    """Fold every expression, drop dead arms and empty text, join neighbouring constants."""
    out: list[Node] = []

    def put(n: Node) -> None:
        if isinstance(n, Out) and isinstance(n.value, Const):
            if not _text(n.value.value):
                return
            if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(_text(out[-1].value.value) + _text(n.value.value)))
                return
        out.append(n)

    for n in nodes:
        if isinstance(n, Out):
            put(Out(fold(n.value, known)))
        elif isinstance(n, For):
            inner = {k: v for k, v in known.items() if k != n.var}
            put(For(n.var, fold(n.over, known), fold_nodes(n.body, inner)))
        elif isinstance(n, Generation):
            put(Generation(fold_nodes(n.body, known)))
        else:
            arms: list[tuple[Expr, list[Node]]] = []
            orelse = fold_nodes(n.orelse, known)
            for test, body in n.arms:
                t = fold(test, known)
                if isinstance(t, Const) and not t.value:
                    continue
                if isinstance(t, Const):
                    orelse = fold_nodes(body, known)
                    break
                arms.append((t, fold_nodes(body, known)))
            if arms:
                put(If(arms, orelse))
            else:
                for x in orelse:
                    put(x)
    return out


# ---- closures -------------------------------------------------------------

Render = Callable[[Scope, bool], Iterator[Piece]]


def _value(e: Expr) -> Callable[[Scope], object]:
    if isinstance(e, Const):
        constant = e.value
        return lambda scope: constant
    if isinstance(e, Name):
        first, rest = e.path[0], e.path[1:]

        def look(scope: Scope) -> object:
            v = scope.get(first)
            for k in rest:
                v = v.get(k) if isinstance(v, dict) else None
            return v
        return look
    if isinstance(e, Not):
        inner = _value(e.value)
        return lambda scope: not inner(scope)
    if isinstance(e, Filter):
        inner, apply = _value(e.value), FILTERS[e.name]
        return lambda scope: apply(inner(scope))
    left, right = _value(e.left), _value(e.right)
    if e.op == "and":
        return lambda scope: left(scope) and right(scope)
    if e.op == "or":
        return lambda scope: left(scope) or right(scope)
    binary = _BINARY[e.op]
    return lambda scope: binary(left(scope), right(scope))


def _render(nodes: list[Node]) -> Render:
    steps: list[Render] = [_step(n) for n in nodes]

    def run(scope: Scope, marked: bool) -> Iterator[Piece]:
        for s in steps:
            yield from s(scope, marked)
    return run


def _step(n: Node) -> Render:
    if isinstance(n, Out):
        value = _value(n.value)

        def out(scope: Scope, marked: bool) -> Iterator[Piece]:
            yield _text(value(scope)), marked
        return out
    if isinstance(n, Generation):
        body = _render(n.body)
        return lambda scope, marked: body(scope, True)
    if isinstance(n, For):
        over, body, var = _value(n.over), _render(n.body), n.var

        def loop(scope: Scope, marked: bool) -> Iterator[Piece]:
            for x in over(scope) or ():  # type: ignore[union-attr]
                yield from body({**scope, var: x}, marked)
        return loop
    arms = [(_value(t), _render(b)) for t, b in n.arms]
    orelse = _render(n.orelse)

    def choose(scope: Scope, marked: bool) -> Iterator[Piece]:
        for test, body in arms:
            if test(scope):
                yield from body(scope, marked)
                return
        yield from orelse(scope, marked)
    return choose


def compile_template(source: str, **constants: object) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """Messages (dicts with role and text) -> pieces of the formatted text, marked where generated."""
    render = _render(fold_nodes(parse(source), dict(constants)))
    return lambda messages: render({"messages": messages}, False)


# ---- reading back ---------------------------------------------------------

# What stands around a text of each role; any other role has nothing around it.
_AROUND = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>")}


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, from the formatted text alone, a turn at a time."""
    buffer, started = "", False
    for text, _ in pieces:
        buffer += text
        if not started and len(buffer) >= len("<s>"):
            if not buffer.startswith("<s>"):
                raise ValueError("no start")
            buffer, started = buffer[len("<s>"):], True
        if not text.endswith("</s>"):  # the end of a turn is a constant of the template
            continue
        while "</s>" in buffer:
            turn, buffer = buffer.split("</s>", 1)
            role, said = turn.removeprefix("<|role|>").split("\n", 1)
            before, after = _AROUND.get(role, ("", ""))
            yield unescape(role), unescape(said[len(before):len(said) - len(after)])
    if buffer:
        raise ValueError("text after the last turn")


class Digest:
    """Digests and lengths of one conversation's output, fed a piece at a time."""

    def __init__(self) -> None:
        self.turns, self.n_turns = hashlib.sha256(), 0
        self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, 0
        self.held: list[str] = []

    def watch(self, pieces: Iterable[Piece]) -> Iterator[Piece]:
        """Count what is rendered and keep the marked text, escapes undone."""
        for text, marked in pieces:
            self.chars += len(text)
            if marked:
                self.held.append(text)
            elif self.held:
                self._flush()
            yield text, marked
        self._flush()

    def _flush(self) -> None:
        said = unescape("".join(self.held))  # escapes never reach across a mark's end
        self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(said)
        self.held = []

    def turn(self, role: str, text: str) -> None:
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))


_DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
_TEXTS = "conv_id long, piece int, text string, loss boolean"


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; ties by role and text."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (c.repartition(tasks(c.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text"))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation's id and its messages, read as they are asked for."""
    rows = ((i, r, t) for b in batches
            for i, r, t in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    ahead = next(rows, None)
    while ahead is not None:
        mine = ahead[0]

        def messages() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == mine:
                _, role, text = ahead
                ahead = next(rows, None)
                yield {"role": role, "text": text}

        yield mine, messages()


def format_digests(conversations: DataFrame, template: str = LLAMA_LIKE) -> DataFrame:
    """One row per conversation of `conversations(conv_id, turn, role, text)`, read back from its formatted text.

    n_turns, turns_sha256 (role, line feed, text, line feed of each turn),
    loss_chars and loss_sha256 (the text in generation blocks, unescaped, on
    end) and formatted_chars. Turns go by number, null last, ties by role and
    text; repeated rows are turns each. Null texts and roles are empty; null
    conv_ids are one conversation. An empty table gives an empty result; other
    columns are not read. A task holds one turn at a time, so a conversation
    of any length fits. The template must mark turns as `LLAMA_LIKE` does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, bos="<s>", eos="</s>")
        out: list[tuple] = []
        for conv, messages in _by_conversation(batches):
            d = Digest()
            for role, text in read_back(d.watch(render(messages))):
                d.turn(role, text)
            out.append((conv, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))
            if len(out) >= 4096:
                yield _batch(out, _NAMES)
                out = []
        if out:
            yield _batch(out, _NAMES)

    return _ordered(conversations).mapInArrow(run, _DIGESTS)


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_KINDS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
          "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "piece": pa.int32(), "text": pa.string(),
          "loss": pa.bool_()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[n]) for n, c in zip(names, zip(*rows))], names=names)


def format_pieces(conversations: DataFrame, template: str = LLAMA_LIKE) -> DataFrame:
    """The formatted texts: pieces in order, each with whether the loss mask covers it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, bos="<s>", eos="</s>")
        out: list[tuple] = []
        for conv, messages in _by_conversation(batches):
            for k, (text, marked) in enumerate(render(messages)):
                if text:
                    out.append((conv, k, text, marked))
                if len(out) >= 1024:
                    yield _batch(out, ["conv_id", "piece", "text", "loss"])
                    out = []
        if out:
            yield _batch(out, ["conv_id", "piece", "text", "loss"])

    return _ordered(conversations).mapInArrow(run, _TEXTS)
