"""Chat formatting with a small sandboxed template language, compiled to Python closures.

A template is text with ``{{ expression }}`` and the statements ``for``, ``if`` / ``elif`` / ``else``,
``set`` and ``generation``, each closed by its ``end...``. Expressions have strings, integers,
true / false / none, names, ``name.field``, ``==``, ``!=``, ``in``, ``and``, ``or``, ``not``, ``~`` or ``+`` for
joining, and filters after ``|``. Nothing else can be named: no calls, no indexing, no
attributes of Python objects, and loops run over the given turns only.

Source -> tokens -> syntax tree -> folded tree -> closures. Folding joins what is constant
(filters of constants, conditions, neighbouring text), so a render only touches what
depends on a conversation. Text inside ``generation`` is marked for the loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that may not appear inside a text as they are: the template's own and those of common chat formats.
CONTROLS = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|startoftext|>", "<|endoftext|>", "<|eot_id|>",
)
TEMPLATE = (
    "{% for turn in turns %}" + TURN + "{{ turn.role | escape }}" + TEXT
    + "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    + "{% else %}{{ turn.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)

_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """Break every control string after its first character by a backslash; a backslash itself is doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not well formed, or names something outside the sandbox."""


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Unary:
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    name: str
    operand: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_WORD = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|~+()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the words of one expression; ``not`` binds closer than ``and``, that than ``or``."""

    def __init__(self, source: str):
        self.words: list[tuple[str, Any]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:].strip()!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.words.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
            elif number is not None:
                self.words.append(("const", int(number)))
            elif name in ("true", "false", "none"):
                self.words.append(("const", {"true": True, "false": False, "none": None}[name]))
            else:
                self.words.append(("name", name) if name and name not in ("and", "or", "not", "in", "if") else ("sign", name or sign))
            at = m.end()
        self.at = 0

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] == "sign" and self.words[self.at][1] in signs

    def next(self, kind: str) -> Any:
        if self.at >= len(self.words) or self.words[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self) -> Any:
        made = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return made

    def _chain(self, signs: tuple[str, ...], part: Callable[[], Any]) -> Any:
        made = part()
        while self.peek(*signs):
            made = Binary(self.next("sign"), made, part())
        return made

    def either(self) -> Any:
        return self._chain(("or",), self.both)

    def both(self) -> Any:
        return self._chain(("and",), self.negated)

    def negated(self) -> Any:
        if self.peek("not"):
            self.next("sign")
            return Unary(self.negated())
        return self._chain(("==", "!=", "in"), self.joined)

    def joined(self) -> Any:
        return self._chain(("~", "+"), self.filtered)

    def filtered(self) -> Any:
        made = self.atom()
        while self.peek("|"):
            self.next("sign")
            name = self.next("name")
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            made = Filter(name, made)
        return made

    def atom(self) -> Any:
        if self.peek("("):
            self.next("sign")
            made = self.either()
            if not self.peek(")"):
                raise TemplateError("a bracket is not closed")
            self.next("sign")
            return made
        if self.at < len(self.words) and self.words[self.at][0] == "const":
            return Const(self.next("const"))
        name = self.next("name")
        if self.peek("."):
            self.next("sign")
            return Name(name, self.next("name"))
        return Name(name)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts += [("text", source[at : m.start()])] if m.start() > at else []
        parts.append(("value", m[1]) if m[1] is not None else ("do", m[2].strip()))
        at = m.end()
    parts += [("text", source[at:])] if at < len(source) else []
    for kind, text in parts:
        if kind == "text" and ("{{" in text or "{%" in text):
            raise TemplateError("a tag is not closed")
    place = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        made: list[Any] = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind != "do":
                made.append(Output(Const(text) if kind == "text" else _Expression(text).whole()))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(made), text
            made.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(made), ""

    def choice(test: str) -> Choice:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return Choice(_Expression(test).whole(), then, (choice(end[4:]),))
        return Choice(_Expression(test).whole(), then, block("endif")[0] if end == "else" else ())

    def statement(word: str, rest: str) -> Any:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"not a loop: {rest!r}")
            return Loop(m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "if":
            return choice(rest)
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"not an assignment: {rest!r}")
            return Assign(m[1], _Expression(m[2]).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


def _text(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: _text(a) in _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def fold(node: Any) -> Any:
    """The tree with everything constant worked out; blocks come back as tuples without constant branches."""
    if isinstance(node, tuple):
        made: list[Any] = []
        for part in map(fold, node):
            for piece in part if isinstance(part, tuple) else (part,):
                if made and isinstance(piece, Output) and isinstance(piece.value, Const) and isinstance(made[-1], Output) and isinstance(made[-1].value, Const):
                    made[-1] = Output(Const(_text(made[-1].value.value) + _text(piece.value.value)))
                else:
                    made.append(piece)
        return tuple(made)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(_OPERATORS[node.op](left.value, right.value))
        if isinstance(left, Const) and node.op in ("and", "or"):
            return right if bool(left.value) == (node.op == "and") else left
        return Binary(node.op, left, right)
    if isinstance(node, Unary):
        operand = fold(node.operand)
        return Const(not operand.value) if isinstance(operand, Const) else Unary(operand)
    if isinstance(node, Filter):
        operand = fold(node.operand)
        return Const(FILTERS[node.name](_text(operand.value))) if isinstance(operand, Const) else Filter(node.name, operand)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Choice):
        test, then, other = fold(node.test), fold(node.then), fold(node.other)
        return (then if test.value else other) if isinstance(test, Const) else Choice(test, then, other)
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


class _Out:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.marks: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda names, v=node.value: v
    if isinstance(node, Name):
        if node.field is None:
            return lambda names, n=node.name: names.get(n)

        def field(names: dict, n: str = node.name, f: str = node.field) -> Any:
            held = names.get(n)
            return held.get(f) if type(held) is dict else None

        return field
    if isinstance(node, Unary):
        inner = _value(node.operand)
        return lambda names: not inner(names)
    if isinstance(node, Filter):
        inner, apply = _value(node.operand), FILTERS[node.name]
        return lambda names: apply(_text(inner(names)))
    left, right, op = _value(node.left), _value(node.right), node.op
    if op == "and":
        return lambda names: left(names) and right(names)
    if op == "or":
        return lambda names: left(names) or right(names)
    apply2 = _OPERATORS[op]
    return lambda names: apply2(left(names), right(names))


def _closure(block: tuple) -> Callable[[dict, _Out], None]:
    steps = [_step(node) for node in block]

    def run(names: dict, out: _Out) -> None:
        for step in steps:
            step(names, out)

    return steps[0] if len(steps) == 1 else run


def _step(node: Any) -> Callable[[dict, _Out], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda names, out: out.add(text)
        value = _value(node.value)
        return lambda names, out: out.add(_text(value(names)))
    if isinstance(node, Assign):
        made, target = _value(node.value), node.name
        return lambda names, out: names.__setitem__(target, made(names))
    if isinstance(node, Choice):
        test, then, other = _value(node.test), _closure(node.then), _closure(node.other)
        return lambda names, out: then(names, out) if test(names) else other(names, out)
    if isinstance(node, Generation):
        body = _closure(node.body)

        def marked(names: dict, out: _Out) -> None:
            start = out.size
            body(names, out)
            out.marks.append((start, out.size))

        return marked
    over, body, name = _value(node.over), _closure(node.body), node.name

    def loop(names: dict, out: _Out) -> None:
        items = over(names)
        if type(items) is not list:
            raise TemplateError("a loop has to run over the turns")
        for i, item in enumerate(items):
            body({**names, name: item, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)

    return loop


@lru_cache(maxsize=16)
def compile_template(source: str) -> Callable[[list[dict[str, str]]], tuple[str, list[tuple[int, int]]]]:
    """turns -> (formatted text, marked ranges in code points)."""
    run = _closure(fold(parse(source)))

    def render(turns: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run({"turns": turns}, out)
        return "".join(out.parts), out.marks

    return render


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text formatted by ``TEMPLATE``."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        text, end, _ = rest.partition(END)
        if not end:
            raise ValueError("a turn is not closed")
        turns.append((unescape(role), unescape(text)))
    return turns


def _render(source: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(source)
        for batch in batches:
            texts, marks = [], []
            for turns in batch.column(1).to_pylist():
                text, marked = render([{"role": t["role"] or "", "text": t["text"] or ""} for t in turns])
                texts.append(text)
                marks.append([{"start": s, "end": e} for s, e in marked])
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(marks, spans)], names=["conv_id", "formatted", "marks"])

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, marks): each conversation of ``turns`` (conv_id, turn, role, text) in one text; marks are the loss ranges.

    Rows are ordered by turn; equal or null turns (null first) by role, then text, and rows that stand twice
    are two turns. Null roles and texts are empty; a null conv_id is a conversation of its own. No rows give no rows.
    """
    kept = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = kept.groupBy("conv_id").agg(rows.alias("turns"))
    return grouped.mapInArrow(_render(template), "conv_id long, formatted string, marks array<struct<start:long,end:long>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, text, marks in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            turns = read_turns(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in marks)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back out of texts formatted by ``TEMPLATE``."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_digests, schema)


def _escaped_sql(column: str) -> str:
    controls = "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)).replace("'", "''")
    return f"regexp_replace(replace({column}, '\\', '\\\\'), '({controls})', '\\1~', 'g')"


#: The hash of a conversation's turns; an escape adds one character wherever it takes hold.
FORMAT_SQL = f"""
    with c as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
           sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(TURN + TEXT + END) + 1})::bigint as formatted_chars
    from c group by conv_id
"""
