"""Chat formatting: a small sandboxed template language, compiled to Python closures.

Grammar: text; ``{{ expr }}``; ``{% for x in expr %}..{% endfor %}``; ``{% if expr %}..{% elif expr %}..{% else %}..
{% endif %}``; ``{% set x = expr %}``; ``{% generation %}..{% endgeneration %}``. Expressions: string and integer
literals, true, false, none, names, ``a.b`` and ``a['b']`` (mapping keys only), ``a | filter``, ``+``, ``==``, ``!=``,
``in``, ``not``, ``and``, ``or``, parentheses, ``loop.index``, ``loop.first``, ``loop.last``. There are no calls, no
attributes of Python objects and no names with a leading underscore, so a template reaches only the data it is given.

A template is parsed to a syntax tree, constants are folded (literals, pure filters, conditions, neighbouring text), and
the tree becomes nested closures that append to an output which also keeps the spans of generation markers.

``guard`` makes control strings inside texts harmless and reversible: after the first character of each control string,
or of one that was guarded before, it adds one backslash; ``unguard`` takes one away.

Defined cases: null role or text is empty; turns are ordered by turn (null first), then role, then text; repeated rows
are separate turns; rows with a null conv_id are one conversation; an empty table gives no rows; other columns are
ignored. A conversation is one output value, so it must fit a row; rendering itself is linear in its size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>", "<</TURN>>")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | guard }}[/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | guard }}{% endgeneration %}</s>"
    "{% else %}<<ROLE>>{{ m.role | guard }}<</ROLE>>{{ m.text | guard }}<</TURN>>{% endif %}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


def _control_pattern(controls: tuple[str, ...], least: str) -> re.Pattern:
    heads: dict[str, list[str]] = {}
    for c in controls:
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    return re.compile("|".join(rf"(?<={re.escape(h)})(?P<b{i}>\\{least})(?={'|'.join(sorted(rests, key=len, reverse=True))})" for i, (h, rests) in enumerate(heads.items())))


class Guard:
    """Reversible escaping of control strings."""

    def __init__(self, controls: tuple[str, ...] = CONTROLS):
        if any("\\" in c or len(c) < 2 for c in controls):
            raise TemplateError("control strings have two characters or more and no backslash")
        self.add, self.drop = _control_pattern(controls, "*"), _control_pattern(controls, "+")
        self.heads = tuple({c[0] for c in controls})

    def guard(self, text: str) -> str:
        return self.add.sub(lambda m: m[0] + "\\", text) if any(h in text for h in self.heads) else text

    def unguard(self, text: str) -> str:
        return self.drop.sub(lambda m: m[0][1:], text) if "\\" in text else text


class Output:
    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[int] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    children: tuple = ()


_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.\[\]|+()=]))")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Expressions:
    """Recursive descent over one tag's tokens."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or expected is not None and self.peek() != expected:
            raise TemplateError(f"expected {expected or 'an expression'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"{value!r} is not an allowed name")
        return value

    def done(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def either(self) -> Node:
        return self._chain("or", self.both)

    def both(self) -> Node:
        return self._chain("and", self.negated)

    def _chain(self, op: str, below: Callable[[], Node]) -> Node:
        node = below()
        while self.peek() == op:
            self.take()
            node = Node(op, None, (node, below()))
        return node

    def negated(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Node("not", None, (self.negated(),))
        left = self.total()
        if self.peek() in ("==", "!=", "in"):
            return Node(self.take()[1], None, (left, self.total()))
        return left

    def total(self) -> Node:
        return self._chain("+", self.piped)

    def piped(self) -> Node:
        node = self.primary()
        while self.peek() == "|":
            self.take()
            node = Node("filter", self.name(), (node,))
        return node

    def primary(self) -> Node:
        kind, value = self.take()
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return Node("const", int(value))
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none"):
            return Node("const", {"true": True, "false": False, "none": None}[value])
        self.at -= 1
        node = Node("name", self.name())
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                node = Node("item", None, (node, Node("const", self.name())))
            else:
                node = Node("item", None, (node, self.either()))
                self.take("]")
        return node


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    stack: list[list] = [["body", None, [], []]]  # kind, header, finished branches, nodes so far
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][3].append(Node("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            e = Expressions(_tokens(m[1]))
            stack[-1][3].append(Node("print", None, (e.either(),)))
            e.done()
            continue
        e = Expressions(_tokens(m[2]))
        word = e.name()
        top = stack[-1]
        if word == "for":
            name = e.name()
            e.take("in")
            stack.append(["for", (name, e.either()), [], []])
        elif word == "if":
            stack.append(["if", e.either(), [], []])
        elif word in ("elif", "else"):
            if top[0] != "if" or top[1] is None:
                raise TemplateError(f"{word} without if")
            top[2].append((top[1], Node("body", None, tuple(top[3]))))
            top[1], top[3] = (e.either() if word == "elif" else None), []
        elif word == "generation":
            stack.append(["generation", None, [], []])
        elif word == "set":
            name = e.name()
            e.take("=")
            top[3].append(Node("set", name, (e.either(),)))
        elif word in ("endfor", "endif", "endgeneration") and top[0] == word[3:]:
            stack.pop()
            body = Node("body", None, tuple(top[3]))
            if word == "endfor":
                node = Node("for", top[1][0], (top[1][1], body))
            elif word == "endif":
                branches = [*top[2], (top[1] if top[1] is not None else Node("const", True), body)]
                node = Node("if", None, tuple(x for branch in branches for x in branch))
            else:
                node = Node("generation", None, (body,))
            stack[-1][3].append(node)
        else:
            raise TemplateError(f"unexpected {word}")
        e.done()
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return Node("body", None, tuple(stack[0][3] + ([Node("text", source[at:])] if at < len(source) else [])))


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _add(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b if isinstance(b, (str, list, tuple, dict)) else False, "+": _add}


def fold(node: Node, filters: dict[str, Callable[[str], str]]) -> Node:
    """The tree with constants evaluated, dead branches gone and neighbouring texts joined."""
    children = tuple(fold(c, filters) for c in node.children)
    node = Node(node.kind, node.value, children)
    constant = [c.value for c in children] if children and all(c.kind == "const" for c in children) else None
    if node.kind in _BINARY and constant:
        return Node("const", _BINARY[node.kind](*constant))
    if node.kind == "not" and constant:
        return Node("const", not constant[0])
    if node.kind in ("and", "or") and children[0].kind == "const":
        return children[1] if bool(children[0].value) == (node.kind == "and") else children[0]
    if node.kind == "filter":
        if node.value not in filters:
            raise TemplateError(f"unknown filter {node.value}")
        return Node("const", filters[node.value](_text(constant[0]))) if constant else node
    if node.kind == "print" and constant:
        return Node("text", _text(constant[0]))
    if node.kind == "if":
        branches = []
        for condition, body in zip(children[::2], children[1::2]):
            if condition.kind == "const" and not condition.value:
                continue
            branches += [condition, body]
            if condition.kind == "const":
                break
        if not branches or branches[0].kind == "const":
            return branches[1] if branches else Node("text", "")
        return Node("if", None, tuple(branches))
    if node.kind == "body":
        out: list[Node] = []
        for c in (x for child in children for x in (child.children if child.kind == "body" else (child,))):
            if c.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + c.value)
            elif c != Node("text", ""):
                out.append(c)
        return Node("body", None, tuple(out))
    return node


def _expression(node: Node, filters) -> Callable[[dict], object]:
    parts = [_expression(c, filters) for c in node.children]
    value = node.value
    if node.kind == "const":
        return lambda scope: value
    if node.kind == "name":
        return lambda scope: scope.get(value)
    if node.kind == "item":
        base, key = parts
        return lambda scope: b.get(key(scope)) if isinstance(b := base(scope), dict) else None
    if node.kind == "filter":
        apply, inner = filters[value], parts[0]
        return lambda scope: apply(_text(inner(scope)))
    if node.kind == "not":
        return lambda scope: not parts[0](scope)
    if node.kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    operation, (left, right) = _BINARY[node.kind], parts
    return lambda scope: operation(left(scope), right(scope))


def _statement(node: Node, filters) -> Callable[[dict, Output], None]:
    value = node.value
    if node.kind == "text":
        return lambda scope, out: out.write(value)
    if node.kind == "print":
        shown = _expression(node.children[0], filters)
        return lambda scope, out: out.write(_text(shown(scope)))
    if node.kind == "set":
        given = _expression(node.children[0], filters)
        return lambda scope, out: scope.__setitem__(value, given(scope))
    if node.kind == "body":
        steps = [_statement(c, filters) for c in node.children]

        def body(scope, out):
            for step in steps:
                step(scope, out)

        return body
    if node.kind == "generation":
        inside = _statement(node.children[0], filters)

        def generation(scope, out):
            start = out.length
            inside(scope, out)
            out.spans += (start, out.length)

        return generation
    if node.kind == "if":
        branches = [(_expression(c, filters), _statement(b, filters)) for c, b in zip(node.children[::2], node.children[1::2])]

        def choose(scope, out):
            for condition, branch in branches:
                if condition(scope):
                    return branch(scope, out)

        return choose
    items, step = _expression(node.children[0], filters), _statement(node.children[1], filters)

    def loop(scope, out):
        rows = items(scope)
        rows = rows if isinstance(rows, (list, tuple)) else ()
        inner = dict(scope)
        for i, row in enumerate(rows):
            inner[value], inner["loop"] = row, {"index": i + 1, "first": i == 0, "last": i + 1 == len(rows)}
            step(inner, out)

    return loop


class Template:
    """A compiled template; ``render`` gives the text and the flat list of generation spans (code points)."""

    def __init__(self, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS):
        self.guarding = Guard(controls)
        self.filters = {"guard": self.guarding.guard, "trim": str.strip, "upper": str.upper, "lower": str.lower}
        self.tree = fold(parse(source), self.filters)
        self.run = _statement(self.tree, self.filters)

    def render(self, **data) -> tuple[str, list[int]]:
        out = Output()
        self.run(dict(data), out)
        return "".join(out.parts), out.spans


FORMATTED = "conv_id long, formatted string, loss_spans array<long>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row per conversation: its formatted text and the spans under the loss mask."""
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def make():
        compiled = Template(template, controls)

        def each(ids, turns):
            for conv_id, messages in zip(ids, turns):
                yield conv_id, *compiled.render(messages=messages)

        return each

    return map_rows(turns, make, FORMATTED)


def read_turns(formatted: str, guarding: Guard) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE made."""
    out, at = [], 0

    def until(mark: str) -> str:
        nonlocal at
        end = formatted.index(mark, at)
        text, at = formatted[at:end], end + len(mark)
        return guarding.unguard(text)

    while at < len(formatted):
        for opening in ("[INST]", "<s>", "<<ROLE>>"):
            if formatted.startswith(opening, at):
                at += len(opening)
                break
        else:
            raise ValueError(f"no turn begins at {at}")
        if opening == "<<ROLE>>":
            out.append((until("<</ROLE>>"), until("<</TURN>>")))
        else:
            out.append(("user", until("[/INST]")) if opening == "[INST]" else ("assistant", until("</s>")))
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations (made with TEMPLATE): turns, and text under the loss mask."""

    def make():
        guarding = Guard(CONTROLS)

        def each(ids, texts, spans):
            for conv_id, text, marks in zip(ids, texts, spans):
                turns = read_turns(text, guarding)
                loss = [guarding.unguard(text[a:b]) for a, b in zip(marks[::2], marks[1::2])]
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                yield conv_id, len(turns), told, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)

        return each

    return map_rows(formatted.select("conv_id", "formatted", "loss_spans"), make, DIGESTS)
