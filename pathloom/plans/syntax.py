"""Path expressions: `$`, `.name`, `[key]`, `["key"]`, `(a|b.c)` and `(...){*}`; tokens, tree and text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum


class PathSyntaxError(ValueError):
    """The text is no path expression; `position` counts characters from 0, `part` is "lexer" or "parser"."""

    def __init__(self, message: str, position: int, part: str = "parser"):
        super().__init__(f"{part} error: {message} at position {position}")
        self.position, self.part = position, part


class Kind(Enum):
    ROOT = "$"
    DOT = "."
    NAME = "name"
    KEY = "[...]"
    OPEN = "("
    CLOSE = ")"
    BAR = "|"
    REPEAT = "{*}"
    LBRACE = "{"
    RBRACE = "}"
    RBRACKET = "]"
    END = "end"


@dataclass(frozen=True)
class Token:
    kind: Kind
    value: str
    position: int
    quoted: bool = False


_LEX = re.compile(
    r"""(?P<space>[ \t-\r\x85\xa0]+)
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<quoted>\["(?P<inner>(?:\\.|[^"\\])*)"\])
      | (?P<plain>\[(?!")(?P<raw>(?:\\.|[^\]\\])*)\])
      | (?P<repeat>\{\*\})
      | (?P<broken>\{\*)
      | (?P<sign>[$.()|{}\]])""",
    re.X | re.S,
)
_SIGNS = {"$": Kind.ROOT, ".": Kind.DOT, "(": Kind.OPEN, ")": Kind.CLOSE, "|": Kind.BAR, "{": Kind.LBRACE, "}": Kind.RBRACE, "]": Kind.RBRACKET}


def tokenize(text: str) -> list[Token]:
    """Tokens of an expression, closed by an END; white space between tokens does not count."""
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if m is None or m["broken"]:
            raise PathSyntaxError("unclosed bracket" if text[at] == "[" else "'{*' without '}'" if m else f"unexpected character {text[at]!r}", at, "lexer")
        if m["name"]:
            out.append(Token(Kind.NAME, m["name"], at))
        elif m["quoted"]:
            out.append(Token(Kind.KEY, m["inner"], at, True))
        elif m["plain"]:
            out.append(Token(Kind.KEY, m["raw"], at))
        elif m["repeat"]:
            out.append(Token(Kind.REPEAT, "{*}", at))
        elif m["sign"]:
            out.append(Token(_SIGNS[m["sign"]], m["sign"], at))
        at = m.end()
    return [*out, Token(Kind.END, "", len(text))]


@dataclass(frozen=True)
class Property:
    name: str

    @property
    def key(self) -> str:
        return self.name

    def to_text(self) -> str:
        return f".{self.name}"


@dataclass(frozen=True)
class Bracket:
    """`raw` is the content as written; `key` has the escapes resolved."""

    raw: str
    quoted: bool

    @property
    def key(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.raw, flags=re.S)

    def to_text(self) -> str:
        return f'["{self.raw}"]' if self.quoted else f"[{self.raw}]"


@dataclass(frozen=True, eq=False)
class Group:
    """One of the alternatives, each a sequence of nodes; repeated: any number of times, none included."""

    alternatives: tuple[tuple[Node, ...], ...]
    repeated: bool = False

    def to_text(self) -> str:
        return _rendered((self,), False)

    def to_expr(self) -> str:
        return _rendered((self,), True)[1:]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Group) and list(flat((self,))) == list(flat((other,)))

    def __hash__(self) -> int:
        return hash(tuple(flat((self,))))


Node = Property | Bracket | Group
Sign = tuple[str, bool]


def flat(nodes: tuple[Node, ...]) -> Iterator[Property | Bracket | Sign]:
    """A tree in the order of its text: keys as they are, ("(", repeated), ("|", False) and (")", repeated). Groups may nest
    however deep, as nothing that goes through a tree calls itself."""
    todo: list[Node | Sign] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if not isinstance(x, Group):
            yield x
            continue
        yield "(", x.repeated
        todo.append((")", x.repeated))
        for k in range(len(x.alternatives) - 1, -1, -1):
            todo.extend(reversed(x.alternatives[k]))
            if k:
                todo.append(("|", False))


def _rendered(nodes: tuple[Node, ...], expr: bool) -> str:
    """Text of a sequence; with `expr` a group has a dot before it and the first member of an alternative none."""
    out: list[str] = []
    first = False
    for x in flat(nodes):
        if isinstance(x, Bracket):
            out.append(x.to_text())
        elif isinstance(x, Property):
            out.append(x.name if expr and first else f".{x.name}")
        elif x[0] == "(":
            out.append(".(" if expr and not first else "(")
        else:
            out.append(x[0] + "{*}" * x[1])
        first = isinstance(x, tuple) and x[0] != ")"
    return "".join(out)


@dataclass(frozen=True)
class PathExpr:
    """A parsed expression. to_text() has the dots of group members as in a plain path; to_expr() parses again to the same tree."""

    segments: tuple[Node, ...]
    root: str = "$"

    def to_text(self) -> str:
        return self.root + _rendered(self.segments, False)

    __str__ = to_text

    def to_expr(self) -> str:
        return self.root + _rendered(self.segments, True)


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> Token:
        return self.tokens[self.at]

    def take(self, kind: Kind) -> Token | None:
        token = self.peek()
        if token.kind is not kind:
            return None
        self.at += 1
        return token

    def need(self, kind: Kind, what: str) -> Token:
        return self.take(kind) or self.fail(what)

    def fail(self, what: str):
        token = self.peek()
        raise PathSyntaxError(f"expected {what}, found {token.value or token.kind.value!r}", token.position)

    def keys(self, nodes: list[Node]) -> None:
        while key := self.take(Kind.KEY):
            nodes.append(Bracket(key.value, key.quoted))

    def expression(self) -> PathExpr:
        self.need(Kind.ROOT, "'$'")
        nodes: list[Node] = []
        open_: list[tuple[list[Node], list[tuple[Node, ...]]]] = []  # what stands before each open group, and its finished ways
        while True:
            if not open_:
                self.keys(nodes)
                if self.take(Kind.END):
                    return PathExpr(tuple(nodes))
                self.need(Kind.DOT, "'.', '[' or the end")
            if name := self.take(Kind.NAME):
                nodes.append(Property(name.value))
                self.keys(nodes)
            else:
                self.need(Kind.OPEN, "a name or '('")
                open_.append((nodes, []))
                nodes = []
                continue
            while open_ and not self.take(Kind.DOT):  # behind a member of a group
                before, ways = open_[-1]
                if self.take(Kind.BAR):
                    ways.append(tuple(nodes))
                    nodes = []
                    break
                self.need(Kind.CLOSE, "'|' or ')'")
                ways.append(tuple(nodes))
                before.append(Group(tuple(ways), self.take(Kind.REPEAT) is not None))
                nodes = before
                open_.pop()


def parse(text: str) -> PathExpr:
    """Read an expression; PathSyntaxError if it is none."""
    return _Reader(tokenize(text)).expression()


def describe(text: str) -> dict[str, object]:
    """What an expression consists of, as the command `parse` shows it."""
    expr = parse(text)
    return {"expression": text, "parsed": expr.to_text(), "root": expr.root, "segment_count": len(expr.segments), "segments": [n.to_text() for n in expr.segments]}
