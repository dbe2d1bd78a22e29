"""Lexer and parser of the read-only Cypher subset. Gives nested tuples; see ``compiler`` for what they mean."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import CypherError, ReadOnlyViolation

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<par>\$\w+)|(?P<op><=|>=|<>|=~|:=|\.\.|->|<-|[-+*/%^=<>()\[\]{},.:|;])""",
    re.S | re.X,
)
WRITES = {"CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "DROP", "ALTER", "COPY", "INSTALL", "LOAD", "ATTACH", "IMPORT", "EXPORT", "CHECKPOINT", "BEGIN", "COMMIT", "ROLLBACK"}
READ_PROCEDURES = {"SHOW_TABLES", "TABLE_INFO", "CURRENT_SETTING", "DB_VERSION", "QUERY_FTS_INDEX", "QUERY_VECTOR_INDEX"}


def tokenize(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, begin, end) of each token, without space and comments; the last is the end."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"Unexpected character {text[at]!r} at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup], m.start(), m.end()))
        at = m.end()
    return [*tokens, ("end", "", len(text), len(text))]


def check_read_only(text: str) -> None:
    """Reject write keywords and procedures that are not listed. Literals, comments and quoted names are free to hold them."""
    words = [value if kind == "name" and not value.startswith("`") else "" for kind, value, *_ in tokenize(text)]
    for before, word in zip(["", *words], words, strict=False):
        if word.upper() in WRITES:
            raise ReadOnlyViolation(f"'{word}' is not allowed in a read query", "Use the upsert and schema operations to write.")
        if before.upper() == "CALL" and word.upper() not in READ_PROCEDURES:
            raise ReadOnlyViolation(f"Procedure {word} is not allowed in a read query", f"Allowed: {', '.join(sorted(READ_PROCEDURES))}")


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: dict[str, Any]


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    props: dict[str, Any]
    direction: str
    hops: tuple[int, int | None] | None = None
    shortest: str | None = None


@dataclass
class PathPattern:
    var: str | None
    parts: list = field(default_factory=list)
    #: "one" or "all" of the shortest paths between each two ends
    shortest: str | None = None
    #: only the length and the number of the paths are wanted
    counted: bool = False


@dataclass
class Item:
    expr: Any
    name: str


@dataclass
class Projection:
    items: list[Item]
    star: bool
    distinct: bool
    order: list[tuple[Any, bool, str]]
    skip: Any
    limit: Any
    where: Any = None
    final: bool = False


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0

    # tokens

    def peek(self, *words: str, ahead: int = 0) -> bool:
        kind, value, *_ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind in ("op", "name") and (value.upper() if kind == "name" else value) in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"Expected {word} at {self.tokens[self.at][2]}, found {self.tokens[self.at][1] or 'the end'!r}")

    def name(self) -> str:
        kind, value, at, _ = self.tokens[self.at]
        if kind != "name":
            raise CypherError(f"Expected a name at {at}, found {value or 'the end'!r}")
        self.at += 1
        return value.strip("`")

    # query

    def query(self) -> list[tuple[bool, list]]:
        """[(all?, clauses)] of the parts of a UNION."""
        parts = [(True, self.single())]
        while self.take("UNION"):
            parts.append((self.take("ALL"), self.single()))
        self.take(";")
        if self.tokens[self.at][0] != "end":
            raise CypherError(f"Unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}", "Only read clauses are supported: MATCH, OPTIONAL MATCH, WITH, UNWIND, CALL, RETURN, UNION.")
        return parts

    def single(self) -> list:
        clauses = []
        while True:
            if self.take("MATCH"):
                clauses.append(("match", False, self.patterns(), self.expr() if self.take("WHERE") else None))
            elif self.peek("OPTIONAL") and self.peek("MATCH", ahead=1):
                self.at += 2
                clauses.append(("match", True, self.patterns(), self.expr() if self.take("WHERE") else None))
            elif self.take("UNWIND"):
                what = self.expr()
                self.need("AS")
                clauses.append(("unwind", what, self.name()))
            elif self.take("CALL"):
                name, args = self.name(), []
                self.need("(")
                while not self.take(")"):
                    if self.tokens[self.at][0] == "name" and self.peek(":=", ahead=1):
                        option = self.name().lower()
                        self.need(":=")
                        args.append(("named", option, self.expr()))
                    else:
                        args.append(self.expr())
                    self.take(",")
                found = []
                if self.take("YIELD"):
                    while True:
                        column = self.name()
                        found.append((column, self.name() if self.take("AS") else column))
                        if not self.take(","):
                            break
                clauses.append(("call", name.upper(), args, found))
                if self.take("WHERE"):
                    clauses.append(("where", self.expr()))
            elif self.take("WITH"):
                projection = self.projection()
                projection.where = self.expr() if self.take("WHERE") else None
                clauses.append(("project", projection))
            elif self.take("RETURN"):
                projection = self.projection()
                projection.final = True
                clauses.append(("project", projection))
                return clauses
            else:
                raise CypherError(f"Expected a clause at {self.tokens[self.at][2]}, found {self.tokens[self.at][1] or 'the end'!r}", "A query ends with RETURN.")

    def projection(self) -> Projection:
        distinct, star, items = self.take("DISTINCT"), False, []
        if self.take("*"):
            star = True
        else:
            while True:
                begin = self.tokens[self.at][2]
                expr = self.expr()
                name = self.text[begin : self.tokens[self.at - 1][3]]
                items.append(Item(expr, self.name() if self.take("AS") else name))
                if not self.take(","):
                    break
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                begin = self.tokens[self.at][2]
                expr = self.expr()
                text = self.text[begin : self.tokens[self.at - 1][3]]
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                order.append((expr, down, text))
                if not self.take(","):
                    break
        skip = self.expr() if self.take("SKIP") else None
        limit = self.expr() if self.take("LIMIT") else None
        return Projection(items, star, distinct, order, skip, limit)

    # patterns

    def patterns(self) -> list[PathPattern]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def path(self) -> PathPattern:
        path = PathPattern(None)
        if self.tokens[self.at][0] == "name" and self.peek("=", ahead=1):
            path.var = self.name()
            self.need("=")
        wrapped = self.peek("SHORTESTPATH", "ALLSHORTESTPATHS")
        if wrapped:
            path.shortest = "all" if self.peek("ALLSHORTESTPATHS") else "one"
            self.at += 1
            self.need("(")
        path.parts.append(self.node())
        while self.peek("-", "<-", "->"):
            path.parts.append(self.rel())
            path.parts.append(self.node())
        if wrapped:
            self.need(")")
        path.shortest = path.shortest or next((r.shortest for r in path.parts[1::2] if r.shortest), None)
        return path

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.tokens[self.at][0] == "name" else None
        labels = []
        if self.take(":"):
            labels.append(self.name())
            while self.take("|", ":"):
                labels.append(self.name())
        props = self.map() if self.peek("{") else {}
        self.need(")")
        return NodePattern(var, labels, props)

    def rel(self) -> RelPattern:
        left = self.take("<-")
        if not left:
            self.need("-")
        rel = RelPattern(None, [], {}, "both")
        if self.take("["):
            if self.tokens[self.at][0] == "name":
                rel.var = self.name()
            if self.take(":"):
                rel.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    rel.types.append(self.name())
            if self.take("*"):
                every = self.take("ALL")
                if self.take("SHORTEST"):
                    rel.shortest = "all" if every else "one"
                low = self._int() if self.tokens[self.at][0] == "num" else None
                if self.take(".."):
                    high = self._int() if self.tokens[self.at][0] == "num" else None
                    rel.hops = (1 if low is None else low, high)
                else:
                    rel.hops = (1, None) if low is None else (low, low)
            if self.peek("{"):
                rel.props = self.map()
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        rel.direction = "both" if left == right else "in" if left else "out"
        return rel

    def _int(self) -> int:
        self.at += 1
        return int(self.tokens[self.at - 1][1])

    def map(self) -> dict[str, Any]:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            self.take(",")
        return out

    # expressions, from the weakest operator to the strongest

    def expr(self) -> Any:
        left = self.xor()
        while self.take("OR"):
            left = ("op", "or", left, self.xor())
        return left

    def xor(self) -> Any:
        left = self.conj()
        while self.take("XOR"):
            left = ("op", "xor", left, self.conj())
        return left

    def conj(self) -> Any:
        left = self.negation()
        while self.take("AND"):
            left = ("op", "and", left, self.negation())
        return left

    def negation(self) -> Any:
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> Any:
        first = left = self.sum()
        chain = []
        while True:
            if self.peek("=", "<>", "<", ">", "<=", ">=", "=~"):
                op = self.tokens[self.at][1]
                self.at += 1
                right = self.sum()
                chain.append(("op", op, left, right))
                left = right
            elif self.peek("IN"):
                self.at += 1
                chain.append(("in", left, self.sum()))
            elif self.peek("IS"):
                self.at += 1
                no = self.take("NOT")
                self.need("NULL")
                chain.append(("notnull" if no else "isnull", left))
            elif self.peek("STARTS", "ENDS"):
                op = self.tokens[self.at][1].lower()
                self.at += 1
                self.need("WITH")
                chain.append(("op", op, left, self.sum()))
            elif self.peek("CONTAINS"):
                self.at += 1
                chain.append(("op", "contains", left, self.sum()))
            else:
                break
        if not chain:
            return first
        out = chain[0]
        for more in chain[1:]:
            out = ("op", "and", out, more)
        return out

    def sum(self) -> Any:
        left = self.product()
        while self.peek("+", "-"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = ("op", op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.power()
        while self.peek("*", "/", "%"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = ("op", op, left, self.power())
        return left

    def power(self) -> Any:
        left = self.unary()
        while self.take("^"):
            left = ("op", "^", left, self.unary())
        return left

    def unary(self) -> Any:
        if self.take("-"):
            return ("neg", self.unary())
        self.take("+")
        return self.postfix()

    def projected(self, subject: Any) -> Any:
        """``n {.a, .*, key: expression, variable}``: names with what they stand for, ``*`` for all properties."""
        self.need("{")
        items: list[tuple[str, Any]] = []
        while not self.take("}"):
            if self.take("."):
                if self.take("*"):
                    items.append(("*", subject))
                else:
                    name = self.name()
                    items.append((name, ("prop", subject, name)))
            else:
                name = self.name()
                items.append((name, self.expr() if self.take(":") else ("var", name)))
            self.take(",")
        return ("projected", subject, items)

    def postfix(self) -> Any:
        out = self.atom()
        while True:
            if out[0] == "var" and self.peek("{"):
                return self.projected(out)
            if self.take("."):
                out = ("prop", out, self.name())
            elif self.take("["):
                low = None if self.peek("..") else self.expr()
                if self.take(".."):
                    high = None if self.peek("]") else self.expr()
                    out = ("slice", out, low, high)
                else:
                    out = ("index", out, low)
                self.need("]")
            else:
                return out

    def atom(self) -> Any:
        kind, value, at, _ = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return ("lit", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            self.at += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1]))
        if kind == "par":
            self.at += 1
            return ("param", value[1:])
        if self.peek("("):
            if (pattern := self.pattern_here()) is not None:
                return ("exists_sub", [pattern], None)
            self.need("(")
            out = self.expr()
            self.need(")")
            return out
        if self.take("["):
            if self.tokens[self.at][0] == "name" and self.peek("IN", ahead=1):
                var = self.name()
                self.need("IN")
                source = self.expr()
                where = self.expr() if self.take("WHERE") else None
                mapped = self.expr() if self.take("|") else None
                self.need("]")
                return ("comprehension", var, source, where, mapped)
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if self.peek("{"):
            return ("map", self.map())
        if kind == "name":
            word = value.upper()
            if word in ("TRUE", "FALSE", "NULL"):
                self.at += 1
                return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[word])
            if word == "CASE":
                return self.case()
            if word in ("EXISTS", "COUNT") and self.peek("{", ahead=1):
                self.at += 2
                self.take("MATCH")
                patterns = self.patterns()
                where = self.expr() if self.take("WHERE") else None
                self.need("}")
                return (word.lower() + "_sub", patterns, where)
            if word in ("ALL", "ANY", "NONE", "SINGLE") and self.peek("(", ahead=1) and self.peek("IN", ahead=3):
                self.at += 2
                var = self.name()
                self.need("IN")
                source = self.expr()
                self.need("WHERE")
                where = self.expr()
                self.need(")")
                return ("quantifier", word.lower(), var, source, where)
            if word == "REDUCE" and self.peek("(", ahead=1):
                self.at += 2
                acc = self.name()
                self.need("=")
                start = self.expr()
                self.need(",")
                var = self.name()
                self.need("IN")
                source = self.expr()
                self.need("|")
                step = self.expr()
                self.need(")")
                return ("reduce", acc, start, var, source, step)
            name = self.name()
            if self.take("("):
                distinct = self.take("DISTINCT")
                if self.take("*"):
                    self.need(")")
                    return ("call", "count", [], False)
                args = []
                while not self.take(")"):
                    args.append(self.expr())
                    if self.take("AS"):
                        args.append(("lit", self.name()))
                    self.take(",")
                return ("call", name.lower(), args, distinct)
            return ("var", name)
        raise CypherError(f"Expected an expression at {at}, found {value or 'the end'!r}")

    def pattern_here(self) -> PathPattern | None:
        """A path of one relationship or more that begins here; otherwise nothing is taken."""
        begin = self.at
        try:
            path = self.path()
        except CypherError:
            path = None
        if path is None or len(path.parts) < 3:
            self.at = begin
            return None
        return path

    def case(self) -> Any:
        self.need("CASE")
        subject = None if self.peek("WHEN") else self.expr()
        branches = []
        while self.take("WHEN"):
            when = self.expr()
            self.need("THEN")
            branches.append((when, self.expr()))
        default = self.expr() if self.take("ELSE") else ("lit", None)
        self.need("END")
        return ("case", subject, branches, default)


def parse(text: str) -> list[tuple[bool, list]]:
    return Parser(text).query()
