"""SPARQL SELECT queries: prefixes, groups, UNION, OPTIONAL, FILTER, modifiers, ORDER BY, LIMIT."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF_TYPE, literal
from .model import Expr, Group, Order, Pattern, Query, QueryError, Term, Var

_TOKENS = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<double>[0-9]*\.?[0-9]+[eE][+-]?[0-9]+)
    |(?P<decimal>[0-9]+\.[0-9]+)
    |(?P<integer>[0-9]+)
    |(?P<var>[?$][0-9A-Za-z_]+)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[0-9A-Za-z_]+)
    |(?P<name>[A-Za-z][0-9A-Za-z_-]*)
    |(?P<sign>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].;,:=<>!+*/-])""",
    re.X,
)
_MODIFIERS = ("DISTINCT", "REDUCED", "COUNT", "DUPLICATES")
#: Built-in functions by their number of arguments, least and most.
_BUILTINS = {
    "STR": (1, 1), "LANG": (1, 1), "LANGMATCHES": (2, 2), "DATATYPE": (1, 1), "BOUND": (1, 1), "SAMETERM": (2, 2),
    "ISIRI": (1, 1), "ISURI": (1, 1), "ISBLANK": (1, 1), "ISLITERAL": (1, 1), "REGEX": (2, 3), "IN": (2, 1 << 30),
}
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        found = _TOKENS.match(text, at)
        if not found:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        if found.lastgroup != "space":
            out.append((found.lastgroup, found[0]))
        at = found.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self._tokens, self._at = _lex(text), 0
        self._prefixes: dict[str, str] = {}
        self._blanks: dict[str, Var] = {}
        self._new = 0

    # tokens

    def _peek(self, ahead: int = 0) -> tuple[str, str]:
        return self._tokens[min(self._at + ahead, len(self._tokens) - 1)]

    def _next(self) -> tuple[str, str]:
        token = self._peek()
        self._at += 1
        return token

    def _is(self, *signs: str) -> bool:
        return self._peek()[0] == "sign" and self._peek()[1] in signs

    def _accept(self, *signs: str) -> str | None:
        return self._next()[1] if self._is(*signs) else None

    def _expect(self, sign: str) -> None:
        if not self._accept(sign):
            raise QueryError(f"{sign!r} expected, not {self._peek()[1]!r}")

    def _keyword(self, *words: str) -> str | None:
        kind, text = self._peek()
        if kind == "name" and text.upper() in words and not (self._peek(1) == ("sign", ":")):
            self._at += 1
            return text.upper()
        return None

    # query

    def query(self) -> Query:
        while self._keyword("PREFIX"):
            name = self._next()[1] if self._peek()[0] == "name" else ""
            self._expect(":")
            kind, iri = self._next()
            if kind != "iri":
                raise QueryError("PREFIX needs an IRI")
            if name in self._prefixes:
                raise QueryError(f"prefix {name!r} is declared twice")
            self._prefixes[name] = iri[1:-1]
        if not self._keyword("SELECT"):
            raise QueryError("SELECT expected")
        modifier = self._keyword(*_MODIFIERS) or ""
        select: list[str] | None = []
        if self._accept("*"):
            select = None
        while select is not None and self._peek()[0] == "var":
            select.append(self._next()[1][1:])
        if select == []:
            raise QueryError("SELECT needs variables or *")
        if self._keyword("FROM"):
            raise QueryError("FROM isn't supported")
        if not self._keyword("WHERE"):
            raise QueryError("WHERE expected")
        self._expect("{")
        query = Query(self._group(), select, modifier)
        if self._keyword("ORDER"):
            if not self._keyword("BY"):
                raise QueryError("ORDER needs BY")
            while (order := self._order()) is not None:
                query.order.append(order)
            if not query.order:
                raise QueryError("ORDER BY needs a variable")
        if self._keyword("LIMIT"):
            kind, number = self._next()
            if kind != "integer" or int(number) < 1:
                raise QueryError("LIMIT needs a positive number")
            query.limit = int(number)
        if self._peek()[0] != "end":
            raise QueryError(f"unexpected {self._peek()[1]!r} after the query")
        if any(o.var is None for o in query.order) and modifier != "COUNT":
            raise QueryError("ORDER BY count needs SELECT COUNT")
        return query

    def _order(self) -> Order | None:
        way = self._keyword("ASC", "DESC")
        if way:
            self._expect("(")
        if self._peek()[0] == "var":
            order = Order(self._next()[1][1:], way == "DESC")
        elif self._keyword("COUNT"):
            order = Order(None, way == "DESC")
        elif way:
            raise QueryError(f"{way} needs a variable or count")
        else:
            return None
        if way:
            self._expect(")")
        return order

    # groups

    def _group(self) -> Group:
        """What follows an opening brace, through the closing one."""
        group = Group()
        while not self._accept("}"):
            if self._accept("{"):
                parts = [self._group()]
                while self._keyword("UNION"):
                    self._expect("{")
                    parts.append(self._group())
                if len(parts) > 1:
                    group.unions.append(parts)
                else:
                    only = parts[0]
                    group.steps += only.steps
                    group.unions += only.unions
                    group.optionals += only.optionals
                    group.filters += only.filters
                self._accept(".")
            elif self._keyword("FILTER"):
                group.filters.append(self._filter())
                self._accept(".")
            elif self._keyword("OPTIONAL"):
                self._expect("{")
                group.optionals.append(self._group())
                self._accept(".")
            elif self._peek()[0] == "end":
                raise QueryError("'}' expected at the end")
            else:
                self._triples(group)
                if not self._accept(".") and not self._is("}", "{") and self._peek()[1].upper() not in ("FILTER", "OPTIONAL"):
                    raise QueryError(f"'.' expected, not {self._peek()[1]!r}")
        return group

    def _triples(self, group: Group) -> None:
        if self._is("["):
            subject = self._brackets(group)
            if self._is(".", "}"):
                return
        else:
            subject = self._term()
        self._properties(subject, group)

    def _properties(self, subject: Term, group: Group) -> None:
        while True:
            predicate = self._verb()
            while True:
                if self._is("["):
                    value = self._brackets(group)
                else:
                    value = self._term(literals=True)
                group.steps.append(Pattern(subject, predicate, value))
                if not self._accept(","):
                    break
            if not self._accept(";") or self._is(".", "}", "]"):
                return

    def _brackets(self, group: Group) -> Var:
        self._expect("[")
        node = self._blank()
        if not self._accept("]"):
            self._properties(node, group)
            self._expect("]")
        return node

    def _blank(self) -> Var:
        self._new += 1
        return Var(f"__bn{self._new - 1}", blank=True)

    def _verb(self) -> Term:
        if self._peek() == ("name", "a") and self._peek(1) != ("sign", ":"):
            self._at += 1
            return RDF_TYPE
        return self._term()

    def _term(self, literals: bool = False) -> Term:
        kind, text = self._peek()
        if kind == "var":
            self._at += 1
            return Var(text[1:])
        if kind == "blank":
            self._at += 1
            if text not in self._blanks:
                self._blanks[text] = self._blank()
            return self._blanks[text]
        if kind == "iri" or kind == "name" or self._is(":"):
            return self._iri()
        if literals:
            sign = self._accept("+", "-") or ""
            kind, text = self._peek()
            if kind in ("integer", "decimal", "double"):
                self._at += 1
                return literal(sign.replace("+", "") + text, datatype={"integer": INTEGER, "decimal": DECIMAL, "double": DOUBLE}[kind])
            if kind == "string":
                return self._literal()
            if word := self._keyword("TRUE", "FALSE"):
                return literal(word.lower(), datatype=BOOLEAN)
        raise QueryError(f"term expected, not {text!r}")

    def _iri(self) -> str:
        kind, text = self._next()
        if kind == "iri":
            return text
        prefix = text if kind == "name" else ""
        if kind == "name":
            if not self._accept(":"):
                raise QueryError(f"unknown word {text!r}")
        if prefix not in self._prefixes:
            raise QueryError(f"unknown prefix {prefix!r}")
        local = self._next()[1] if self._peek()[0] in ("name", "integer") else ""
        return f"<{self._prefixes[prefix]}{local}>"

    def _literal(self) -> str:
        text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), self._next()[1][1:-1])
        if self._peek()[0] == "lang":
            return literal(text, language=self._next()[1][1:])
        if self._accept("^^"):
            return literal(text, datatype=self._iri())
        return literal(text)

    # expressions, from loose to tight

    def _filter(self) -> Expr:
        if self._is("("):
            return self._primary()
        found = self._primary()
        if found.op in ("var", "iri", "literal", "number", "boolean"):
            raise QueryError("FILTER needs parentheses or a function")
        return found

    def _chain(self, signs: tuple[str, ...], tighter: Callable[[], Expr]) -> Expr:
        left = tighter()
        while sign := self._accept(*signs):
            left = Expr(sign, (left, tighter()))
        return left

    def _expression(self) -> Expr:
        return self._chain(("||",), lambda: self._chain(("&&",), self._relation))

    def _relation(self) -> Expr:
        left = self._sum()
        sign = self._accept("=", "!=", "<=", ">=", "<", ">")
        return Expr(sign, (left, self._sum())) if sign else left

    def _sum(self) -> Expr:
        return self._chain(("+", "-"), lambda: self._chain(("*", "/"), self._unary))

    def _unary(self) -> Expr:
        if sign := self._accept("!", "+", "-"):
            return Expr({"!": "not", "+": "plus", "-": "minus"}[sign], (self._unary(),))
        return self._primary()

    def _primary(self) -> Expr:
        if self._accept("("):
            found = self._expression()
            self._expect(")")
            return found
        kind, text = self._peek()
        if kind == "var":
            self._at += 1
            return Expr("var", (text[1:],))
        if kind in ("integer", "decimal", "double"):
            self._at += 1
            return Expr("number", (float(text),))
        if kind == "string":
            return Expr("literal", (self._literal(),))
        if kind == "iri":
            iri = self._iri()
            return Expr("call", (iri, *self._arguments())) if self._is("(") else Expr("iri", (iri,))
        if word := self._keyword("TRUE", "FALSE"):
            return Expr("boolean", (word == "TRUE",))
        if kind == "name" and text.upper() in _BUILTINS and self._peek(1) == ("sign", "("):
            self._at += 1
            arguments = self._arguments()
            least, most = _BUILTINS[text.upper()]
            if not least <= len(arguments) <= most:
                raise QueryError(f"{text} has {len(arguments)} arguments")
            if text.upper() == "BOUND" and arguments[0].op != "var":
                raise QueryError("BOUND needs a variable")
            return Expr(text.upper(), tuple(arguments))
        if kind == "name" and self._peek(1) != ("sign", ":"):
            raise QueryError(f"unknown function {text!r}")
        if kind == "name" or self._is(":"):
            return Expr("iri", (self._iri(),))
        raise QueryError(f"expression expected, not {text!r}")

    def _arguments(self) -> list[Expr]:
        self._expect("(")
        found: list[Expr] = []
        while not self._accept(")"):
            if found:
                self._expect(",")
            found.append(self._expression())
        return found


def parse_sparql(text: str) -> Query:
    return _Parser(text).query()
