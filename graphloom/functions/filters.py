"""FILTER expressions as Columns over term columns.

Errors are null and count as false. Two values compare as numbers if both are, else as terms or
texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import Expr, QueryError
from ..terms import datatype_of, is_literal, language_of, lexical_text, number_of, text_of

_RELATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}


@dataclass(frozen=True)
class Value:
    """A column that holds terms, texts, numbers or booleans; ``constant`` is the term of a constant."""

    kind: str
    column: Column
    constant: str | None = None

    def number(self) -> Column:
        if self.kind == "number":
            return self.column
        if self.kind == "boolean":
            return F.lit(None).cast("double")
        return number_of(self.column) if self.kind == "term" else self.column.try_cast("double")

    def text(self) -> Column:
        if self.kind == "term":
            return F.lit(lexical_text(self.constant)) if self.constant is not None else text_of(self.column)
        return self.column if self.kind == "text" else self.column.cast("string")

    def truth(self) -> Column:
        """Effective boolean value."""
        if self.kind == "boolean":
            return self.column
        if self.kind == "number":
            return self.column != 0
        if self.kind == "text":
            return F.length(self.column) > 0
        text, number = text_of(self.column), number_of(self.column)
        boolean = F.endswith(self.column, F.lit("boolean>"))
        return F.when(self.column.startswith('"'), F.when(boolean, text.isin("true", "1")).when(number.isNotNull(), number != 0).otherwise(F.length(text) > 0))


class FilterCompiler:
    """Compiles expressions over the columns of a result; ``functions`` are by IRI, with their angle brackets, on Columns."""

    def __init__(self, columns: list[str], functions: dict[str, Callable[..., Column]] | None = None, terms: dict[str, Column] | None = None):
        """``terms``: of variables whose terms aren't in the column of their name."""
        self._columns, self._functions, self._terms = set(columns), functions or {}, terms or {}

    def _variable(self, name: str) -> Column:
        return self._terms.get(name, F.col(f"`{name}`"))

    def condition(self, expr: Expr) -> Column:
        return F.coalesce(self._value(expr).truth(), F.lit(False))

    def _value(self, expr: Expr) -> Value:
        op, args = expr.op, expr.args
        if op == "var":
            return Value("term", self._variable(args[0]) if args[0] in self._columns else F.lit(None).cast("string"))
        if op in ("iri", "literal"):
            return Value("term", F.lit(args[0]), args[0])
        if op in ("number", "boolean"):
            return Value(op, F.lit(args[0]))
        if op == "BOUND":
            name = args[0].args[0]
            return Value("boolean", self._variable(name).isNotNull() if name in self._columns else F.lit(False))
        if op == "call":
            name, *rest = args
            if name not in self._functions:
                raise QueryError(f"unknown function {name}")
            return Value("text", self._functions[name](*[self._value(a).text() for a in rest]).cast("string"))
        values = [self._value(a) for a in args]
        if op in ("||", "&&"):
            a, b = (v.truth() for v in values)
            return Value("boolean", a | b if op == "||" else a & b)
        if op == "not":
            return Value("boolean", ~values[0].truth())
        if op in _RELATIONS:
            return Value("boolean", self._compare(op, *values))
        if op in _ARITHMETIC:
            return Value("number", _ARITHMETIC[op](values[0].number(), values[1].number()))
        if op in ("plus", "minus"):
            return Value("number", values[0].number() if op == "plus" else -values[0].number())
        return self._builtin(op, values)

    def _compare(self, op: str, a: Value, b: Value) -> Column:
        compare = _RELATIONS[op]
        if "boolean" in (a.kind, b.kind):
            return compare(a.truth(), b.truth())
        numbers = compare(a.number(), b.number())
        if "number" in (a.kind, b.kind):
            # a term that isn't a number differs from any number
            return F.coalesce(numbers, F.lit(True)) if op == "!=" else numbers
        both_terms = a.kind == b.kind == "term"
        same = op in ("=", "!=")
        plain = compare(a.column, b.column) if both_terms and same else compare(a.text(), b.text())
        if any(v.constant is not None and (not is_literal(v.constant) or not _is_number(lexical_text(v.constant))) for v in (a, b)):
            return plain
        return F.coalesce(numbers, plain)

    def _builtin(self, op: str, values: list[Value]) -> Value:
        first = values[0]
        if op == "STR":
            return Value("text", first.text())
        if op == "LANG":
            return Value("text", language_of(first.column) if first.kind == "term" else F.lit(""))
        if op == "DATATYPE":
            return Value("term", datatype_of(first.column) if first.kind == "term" else F.lit(None).cast("string"))
        if op == "LANGMATCHES":
            tag, wanted = F.lower(first.text()), F.lower(values[1].text())
            return Value("boolean", F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))))
        if op == "SAMETERM":
            return Value("boolean", first.column == values[1].column)
        if op in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            sign = {"ISBLANK": "_:", "ISLITERAL": '"'}.get(op, "<")
            return Value("boolean", first.column.startswith(sign) if first.kind == "term" else F.lit(op == "ISLITERAL"))
        if op == "REGEX":
            pattern = values[1].text()
            if len(values) == 3:
                pattern = F.concat(F.lit("(?"), values[2].text(), F.lit(")"), pattern)
            return Value("boolean", F.regexp_like(first.text(), pattern))
        if op == "IN":
            found = [self._compare("=", first, v) for v in values[1:]]
            out = found[0]
            for one in found[1:]:
                out = out | one
            return Value("boolean", out)
        raise QueryError(f"unknown function {op}")


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def variables(expr: Expr) -> set[str]:
    if expr.op == "var":
        return {expr.args[0]}
    return set().union(*(variables(a) for a in expr.args if isinstance(a, Expr)))
