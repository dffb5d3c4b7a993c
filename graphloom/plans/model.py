"""Queries as data: terms, patterns, groups, expressions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Var:
    name: str
    blank: bool = False

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Placeholder:
    """``%type`` of a template: any instance of the type."""

    type: str


#: A constant is its N-Triples token.
Term = Var | Placeholder | str


@dataclass(frozen=True)
class Pattern:
    """A triple pattern; ``reverse`` if the plan language has it start from the object."""

    s: Term
    p: Term
    o: Term
    reverse: bool = False

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in (self.s, self.p, self.o) if isinstance(t, Var)))


@dataclass(frozen=True)
class IndexScan:
    """Distinct subjects or objects of a predicate."""

    var: Var
    predicate: str
    subjects: bool

    def variables(self) -> list[str]:
        return [self.var.name]


@dataclass(frozen=True)
class Corun:
    """Keep rows whose values a chain confirms that is run from the distinct values of its start."""

    chain: tuple[Pattern, ...]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for p in self.chain for v in p.variables()))


Step = Pattern | IndexScan | Corun


@dataclass(frozen=True)
class Expr:
    """``op`` of ``args``; a leaf has its value in ``args``: var, iri, literal, number, boolean."""

    op: str
    args: tuple = ()


@dataclass
class Group:
    steps: list[Step] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    filters: list[Expr] = field(default_factory=list)


@dataclass(frozen=True)
class Order:
    """By variable, or by the count of SELECT COUNT if ``var`` is None."""

    var: str | None
    descending: bool = False


@dataclass
class Query:
    where: Group
    #: None: all named variables.
    select: list[str] | None = None
    #: "", DISTINCT, REDUCED, COUNT or DUPLICATES.
    modifier: str = ""
    order: list[Order] = field(default_factory=list)
    limit: int | None = None
    #: Plan-language queries run in the order as written.
    ordered: bool = False


class QueryError(ValueError):
    """A query that can't be parsed or doesn't make sense."""


def inner_name(name: str) -> str:
    """A column name for a variable; columns, unlike variables, don't differ by case."""
    upper = sum(1 << i for i, c in enumerate(name) if c.isupper())
    return f"{name.lower()}^{upper:x}" if upper else name


def with_inner_names(query: Query) -> Query:
    """The query with variables that differ as columns."""

    def term(t: Term) -> Term:
        return replace(t, name=inner_name(t.name)) if isinstance(t, Var) else t

    def step(s: Step) -> Step:
        if isinstance(s, Corun):
            return Corun(tuple(map(step, s.chain)))
        if isinstance(s, IndexScan):
            return replace(s, var=term(s.var))
        return replace(s, s=term(s.s), p=term(s.p), o=term(s.o))

    def expr(e: Expr) -> Expr:
        return Expr("var", (inner_name(e.args[0]),)) if e.op == "var" else Expr(e.op, tuple(expr(a) if isinstance(a, Expr) else a for a in e.args))

    def group(g: Group) -> Group:
        return Group([step(s) for s in g.steps], [[group(p) for p in parts] for parts in g.unions], [group(p) for p in g.optionals], [expr(f) for f in g.filters])

    order = [replace(o, var=None if o.var is None else inner_name(o.var)) for o in query.order]
    return replace(query, where=group(query.where), select=None if query.select is None else [inner_name(v) for v in query.select], order=order)
