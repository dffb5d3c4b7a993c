"""The plan language: queries whose steps run in the order and direction as written.

White space separates all tokens. A step has four: subject, predicate, object, and ``.`` or ``->``
to go from subject to object, ``<-`` to go from object to subject. ``__PREDICATE__`` in the middle
scans the index of a predicate; ``CORUN`` and ``FETCH`` enclose a chain; ``%type`` stands for any
instance of a type.
"""

from __future__ import annotations

from .model import Corun, Group, IndexScan, Pattern, Placeholder, Query, QueryError, Step, Term, Var

PREDICATE = "__PREDICATE__"


def _expanded(token: str, prefixes: dict[str, str]) -> str:
    """Prefixed names become IRIs; a name with an unknown prefix is a key of its own."""
    prefix, colon, local = token.partition(":")
    if token[:1] in "<\"_" or not colon or prefix not in prefixes:
        return token
    return f"<{prefixes[prefix]}{local}>"


def _term(token: str, prefixes: dict[str, str]) -> Term:
    if token[0] == "?":
        return Var(token[1:])
    if token[0] == "%":
        return Placeholder(_expanded(token[1:], prefixes))
    return _expanded(token, prefixes)


def _step(tokens: list[str], prefixes: dict[str, str]) -> Step:
    s, p, o = (_term(t, prefixes) for t in tokens[:3])
    if tokens[3] not in (".", "->", "<-"):
        raise QueryError(f"'.', '->' or '<-' expected, not {tokens[3]!r}")
    back = tokens[3] == "<-"
    if p == PREDICATE:
        var, predicate = (s, o) if back else (o, s)
        if not isinstance(var, Var) or not isinstance(predicate, str):
            raise QueryError(f"{PREDICATE} needs a variable and a predicate")
        return IndexScan(var, predicate, subjects=back)
    return Pattern(s, p, o, back)


def parse_plan(text: str) -> Query:
    tokens = text.split()
    prefixes: dict[str, str] = {}
    while tokens[:1] == ["PREFIX"]:
        if len(tokens) < 3 or not tokens[1].endswith(":"):
            raise QueryError("PREFIX needs a name and an IRI")
        prefixes[tokens[1][:-1]] = tokens[2].strip("<>")
        tokens = tokens[3:]
    if tokens[:1] != ["SELECT"] or "WHERE" not in tokens:
        raise QueryError("SELECT ... WHERE expected")
    at = tokens.index("WHERE")
    select = [t[1:] for t in tokens[1:at] if t[0] == "?"]
    tokens = tokens[at + 1 :]
    if tokens[:1] != ["{"] or "}" not in tokens:
        raise QueryError("braces expected after WHERE")
    tokens = tokens[1 : tokens.index("}")]
    marks = [i for i, t in enumerate(tokens) if t in ("CORUN", "FETCH")]
    if marks and [tokens[i] for i in marks] != ["CORUN", "FETCH"]:
        raise QueryError("one CORUN and then one FETCH may stand in a query")
    begin, end = marks or (len(tokens), len(tokens))
    steps: list[Step] = []
    for part, inside in ((tokens[:begin], False), (tokens[begin + 1 : end], True), (tokens[end + 1 :], False)):
        if len(part) % 4:
            raise QueryError("a step has four tokens")
        found = [_step(part[i : i + 4], prefixes) for i in range(0, len(part), 4)]
        if inside and found:
            if not all(isinstance(s, Pattern) for s in found):
                raise QueryError("CORUN takes triple patterns")
            steps.append(Corun(tuple(found)))
        elif not inside:
            steps += found
    if not steps:
        raise QueryError("no steps")
    return Query(Group(steps), select or None, ordered=True)


def placeholders(query: Query) -> list[str]:
    """Types of the placeholders in order, each as often as it stands in the query."""
    patterns = [p for s in query.where.steps for p in (s.chain if isinstance(s, Corun) else (s,)) if isinstance(p, Pattern)]
    return [t.type for p in patterns for t in (p.s, p.p, p.o) if isinstance(t, Placeholder)]
