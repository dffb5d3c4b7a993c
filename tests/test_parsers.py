from __future__ import annotations

import pytest

from graphloom.config import EngineConfig, parse_config, show_config
from graphloom.plans.model import Corun, Expr, IndexScan, Order, Pattern, QueryError, Var
from graphloom.plans.plan_language import parse_plan
from graphloom.plans.sparql import parse_sparql
from graphloom.terms import RDF_TYPE
from graphloom.workload import Log, QueryTemplate, read_mix


def where(text):
    return parse_sparql(f"PREFIX p: <http://p/> SELECT * WHERE {{ {text} }}").where


def test_triples_share_subjects_and_predicates():
    steps = where("?x a p:T ; p:q ?y , ?z . [] p:q [ p:r ?x ]").steps
    assert steps[0] == Pattern(Var("x"), RDF_TYPE, "<http://p/T>")
    assert [s.o for s in steps[1:3]] == [Var("y"), Var("z")]
    assert len(steps) == 5 and steps[3].p == "<http://p/r>" and steps[4].o == steps[3].s


def test_blank_nodes_are_not_named():
    steps = where("_:a p:q _:b . _:a p:q ?x").steps
    assert steps[0].s == steps[1].s and steps[0].s.blank and steps[0].s != steps[0].o


@pytest.mark.parametrize(
    "text,tree",
    [
        ("?a || ?b && ?c", Expr("||", (Expr("var", ("a",)), Expr("&&", (Expr("var", ("b",)), Expr("var", ("c",))))))),
        ("?a + ?b * ?c", Expr("+", (Expr("var", ("a",)), Expr("*", (Expr("var", ("b",)), Expr("var", ("c",))))))),
        ("!?a", Expr("not", (Expr("var", ("a",)),))),
        ("?a<=1", Expr("<=", (Expr("var", ("a",)), Expr("number", (1.0,))))),
        ("?a = 1.5e1", Expr("=", (Expr("var", ("a",)), Expr("number", (15.0,))))),
        ("true", Expr("boolean", (True,))),
    ],
)
def test_expressions(text, tree):
    assert where(f"?a p:q ?b FILTER({text})").filters == [tree]


def test_modifiers():
    query = parse_sparql("select distinct ?a $b where { ?a <http://p> ?b } order by ?a desc(?b) limit 5 # end")
    assert (query.modifier, query.select, query.limit) == ("DISTINCT", ["a", "b"], 5)
    assert query.order == [Order("a"), Order("b", True)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT WHERE { ?a <p> ?b }", "SELECT * { ?a <p> ?b }", "SELECT * FROM <x> WHERE { ?a <p> ?b }", "SELECT * WHERE { ?a p:b ?c }", "SELECT * WHERE { ?a <p> ?b } LIMIT 0",
        "PREFIX a: <x> PREFIX a: <y> SELECT * WHERE { ?a <p> ?b }", "SELECT * WHERE { ?a <p> ?b FILTER(foo(?a)) }", "SELECT * WHERE { ?a <p> ?b FILTER(STR(?a, ?b)) }",
        "SELECT * WHERE { ?a <p> }", "SELECT * WHERE { ?a <p> ?b", "SELECT ?a WHERE { ?a <p> ?b } ORDER BY count", "SELECT * WHERE { ?a <p> ?b } x", 'SELECT * WHERE { "a" <p> ?b }',
    ],
)
def test_sparql_errors(text):
    with pytest.raises(QueryError):
        parse_sparql(text)


def test_plan_steps():
    query = parse_plan('PREFIX u: <http://u#> SELECT ?x WHERE { ?x u:p "v w" . }'.replace('"v w"', "u:v"))
    assert query.where.steps == [Pattern(Var("x"), "<http://u#p>", "<http://u#v>")]
    steps = parse_plan("SELECT ?x WHERE { ?x __PREDICATE__ y:p <- ?x y:q ?y -> CORUN ?y y:r ?x <- FETCH }").where.steps
    assert steps[0] == IndexScan(Var("x"), "y:p", True) and not steps[1].reverse
    assert steps[2] == Corun((Pattern(Var("y"), "y:r", Var("x"), True),))


@pytest.mark.parametrize("text", ["select ?x WHERE { ?x p ?y . }", "SELECT ?x WHERE { ?x p ?y }", "SELECT ?x WHERE { ?x p ?y ; }", "SELECT ?x WHERE { CORUN ?x p ?y . }", "SELECT ?x WHERE { }"])
def test_plan_errors(text):
    with pytest.raises(QueryError):
        parse_plan(text)


def test_templates_take_the_same_seed_everywhere():
    template = QueryTemplate.parse("SELECT ?x WHERE { ?x y:p %y:T . %y:U y:q ?x <- }")
    template.candidates = [["a", "b", "c"], ["d", "e"]]
    assert [(s.s, s.o) for s in template.instantiate(4).where.steps] == [(Var("x"), "b"), ("d", Var("x"))]
    with pytest.raises(QueryError):
        QueryTemplate.parse("SELECT ?x WHERE { ?x y:p ?y . }")


def test_mix_and_log():
    assert [(e.path, e.weight, e.heavy) for e in read_mix("3 1\nq1 10\nq2 5\nheavy 1")] == [("q1", 10, False), ("q2", 5, False), ("heavy", 1, True)]
    log = Log({"q": [float(i) for i in range(100)]}, 0.0, 10.0)
    assert log.percentile("q", 50) == 50 and log.percentile("q", 99) == 99 and len(log.cdf("q")) == 25 and log.throughput() == 10
    assert len(log.merge(log).latencies["q"]) == 200


def test_config():
    assert parse_config("# c\nparallel 3\nuse_statistics 1") == EngineConfig(parallel=3, use_statistics=True)
    assert "print_rows 10" in show_config(EngineConfig())
    with pytest.raises(ValueError):
        parse_config("shuffle_partitions 3", reload=True)
