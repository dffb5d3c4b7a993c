from __future__ import annotations

import __spark_entry__
from graphloom import catalog


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 194


def test_graph_queries_have_oracles():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_planner_sees_the_whole_graph(spark, monkeypatch):
    seen = []
    analyze = catalog.Engine.analyze
    monkeypatch.setattr(catalog.Engine, "analyze", lambda engine: seen.append(engine) or analyze(engine))
    folder = "/root/testdata/sf0.001"
    rows = catalog.queries()["planned_bgp"](spark, folder).collect()
    whole = {r["p"] for r in catalog._triples(spark, folder).select("p").distinct().collect()}
    assert rows and {r["p"] for r in seen[0].store.triples().select("p").distinct().collect()} == whole


def test_ids_are_given_to_the_whole_graph(spark, monkeypatch):
    seen = []
    encode = catalog.encode_ids
    monkeypatch.setattr(catalog, "encode_ids", lambda triples: seen.append(triples) or encode(triples))
    folder = "/root/testdata/sf0.001"
    catalog.queries()["dictionary_ids"](spark, folder)
    whole = {r["p"] for r in catalog._triples(spark, folder).select("p").distinct().collect()}
    assert {r["p"] for r in seen[0].select("p").distinct().collect()} == whole
