from __future__ import annotations

import io
import time

import pytest

from graphloom import workload
from graphloom.config import parse_config
from graphloom.console import Console
from graphloom.engine import Engine
from graphloom.plans.model import Pattern, Var
from graphloom.sources.mapping import EDGES, MappedStore, vocabulary
from graphloom.sources.ntriples import encode_ids, predicate_catalogue, read_dictionary, read_id_triples, read_ntriples, write_encoded, write_id_triples, write_ntriples
from graphloom.sources.stores import VERTEX, DictStore, TermStore
from graphloom.storage import materialize, numbered, scope
from graphloom.streaming.append import append_triples, completed_by, stream_triples
from graphloom.terms import RDF_TYPE
from graphloom.workload import read_mix, run_mix

SF = "/root/testdata/sf0.001"
LINES = f"""# a comment
<http://t/T> <http://t/p> "with space \\"q\\"" .
<http://t/a> {RDF_TYPE} <http://t/T> .
<http://t/a> <http://t/p> "tag"@en .
<http://t/a> <http://t/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .
_:b <http://t/p> <http://t/a> .
_:b <http://t/p> <http://t/a> .

"""


def test_ntriples_to_ids_and_back(spark, tmp_path):
    (tmp_path / "in.nt").write_text(LINES)
    triples = read_ntriples(spark, str(tmp_path / "in.nt"))
    assert triples.count() == 6
    ids, names = encode_ids(triples)
    by_name = {r["str"]: (r["id"], r["kind"]) for r in names.collect()}
    assert by_name[RDF_TYPE] == (1, "index") and by_name["<http://t/T>"][0] < VERTEX <= by_name["<http://t/a>"][0]
    assert by_name["<http://t/T>"][1] == "index" and ids.count() == 5
    write_encoded(ids, names, str(tmp_path / "out"))
    back = DictStore(read_id_triples(spark, str(tmp_path / "out/id_triples"), "part-*"), read_dictionary(spark, str(tmp_path / "out")))
    assert sorted(r["o"] for r in Engine(back).sparql("SELECT ?o WHERE { <http://t/a> <http://t/p> ?o }").collect()) == ['"5"^^<http://www.w3.org/2001/XMLSchema#integer>', '"tag"@en']
    assert Engine(back).sparql("SELECT ?x WHERE { ?x a <http://t/T> }").count() == 1
    assert {r["str"] for r in predicate_catalogue(names).collect()} == {RDF_TYPE, "<http://t/T>", "<http://t/p>"}
    assert read_dictionary(spark, str(tmp_path / "out"), only=["_:b"]).where("kind = 'vertex'").count() == 1
    write_id_triples(ids, str(tmp_path / "by_p"))
    assert spark.read.parquet(str(tmp_path / "by_p")).count() == 5
    write_ntriples(triples, str(tmp_path / "nt"))
    assert read_ntriples(spark, str(tmp_path / "nt")).distinct().count() == 5


def test_bad_line_is_an_error(spark, tmp_path):
    (tmp_path / "in.nt").write_text("<a> <b> .\n")
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, str(tmp_path / "in.nt")).collect()


def test_constants_reach_the_scan(spark):
    store = MappedStore(spark, SF)
    plan = store.edges(vocabulary("placedBy"), o="<http://t/customer/7>")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert store.edges(vocabulary("placedBy"), o="<http://t/customer/07>").count() == 0
    assert store.edges("<http://t/none>").count() == 0


def test_stream_appends_once_and_completes_a_pattern(spark, tmp_path):
    rows = [("<x1>", "<p>", "<y1>"), ("<x2>", "<p>", "<y2>")]
    spark.createDataFrame([*rows, rows[0]], "s string, p string, o string").write.parquet(str(tmp_path / "in"))
    query = append_triples(stream_triples(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    static = TermStore(spark.createDataFrame([("<y1>", "<q>", "<z>")], "s string, p string, o string"))
    found = completed_by(stream_triples(spark, str(tmp_path / "in")), Pattern(Var("x"), "<p>", Var("y")), [Pattern(Var("y"), "<q>", Var("z"))], static)
    out = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert {tuple(r) for r in spark.table("found").select("x", "y", "z").collect()} == {("<x1>", "<y1>", "<z>")}


def test_settings_act(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    engine = Engine(MappedStore(spark, SF, {k: v for k, v in EDGES.items() if k in (RDF_TYPE, vocabulary("inRegion"))}))
    (tmp_path / "off").write_text("use_statistics 0\n")
    out = io.StringIO()
    console = Console(engine, parse_config("use_statistics 1\nshuffle_partitions 3"), out)
    assert engine.statistics is not None and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    console.run([f"reload-config {tmp_path / 'off'}"])
    assert engine.statistics is None and not out.getvalue()
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_instances_beyond_what_is_kept_are_looked_up(spark, monkeypatch):
    engine = Engine(MappedStore(spark, SF))
    for kept in (100, 3):
        monkeypatch.setattr(workload, "KEPT_INSTANCES", kept)
        found = workload.Instances(engine, vocabulary("Nation"))
        assert len(found) == 25 and [found[i] for i in (0, 24)] == ["<http://t/nation/0>", "<http://t/nation/9>"]


def test_written_tables_go_with_their_scope(spark):
    with scope(spark) as keep:
        gone, kept = materialize(spark.range(3), "gone"), keep(materialize(spark.range(4), "kept"))
    assert kept.count() == 4
    with pytest.raises(Exception, match="not exist|NOT_EXIST|FileNotFound"):
        spark.read.parquet(gone.scratch_path).count()
    assert [r["id"] for r in numbered(spark.createDataFrame([("b",), ("a",), ("c",)], "str string"), 5).orderBy("str").collect()] == [5, 6, 7]


def test_console_and_mix(spark, tmp_path):
    engine = Engine(MappedStore(spark, SF))
    (tmp_path / "light").write_text(f"SELECT ?x WHERE {{ ?x {vocabulary('inRegion')} %{vocabulary('Region')} <- }}")
    (tmp_path / "heavy").write_text(f"SELECT ?x WHERE {{ ?x {vocabulary('inRegion')} ?y . }}")
    (tmp_path / "mix").write_text("2 1\nlight 9\nheavy 1\n")
    out = io.StringIO()
    Console(engine, out=out).run(["help", f"sparql -f {tmp_path / 'heavy'} -p -n 2 -v 3", "show-config", "nonsense", "sparql -s 'SELECT'", "quit", "help"])
    text = out.getvalue()
    assert "25 rows" in text and "unknown command" in text and "error:" in text and "print_rows 10" in text
    began = time.time()
    log = run_mix(engine, read_mix((tmp_path / "mix").read_text()), tmp_path, duration=2, warm_up=0, parallel=2)
    assert log.latencies["light"] and time.time() - began < 30
