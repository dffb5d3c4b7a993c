"""Queries of the graph engine by name, with oracle SQL over the relational tables.

The graph is the mapping of the order, shipping and event tables in ``sources.mapping``. Oracle SQL
states each query over the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans import statistics as st
from .plans.sparql import parse_sparql
from .sources.mapping import ENTITY, MappedStore, vocabulary
from .sources.ntriples import encode_ids, predicate_catalogue, read_dictionary, read_id_triples, read_ntriples, write_encoded, write_id_triples, write_ntriples
from .sources.stores import DictStore, TermStore
from .storage import scratch_path
from .terms import INTEGER, RDF_TYPE
from .workload import QueryTemplate

Build = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Build] = {}
_ORACLES: dict[str, str] = {}
_PREFIXES = f"PREFIX v: <{vocabulary('')[1:-1]}> PREFIX nation: <{ENTITY}nation/> PREFIX region: <{ENTITY}region/> PREFIX customer: <{ENTITY}customer/> PREFIX part: <{ENTITY}part/> "
_FUNCTION = f"<{ENTITY}f#initial>"


def _e(kind: str, key: str) -> str:
    """SQL of an entity's term."""
    return f"'<{ENTITY}{kind}/' || {key} || '>'"


def _v(name: str) -> str:
    return f"'{vocabulary(name)}'"


def _t(column: str) -> str:
    return f"'\"' || {column} || '\"'"


def _i(column: str) -> str:
    return f"'\"' || {column} || '\"^^{INTEGER}'"


#: All distinct triples of the graph.
_TRIPLES = "WITH t AS MATERIALIZED (" + " UNION ".join(
    f"SELECT {s} AS s, {p} AS p, {o} AS o FROM {table}"
    for table, s, p, o in [
        *[(t, _e(k.lower(), c), f"'{RDF_TYPE}'", _v(k)) for t, k, c in [
            ("region", "Region", "r_regionkey"), ("nation", "Nation", "n_nationkey"), ("customer", "Customer", "c_custkey"), ("supplier", "Supplier", "s_suppkey"),
            ("part", "Part", "p_partkey"), ("orders", "Order", "o_orderkey"), ("events", "Event", "event_id"), ("events", "User", "user_id")]],
        ("region", _e("region", "r_regionkey"), _v("name"), _t("r_name")), ("nation", _e("nation", "n_nationkey"), _v("name"), _t("n_name")),
        ("customer", _e("customer", "c_custkey"), _v("name"), _t("c_name")), ("supplier", _e("supplier", "s_suppkey"), _v("name"), _t("s_name")),
        ("part", _e("part", "p_partkey"), _v("name"), _t("p_name")), ("nation", _e("nation", "n_nationkey"), _v("inRegion"), _e("region", "n_regionkey")),
        ("customer", _e("customer", "c_custkey"), _v("inNation"), _e("nation", "c_nationkey")), ("supplier", _e("supplier", "s_suppkey"), _v("inNation"), _e("nation", "s_nationkey")),
        ("customer", _e("customer", "c_custkey"), _v("segment"), _t("c_mktsegment")), ("part", _e("part", "p_partkey"), _v("brand"), _t("p_brand")),
        ("part", _e("part", "p_partkey"), _v("size"), _i("p_size")), ("orders", _e("order", "o_orderkey"), _v("placedBy"), _e("customer", "o_custkey")),
        ("orders", _e("order", "o_orderkey"), _v("status"), _t("o_orderstatus")), ("orders", _e("order", "o_orderkey"), _v("priority"), _t("o_orderpriority")),
        ("lineitem", _e("order", "l_orderkey"), _v("hasPart"), _e("part", "l_partkey")), ("lineitem", _e("order", "l_orderkey"), _v("hasSupplier"), _e("supplier", "l_suppkey")),
        ("lineitem", _e("part", "l_partkey"), _v("suppliedBy"), _e("supplier", "l_suppkey")), ("events", _e("event", "event_id"), _v("byUser"), _e("user", "user_id")),
        ("events", _e("event", "event_id"), _v("kind"), _t("event_type")),
    ]) + ") "


def _engine(spark: SparkSession, folder: str) -> Engine:
    return Engine(MappedStore(spark, folder), functions={_FUNCTION: lambda text: F.substr(text, F.lit(1), F.lit(1))})


def _add(name: str, build: Build, oracle: str) -> None:
    _QUERIES[name], _ORACLES[name] = build, oracle


def _plan(name: str, steps: str, oracle: str) -> None:
    text = f"{_PREFIXES} PREFIX rdf: <{RDF_TYPE[1:-5]}> SELECT * WHERE {{ {steps} }}"
    _add(name, lambda spark, folder: _engine(spark, folder).plan(text), oracle)


def _sparql(name: str, text: str, oracle: str) -> None:
    _add(name, lambda spark, folder: _engine(spark, folder).sparql(_PREFIXES + text), oracle)


def _filter(name: str, condition: str, oracle: str, where: str = "?p a v:Part ; v:size ?z ; v:name ?n", select: str = "?p") -> None:
    """Parts by a condition on their size ?z or name ?n."""
    _sparql(f"filter_{name}", f"SELECT {select} WHERE {{ {where} FILTER({condition}) }}", f"SELECT {_e('part', 'p_partkey')} AS p FROM part WHERE {oracle}")


_SUPPLIED = "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"
_CYCLE = f"""SELECT {_e("order", "l_orderkey")} AS o, {_e("supplier", "l_suppkey")} AS s, {_e("customer", "c_custkey")} AS c, {_e("nation", "c_nationkey")} AS n
FROM {_SUPPLIED} JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"""
_WHOLE_CYCLE = "?o v:hasSupplier ?s . ?o v:placedBy ?c . ?c v:inNation ?n . ?s v:inNation ?n"

# scans and lookups
_plan("type_index_scan", "?x rdf:type v:Supplier <-", f"SELECT {_e('supplier', 's_suppkey')} AS x FROM supplier")
_plan("pred_index_subjects", "?x __PREDICATE__ v:hasSupplier <-", f"SELECT DISTINCT {_e('order', 'l_orderkey')} AS x FROM lineitem")
_plan("pred_index_objects", "v:hasSupplier __PREDICATE__ ?x .", f"SELECT DISTINCT {_e('supplier', 'l_suppkey')} AS x FROM lineitem")
_plan("const_to_unknown_out", "customer:0 v:inNation ?n .", f"SELECT {_e('nation', 'c_nationkey')} AS n FROM customer WHERE c_custkey = 0")
_plan(
    "const_to_unknown_in", "?x v:inNation nation:0 <-",
    f"SELECT {_e('customer', 'c_custkey')} AS x FROM customer WHERE c_nationkey = 0 UNION ALL SELECT {_e('supplier', 's_suppkey')} FROM supplier WHERE s_nationkey = 0",
)
_plan("const_to_const", "?r rdf:type v:Region <- customer:0 v:segment ?g . customer:0 rdf:type v:Customer .", f"""SELECT {_e('region', 'r_regionkey')} AS r, {_t('c_mktsegment')} AS g FROM region, customer WHERE c_custkey = 0""")
_plan("const_to_known", "?x rdf:type v:Customer <- nation:0 v:inRegion ?r . ?x v:inNation nation:0 <-", f"SELECT {_e('customer', 'c_custkey')} AS x, {_e('region', 'n_regionkey')} AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey = 0")
_plan("known_to_const", '?o rdf:type v:Order <- ?o v:status "F" .', f"SELECT {_e('order', 'o_orderkey')} AS o FROM orders WHERE o_orderstatus = 'F'")
_plan("known_to_known", "?c v:inNation ?n . ?s v:inNation ?n <- ?s rdf:type v:Supplier . ?c rdf:type v:Customer . ?c v:inNation nation:3 .", f"""
SELECT {_e('customer', 'c_custkey')} AS c, {_e('nation', 'c_nationkey')} AS n, {_e('supplier', 's_suppkey')} AS s FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_nationkey = 3""")
_plan("unknown_constant", "?x v:inNation nation:99999 <-", "SELECT '' AS x WHERE false")
# expansions and joins
_plan("expand_out", "?x rdf:type v:Part <- ?x v:name ?y .", f"SELECT {_e('part', 'p_partkey')} AS x, {_t('p_name')} AS y FROM part")
_plan("expand_in", "?n v:inRegion region:1 <- ?x v:inNation ?n <-", f"""SELECT {_e('nation', 'n_nationkey')} AS n, x FROM nation JOIN (
SELECT c_nationkey AS k, {_e('customer', 'c_custkey')} AS x FROM customer UNION ALL SELECT s_nationkey, {_e('supplier', 's_suppkey')} FROM supplier) ON k = n_nationkey WHERE n_regionkey = 1""")
_plan("star", "?x v:inNation nation:0 <- ?x rdf:type v:Customer . ?x v:name ?n . ?x v:segment ?g .", f"SELECT {_e('customer', 'c_custkey')} AS x, {_t('c_name')} AS n, {_t('c_mktsegment')} AS g FROM customer WHERE c_nationkey = 0")
_plan("two_hop", "?n v:inRegion region:0 <- ?n rdf:type v:Nation . ?x v:inNation ?n <- ?x rdf:type v:Supplier .", f"SELECT {_e('nation', 'n_nationkey')} AS n, {_e('supplier', 's_suppkey')} AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0")
_plan("const_out_then_in", "customer:0 v:inNation ?n . ?y v:inNation ?n <-", f"""SELECT {_e('nation', 'c.c_nationkey')} AS n, y FROM customer c JOIN (
SELECT c_nationkey AS k, {_e('customer', 'c_custkey')} AS y FROM customer UNION ALL SELECT s_nationkey, {_e('supplier', 's_suppkey')} FROM supplier) ON k = c.c_nationkey WHERE c.c_custkey = 0""")
_sparql("cycle", f"SELECT ?o ?s ?c ?n WHERE {{ {_WHOLE_CYCLE} }}", _CYCLE)
_plan("cycle_plan", "?o v:hasSupplier ?s . ?o v:placedBy ?c . ?c v:inNation ?n . ?s v:inNation ?n .", _CYCLE)
_sparql("triangle", "SELECT ?o ?p ?s WHERE { ?o v:hasPart ?p . ?o v:hasSupplier ?s . ?p v:suppliedBy ?s }", f"""
SELECT {_e('order', 'a.l_orderkey')} AS o, {_e('part', 'a.l_partkey')} AS p, {_e('supplier', 'b.l_suppkey')} AS s FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
JOIN {_SUPPLIED} b ON a.l_orderkey = b.l_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) c ON c.l_partkey = a.l_partkey AND c.l_suppkey = b.l_suppkey""")
_sparql("empty_bgp", "SELECT ?x ?n WHERE { ?x a v:Part . ?x v:inNation ?n }", "SELECT '' AS x, '' AS n WHERE false")
_plan("corun", "?o v:hasSupplier ?s . ?o v:placedBy ?c . ?c v:inNation ?n . CORUN ?s v:inNation ?n . FETCH", _CYCLE)
_sparql("self_join", "SELECT ?a ?b ?n WHERE { ?a v:inNation ?n . ?b v:inNation ?n . ?a a v:Supplier . ?b a v:Supplier }", f"SELECT {_e('supplier', 'a.s_suppkey')} AS a, {_e('supplier', 'b.s_suppkey')} AS b, {_e('nation', 'a.s_nationkey')} AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
_sparql("same_variable_twice", "SELECT ?x WHERE { ?x v:inNation ?x }", "SELECT '' AS x WHERE false")
# variable predicates
_sparql("const_var_var", "SELECT ?p ?o WHERE { customer:0 ?p ?o }", f"{_TRIPLES} SELECT p, o FROM t WHERE s = '<{ENTITY}customer/0>'")
_plan("known_var_var", "?x v:inNation nation:0 <- ?x ?p ?o .", f"{_TRIPLES} SELECT a.s AS x, b.p, b.o FROM t a JOIN t b ON b.s = a.s WHERE a.p = {_v('inNation')} AND a.o = '<{ENTITY}nation/0>'")
_plan("known_var_const", "?x rdf:type v:Order <- ?x ?p customer:0 .", f"{_TRIPLES} SELECT a.s AS x, b.p FROM t a JOIN t b ON b.s = a.s WHERE a.p = '{RDF_TYPE}' AND a.o = {_v('Order')} AND b.o = '<{ENTITY}customer/0>'")
_sparql("spo_scan", "SELECT ?s ?p ?o WHERE { ?s ?p ?o }", f"{_TRIPLES} SELECT * FROM t")
# projection and modifiers
_sparql("select_star", "SELECT * WHERE { ?x v:segment ?g . ?x v:inNation nation:1 }", f"SELECT {_e('customer', 'c_custkey')} AS x, {_t('c_mktsegment')} AS g FROM customer WHERE c_nationkey = 1")
_sparql("select_distinct", "SELECT DISTINCT ?g WHERE { ?x v:segment ?g }", f"SELECT DISTINCT {_t('c_mktsegment')} AS g FROM customer")
_sparql("select_reduced", "SELECT REDUCED ?g WHERE { ?x v:segment ?g }", f"SELECT DISTINCT {_t('c_mktsegment')} AS g FROM customer")
_sparql("select_duplicates", "SELECT DUPLICATES ?g WHERE { ?x v:segment ?g }", f"SELECT {_t('c_mktsegment')} AS g FROM customer")
_sparql("count_modifier", "SELECT COUNT ?g WHERE { ?x v:segment ?g }", f"SELECT {_t('c_mktsegment')} AS g, count(*) AS count FROM customer GROUP BY c_mktsegment")
_sparql("order_limit", "SELECT ?x ?y WHERE { ?x a v:Part ; v:name ?y } ORDER BY DESC(?y) ?x LIMIT 20", f"SELECT {_e('part', 'p_partkey')} AS x, {_t('p_name')} AS y FROM part ORDER BY y DESC, x LIMIT 20")
_sparql("order_by_count", "SELECT COUNT ?c WHERE { ?o v:placedBy ?c } ORDER BY DESC(count) ASC(?c) LIMIT 10", f"SELECT {_e('customer', 'o_custkey')} AS c, count(*) AS count FROM orders GROUP BY o_custkey ORDER BY count DESC, c LIMIT 10")
# groups
_sparql("union", "SELECT ?x WHERE { { ?x a v:Customer } UNION { ?x a v:Supplier } }", f"SELECT {_e('customer', 'c_custkey')} AS x FROM customer UNION ALL SELECT {_e('supplier', 's_suppkey')} FROM supplier")
_sparql("union_joined", "SELECT ?x ?n WHERE { ?x v:name ?n . { ?x v:inNation nation:2 } UNION { ?x v:inNation nation:4 } UNION { ?x v:inRegion region:1 } }", f"""
SELECT {_e('customer', 'c_custkey')} AS x, {_t('c_name')} AS n FROM customer WHERE c_nationkey IN (2, 4) UNION ALL SELECT {_e('supplier', 's_suppkey')}, {_t('s_name')} FROM supplier WHERE s_nationkey IN (2, 4)
UNION ALL SELECT {_e('nation', 'n_nationkey')}, {_t('n_name')} FROM nation WHERE n_regionkey = 1""")
_sparql("nested_group", "SELECT ?x ?g WHERE { { ?x a v:Customer . { ?x v:segment ?g } } ?x v:inNation nation:5 }", f"SELECT {_e('customer', 'c_custkey')} AS x, {_t('c_mktsegment')} AS g FROM customer WHERE c_nationkey = 5")
_sparql("optional", "SELECT ?o ?s WHERE { ?o a v:Order OPTIONAL { ?o v:hasSupplier ?s } }", f"SELECT {_e('order', 'o_orderkey')} AS o, {_e('supplier', 'l_suppkey')} AS s FROM orders LEFT JOIN {_SUPPLIED} ON l_orderkey = o_orderkey")
_sparql("optional_filter_outer", "SELECT ?p ?z ?n WHERE { ?p v:size ?z OPTIONAL { ?p v:name ?n FILTER(?z > 25) } }", f"SELECT {_e('part', 'p_partkey')} AS p, {_i('p_size')} AS z, CASE WHEN p_size > 25 THEN {_t('p_name')} END AS n FROM part")
_sparql("optional_filter_inner", 'SELECT ?p ?n WHERE { ?p a v:Part OPTIONAL { ?p v:name ?n FILTER(REGEX(STR(?n), "^cold")) } }', f"SELECT {_e('part', 'p_partkey')} AS p, CASE WHEN p_name LIKE 'cold%' THEN {_t('p_name')} END AS n FROM part")
_sparql("optional_after_union", "SELECT ?x ?g ?n WHERE { { ?x v:segment ?g } UNION { ?x a v:Supplier } ?x v:inNation nation:3 OPTIONAL { ?x v:name ?n } OPTIONAL { ?x v:segment ?g } }", f"""
SELECT {_e('customer', 'c_custkey')} AS x, {_t('c_mktsegment')} AS g, {_t('c_name')} AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {_e('supplier', 's_suppkey')}, NULL, {_t('s_name')} FROM supplier WHERE s_nationkey = 3""")
_sparql("variables_by_case", "SELECT ?x ?n WHERE { ?x v:inNation ?N . ?n v:inNation ?N . ?x a v:Supplier . ?n a v:Supplier . ?N v:inRegion ?X }", f"SELECT {_e('supplier', 'a.s_suppkey')} AS x, {_e('supplier', 'b.s_suppkey')} AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
_sparql("order_numbers", "SELECT ?p ?z WHERE { ?p v:size ?z FILTER(?z < 12) } ORDER BY DESC(?z) ?p LIMIT 25", f"SELECT {_e('part', 'p_partkey')} AS p, {_i('p_size')} AS z FROM part WHERE p_size < 12 ORDER BY p_size DESC, p LIMIT 25")
_sparql("semicolon_comma", "SELECT ?a ?b ?n WHERE { ?o v:hasPart ?a , ?b ; v:placedBy customer:1 . ?a v:name ?n }", f"""WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 1)
SELECT {_e('part', 'a.l_partkey')} AS a, {_e('part', 'b.l_partkey')} AS b, {_t('p_name')} AS n FROM d a JOIN d b USING (l_orderkey) JOIN part ON p_partkey = a.l_partkey""")
_sparql("blank_node", "SELECT ?c ?s WHERE { [ v:placedBy ?c ; v:status ?s ] . ?c v:inNation _:n . _:n v:inRegion region:2 }", f"""SELECT {_e('customer', 'o_custkey')} AS c, {_t('o_orderstatus')} AS s FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2""")
# filters
_filter("gt", "?z > 40", "p_size > 40")
_filter("le", "?z <= 10", "p_size <= 10")
_filter("lt", "?z < 7", "p_size < 7")
_filter("ge", "?z >= 49", "p_size >= 49")
_filter("eq", "?z = 25", "p_size = 25")
_filter("arith", "?z * 2 + 1 >= 90", "p_size * 2 + 1 >= 90")
_filter("divide", "(?z - 1) / 2 > 20.5", "(p_size - 1) / 2.0 > 20.5")
_filter("unary", "-?z < -45 && +?z > 0", "p_size > 45")
_filter("and", "?z > 20 && ?z < 30", "p_size > 20 AND p_size < 30")
_filter("or_not", "!(?z > 3) || ?z = 50", "p_size <= 3 OR p_size = 50")
_filter("error_is_false", "?n > 5", "false")
_filter("boolean", "true && (?z = 1) = true", "p_size = 1")
_filter("str", 'STR(?z) = "7"', "p_size = 7")
_filter("lang", 'LANG(?n) = "" && ?z = 9', "p_size = 9")
_filter("langmatches", 'LANGMATCHES("en-GB", "en") && ?z = 10', "p_size = 10")
_filter("datatype", f"DATATYPE(?z) = {INTEGER} && ?z = 11", "p_size = 11")
_filter("bound", "BOUND(?z) && !BOUND(?missing) && ?z = 12", "p_size = 12")
_filter("sameterm", f'sameTerm(?z, "13"^^{INTEGER})', "p_size = 13")
_filter("isiri", "isIRI(?p) && isURI(?p) && !isIRI(?n) && ?z = 14", "p_size = 14")
_filter("isblank", "!isBLANK(?p) && ?z = 15", "p_size = 15")
_filter("isliteral", "isLITERAL(?n) && !isLITERAL(?p) && ?z = 16", "p_size = 16")
_filter("regex", 'REGEX(STR(?n), "^cold")', "p_name LIKE 'cold%'")
_filter("regex_flags", 'REGEX(STR(?n), "COLD", "i")', "lower(p_name) LIKE '%cold%'")
_filter("iri", "?p = part:17", "p_partkey = 17")
_filter("function", f'{_FUNCTION}(?n) = "c"', "p_name LIKE 'c%'")
_sparql("filter_ne", "SELECT ?a ?b WHERE { ?a a v:Supplier . ?b a v:Supplier . ?a v:inNation ?n . ?b v:inNation ?n FILTER(?a != ?b) }", f"SELECT {_e('supplier', 'a.s_suppkey')} AS a, {_e('supplier', 'b.s_suppkey')} AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
_sparql("filter_in", 'SELECT ?c WHERE { ?c v:segment ?g FILTER(IN(?g, "FURNITURE", "BUILDING")) }', f"SELECT {_e('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING')")


# statistics, ids, templates, planner


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    return MappedStore(spark, folder).triples()


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship over integer ids and a dictionary of them."""
    triples, names = encode_ids(_triples(spark, folder))
    return Engine(DictStore(triples, names, distinct=False)).sparql(f"{_PREFIXES} SELECT ?o ?s ?c ?n WHERE {{ {_WHOLE_CYCLE} }}")


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    """Joins ordered by statistics, over materialised terms."""
    engine = Engine(TermStore(_triples(spark, folder)))
    engine.analyze()
    return engine.sparql(f"{_PREFIXES} SELECT ?n ?x WHERE {{ ?x v:inNation ?n . ?x a v:Supplier . ?n v:inRegion region:0 . ?n a v:Nation }}")


def _template(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    template = QueryTemplate.parse(f"{_PREFIXES} PREFIX rdf: <{RDF_TYPE[1:-5]}> SELECT ?x WHERE {{ ?x v:inNation %v:Nation <- ?x rdf:type v:Supplier . }}")
    template.fill(engine)
    return engine.run(template.instantiate(0))


def _through_text(spark: SparkSession, folder: str) -> DataFrame:
    """The graph written as N-Triples and read back."""
    path = scratch_path(spark, "ntriples")
    write_ntriples(_triples(spark, folder), path)
    return read_ntriples(spark, path).distinct()


def _through_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """The graph written as id triples with dictionary files, and read back."""
    path = scratch_path(spark, "ids")
    write_encoded(*encode_ids(_triples(spark, folder)), path)
    store = DictStore(read_id_triples(spark, f"{path}/id_triples", "part-*"), read_dictionary(spark, path))
    return store.decode(store.triples(), ["s", "p", "o"]).withColumn("p", F.when(F.col("p") == "rdf:type", F.lit(RDF_TYPE)).otherwise(F.col("p")))


def _through_predicate_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of ids in a folder for each predicate, and how many each has."""
    triples, names = encode_ids(_triples(spark, folder))
    path = scratch_path(spark, "by_predicate")
    write_id_triples(triples, path)
    sizes = spark.read.parquet(path).groupBy(F.col("p").alias("id")).agg(F.count("*").alias("n"))
    return sizes.join(predicate_catalogue(names), "id").select(F.col("str").alias("p"), "n")


_add("ntriples_files", _through_text, f"{_TRIPLES} SELECT * FROM t")
_add("id_files", _through_id_files, f"{_TRIPLES} SELECT * FROM t")
_add("predicate_folders", _through_predicate_folders, f"{_TRIPLES} SELECT p, count(*) AS n FROM t GROUP BY p")
_add("pred_stats", lambda s, d: st.predicate_sizes(_triples(s, d)), f"{_TRIPLES} SELECT p, count(*) AS n_triples, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM t GROUP BY p")
_add("type_stats", lambda s, d: st.type_sizes(_triples(s, d), RDF_TYPE), f"{_TRIPLES} SELECT o, count(*) AS n_instances FROM t WHERE p = '{RDF_TYPE}' GROUP BY o")
_add("pred_correlation", lambda s, d: st.predicate_pairs(_triples(s, d)), f"""{_TRIPLES}, k AS (SELECT DISTINCT s AS v, p, 'out' AS d FROM t UNION SELECT DISTINCT o, p, 'in' FROM t)
SELECT a.p AS p1, a.d AS d1, b.p AS p2, b.d AS d2, count(*) AS n FROM k a JOIN k b ON a.v = b.v AND (a.p, a.d) < (b.p, b.d) GROUP BY ALL""")
_add("dataset_stats", lambda s, d: st.dataset_size(_triples(s, d)), f"{_TRIPLES} SELECT count(*) AS n_triples, count(DISTINCT s) AS n_subjects, count(DISTINCT p) AS n_predicates, count(DISTINCT o) AS n_objects FROM t")
_add("result_count", lambda s, d: _engine(s, d).group(parse_sparql(f"{_PREFIXES} SELECT * WHERE {{ {_WHOLE_CYCLE} }}").where).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM ({_CYCLE})")
_add("dictionary_ids", _ids, _CYCLE)
_add("planned_bgp", _planned, f"SELECT {_e('nation', 'n_nationkey')} AS n, {_e('supplier', 's_suppkey')} AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0")
_add("template_instance", _template, f"SELECT {_e('supplier', 's_suppkey')} AS x FROM supplier WHERE s_nationkey = 0")


def queries() -> dict[str, Build]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
