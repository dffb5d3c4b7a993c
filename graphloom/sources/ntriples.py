"""N-Triples files, integer-id triple files, dictionaries, and the encoding from one to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, numbered, scope
from ..terms import RDF_TYPE
from .stores import PREDICATE_ID, TYPE_ID, VERTEX

#: Names of the reserved ids in dictionary files.
RESERVED = (("__PREDICATE__", PREDICATE_ID), ("rdf:type", TYPE_ID))
_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of the lines that are triples; comments and empty lines are passed over, others raise an error."""
    line = F.col("value")
    rows = spark.read.text(path).where(~line.rlike(r"^\s*(#.*)?$"))
    parts = [F.regexp_extract(line, _LINE, i) for i in (1, 2, 3)]
    valid = F.when(line.rlike(_LINE), parts[0]).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), line)))
    return rows.select(valid.alias("s"), parts[1].alias("p"), parts[2].alias("o"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.text(path)


def encode_ids(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct triples of ids, sorted by predicate in each file, and the dictionary (id, str, kind); both written.

    Predicates and types get the ids from 2, in order; all other terms those from 2 ** 17, or after
    the last index id if there are more. A type is an index wherever else it stands.
    """
    spark = triples.sparkSession
    with scope(spark) as keep:
        distinct = materialize(triples.select("s", "p", "o").distinct(), "triples")
        # a row for each term: whether it is a predicate or type anywhere
        is_type = F.col("p") == RDF_TYPE
        roles = F.array(F.struct(F.col("s").alias("str"), F.lit(False).alias("index")), F.struct(F.col("o").alias("str"), is_type.alias("index")), F.struct(F.col("p").alias("str"), F.lit(True).alias("index")))
        terms = distinct.select(F.explode(roles).alias("t")).select("t.*").where(F.col("str") != RDF_TYPE).groupBy("str").agg(F.max("index").alias("index"))
        terms = materialize(terms, "terms")
        index = terms.where("index")
        start = max(VERTEX, index.count() + TYPE_ID + 1)
        reserved = spark.createDataFrame([(i, RDF_TYPE if i == TYPE_ID else name, "index") for name, i in RESERVED], "id long, str string, kind string")
        parts = [numbered(rows, first).select("id", "str", F.lit(kind).alias("kind")) for rows, first, kind in ((index, TYPE_ID + 1, "index"), (terms.where("NOT index"), start, "vertex"))]
        names = keep(materialize(reserved.union(parts[0]).union(parts[1]), "dictionary"))
        out = distinct
        for column in ("p", "s", "o"):
            key = names.where("kind = 'index'") if column == "p" else names
            out = out.join(key.select(F.col("id").alias(f"{column}_id"), F.col("str").alias(column)), column)
        out = out.select(F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o")).sortWithinPartitions("p")
        return keep(materialize(out, "id_triples")), names


def read_id_triples(spark: SparkSession, folder: str, pattern: str = "id_*") -> DataFrame:
    """Distinct s, p, o of tab-separated files, predicate first in each partition as a store would sort them."""
    rows = spark.read.option("pathGlobFilter", pattern).csv(folder, sep="\t", schema="s long, p long, o long")
    return rows.distinct()


def write_id_triples(triples: DataFrame, folder: str) -> None:
    """Partitioned by predicate, sorted within: readers of one predicate open its folder alone."""
    triples.select("s", "p", "o").repartition("p").sortWithinPartitions("p", "s", "o").write.partitionBy("p").parquet(folder)


def read_dictionary(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """id, str, kind of the files str_index and str_normal; ``only``: of vertices just these terms."""
    schema = "str string, id long"
    options = {"sep": "\t", "schema": schema, "quote": ""}
    index = spark.read.csv(f"{folder}/str_index", **options).select("id", "str", F.lit("index").alias("kind"))
    normal = spark.read.csv(f"{folder}/str_normal", **options).select("id", "str", F.lit("vertex").alias("kind"))
    if only is not None:
        normal = normal.where(F.col("str").isin(only))
    return index.union(normal)


def write_encoded(triples: DataFrame, names: DataFrame, folder: str) -> None:
    """id_* folder of tab-separated triples, str_index and str_normal."""
    triples.select(F.concat_ws("\t", "s", "p", "o")).write.text(f"{folder}/id_triples")
    shown = F.when(F.col("str") == RDF_TYPE, F.lit("rdf:type")).otherwise(F.col("str"))
    for kind, name in (("index", "str_index"), ("vertex", "str_normal")):
        names.where(F.col("kind") == kind).select(F.concat_ws("\t", shown, "id")).write.text(f"{folder}/{name}")


def predicate_catalogue(names: DataFrame) -> DataFrame:
    """Predicates and types: the index terms but the reserved one of predicates."""
    return names.where((F.col("kind") == "index") & (F.col("id") != PREDICATE_ID)).select("id", "str")
