"""RDF terms as N-Triples tokens: ``<iri>``, ``"text"``, ``"text"@en``, ``"5"^^<datatype>``, ``_:node``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
INTEGER, DECIMAL, DOUBLE, BOOLEAN, STRING = (f"<{XSD}{name}>" for name in ("integer", "decimal", "double", "boolean", "string"))

#: A literal in three parts: text, language, datatype.
LITERAL = r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z][A-Za-z0-9-]*))?(?:\^\^(<[^>]*>))?$'
_LITERAL = re.compile(LITERAL, re.S)
_SPARK_LITERAL = f"(?s){LITERAL}"


def literal(text: str, language: str = "", datatype: str = "") -> str:
    """A literal token; ``datatype`` with its angle brackets."""
    escaped = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'"{escaped}"' + (f"@{language}" if language else f"^^{datatype}" if datatype else "")


def is_literal(term: str) -> bool:
    return bool(_LITERAL.match(term))


def lexical_text(term: str) -> str:
    """Text of a literal, address of an IRI."""
    found = _LITERAL.match(term)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), found[1]) if found else term.strip("<>")


def text_of(term: Column) -> Column:
    """Text of a literal, address of an IRI, null for a blank node."""
    raw = F.regexp_extract(term, _SPARK_LITERAL, 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\n", "\n"), r"\\r", "\r"), r"\\(.)", "$1")
    text = F.when(F.contains(raw, F.lit("\\")), plain).otherwise(raw)
    return F.when(term.startswith('"'), text).when(term.startswith("<"), F.substr(term, F.lit(2), F.length(term) - 2))


def language_of(term: Column) -> Column:
    """Language of a literal, empty if it has none; null for other terms."""
    return F.when(term.startswith('"'), F.regexp_extract(term, _SPARK_LITERAL, 2))


def datatype_of(term: Column) -> Column:
    """Datatype of a literal without language, that of strings if it has none; null for other terms."""
    named = F.regexp_extract(term, _SPARK_LITERAL, 3)
    plain = term.startswith('"') & (F.regexp_extract(term, _SPARK_LITERAL, 2) == "")
    return F.when(plain, F.when(named == "", F.lit(STRING)).otherwise(named))


def number_of(term: Column) -> Column:
    """Value of a literal whose text is a number, else null."""
    return F.when(term.startswith('"') & (F.regexp_extract(term, _SPARK_LITERAL, 2) == ""), F.regexp_extract(term, _SPARK_LITERAL, 1).try_cast("double"))
