"""RDF terms as canonical text: <iri>, _:label, "lexical"^^<datatype> or "lexical"@lang; << s p o >> for triple terms.

One string per position keeps joins, DISTINCT and sorting on plain columns. The functions below are Column builders;
an operation that has no value for its operand gives null, as an unbound result does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: IRIs of the RDF, RDFS, OWL and XSD vocabularies
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
TYPE = f"<{RDF}type>"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (f"<{RDFS}{x}>" for x in ("subClassOf", "subPropertyOf", "domain", "range"))

_LITERAL = r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def iri(*parts: Column | str) -> Column:
    """An IRI from constant strings and columns."""
    return F.concat(F.lit("<"), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(">"))


def literal(value: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    text = F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    end = f'"@{lang}' if lang else f'"^^<{datatype}>' if datatype else '"'
    return F.concat(F.lit('"'), text, F.lit(end))


def blank(*parts: Column | str) -> Column:
    """A blank node whose label is a hash of its scope."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit("_:b"), F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in cols])), 256), 1, 32))


def is_iri(t: Column) -> Column:
    return t.startswith("<") & ~t.startswith("<<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """STR(): the IRI or the lexical form; null for blank nodes."""
    inner = F.regexp_extract(t, _LITERAL, 1)
    unescaped = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(is_iri(t), F.regexp_extract(t, "^<([^>]*)>$", 1)).when(is_literal(t), unescaped)


def lang(t: Column) -> Column:
    """LANG(): the tag, "" for literals without one, null for others."""
    return F.when(is_literal(t), F.regexp_extract(t, _LITERAL, 2))


def datatype(t: Column) -> Column:
    """DATATYPE() as a term: rdf:langString for tagged literals, xsd:string for plain ones."""
    own = F.regexp_extract(t, _LITERAL, 3)
    name = F.when(F.regexp_extract(t, _LITERAL, 2) != "", F.lit(f"{RDF}langString")).when(own != "", own).otherwise(F.lit(f"{XSD}string"))
    return F.when(is_literal(t), F.concat(F.lit("<"), name, F.lit(">")))


# fixed values: Spark types for XSD datatypes
XSD_TYPES = {"integer": "decimal(38,0)", "long": "bigint", "int": "int", "short": "smallint", "byte": "tinyint", "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "dateTime": "timestamp_ntz", "string": "string"}


def xsd_cast(t: Column, name: str) -> Column:
    """The value of a literal as an XSD type; null if its lexical form isn't one."""
    return lexical(t).try_cast(XSD_TYPES[name])


def number(t: Column) -> Column:
    return lexical(t).try_cast("double")


def regex(t: Column, pattern: str, flags: str = "") -> Column:
    """REGEX() on the lexical form; a bad pattern is the caller's error."""
    return lexical(t).rlike(f"(?{flags}){pattern}" if flags else pattern)


def effective_boolean(t: Column) -> Column:
    """EBV: false for empty strings and zero; null, so no solution, where it isn't defined."""
    x, kind = lexical(t), datatype(t)
    numeric = F.regexp_extract(kind, f"^<{XSD}(integer|long|int|short|byte|decimal|double|float)>$", 1) != ""
    return F.when(kind == f"<{XSD}boolean>", x.isin("true", "1")).when(numeric, (x.try_cast("double") != 0) & ~F.isnan(x.try_cast("double"))).when(kind.isin(f"<{XSD}string>", f"<{RDF}langString>"), x != "")
