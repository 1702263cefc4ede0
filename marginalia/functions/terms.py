"""RDF terms as columns: literals, IRIs, namespaces and sampling hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE = RDF + "type"
#: A term: kind is uri, bnode or literal.
TERM = "struct<kind:string,value:string,datatype:string,lang:string>"


def _term(kind: str, value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (none if datatype is None else datatype).alias("datatype"), (none if lang is None else lang).alias("lang"))


def uri(value: Column) -> Column:
    return _term("uri", value)


def bnode(*parts: Column) -> Column:
    """A blank node whose label is a digest of what it stands for: the same on each run."""
    return _term("bnode", F.concat(F.lit("b"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 24)))


def literal(value: Column, datatype: str = "string") -> Column:
    """A typed literal in its lexical form: doubles in exponent form, booleans and times as XSD writes them."""
    if datatype in ("double", "float"):
        text = F.format_string("%E", value.cast("double"))
    elif datatype == "dateTime":
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = value.cast("string")
    return _term("literal", text, F.lit(XSD + datatype))


def lang_literal(value: Column, lang: str) -> Column:
    return _term("literal", value, F.lit(RDF + "langString"), F.lit(lang))


def value_of(term: Column, datatype: str) -> Column:
    """The value of a literal, null where it isn't one of that type."""
    kind = {"integer": "bigint", "nonNegativeInteger": "bigint", "gYear": "int", "double": "double", "float": "double", "decimal": "double", "boolean": "boolean", "dateTime": "timestamp", "string": "string"}[datatype]
    return F.when((term["kind"] == "literal") & (term["datatype"] == XSD + datatype), term["value"].try_cast(kind))


def escape(text: Column) -> Column:
    out = text
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def ntriples(term: Column) -> Column:
    """A term as N-Triples writes it."""
    quoted = F.concat(F.lit('"'), escape(term["value"]), F.lit('"'))
    suffix = F.when(term["lang"].isNotNull(), F.concat(F.lit("@"), term["lang"])).when(term["datatype"].isNull() | (term["datatype"] == XSD + "string"), "").otherwise(F.concat(F.lit("^^<"), term["datatype"], F.lit(">")))
    return F.when(term["kind"] == "uri", F.concat(F.lit("<"), term["value"], F.lit(">"))).when(term["kind"] == "bnode", F.concat(F.lit("_:"), term["value"])).otherwise(F.concat(quoted, suffix))


def namespacify(df: DataFrame, value: str, namespaces: DataFrame) -> DataFrame:
    """Add ``prefix`` and ``local`` by the longest of the namespaces (prefix, base) that the IRI begins with; null where there is none.

    The namespaces become one sorted array expression, as they are few, so no join multiplies the rows.
    """
    known = sorted(((r.prefix, r.base) for r in namespaces.select("prefix", "base").limit(10_001).collect()), key=lambda x: -len(x[1]))
    if len(known) > 10_000:
        raise ValueError("more than 10,000 namespaces")
    if len({b for _, b in known}) < len(known):
        raise ValueError("a namespace is named twice")
    v = F.col(value)
    prefix = base = None
    for p, b in known:
        hit = v.startswith(b)
        prefix = F.when(hit, p) if prefix is None else prefix.when(hit, p)
        base = F.when(hit, len(b)) if base is None else base.when(hit, len(b))
    if prefix is None:
        prefix, base = F.lit(None).cast("string"), F.lit(None).cast("int")
    return df.withColumn("prefix", prefix).withColumn("local", F.when(F.col("prefix").isNotNull(), F.substr(v, base + 1)))


def prefixed(prefix: Column, local: Column, iri: Column) -> Column:
    """``prefix:local`` with reserved characters escaped, or the IRI in angle brackets."""
    safe = F.regexp_replace(local, r"([~.!$&'()*+,;=/?#@%_-])", r"\\$1")
    safe = F.replace(F.replace(safe, F.lit("\\_"), F.lit("_")), F.lit("\\-"), F.lit("-"))
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit(":"), safe)).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def sha256_mod(text: Column, m: int) -> Column:
    """The whole SHA-256 digest as one number, modulo m (up to 2^31), exactly."""
    digest = F.sha2(text, 256)
    out = F.lit(0).cast("bigint")
    for i in range(8):
        out = (out * 4294967296 + F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("bigint")) % m
    return out


def fraction(text: Column) -> Column:
    """The smallest nested sample that a text is in: 1 in 10,000, 1,000, 100, 10, or all."""
    return F.when(sha256_mod(text, 10_000) == 0, 10_000).when(sha256_mod(text, 1_000) == 0, 1_000).when(sha256_mod(text, 100) == 0, 100).when(sha256_mod(text, 10) == 0, 10).otherwise(1)
