"""Writers: N-Triples, Turtle, graph dumps, JSON-LD and converted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import terms as T


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """(value): a line for each triple."""
    return triples.select(F.concat(T.ntriples(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), T.ntriples(F.col("o")), F.lit(" .")).alias("value"))


def _headed(lines: DataFrame, head: str) -> DataFrame:
    """Lines of text with a head before the first of each partition, so of each file."""

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values and first and head:
                values[0], first = head + values[0], False
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    return lines.mapInArrow(headed, "value string")


def write_ntriples(triples: DataFrame, path: str, compress: bool = False, graph: str | None = None, append: bool = False) -> None:
    """Text files of N-Triples; with a graph, each file names it first, as the loader expects."""
    lines = ntriples_lines(triples)
    if graph is not None:
        lines = _headed(lines, f"# Graph: <{graph}>\n")
    writer = lines.write.mode("append" if append else "errorifexists")
    (writer.option("compression", "gzip") if compress else writer).text(path)


def turtle_blocks(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(value): a Turtle statement for each subject: predicates joined by ``;``, objects by ``,``, ``a`` for the type."""
    known = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))

    def short(iri):
        out = F.concat(F.lit("<"), iri, F.lit(">"))
        for p, base in known[::-1]:
            local = F.substr(iri, F.lit(len(base) + 1))
            out = F.when(iri.startswith(base) & local.rlike(r"^[A-Za-z0-9_]+$"), F.concat(F.lit(p + ":"), local)).otherwise(out)
        return out

    def term(t):
        bare = t["datatype"].isin(T.XSD + "integer", T.XSD + "boolean") & t["value"].rlike(r"^([+-]?\d+|true|false)$")
        return F.when(t["kind"] == "uri", short(t["value"])).when((t["kind"] == "literal") & F.coalesce(bare, F.lit(False)), t["value"]).otherwise(T.ntriples(t))

    written = triples.select(term(F.col("s")).alias("s"), F.when(F.col("p") == T.RDF + "type", F.lit("a")).otherwise(short(F.col("p"))).alias("p"), term(F.col("o")).alias("o"))
    objects = written.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("o"))
    # "a" comes first
    order = F.struct(F.when(F.col("p") == "a", 0).otherwise(1).alias("k"), "p", "o")
    subjects = objects.groupBy("s").agg(F.array_sort(F.collect_list(order)).alias("po"))
    body = F.array_join(F.transform("po", lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n  ")
    return subjects.select(F.concat("s", F.lit(" "), body, F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None, compress: bool = False) -> None:
    """Turtle files, each with its own prefix lines at the head."""
    head = "".join(f"@prefix {p}: <{b}> .\n" for p, b in (prefixes or {}).items())

    out = _headed(turtle_blocks(triples, prefixes), head).write
    (out.option("compression", "gzip") if compress else out).text(path)


def write_jsonld(rows: DataFrame, path: str, append: bool = False) -> None:
    """Line-wise JSON-LD files of (uri, json) rows."""
    rows.select(F.col("json").alias("value")).write.mode("append" if append else "errorifexists").text(path)


def records_jsonld(triples: DataFrame, classes=(), query: str | None = None, variable: str = "uri") -> DataFrame:
    """(uri, type, json): the root records of a graph as JSON-LD; with a query, those that its variable names and all that they lead to."""
    import functools

    from marginalia.operators import records as R
    from marginalia.operators import sparql

    known = {c.name: c for c in (classes or R.CLASSES)}
    if query is None:
        loaded = R.load_all(triples, tuple(known.values()))
    else:
        loaded = R.load_transitively(triples, sparql.query(triples, query).select(F.col(variable)["value"].alias("uri")), tuple(known.values()))
    return functools.reduce(DataFrame.unionByName, [R.to_jsonld(df, known[n]).select("uri", F.lit(n).alias("type"), "json") for n, df in loaded.items()])


def document_json(dnm: DataFrame, key: str, version: str = "1") -> DataFrame:
    """(key, json): plain text with its run-length references and replaced nodes."""
    return dnm.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("document"), F.lit(version).alias("version"), F.col("text").alias("plaintext"), "segments", F.col("replaced").alias("annotations"))).alias("json"))


def token_json(tokens: DataFrame, key: str) -> DataFrame:
    """(key, json): a document's tokens in order, with their offsets."""
    ordered = F.array_sort(F.collect_list(F.struct("tok_id", "token", F.col("start").alias("start-ref"), F.col("end").alias("end-ref"))))
    return tokens.groupBy(key).agg(F.to_json(ordered).alias("json"))


def token_arrays_json(arrays: DataFrame, key: str) -> DataFrame:
    """(key, json): what ``token_json`` gives, from a document's tokens in one array (``functions.text.token_arrays``): no token is shuffled or gathered."""
    ordered = F.transform("tokens", lambda x: F.struct(x["tok_id"].alias("tok_id"), x["token"].alias("token"), x["start"].alias("start-ref"), x["end"].alias("end-ref")))
    return arrays.select(key, F.to_json(ordered).alias("json"))


def graphviz(triples: DataFrame) -> DataFrame:
    """(value): an edge in DOT for each triple."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return triples.select(F.concat(quote(F.col("s.value")), F.lit(" -> "), quote(F.col("o.value")), F.lit(" [label="), quote(F.col("p")), F.lit("];")).alias("value"))
