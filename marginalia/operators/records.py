"""Typed records as DataFrames, and their ways to triples, back, and to JSON-LD.

A record class is declared once (``RecordClass``); from it come the DataFrame schema, the triples, the conditional aggregation
that reads them back, and the JSON-LD form with its context.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.functions import terms as T
from marginalia.functions.batches import in_batches
from marginalia.sources.shared import discard, written

OA = "http://www.w3.org/ns/oa#"
DCT = "http://purl.org/dc/terms/"
NS = "http://example.org/marginalia/"


@dataclass(frozen=True)
class Attr:
    """An attribute: its column, predicate and type (``uri``, ``html`` or an XSD type); several values, an RDF list, or a reversed predicate.

    With ``nested`` classes the column holds records: a struct (or an array of structs) of ``type``, ``uri`` and the attributes of any of them.
    """

    name: str
    predicate: str
    kind: str = "uri"
    many: bool = False
    ordered: bool = False
    reverse: bool = False
    term: str | None = None
    nested: tuple["RecordClass", ...] = ()


@dataclass(frozen=True)
class RecordClass:
    """A class of records: type IRI and attributes; ``root`` records have an IRI of their own in the column ``uri``."""

    name: str
    type: str
    attrs: tuple[Attr, ...]
    root: bool = True


ANNOTATION = RecordClass("Annotation", OA + "Annotation", (Attr("target_uri", OA + "hasTarget", term="target"), Attr("creator_uri", DCT + "creator", term="creator"), Attr("tags", NS + "val", many=True, term="tags")))
FRAGMENT_TARGET = RecordClass("FragmentTarget", NS + "FragmentTarget", (Attr("source", OA + "hasSource"), Attr("start", OA + "start", "nonNegativeInteger"), Attr("end", OA + "end", "nonNegativeInteger")))
PATH_SELECTOR = RecordClass("PathSelector", NS + "PathSelector", (Attr("start_path", NS + "startPath", "string", term="startPath"), Attr("end_path", NS + "endPath", "string", term="endPath")), root=False)
OFFSET_SELECTOR = RecordClass("OffsetSelector", NS + "OffsetSelector", (Attr("start", OA + "start", "nonNegativeInteger"), Attr("end", OA + "end", "nonNegativeInteger")), root=False)
LIST_SELECTOR = RecordClass("ListSelector", NS + "ListSelector", (Attr("selectors", NS + "vals", many=True, ordered=True, term="vals"),), root=False)
SIMPLE_TAG_BODY = RecordClass("SimpleTagBody", NS + "SimpleTagBody", (Attr("tag", NS + "val", term="val"),), root=False)
MULTI_TAG_BODY = RecordClass("MultiTagBody", NS + "MultiTagBody", (Attr("tags", NS + "val", many=True, term="val"),), root=False)
TAG = RecordClass("Tag", NS + "Tag", (Attr("belongs_to", NS + "belongsTo", term="belongsTo"), Attr("label", "http://www.w3.org/2000/01/rdf-schema#label", "string"), Attr("comment", "http://www.w3.org/2000/01/rdf-schema#comment", "string"), Attr("sub_tag_of", NS + "subTagOf", term="subTagOf")))
TAG_SET = RecordClass("TagSet", NS + "TagSet", (Attr("tags", NS + "belongsTo", many=True, reverse=True), Attr("label", "http://www.w3.org/2000/01/rdf-schema#label", "string"), Attr("comment", "http://www.w3.org/2000/01/rdf-schema#comment", "string")))
REPLACED_HTML_BODY = RecordClass("ReplacedHtmlBody", NS + "ReplacedHtmlBody", (Attr("html_frag", NS + "val", "html", term="html-val"),), root=False)
DOCUMENT_INFO = RecordClass("DocumentInfo", NS + "Document", (Attr("license", DCT + "license"), Attr("belongs_to", NS + "belongsTo", term="belongsTo"), Attr("title", DCT + "title", "string"), Attr("year", DCT + "issued", "gYear"), Attr("based_on", NS + "isBasedOn", term="isBasedOn")))
CORPUS_INFO = RecordClass("CorpusInfo", NS + "Corpus", (Attr("label", "http://www.w3.org/2000/01/rdf-schema#label", "string"), Attr("comment", "http://www.w3.org/2000/01/rdf-schema#comment", "string"), Attr("based_on", NS + "isBasedOn", term="isBasedOn")))
SPOTTER_RUN = RecordClass("SpotterRun", NS + "SpotterRun", (Attr("spotter", NS + "withSpotter"), Attr("version", NS + "spotterVersion", "string", term="spotterVersion"), Attr("label", "http://www.w3.org/2000/01/rdf-schema#label", "string"), Attr("date", NS + "runDate", "dateTime", term="runDate")))
IDENTIFIER = RecordClass("Identifier", NS + "Identifier", (Attr("id_string", NS + "idString", "string", term="idString"),))
OCCURRENCE = RecordClass("IdentifierOccurrence", NS + "IdentifierOccurrence", (Attr("occurrence_of", NS + "occurrenceOf", term="occurrenceOf"),), root=False)
DECLARATION = RecordClass("IdentifierDeclaration", NS + "IdentifierDeclaration", (Attr("polarity", NS + "polarity"), Attr("declares", NS + "declares")), root=False)
TYPE_RESTRICTION = RecordClass("IdentifierTypeRestriction", NS + "IdentifierTypeRestriction", (Attr("restricts", NS + "restricts"),), root=False)
CLASSES = (ANNOTATION, FRAGMENT_TARGET, PATH_SELECTOR, OFFSET_SELECTOR, LIST_SELECTOR, SIMPLE_TAG_BODY, MULTI_TAG_BODY, TAG, TAG_SET, REPLACED_HTML_BODY, DOCUMENT_INFO, CORPUS_INFO, SPOTTER_RUN, IDENTIFIER, OCCURRENCE, DECLARATION, TYPE_RESTRICTION)


#: Targets with their selectors, which lists of selectors refine; annotations with a target and bodies in them.
_REFINED = RecordClass("ListSelector", NS + "ListSelector", (Attr("vals", NS + "vals", ordered=True, nested=(PATH_SELECTOR, OFFSET_SELECTOR)),), root=False)
NESTED_SELECTORS = tuple(replace(c, attrs=(*c.attrs, Attr("refined_by", OA + "refinedBy", nested=(_REFINED,), term="refinedBy"))) for c in (PATH_SELECTOR, OFFSET_SELECTOR))
NESTED_TARGET = RecordClass("FragmentTarget", NS + "FragmentTarget", (Attr("source", OA + "hasSource"), Attr("selectors", OA + "hasSelector", many=True, nested=NESTED_SELECTORS, term="selector")))
NESTED_ANNOTATION = RecordClass("Annotation", OA + "Annotation", (Attr("target", OA + "hasTarget", nested=(NESTED_TARGET,)), Attr("creator_uri", DCT + "creator", term="creator"), Attr("bodies", OA + "hasBody", many=True, nested=(SIMPLE_TAG_BODY, REPLACED_HTML_BODY), term="body")))


class Resolver:
    """Type IRI -> record class; two classes for one type are an error."""

    def __init__(self, classes: tuple[RecordClass, ...] = CLASSES):
        self.by_type: dict[str, RecordClass] = {}
        for c in classes:
            if self.by_type.setdefault(c.type, c) is not c:
                raise ValueError(f"two record classes for {c.type}")

    def __getitem__(self, type_: str) -> RecordClass:
        return self.by_type[type_]


def _object(attr: Attr, value: Column) -> Column:
    if attr.kind == "uri":
        return T.uri(value)
    if attr.kind == "html":
        return F.struct(F.lit("literal").alias("kind"), value.cast("string").alias("value"), F.lit(T.RDF + "HTML").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return T.literal(value, attr.kind)


_KIND = f"array<struct<s:{T.TERM},p:string,o:{T.TERM}>>"


def _triple(s: Column, p: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def _many(attr: Attr, values: Column, seed: Column, subject: Column) -> tuple[list[Column], list[Column]]:
    """Triples, and arrays of triples, of an attribute with several values."""
    node = (lambda x, i: _nested_subject(attr, x, seed, i)) if attr.nested else (lambda x, i: _object(attr, x))
    below = [F.flatten(F.transform(values, lambda x, i: _nested_triples(attr, x, seed, i)))] if attr.nested else []
    if not attr.ordered:
        link = (lambda x, i: _triple(node(x, i), attr.predicate, subject)) if attr.reverse else (lambda x, i: _triple(subject, attr.predicate, node(x, i)))
        return [], [F.transform(values, link), *below]
    nil, n = T.uri(F.lit(T.RDF + "nil")), F.size(values)

    def cell(i: Column) -> Column:
        return T.bnode(seed, F.lit(attr.name), i)

    def both(x: Column, i: Column) -> Column:
        return F.array(_triple(cell(i), T.RDF + "first", node(x, i)), _triple(cell(i), T.RDF + "rest", F.when(i + 1 < n, cell(i + 1)).otherwise(nil)))

    head = F.when(values.isNotNull(), _triple(subject, attr.predicate, F.when(n == 0, nil).otherwise(cell(F.lit(0)))))
    return [head], [F.flatten(F.transform(values, both)), *below]


def _nested_seed(attr: Attr, seed: Column, i: Column) -> Column:
    return F.concat_ws("\x1e", seed, F.lit(attr.name), i.cast("string"))


def _nested_subject(attr: Attr, value: Column, seed: Column, i: Column) -> Column:
    blank = T.bnode(_nested_seed(attr, seed, i))
    return F.when(value["uri"].isNotNull(), T.uri(value["uri"])).otherwise(blank)


def _nested_triples(attr: Attr, value: Column, seed: Column, i: Column) -> Column:
    """All triples of a nested record, of whichever of the attribute's classes its ``type`` names."""
    subject, inner, out = _nested_subject(attr, value, seed, i), _nested_seed(attr, seed, i), F.array().cast(_KIND)
    for c in attr.nested:
        own = _record_triples(c, subject, inner, lambda name, v=value: v[name])
        out = F.when(value["type"] == c.name, own).otherwise(out)
    return out


def _record_triples(cls: RecordClass, subject: Column, seed: Column, get, types: bool = True) -> Column:
    singles = [_triple(subject, T.RDF + "type", T.uri(F.lit(cls.type)))] if types else []
    arrays = []
    for a in cls.attrs:
        c = get(a.name)
        if a.many or a.ordered:
            one, more = _many(a, c, seed, subject)
            singles += one
            arrays += more
            continue
        zero = F.lit(0)
        o = _nested_subject(a, c, seed, zero) if a.nested else _object(a, c)
        singles.append(F.when(c.isNotNull(), _triple(o, a.predicate, subject) if a.reverse else _triple(subject, a.predicate, o)))
        if a.nested:
            arrays.append(F.when(c.isNotNull(), _nested_triples(a, c, seed, zero)))
    return F.concat(F.array_compact(F.array(*singles).cast(_KIND)), *[F.coalesce(x.cast(_KIND), F.array().cast(_KIND)) for x in arrays])


def to_triples(df: DataFrame, cls: RecordClass, graph: str | None = None, types: bool = True) -> DataFrame:
    """(g, s, p, o): the type and every attribute of each record, nested records included; null attributes give none, an empty list gives nil.

    Records without an IRI, and list cells, are blank nodes named by a digest of what they stand for, so reruns agree.
    """
    subject = T.uri(F.col("uri")) if cls.root else T.bnode(F.col("uri"), F.lit(cls.name))
    every = _record_triples(cls, subject, F.col("uri"), F.col, types)
    return df.select(F.explode(every).alias("t")).select(F.lit(graph).cast("string").alias("g"), "t.s", "t.p", "t.o")


class Graph:
    """Tables with their record classes, read as triples: all of them, or only those of one predicate, from the tables and columns that have it."""

    def __init__(self, *parts: tuple[DataFrame, RecordClass]):
        self.parts = parts

    def triples(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [to_triples(df, c) for df, c in self.parts])

    def with_predicate(self, predicate: str) -> DataFrame:
        if predicate in (T.RDF + "first", T.RDF + "rest") or any(a.nested for _, c in self.parts for a in c.attrs):
            return self.triples().where(F.col("p") == predicate)
        found = []
        for df, c in self.parts:
            if predicate == T.RDF + "type":
                found.append(df.select(F.lit(None).cast("string").alias("g"), (T.uri(F.col("uri")) if c.root else T.bnode(F.col("uri"), F.lit(c.name))).alias("s"), F.lit(predicate).alias("p"), T.uri(F.lit(c.type)).alias("o")))
            for a in (a for a in c.attrs if a.predicate == predicate):
                own = replace(c, attrs=(a,))
                if a.many or a.ordered:
                    found.append(to_triples(df, own, types=False).where(F.col("p") == predicate))
                else:
                    s, o = (T.uri(F.col("uri")) if c.root else T.bnode(F.col("uri"), F.lit(c.name))), _object(a, F.col(a.name))
                    s, o = (o, s) if a.reverse else (s, o)
                    found.append(df.where(F.col(a.name).isNotNull()).select(F.lit(None).cast("string").alias("g"), s.alias("s"), F.lit(predicate).alias("p"), o.alias("o")))
        return functools.reduce(DataFrame.unionByName, found) if found else self.triples().limit(0)


def from_triples(triples: DataFrame, cls: RecordClass) -> DataFrame:
    """The records of a class, one row each: one conditional aggregation by subject instead of a query per attribute.

    Of several values of a single-valued attribute the smallest is taken; many-valued ones are sorted sets.
    """
    flat = [a for a in cls.attrs if not a.ordered and not a.nested]
    fact = F.col("p").isin([a.predicate for a in flat])
    typed = (F.col("p") == T.RDF + "type") & (F.col("o.value") == cls.type)
    # the type is one more fact, so that a subject's rows meet once
    facts = triples.where(typed | fact) if flat else triples.where(typed)
    forward = facts.select(F.col("s.value").alias("uri"), "p", "o", F.lit(False).alias("back"))
    if any(a.reverse for a in flat):
        forward = forward.unionByName(triples.where(fact).select(F.col("o.value").alias("uri"), "p", F.col("s").alias("o"), F.lit(True).alias("back")))
    columns = []
    for a in flat:
        value = F.col("o.value") if a.kind in ("uri", "html") else T.value_of(F.col("o"), a.kind)
        own = F.when((F.col("p") == a.predicate) & (F.col("back") == F.lit(a.reverse)), value)
        columns.append((F.when(F.count_if(fact) > 0, F.sort_array(F.collect_set(own))) if a.many else F.min(own)).alias(a.name))
    instance = F.max(typed & ~F.col("back")).alias("__instance")
    out = forward.groupBy("uri").agg(instance, *columns).where("__instance").drop("__instance")
    for a in (a for a in cls.attrs if a.nested):
        out = out.join(_nested_records(triples, a), "uri", "left")
    for a in (a for a in cls.attrs if a.ordered and not a.nested):
        item = (lambda x: x["value"]) if a.kind in ("uri", "html") else (lambda x, k=a.kind: T.value_of(x, k))
        out = out.join(lists(triples, a.predicate).select(F.col("s").alias("uri"), F.transform("items", item).alias(a.name)), "uri", "left")
    return out.select("uri", *[a.name for a in cls.attrs])


def _fields(classes: tuple[RecordClass, ...]) -> list[Attr]:
    """The attributes of any of the classes, each name once."""
    return list({a.name: a for c in classes for a in c.attrs}.values())


def _nested_records(triples: DataFrame, attr: Attr) -> DataFrame:
    """(uri, the attribute): the records that an attribute's objects are, as structs; of a list in its order, else sorted by their IRIs."""
    fields, every = _fields(attr.nested), None
    for c in attr.nested:
        found = from_triples(triples, c)
        kinds = dict(found.dtypes)
        one = found.select(F.col("uri").alias("__o"), F.struct(F.lit(c.name).alias("type"), F.col("uri"), *[F.col(f.name) if f.name in kinds else F.lit(None).alias(f.name) for f in fields]).alias("__r"))
        every = one if every is None else every.unionByName(one)
    if attr.ordered:
        links = lists(triples, attr.predicate).select(F.col("s").alias("uri"), F.posexplode("items").alias("__i", "__t")).select("uri", "__i", F.col("__t.value").alias("__o"), F.col("__t.kind").alias("__k"))
    else:
        ends = ("o", "s") if attr.reverse else ("s", "o")
        links = triples.where(F.col("p") == attr.predicate).select(F.col(f"{ends[0]}.value").alias("uri"), F.lit(0).alias("__i"), F.col(f"{ends[1]}.value").alias("__o"), F.col(f"{ends[1]}.kind").alias("__k"))
    bare = F.col("__r").withField("uri", F.when(F.col("__k") == "uri", F.col("__o")))  # a blank node's label is no IRI
    met = links.join(every, "__o").groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("__i", "__o", bare.alias("__r")))).alias("__all"))
    values = F.transform("__all", lambda x: x["__r"])
    return met.select("uri", (values if attr.many or attr.ordered else F.get(values, F.lit(0))).alias(attr.name))


def _pieces(triples: DataFrame, predicate: str, chain: bool) -> DataFrame:
    """What a list predicate's triples and list cells come to: heads (kind 3: s, cell), and cells in pieces.

    With ``chain``, cells whose triples are in one batch and that follow one another are one piece (kind 0: cell, items, next), so lists that are
    written together need no join; of other cells, and of all without it, the values (kind 1: cell, items) and the next ones (kind 2: cell, next).
    """
    kind = F.when(F.col("p") == predicate, 3).when(F.col("p") == T.RDF + "first", 1).when(F.col("p") == T.RDF + "rest", 2)
    own = triples.select(kind.alias("kind"), F.col("s.value").alias("s"), F.col("o")).where("kind is not null")
    fields = StructType.fromDDL(f"kind int, s string, cell string, items array<{T.TERM}>, next string")

    def found(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(fields)
        for batch in batches:
            kinds, subjects, terms = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            objects = terms.field(1).to_pylist()
            at: tuple[dict, dict] = {}, {}
            heads, loose, rows = set(), set(), []
            for i, (k, s) in enumerate(zip(kinds, subjects)):
                if k == 3:
                    heads.add(objects[i])
                    rows.append((3, s, objects[i], (), None))
                elif s in at[k - 1] or not chain:
                    loose.add(s)
                else:
                    at[k - 1][s] = i
            first, rest = at
            whole = {c for c in first if c in rest and c not in loose}
            for i, (k, s) in enumerate(zip(kinds, subjects)):
                if k != 3 and s not in whole:
                    rows.append((1, None, s, (i,), None) if k == 1 else (2, None, s, (), objects[i]))
            met: dict = {}
            for c in whole:
                met[objects[rest[c]]] = met.get(objects[rest[c]], 0) + 1
            inner = {c for c, n in met.items() if n == 1 and c in whole and c not in heads}
            seen = set()
            for c in [*(c for c in whole if c not in inner), *inner]:  # what is left of the inner ones is a circle
                if c in seen:
                    continue
                items, here = [], c
                while True:
                    seen.add(here)
                    items.append(first[here])
                    following = objects[rest[here]]
                    if following not in inner or following in seen:
                        break
                    here = following
                rows.append((0, None, c, items, following))
            ends = [0]
            for r in rows:
                ends.append(ends[-1] + len(r[3]))
            values = terms.take(pa.array([i for r in rows for i in r[3]], pa.int64()))
            lists_ = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.cast(names.field("items").type.value_type))
            columns = [pa.array([r[j] for r in rows], names.field(j).type) if j != 3 else lists_.cast(names.field(3).type) for j in range(5)]
            yield pa.RecordBatch.from_arrays(columns, schema=names)

    return in_batches(own, found, fields)


def lists(triples: DataFrame, predicate: str, max_rounds: int = 40) -> DataFrame:
    """(s, items): the RDF lists that a predicate points at, in order.

    Cells that stand together are chained in one pass over the triples, which are read once.  Every other piece finds its list's first one by pointer
    doubling, so lists of n pieces take log n joins; each round is written to the shared folder, so that the plan doesn't grow with the rounds, and the
    one before it is deleted.  Where something points into a chain, as where lists share a tail, all cells are pieces.
    """
    nil = T.RDF + "nil"
    for chain in (True, False):
        made = written(_pieces(triples, predicate, chain), "list-pieces", "zstd")
        heads = made.where("kind = 3").select("s", "cell")
        values = made.where("kind = 1").select("cell", "items")
        loose = made.where("kind = 2").select("cell", "next").join(values, "cell", "full").select("cell", F.coalesce("items", F.array().cast(f"array<{T.TERM}>")).alias("items"), "next")
        pieces = made.where("kind = 0").select("cell", "items", "next").unionByName(loose)
        follows = made.where("kind in (0, 2)").where(F.col("next") != nil).select(F.col("next").alias("cell"), F.col("cell").alias("up"))
        if chain:
            known = made.where("kind in (0, 1, 2)").select("cell")
            if follows.select("cell").join(known, "cell", "left_anti").isEmpty() and heads.where(F.col("cell") != nil).select("cell").join(known, "cell", "left_anti").isEmpty():
                break
            discard(made)
    state = written(follows.join(heads.select("cell"), "cell", "left_anti").withColumn("n", F.lit(1)), "list-cells", "zstd")
    total = state.agg(F.sum("n")).first()[0]
    for _ in range(max_rounds if total else 0):
        far = state.select(F.col("cell").alias("up"), F.col("up").alias("upper"), F.col("n").alias("m"))
        grown = state.join(far, "up", "left").select("cell", F.coalesce("upper", "up").alias("up"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        grown = written(grown, "list-cells", "zstd")
        now = grown.agg(F.sum("n")).first()[0]
        discard(state)
        state = grown
        if now == total:
            break
        total = now
    placed = pieces.select("cell", "items").join(state, "cell", "left").select(F.coalesce("up", "cell").alias("cell"), F.coalesce("n", F.lit(0)).alias("n"), "items")
    items = placed.groupBy("cell").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "items"))), lambda x: x["items"])).alias("items"))
    return heads.join(items, "cell", "left").select("s", F.coalesce("items", F.array().cast(f"array<{T.TERM}>")).alias("items"))


_JSON = {"uri": "string", "html": "string", "string": "string", "integer": "bigint", "nonNegativeInteger": "bigint", "gYear": "int", "double": "double", "boolean": "boolean", "dateTime": "string"}


def _written(attr: Attr, value: Column) -> Column:
    """An attribute's value as JSON holds it: nested records become objects without their null fields."""
    if attr.nested:
        one = lambda x: F.struct(x["uri"].alias("id"), x["type"].alias("type"), *[_written(f, x[f.name]).alias(f.term or f.name) for f in _fields(attr.nested)])
        return F.transform(value, one) if attr.many or attr.ordered else F.when(value.isNotNull(), one(value))
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss") if attr.kind == "dateTime" else value


def _json_type(attr: Attr) -> str:
    kind = "struct<id:string,type:string," + ",".join(f"`{f.term or f.name}`:{_json_type(f)}" for f in _fields(attr.nested)) + ">" if attr.nested else _JSON[attr.kind]
    return f"array<{kind}>" if attr.many or attr.ordered else kind


def _read(attr: Attr, value: Column) -> Column:
    if attr.nested:
        one = lambda x: F.struct(x["type"].alias("type"), x["id"].alias("uri"), *[_read(f, x[f.term or f.name]).alias(f.name) for f in _fields(attr.nested)])
        return F.transform(value, one) if attr.many or attr.ordered else F.when(value.isNotNull(), one(value))
    return F.to_timestamp(value) if attr.kind == "dateTime" else value


def to_jsonld(df: DataFrame, cls: RecordClass) -> DataFrame:
    """(uri, json): each record as a JSON-LD object, nested records as objects in it; null attributes are left out."""
    fields = [F.lit(cls.name).alias("type")]
    if cls.root:
        fields.insert(0, F.col("uri").alias("id"))
    fields += [_written(a, F.col(a.name)).alias(a.term or a.name) for a in cls.attrs]
    return df.select("uri", F.to_json(F.struct(*fields)).alias("json"))


def from_jsonld(df: DataFrame, cls: RecordClass, json: str = "json") -> DataFrame:
    """Records of JSON-LD objects; a type that isn't the class's, a root record without id, or an unknown key raises."""
    fields = ["`id` string", "`type` string", *[f"`{a.term or a.name}` {_json_type(a)}" for a in cls.attrs]]
    known = ["id", "type", *[a.term or a.name for a in cls.attrs]]
    read = df.select(F.from_json(json, ", ".join(fields)).alias("r"), F.json_object_keys(json).alias("keys"))
    extra = F.array_except("keys", F.array(*map(F.lit, known)))
    bad = F.when(F.col("keys").isNull(), "not a JSON object").when(~F.col("r.type").eqNullSafe(F.lit(cls.name)), "another type").when(F.lit(cls.root) & F.col("r.id").isNull(), "no id").when(F.size(extra) > 0, F.concat(F.lit("unknown key "), extra[0]))
    checked = read.withColumn("uri", F.when(bad.isNotNull(), F.raise_error(F.coalesce(bad, F.lit("")))).otherwise(F.col("r.id")))
    return checked.select("uri", *[_read(a, F.col("r")[a.term or a.name]).alias(a.name) for a in cls.attrs])


def compact(iri: Column, prefixes: dict[str, str], terms: dict[str, str] | None = None) -> Column:
    """An IRI as a JSON-LD processor shortens it: a term that stands for it, else the longest prefix's ``prefix:rest``, else itself."""
    out = iri
    for p, base in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(iri.startswith(base) & (F.length(iri) > len(base)), F.concat(F.lit(p + ":"), F.substr(iri, F.lit(len(base) + 1)))).otherwise(out)
    for term, full in sorted((terms or {}).items()):
        out = F.when(iri == full, F.lit(term)).otherwise(out)
    return out


def expand(name: Column, prefixes: dict[str, str], terms: dict[str, str] | None = None) -> Column:
    """The IRI of a term or of ``prefix:rest``; IRIs of other schemes stay, and so does what nothing is known of."""
    out = name
    for p, base in sorted(prefixes.items()):
        out = F.when(name.startswith(p + ":") & ~F.substr(name, F.lit(len(p) + 2)).startswith("//"), F.concat(F.lit(base), F.substr(name, F.lit(len(p) + 2)))).otherwise(out)
    for term, full in sorted((terms or {}).items()):
        out = F.when(name == term, F.lit(full)).otherwise(out)
    return out


def load_all(triples: DataFrame, classes: tuple[RecordClass, ...] = ()) -> dict[str, DataFrame]:
    """The records of every root class, by its name."""
    return {c.name: from_triples(triples, c) for c in (classes or CLASSES) if c.root}


def load_transitively(triples: DataFrame, uris: DataFrame, classes: tuple[RecordClass, ...] = (), max_rounds: int = 50) -> dict[str, DataFrame]:
    """The root records among ``uris`` (uri) and all that their attributes lead to, by class.

    A round follows the attributes of the records found last, and only new ones go on to the next.
    """
    classes = classes or CLASSES
    followed = triples.where(F.col("p").isin(sorted({a.predicate for c in classes for a in c.attrs if a.kind == "uri" and not a.reverse} | {T.RDF + "first", T.RDF + "rest"})) & (F.col("o.kind") != "literal"))
    steps = written(followed.select(F.col("s.value").alias("uri"), F.col("o.value").alias("to")).distinct(), "steps")
    known = frontier = written(uris.select("uri").distinct(), "reached")
    for _ in range(max_rounds):
        frontier = written(frontier.join(steps, "uri").select(F.col("to").alias("uri")).distinct().join(known, "uri", "left_anti"), "reached")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return {name: df.join(known, "uri", "left_semi") for name, df in load_all(triples, classes).items()}


def context(classes: tuple[RecordClass, ...] = CLASSES) -> dict:
    """The JSON-LD context of record classes; terms that would mean two predicates raise."""
    out: dict = {"id": "@id", "type": "@type"}
    for c in classes:
        out[c.name] = {"@id": c.type}
        for a in c.attrs:
            entry: dict = {"@reverse" if a.reverse else "@id": a.predicate}
            if a.kind == "uri":
                entry["@type"] = "@id"
            elif a.kind == "html":
                entry["@type"] = T.RDF + "HTML"
            elif a.kind != "string":
                entry["@type"] = T.XSD + a.kind
            if a.ordered:
                entry["@container"] = "@list"
            if out.setdefault(a.term or a.name, entry) != entry and not (a.many or out[a.term or a.name].get("@id") == entry.get("@id")):
                raise ValueError(f"the term {a.term or a.name} has two meanings")
    return {"@context": out}


def tables_to_triples(df: DataFrame, subject: Column, type_: str, predicates: dict[str, tuple[str, str]]) -> DataFrame:
    """(s, p, o) of any table: ``predicates`` maps a column to its predicate and kind."""
    cls = RecordClass("row", type_, tuple(Attr(c, p, k) for c, (p, k) in predicates.items()))
    return to_triples(df.withColumn("uri", subject), cls).select("s", "p", "o")
