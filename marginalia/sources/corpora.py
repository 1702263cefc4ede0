"""Document corpora, metadata and graph dumps as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import terms as T

DOCUMENT = "doc_uri string, corpus_uri string, html string"


def html_directory(spark: SparkSession, path: str, base: str, corpus: str | None = None) -> DataFrame:
    """(doc_uri, corpus_uri, html) of the ``*.html`` files of a directory; the IRI is the base and the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.html$", 1)
    return files.select(F.concat(F.lit(base), stem).alias("doc_uri"), F.lit(corpus or base).alias("corpus_uri"), F.decode("content", "UTF-8").alias("html"))


def year_month(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Documents of a corpus of directories or zip files named by four digits, one task a zip file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    month = F.regexp_extract("path", r"/(\d{4})(?:\.zip$|/)", 1)
    plain = files.where(F.col("path").rlike(r"/\d{4}/[^/]+\.html$")).select(month.alias("yymm"), F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("name"), F.decode("content", "UTF-8").alias("html"))

    def unzip(batches):
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for yymm, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # read in place, member by member: an archive may be larger than memory and than a binary column
                system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    for member in sorted(n for n in z.namelist() if n.endswith(".html")):
                        stem = member.rsplit("/", 1)[-1][: -len(".html")]
                        yield pa.RecordBatch.from_arrays([pa.array([yymm]), pa.array([stem]), pa.array([z.read(member).decode("utf-8", "replace")])], ["yymm", "name", "html"])

    archives = files.where(F.col("path").rlike(r"/\d{4}\.zip$")).select(month.alias("yymm"), "path")
    zipped = archives.mapInArrow(unzip, "yymm string, name string, html string")
    # an old identifier has its archive's letters before the digits
    identifier = F.regexp_replace("name", r"^([a-z-]+)(\d{7})$", "$1/$2")
    return plain.unionByName(zipped).select(F.concat(F.lit(base), identifier).alias("doc_uri"), F.lit(base).alias("corpus_uri"), "html", "yymm")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, categories, license) of line-wise JSON; rows without categories are left out."""
    rows = spark.read.schema("id string, title string, categories string, license string").json(path)
    return rows.where(F.coalesce(F.trim("categories"), F.lit("")) != "").withColumn("categories", F.split(F.trim("categories"), r"\s+"))


def severities(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(file, severity) of text files that list file names, one for each severity."""
    out = None
    for severity, path in paths.items():
        one = spark.read.text(path).select(F.trim("value").alias("file"), F.lit(severity).alias("severity")).where("file <> ''")
        out = one if out is None else out.unionByName(one)
    return out


def _annotated(base: DataFrame, cls=None) -> DataFrame:
    """Annotations (uri, target_uri, creator_uri, tags) with a body that holds their tags, as triples."""
    from marginalia.operators import records as R

    body = F.struct(F.lit("MultiTagBody").alias("type"), F.lit(None).cast("string").alias("uri"), F.col("tags"))
    return R.to_triples(base.withColumn("body", body), R.RecordClass("Annotation", R.OA + "Annotation", (R.Attr("target_uri", R.OA + "hasTarget"), R.Attr("creator_uri", R.DCT + "creator"), R.Attr("body", R.OA + "hasBody", nested=(R.MULTI_TAG_BODY,)))))


def metadata_triples(meta: DataFrame, base: str, dataset: str, run: str, labels: dict[str, str] | None = None) -> DataFrame:
    """(g, s, p, o) of metadata rows (id, categories): the documents, the category tags with their parents and labels, and annotations.

    Each document has its categories as an annotation, and those in a nested sample one of the samples that hold it.  A category ``a.b`` has the parent ``a``.
    """
    from marginalia.operators import records as R

    uri = F.concat(F.lit(base), F.col("id"))
    docs = R.to_triples(meta.select(uri.alias("uri"), F.lit(dataset).alias("belongs_to")).distinct(), R.RecordClass("DocumentInfo", R.NS + "Document", (R.Attr("belongs_to", R.NS + "belongsTo"),)))
    direct = meta.select(F.explode("categories").alias("c")).distinct()
    every = direct.unionByName(direct.select(F.split_part("c", F.lit("."), F.lit(1)).alias("c"))).distinct()
    label = F.col("c")
    for name, text in sorted((labels or {}).items()):
        label = F.when(F.col("c") == name, text).otherwise(label)
    tag = lambda c: F.concat(F.lit(base + "category/"), c)
    parent = F.when(F.contains("c", F.lit(".")), tag(F.split_part("c", F.lit("."), F.lit(1))))
    tags = R.to_triples(every.select(tag(F.col("c")).alias("uri"), F.lit(base + "category").alias("belongs_to"), label.alias("label"), F.lit(None).cast("string").alias("comment"), parent.alias("sub_tag_of")), R.TAG)
    own = meta.select(uri.alias("target_uri"), F.concat(uri, F.lit("#meta.cat.anno")).alias("uri"), F.lit(run).alias("creator_uri"), F.transform(F.array_distinct("categories"), tag).alias("tags"))
    m = F.col("__m")
    parts = F.array_compact(F.array(*[F.when(m % n == 0, F.lit(f"{base}sample/{name}")) for n, name in ((10, "deci"), (100, "centi"), (1000, "milli"), (10000, "decimilli"))]))
    sampled = meta.withColumn("__m", T.sha256_mod(F.col("id"), 10_000)).where(m % 10 == 0)
    sampled = sampled.select(uri.alias("target_uri"), F.concat(uri, F.lit("#meta.subcorpus.anno")).alias("uri"), F.lit(run).alias("creator_uri"), parts.alias("tags"))
    return docs.unionByName(tags).unionByName(_annotated(own)).unionByName(_annotated(sampled))


def severity_triples(rows: DataFrame, base: str, run: str) -> DataFrame:
    """(g, s, p, o) of (file, severity) rows: a tag for each severity, an annotation for each file that names a paper; others are left out."""
    from marginalia.operators import records as R

    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[a-z]+)?$", 1)
    identifier = F.regexp_replace(stem, r"^([a-z-]+)(\d{7})$", "$1/$2")
    known = rows.withColumn("id", identifier).where(F.col("id").rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+/\d{7})$"))
    tag = F.concat(F.lit(base + "severity/"), F.replace("severity", F.lit(" "), F.lit("_")))
    none = F.lit(None).cast("string")
    tags = R.to_triples(known.select("severity").distinct().select(tag.alias("uri"), F.lit(base + "severity").alias("belongs_to"), F.col("severity").alias("label"), none.alias("comment"), none.alias("sub_tag_of")), R.TAG)
    uri = F.concat(F.lit(base), F.col("id"))
    made = known.select(uri.alias("target_uri"), F.concat(uri, F.lit("#meta.severity.anno")).alias("uri"), F.lit(run).alias("creator_uri"), F.array(tag).alias("tags"))
    return tags.unionByName(_annotated(made))


def documents_from_query(triples, query: str, documents: DataFrame, variable: str = "doc") -> DataFrame:
    """The documents that a query's variable names, in the order of their IRIs; a value that is no IRI or has no document raises."""
    from marginalia.operators import sparql

    found = sparql.query(triples, query)
    if variable not in found.columns:
        raise ValueError(f"the query has no variable ?{variable}")
    term = F.col(variable)
    asked = found.select(F.when(term.isNull() | (term["kind"] != "uri"), F.raise_error(F.lit("not an IRI"))).otherwise(term["value"]).alias("doc_uri")).distinct()
    joined = asked.join(documents.withColumn("__known", F.lit(True)), "doc_uri", "left")
    checked = joined.withColumn("doc_uri", F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("no document "), F.col("doc_uri")))).otherwise(F.col("doc_uri")))
    return checked.drop("__known").orderBy("doc_uri")


_SUBJECT = r"(<[^>]*>|_:\S+)"
_LINE = rf"^\s*{_SUBJECT}\s+<([^>]*)>\s+(.*?)\s*\.\s*$"


def _parsed(term):
    raw = F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1)
    for old, new in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        raw = F.replace(raw, F.lit(old), F.lit(new))
    lang = F.nullif(F.regexp_extract(term, r'"@([A-Za-z-]+)$', 1), F.lit(""))
    datatype = F.nullif(F.regexp_extract(term, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    literal = F.struct(F.lit("literal").alias("kind"), raw.alias("value"), F.when(lang.isNotNull(), T.RDF + "langString").otherwise(F.coalesce(datatype, F.lit(T.XSD + "string"))).alias("datatype"), lang.alias("lang"))
    name = F.when(term.startswith("<"), T.uri(F.regexp_extract(term, r"^<(.*)>$", 1))).when(term.startswith("_:"), F.struct(F.lit("bnode").alias("kind"), F.substring(term, 3, 1_000_000).alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")))
    return F.coalesce(name, literal)


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(g, s, p, o) of N-Triples files, plain or gzipped; a first line ``# Graph: <...>`` names the graph of its file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    graphs = lines.where(F.col("value").rlike(r"^#\s*Graph:\s*<")).select("file", F.regexp_extract("value", "<(.*)>", 1).alias("g"))
    bad = F.when(~F.col("value").rlike(_LINE), F.raise_error(F.concat(F.lit("not a triple: "), F.col("value"))))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).select("file", F.coalesce(bad.cast("string"), "value").alias("value"))
    split = rows.select("file", _parsed(F.regexp_extract("value", _LINE, 1)).alias("s"), F.regexp_extract("value", _LINE, 2).alias("p"), _parsed(F.regexp_extract("value", _LINE, 3)).alias("o"))
    return split.join(graphs, "file", "left").select("g", "s", "p", "o")


def namespaces(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, base) of the ``@prefix`` lines of Turtle files."""
    line = r"^\s*@prefix\s+([\w.-]*):\s*<([^>]*)>"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("prefix"), F.regexp_extract("value", line, 2).alias("base")).distinct()


_TURTLE = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+|[+-]?\d*\.\d+|[+-]?\d+)|(?P<bnode>_:[\w-]+(?:\.[\w-]+)*)|(?P<pname>(?:[A-Za-z][\w.-]*)?:(?:[\w:%-]|\\.|\.(?=[\w:%\\-]))*)|(?P<word>[A-Za-z]+)|(?P<sym>\^\^|[\[\]();,.])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def parse_turtle(text: str, scope: str = "") -> list[tuple[tuple, str, tuple]]:
    """The triples (s, p, o) of a Turtle document; terms are (kind, value, datatype, lang).

    Blank nodes are named after ``scope`` and their label or number, so that two documents' don't meet.  Raises ``ValueError`` where it isn't Turtle.
    """
    import hashlib

    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"not Turtle at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    tokens.append(("end", ""))
    prefixes, base, out = {}, "", []
    pos = fresh = 0

    def unescape(value: str) -> str:
        return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[3] is None else _CONTROL.get(m[3], m[3]), value)

    def peek() -> str:
        return tokens[pos][1]

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal pos
        token = tokens[pos]
        if token[0] == "end" or (expected is not None and token[1] != expected):
            raise ValueError(f"expected {expected or 'more'}, found {token[1] or 'the end'}")
        pos += 1
        return token

    def blank(label: str) -> tuple:
        return ("bnode", "b" + hashlib.sha256(f"{scope}\x1f{label}".encode()).hexdigest()[:24], None, None)

    def new() -> tuple:
        nonlocal fresh
        fresh += 1
        return blank(f"[{fresh}]")

    def iri(token: tuple[str, str]) -> str:
        kind, value = token
        if kind == "iri":
            value = unescape(value[1:-1])
            return value if re.match(r"[A-Za-z][\w+.-]*:", value) else base + value
        prefix, _, local = value.partition(":")
        if kind != "pname" or prefix not in prefixes:
            raise ValueError(f"not an IRI: {value}")
        return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def properties(s: tuple) -> None:
        while True:
            p = T.RDF + "type" if peek() == "a" else None
            token = take()
            p = p or iri(token)
            while True:
                o = term()
                out.append((s, p, o))
                if peek() != ",":
                    break
                take()
            if peek() != ";":
                return
            while peek() == ";":
                take()
            if peek() in (".", "]", ""):
                return

    def term() -> tuple:
        kind, value = token = take()
        if value == "[":
            node = new()
            if peek() != "]":
                properties(node)
            take("]")
            return node
        if value == "(":
            items = []
            while peek() != ")":
                items.append(term())
            take(")")
            nil = ("uri", T.RDF + "nil", None, None)
            cells = [new() for _ in items]
            for k, item in enumerate(items):
                out.append((cells[k], T.RDF + "first", item))
                out.append((cells[k], T.RDF + "rest", cells[k + 1] if k + 1 < len(cells) else nil))
            return cells[0] if cells else nil
        if kind == "bnode":
            return blank(value)
        if kind in ("str", "long"):
            edge = 3 if kind == "long" else 1
            written, datatype, lang = unescape(value[edge:-edge]), T.XSD + "string", None
            if peek() == "^^":
                take()
                datatype = iri(take())
            elif tokens[pos][0] == "at":
                datatype, lang = T.RDF + "langString", take()[1][1:]
            return ("literal", written, datatype, lang)
        if kind == "num":
            return ("literal", value, T.XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if value in ("true", "false"):
            return ("literal", value, T.XSD + "boolean", None)
        return ("uri", iri(token), None, None)

    while tokens[pos][0] != "end":
        word = peek().lower()
        if word in ("@prefix", "prefix", "@base", "base"):
            marked = take()[1].startswith("@")
            if word.endswith("prefix"):
                name = take()[1].rstrip(":")
                prefixes[name] = iri(take())
            else:
                base = iri(take())
            if marked:
                take(".")
            continue
        s = term()
        if s[0] == "literal":
            raise ValueError("a literal as subject")
        if peek() != ".":
            properties(s)
        take(".")
    return out


TRIPLE = f"g string, s {T.TERM}, p string, o {T.TERM}"


def _triples(batches, read):
    import pyarrow as pa

    names = ("kind", "value", "datatype", "lang")
    term = pa.struct([(n, pa.string()) for n in names])
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            g, found = read(*row)
            for k in range(0, len(found), 10_000):
                part = found[k : k + 10_000]
                columns = [pa.array([g] * len(part), pa.string()), pa.array([dict(zip(names, t[0])) for t in part], term), pa.array([t[1] for t in part], pa.string()), pa.array([dict(zip(names, t[2])) for t in part], term)]
                yield pa.RecordBatch.from_arrays(columns, ["g", "s", "p", "o"])


def turtle_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(g, s, p, o) of a column of Turtle documents; the key tells their blank nodes apart, and a null text has no triple."""
    return df.select(F.col(key).cast("string"), text).mapInArrow(lambda batches: _triples(batches, lambda k, t: (None, parse_turtle(t or "", k or ""))), TRIPLE)


def turtle(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """(g, s, p, o) of Turtle files, plain or gzipped, a file being parsed whole by one task; a first line ``# Graph: <...>`` names its graph."""

    def read(name, content):
        import gzip

        text = (gzip.decompress(content) if name.endswith(".gz") else content).decode("utf-8")
        named = re.match(r"#\s*Graph:\s*<(.*)>", text)
        return graph or (named[1] if named else None), parse_turtle(text, name)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.(ttl|txt|nt)(\.gz)?$"))
    return files.select("path", "content").mapInArrow(lambda batches: _triples(batches, read), TRIPLE)


class GraphStore:
    """Named graphs as folders of Parquet files: CREATE, LOAD, CLEAR and DROP."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, graph: str) -> str:
        import hashlib

        return f"{self.path}/{hashlib.sha256(graph.encode()).hexdigest()[:32]}"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def exists(self, graph: str) -> bool:
        fs, at = self._files(self._folder(graph))
        return fs.exists(at)

    def create(self, graph: str) -> None:
        """An empty graph; one that exists is an error."""
        if self.exists(graph):
            raise ValueError(f"{graph} exists")
        self.spark.createDataFrame([], TRIPLE).write.parquet(self._folder(graph))

    def load(self, triples: DataFrame, graph: str) -> None:
        """Add triples to a graph, which is created if need be."""
        triples.select(F.lit(graph).alias("g"), "s", "p", "o").write.mode("append").parquet(self._folder(graph))

    def clear(self, graph: str) -> None:
        """Remove a graph's triples; the graph stays."""
        self.spark.createDataFrame([], TRIPLE).write.mode("overwrite").parquet(self._folder(graph))

    def drop(self, graph: str) -> None:
        fs, at = self._files(self._folder(graph))
        fs.delete(at, True)

    def replace(self, triples: DataFrame, graph: str) -> None:
        """CLEAR and LOAD in one step."""
        triples.select(F.lit(graph).alias("g"), "s", "p", "o").write.mode("overwrite").parquet(self._folder(graph))

    def temporary(self, prefix: str = "tmp:") -> str:
        """A graph name that no other one has."""
        import uuid

        return prefix + uuid.uuid4().hex

    def triples(self, *graphs: str) -> DataFrame:
        """(g, s, p, o) of some graphs, or of all."""
        paths = [self._folder(g) for g in graphs] or [f"{self.path}/*"]
        return self.spark.read.schema(TRIPLE).parquet(*paths)


class Resolver:
    """Corpora by the prefix of their documents' IRIs; the longest that fits is asked."""

    def __init__(self):
        self.corpora: dict[str, DataFrame] = {}

    def register(self, base: str, documents: DataFrame) -> None:
        if base in self.corpora:
            raise ValueError(f"{base} is registered")
        self.corpora[base] = documents

    def corpus(self, uri: str) -> DataFrame:
        bases = [b for b in self.corpora if uri.startswith(b)]
        if not bases:
            raise KeyError(f"{uri} is in no corpus")
        return self.corpora[max(bases, key=len)]

    def document(self, uri: str) -> DataFrame:
        """The one row of a document; an IRI that no corpus claims and one that its corpus lacks are different errors."""
        row = self.corpus(uri).where(F.col("doc_uri") == uri)
        if row.limit(1).count() == 0:
            raise LookupError(f"{uri} isn't in its corpus")
        return row


def paper_id(text: str) -> dict | None:
    """Parts of a paper identifier: its month, file name form and archive; None if it isn't one."""
    if m := re.fullmatch(r"(\d{2})(\d{2})\.(\d{4,5})", text):
        return {"yymm": m[1] + m[2], "name": text, "archive": None}
    if m := re.fullmatch(r"([a-z-]+(?:\.[A-Z]{2})?)/(\d{4})(\d{3})", text):
        return {"yymm": m[2], "name": m[1].split(".")[0] + m[2] + m[3], "archive": m[1]}
    return None
