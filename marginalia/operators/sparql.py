"""A SPARQL subset compiled to DataFrame plans over a relation of triples (g, s, p, o).

Supported: SELECT [DISTINCT], ASK, CONSTRUCT; basic graph patterns with ``;`` ``,`` ``a`` and ``[ ... ]``; OPTIONAL, UNION, VALUES, GRAPH;
FILTER isIRI(?x) and FILTER strstarts(str(?x), "..."); property paths of ``/``, ``^`` and ``*``.  Anything else is an error.
A pattern is an equality join on the variables it shares, each side filtered on its predicate first; Catalyst picks order and strategy.
A variable that OPTIONAL, UNION or UNDEF may leave unbound is compatible with any value, as the algebra has it; patterns that share no
variable give all pairs of their rows, however many.  A ``*`` path is followed from the ends that other patterns bind.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import terms as T
from marginalia.sources.shared import written

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>[+-]?\d+)|(?P<pname>[A-Za-z_][\w-]*?:[\w%-]*(?:\.[\w%-]+)*|:[\w-]+)|(?P<word>[A-Za-z]+)|(?P<sym>\^\^|[{}()\[\].;,/^*@])""")


@dataclass(frozen=True)
class Path:
    """A property path: op is ``iri``, ``seq``, ``inverse`` or ``star``."""

    op: str
    parts: tuple = ()

    def __truediv__(self, other: "Path") -> "Path":
        return Path("seq", (self, other))

    def inverted(self) -> "Path":
        return Path("inverse", (self,))

    def star(self) -> "Path":
        return Path("star", (self,))


def iri(value: str) -> Path:
    return Path("iri", (value,))


@dataclass
class Group:
    triples: list = field(default_factory=list)
    optionals: list = field(default_factory=list)
    unions: list = field(default_factory=list)
    graphs: list = field(default_factory=list)
    values: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Query:
    form: str
    variables: list[str] | None
    distinct: bool
    where: Group
    template: list = field(default_factory=list)


class SparqlError(ValueError):
    """A query outside the supported subset."""


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected text: {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.at, self.prefixes, self.fresh = 0, {}, itertools.count()

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def next(self, expected: str | None = None) -> str:
        value = self.peek()
        if not value or (expected is not None and value.upper() != expected.upper()):
            raise SparqlError(f"expected {expected or 'more'}, found {value or 'the end'}")
        self.at += 1
        return value

    def word(self, *names: str) -> bool:
        return self.peek().upper() in names

    def parse(self) -> Query:
        while self.word("PREFIX"):
            self.next()
            name = self.next()
            self.prefixes[name.rstrip(":")] = self.next()[1:-1]
        if self.word("SELECT"):
            self.next()
            distinct = self.word("DISTINCT") and bool(self.next())
            names: list[str] | None = []
            while self.kind() == "var":
                names.append(self.next()[1:])
            if self.peek() == "*":
                self.next()
                names = None
            if self.word("WHERE"):
                self.next()
            query = Query("select", names, distinct, self.group())
        elif self.word("ASK"):
            self.next()
            if self.word("WHERE"):
                self.next()
            query = Query("ask", None, False, self.group())
        elif self.word("CONSTRUCT"):
            self.next()
            if self.word("WHERE"):
                self.next()
                where = self.group()
                query = Query("construct", None, True, where, where.triples)
            else:
                template = self.group().triples
                self.next("WHERE")
                query = Query("construct", None, True, self.group(), template)
        else:
            raise SparqlError(f"unsupported query form {self.peek()}")
        if self.peek():
            raise SparqlError(f"unsupported after the pattern: {self.peek()}")
        return query

    def group(self) -> Group:
        self.next("{")
        g = Group()
        while self.peek() != "}":
            if self.word("OPTIONAL"):
                self.next()
                g.optionals.append(self.group())
            elif self.word("GRAPH"):
                self.next()
                g.graphs.append((self.term(g), self.group()))
            elif self.word("VALUES"):
                self.next()
                several = self.peek() == "("
                names = [self.next()[1:]] if not several else []
                if several:
                    self.next("(")
                    while self.peek() != ")":
                        names.append(self.next()[1:])
                    self.next(")")
                self.next("{")
                rows = []
                while self.peek() != "}":
                    if several:
                        self.next("(")
                    rows.append([self.value(g) for _ in names])
                    if several:
                        self.next(")")
                self.next("}")
                g.values.append((names, rows))
            elif self.word("FILTER"):
                self.next()
                g.filters.append(self.filter())
            elif self.peek() == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    self.next()
                    parts.append(self.group())
                g.unions.append(parts)
            elif self.peek() == ".":
                self.next()
            elif self.kind() == "word" and not self.word("A", "TRUE", "FALSE"):
                raise SparqlError(f"unsupported: {self.peek()}")
            else:
                s = self.term(g)
                if self.peek() not in (".", "}"):
                    self.properties(g, s)
        self.next("}")
        return g

    def value(self, g: Group):
        if self.word("UNDEF"):
            self.next()
            return None
        return self.term(g)

    def filter(self):
        wrapped = self.peek() == "(" and bool(self.next())
        name = self.next().lower()
        self.next("(")
        if name == "isiri":
            found = ("isiri", self.next()[1:])
        elif name == "strstarts":
            self.next("str")
            self.next("(")
            v = self.next()[1:]
            self.next(")")
            self.next(",")
            found = ("strstarts", v, self.string(self.next()))
        else:
            raise SparqlError(f"unsupported filter {name}")
        self.next(")")
        if wrapped:
            self.next(")")
        return found

    def properties(self, g: Group, s) -> None:
        while True:
            p = self.path()
            while True:
                g.triples.append((s, p, self.term(g)))
                if self.peek() != ",":
                    break
                self.next()
            if self.peek() != ";":
                return
            while self.peek() == ";":
                self.next()
            if self.peek() in (".", "}", "]"):
                return

    def path(self):
        if self.kind() == "var":
            return ("var", self.next()[1:])
        out = self.step()
        while self.peek() == "/":
            self.next()
            out = out / self.step()
        return out

    def step(self) -> Path:
        if self.peek() == "^":
            self.next()
            return self.step().inverted()
        if self.peek() == "(":
            self.next()
            out = self.path()
            self.next(")")
        elif self.peek() == "a":
            self.next()
            out = iri(T.RDF + "type")
        else:
            out = iri(self.iri(self.next()))
        while self.peek() == "*":
            self.next()
            out = out.star()
        return out

    def iri(self, text: str) -> str:
        if text.startswith("<"):
            return text[1:-1]
        prefix, sep, local = text.partition(":")
        if not sep or prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix in {text}")
        return self.prefixes[prefix] + local

    @staticmethod
    def string(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), text[1:-1])

    def term(self, g: Group):
        kind, text = self.kind(), self.next()
        if kind == "var":
            return ("var", text[1:])
        if text == "[":
            node = ("var", f"__b{next(self.fresh)}")
            if self.peek() != "]":
                self.properties(g, node)
            self.next("]")
            return node
        if kind == "str":
            datatype, lang = T.XSD + "string", None
            if self.peek() == "^^":
                self.next()
                datatype = self.iri(self.next())
            elif self.peek() == "@":
                self.next()
                datatype, lang = T.RDF + "langString", self.next()
            return ("literal", self.string(text), datatype, lang)
        if kind == "num":
            return ("literal", str(int(text)), T.XSD + "integer", None)
        if text in ("true", "false"):
            return ("literal", text, T.XSD + "boolean", None)
        return ("uri", self.iri(text))


def parse(text: str) -> Query:
    """The query's structure; raises ``SparqlError`` outside the subset."""
    return _Parser(text).parse()


def _constant(term):
    if term[0] == "uri":
        return T.uri(F.lit(term[1]))
    return F.struct(F.lit("literal").alias("kind"), F.lit(term[1]).alias("value"), F.lit(term[2]).alias("datatype"), F.lit(term[3]).cast("string").alias("lang"))


def _with(triples, predicate: str) -> DataFrame:
    """The triples of one predicate: a ``records.Graph`` reads only the tables that have it."""
    return triples.with_predicate(predicate) if hasattr(triples, "with_predicate") else triples.where(F.col("p") == predicate)


def _all(triples) -> DataFrame:
    return triples.triples() if hasattr(triples, "triples") else triples


def pairs(triples, path: Path) -> DataFrame:
    """(s, o) pairs of a property path."""
    if path.op == "iri":
        return _with(triples, path.parts[0]).select("s", "o")
    if path.op == "inverse":
        return pairs(triples, path.parts[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
    if path.op == "seq":
        a, b = (pairs(triples, p) for p in path.parts)
        return a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
    every = _all(triples)
    nodes = every.select("s").unionByName(every.where(F.col("o.kind") != "literal").select(F.col("o").alias("s"))).distinct()
    return closure(pairs(triples, path.parts[0]), nodes)


def closure(step: DataFrame, starts: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(s, o): what each of the starts (s) reaches in any number of steps, itself included.

    A round follows the pairs that the last one found and keeps the new ones, so cycles end it; each round is written to the shared folder.
    """
    step = written(step.distinct(), "steps")
    known = frontier = written(starts.select("s", F.col("s").alias("o")).distinct(), "reached")
    for _ in range(max_rounds):
        found = frontier.select("s", F.col("o").alias("m")).join(step.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        frontier = written(found.join(known, ["s", "o"], "left_anti"), "reached")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise SparqlError("a path is too long")


@dataclass
class Solutions:
    """Rows of bindings, with the variables that may be unbound in some of them."""

    rows: DataFrame
    unsure: frozenset = frozenset()

    @property
    def names(self) -> list[str]:
        return self.rows.columns


#: Rows of a side that meets all rows of the other, at most, where a caller wants such products refused; none are by default.
CROSS_ROWS: int | None = None


def _product(x: DataFrame, y: DataFrame) -> DataFrame:
    if CROSS_ROWS is not None and y.limit(CROSS_ROWS + 1).count() > CROSS_ROWS:
        raise SparqlError("patterns that share no bound variable would pair too many rows")
    return x.crossJoin(y)


def _free(names: list[str]) -> list[Column]:
    """The conditions under which variables that may be unbound are compatible."""
    return [F.col(f"`{c}`").isNull() | F.col(f"`__r_{c}`").isNull() | (F.col(f"`{c}`") == F.col(f"`__r_{c}`")) for c in names]


def _parts(left: Solutions, right: Solutions, x: DataFrame, y: DataFrame, v: str) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame | None]:
    """Rows of the left side that bind ``v`` and those that don't, and the same of the right; None where a side always binds it."""
    a, b = F.col(f"`{v}`"), F.col(f"`__r_{v}`")
    lefts = (x.where(a.isNotNull()), x.where(a.isNull())) if v in left.unsure else (x, None)
    rights = (y.where(b.isNotNull()), y.where(b.isNull())) if v in right.unsure else (y, None)
    return *lefts, *rights


def _compatible(left: Solutions, right: Solutions, r: DataFrame, unsure: list[str]) -> DataFrame:
    """All compatible pairs when no shared variable is bound for sure: rows that bind one meet by equality, and only rows that don't meet all others."""

    def pairs_of(x: DataFrame, y: DataFrame, todo: list[str]) -> DataFrame:
        if not todo:
            return _product(x, y)
        v, rest = todo[0], todo[1:]
        bound, unbound, r_bound, r_unbound = _parts(left, right, x, y, v)
        rows = bound.join(r_bound, functools.reduce(operator.and_, [F.col(f"`{v}`") == F.col(f"`__r_{v}`"), *_free(rest)]))
        if unbound is not None:
            rows = rows.unionByName(pairs_of(unbound, y, rest))
        if r_unbound is not None:
            rows = rows.unionByName(pairs_of(bound, r_unbound, rest))
        return rows

    return pairs_of(left.rows, r, unsure)


def _unmatched(left: Solutions, right: Solutions, r: DataFrame, unsure: list[str]) -> DataFrame:
    """The rows of the left side that ``_compatible`` pairs with none."""

    def lonely(x: DataFrame, y: DataFrame, todo: list[str]) -> DataFrame:
        if not todo:
            return x.join(F.broadcast(y.limit(1)), F.lit(True), "left_anti")
        v, rest = todo[0], todo[1:]
        bound, unbound, r_bound, r_unbound = _parts(left, right, x, y, v)
        rows = bound.join(r_bound, functools.reduce(operator.and_, [F.col(f"`{v}`") == F.col(f"`__r_{v}`"), *_free(rest)]), "left_anti")
        if r_unbound is not None:
            rows = lonely(rows, r_unbound, rest)
        return rows if unbound is None else rows.unionByName(lonely(unbound, y, rest))

    return lonely(left.rows, r, unsure)


def _join(left: Solutions | None, right: Solutions, how: str = "inner") -> Solutions:
    """All compatible pairs; with ``left``, rows without one stay."""
    if left is None:
        return right
    shared = [c for c in left.names if c in right.names]
    unsure = [c for c in shared if c in left.unsure or c in right.unsure]
    keys = [c for c in shared if c not in unsure]
    r = right.rows.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in right.names])
    on = [F.col(f"`{c}`") == F.col(f"`__r_{c}`") for c in keys]
    free = _free(unsure)
    if keys:
        rows = left.rows.join(r, functools.reduce(operator.and_, [*on, *free]), how)
    else:
        rows = _compatible(left, right, r, unsure)
        if how != "inner":
            none = [F.lit(None).cast(r.schema[c].dataType).alias(c) for c in r.columns]
            rows = rows.unionByName(_unmatched(left, right, r, unsure).select("*", *none))
    out = [F.coalesce(F.col(f"`{c}`"), F.col(f"`__r_{c}`")).alias(c) if c in unsure else F.col(f"`{c}`") for c in left.names]
    out += [F.col(f"`__r_{c}`").alias(c) for c in right.names if c not in left.names]
    if how == "inner":
        open_ = {c for c in left.unsure | right.unsure if (c in left.unsure or c not in left.names) and (c in right.unsure or c not in right.names)}
    else:
        open_ = left.unsure | (set(right.names) - set(left.names))
    return Solutions(rows.select(*out), frozenset(open_))


def _pattern(triples, s, p, o, graph: str | None = None) -> DataFrame:
    """Bindings of one triple pattern; without variables, one row of the column ``__found`` if it holds."""
    if isinstance(p, Path):
        if graph and p.op != "iri":
            raise SparqlError("a path in a variable graph")
        base = _with(triples, p.parts[0]) if graph else pairs(triples, p)
    else:
        base = _all(triples).select("s", "o", T.uri(F.col("p")).alias("p"), *["g"] * bool(graph))
    if graph:
        base = base.where("g is not null").withColumn("g", T.uri(F.col("g")))
    out: dict[str, str] = {}
    for column, term in (("s", s), ("o", o), *([("p", p)] if not isinstance(p, Path) else []), *([("g", ("var", graph))] if graph else [])):
        if term[0] != "var":
            base = base.where(F.col(f"{column}.kind") == term[0]).where(F.col(f"{column}.value") == term[1])
            if term[0] == "literal":
                base = base.where(F.col(f"{column}.datatype") == term[2]).where(F.col(f"{column}.lang").eqNullSafe(F.lit(term[3]).cast("string")))
        elif term[1] in out:
            base = base.where(F.col(column) == F.col(out[term[1]]))
        else:
            out[term[1]] = column
    if not out:
        return base.limit(1).select(F.lit(True).alias("__found"))
    return base.select(*[F.col(c).alias(v) for v, c in out.items()])


def _starred(path) -> bool:
    return isinstance(path, Path) and (path.op == "star" or any(_starred(x) for x in path.parts))


def _unfolded(triples: list) -> list:
    """Sequences that hold a star, cut at fresh variables, so that the star starts from what the rest binds."""
    fresh, out, todo = itertools.count(), [], list(triples)
    while todo:
        s, p, o = todo.pop(0)
        if _starred(p) and p.op == "seq":
            middle = ("var", f"__p{next(fresh)}")
            todo[:0] = [(s, p.parts[0], middle), (middle, p.parts[1], o)]
        elif _starred(p) and p.op == "inverse":
            todo.insert(0, (o, p.parts[0], s))
        else:
            out.append((s, p, o))
    return out


def _follow(out: Solutions | None, triples, s, path: Path, o) -> Solutions:
    """Join a star pattern, from its bound end."""
    step = pairs(triples, path.parts[0])
    bound = lambda t: t[0] != "var" or (out is not None and t[1] in out.names and t[1] not in out.unsure)
    if not bound(s) and bound(o):
        s, o, step = o, s, step.select(F.col("o").alias("s"), F.col("s").alias("o"))
    if s[0] != "var":
        starts = triples_session(triples).range(1).select(_constant(s).alias("s"))
    elif bound(s):
        starts = out.rows.select(F.col(f"`{s[1]}`").alias("s")).distinct()
    else:
        every = _all(triples)
        starts = every.select("s").unionByName(every.where(F.col("o.kind") != "literal").select(F.col("o").alias("s"))).distinct()
    return _join(out, Solutions(_pattern_of(closure(step, starts), s, o)))


def _pattern_of(base: DataFrame, s, o) -> DataFrame:
    return _pattern(base.withColumn("p", F.lit("")), s, iri(""), o)


def triples_session(triples):
    return _all(triples).sparkSession


def _evaluate(group: Group, triples, graph: str | None = None) -> Solutions:
    spark = triples_session(triples)
    out: Solutions | None = None
    parts: list[Solutions] = []
    for names, rows in group.values:
        table = None
        for r in rows:
            one = spark.range(1).select(*[(F.lit(None).cast(T.TERM) if v is None else _constant(v)).alias(n) for n, v in zip(names, r)])
            table = one if table is None else table.unionByName(one)
        if table is None:
            table = spark.range(0).select(*[F.lit(None).cast(T.TERM).alias(n) for n in names])
        parts.append(Solutions(F.broadcast(table), frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows))))
    patterns = _unfolded(group.triples)
    stars = [t for t in patterns if _starred(t[1])]
    if graph and stars:
        raise SparqlError("a path in a variable graph")
    parts += [Solutions(_pattern(triples, *t, graph)) for t in patterns if not _starred(t[1])]
    for term, inner in group.graphs:
        if term[0] == "var":
            parts.append(_evaluate(inner, triples, term[1]))
        else:
            parts.append(_evaluate(inner, _all(triples).where(F.col("g") == term[1])))
    for alternatives in group.unions:
        branches = [_evaluate(a, triples, graph) for a in alternatives]
        table = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.rows for b in branches])
        parts.append(Solutions(table, frozenset(c for c in table.columns if any(c in b.unsure or c not in b.names for b in branches))))
    # patterns without variables hold or don't: one row, or none
    gates = [p for p in parts if p.names == ["__found"]]
    parts = [p for p in parts if p.names != ["__found"]]
    # join what shares a variable first, best one that is surely bound
    while parts:
        sure = [set(p.names) & set(out.names) - p.unsure - out.unsure if out else {0} for p in parts]
        ready = next((i for i, x in enumerate(sure) if x), next((i for i, p in enumerate(parts) if out is None or set(p.names) & set(out.names)), 0))
        out = _join(out, parts.pop(ready))
    for s, p, o in stars:
        found = _follow(out, triples, s, p, o)
        if found.names == ["__found"]:
            gates.append(found)
        else:
            out = found
    for gate in gates:
        one = gate.rows.limit(1)
        out = Solutions(one) if out is None else Solutions(out.rows.crossJoin(F.broadcast(one.select(F.lit(1).alias("__gate")))).drop("__gate"), out.unsure)
    if out is None:
        raise SparqlError("an empty group")
    for optional in group.optionals:
        inner = _evaluate(optional, triples, graph)
        out = _join(out, inner, "left") if inner.names != ["__found"] else out
    rows = out.rows
    for f in group.filters:
        if f[0] == "isiri":
            rows = rows.where(F.col(f"{f[1]}.kind") == "uri")
        else:
            rows = rows.where(F.startswith(F.col(f"{f[1]}.value"), F.lit(f[2])))
    return Solutions(rows, out.unsure)


def query(triples, text: str) -> DataFrame:
    """The result of a query: a column of terms per variable (unbound: null); one row ``ask``; or distinct (s, p, o).

    ``triples`` is a DataFrame (g, s, p, o), g being optional, or a ``records.Graph`` over tables.
    """
    if isinstance(triples, DataFrame) and "g" not in triples.columns:
        triples = triples.withColumn("g", F.lit(None).cast("string"))
    q = parse(text)
    rows = _evaluate(q.where, triples).rows
    if q.form == "ask":
        return rows.limit(1).agg((F.count("*") > 0).alias("ask"))
    if q.form == "construct":
        made = []
        for s, p, o in q.template:
            if isinstance(p, Path) and p.op != "iri":
                raise SparqlError("a path in a template")
            pick = lambda t: F.col(t[1]) if t[0] == "var" else _constant(t)
            made.append(F.struct(pick(s).alias("s"), (F.lit(p.parts[0]) if isinstance(p, Path) else F.col(f"{p[1]}.value")).alias("p"), pick(o).alias("o")))
        return rows.select(F.explode(F.array(*made)).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()
    names = q.variables if q.variables is not None else [c for c in rows.columns if not c.startswith("__")]
    out = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(T.TERM).alias(c) for c in names])
    return out.distinct() if q.distinct else out
