import pytest
from marginalia.functions import terms as T
from marginalia.operators import records, sparql, spotters
from marginalia.sources import corpora, sinks
from pyspark.sql import functions as F


def test_records_round_trip(spark):
    df = spark.createDataFrame([("u:1", "t:1", "c:1", ["x", "y"]), ("u:2", "t:2", None, [])], "uri string, target_uri string, creator_uri string, tags array<string>")
    back = {r.uri: r for r in records.from_triples(records.to_triples(df, records.ANNOTATION), records.ANNOTATION).collect()}
    assert back["u:1"].tags == ["x", "y"] and back["u:2"].creator_uri is None and back["u:2"].target_uri == "t:2"
    again = {r.uri: r for r in records.from_jsonld(records.to_jsonld(df, records.ANNOTATION), records.ANNOTATION).collect()}
    assert again["u:1"].tags == ["x", "y"] and again["u:2"].creator_uri is None


def test_json_import_is_strict(spark):
    for bad in ('{"type": "Annotation"}', '{"id": "u", "type": "Tag"}', '{"id": "u", "type": "Annotation", "odd": 1}', "[]"):
        with pytest.raises(Exception):
            records.from_jsonld(spark.createDataFrame([(bad,)], "json string"), records.ANNOTATION).collect()


def test_lists_keep_their_order(spark):
    df = spark.createDataFrame([("u:1", [5, 1, 3, 1]), ("u:2", [])], "uri string, items array<int>")
    cls = records.RecordClass("L", "x:L", (records.Attr("items", "x:items", "integer", many=True, ordered=True),))
    got = {r.s: [x.value for x in r["items"]] for r in records.lists(records.to_triples(df, cls), "x:items").collect()}
    assert got == {"u:1": ["5", "1", "3", "1"], "u:2": []}


def test_literals(spark):
    row = spark.range(1).select(T.ntriples(T.literal(F.lit(4.5), "double")).alias("d"), T.ntriples(T.literal(F.lit('a"b\\c\n'))).alias("s"), T.ntriples(T.literal(F.lit(True), "boolean")).alias("b")).first()
    assert row.d == '"4.500000E+00"^^<http://www.w3.org/2001/XMLSchema#double>' and row.s == '"a\\"b\\\\c\\n"' and row.b.startswith('"true"')


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u:1", 'say "hi"\n', "c")], "uri string, label string, comment string")
    triples = records.to_triples(df, records.CORPUS_INFO.__class__("C", "x:C", (records.Attr("label", "x:label", "string"),)))
    sinks.write_ntriples(triples, str(tmp_path / "nt"), compress=True, graph="g:1")
    back = corpora.ntriples(spark, str(tmp_path / "nt")).collect()
    assert {r.g for r in back} == {"g:1"} and {r.o.value for r in back} == {"x:C", 'say "hi"\n'}
    sinks.write_turtle(triples, str(tmp_path / "ttl"), {"x": "x:"})
    assert [(r.prefix, r.base) for r in corpora.namespaces(spark, str(tmp_path / "ttl")).collect()] == [("x", "x:")]


def test_longest_namespace(spark):
    df = spark.createDataFrame([("e:/1/2/abc",), ("e:/1/foo",), ("z:q",)], "u string")
    names = spark.createDataFrame([("n1", "e:/1/"), ("n12", "e:/1/2/")], "prefix string, base string")
    assert [(r.prefix, r.local) for r in T.namespacify(df, "u", names).collect()] == [("n12", "abc"), ("n1", "foo"), (None, None)]


def _graph(spark):
    uri = lambda v: ("uri", v, None, None)
    rows = [("g", uri("a"), "x:next", uri("b")), ("g", uri("b"), "x:next", uri("c")), ("g", uri("c"), "x:next", uri("a")), ("h", uri("a"), "x:name", ("literal", "A", T.XSD + "string", None))]
    return spark.createDataFrame(rows, f"g string, s {T.TERM}, p string, o {T.TERM}")


def test_star_survives_cycles(spark):
    rows = sparql.query(_graph(spark), "PREFIX x: <x:> SELECT ?o WHERE { <a> x:next* ?o }").collect()
    assert sorted(r.o.value for r in rows) == ["a", "b", "c"]


def test_subset_is_enforced(spark):
    for bad in ("SELECT ?x WHERE { ?x x:y ?z }", "SELECT ?x WHERE { ?x <p> ?y MINUS { ?x <q> ?y } }", "DESCRIBE <a>", "SELECT ?x WHERE { ?x <p> ?y } LIMIT 3"):
        with pytest.raises(sparql.SparqlError):
            sparql.query(_graph(spark), bad)


def _triples(spark, text):
    uri = lambda v: ("uri", v, None, None)
    return spark.createDataFrame([("g", uri(s), p, uri(o)) for s, p, o in (line.split() for line in text.split(","))], f"g string, s {T.TERM}, p string, o {T.TERM}")


def _bindings(spark, text, query):
    return sorted((tuple(None if v is None else v["value"] for v in r) for r in sparql.query(_triples(spark, text), query).collect()), key=str)


def test_unbound_variables_are_compatible(spark):
    data = "a p b,c p d,e q f,f r g,h r i"
    got = _bindings(spark, data, "SELECT ?x ?y ?z WHERE { { ?x <p> ?y } UNION { ?x <q> ?z } ?z <r> ?w }")
    assert got == sorted([("a", "b", "f"), ("a", "b", "h"), ("c", "d", "f"), ("c", "d", "h"), ("e", None, "f")], key=str)
    data = "a p b,c p d,a q m,m r n,k r l"
    got = _bindings(spark, data, "SELECT ?x ?m ?n WHERE { ?x <p> ?y OPTIONAL { ?x <q> ?m } OPTIONAL { ?m <r> ?n } }")
    assert got == sorted([("a", "m", "n"), ("c", "m", "n"), ("c", "k", "l")], key=str)
    got = _bindings(spark, data, "SELECT ?x ?y WHERE { VALUES (?x ?y) { (<a> UNDEF) (UNDEF <d>) } ?x <p> ?y }")
    assert got == [("a", "b"), ("c", "d")]


def test_patterns_that_share_nothing(spark, monkeypatch):
    query = "SELECT ?x ?z WHERE { ?x <p> ?y . ?z <q> ?w }"
    assert _bindings(spark, "a p b,c p d,e q f", query) == [("a", "e"), ("c", "e")]
    monkeypatch.setattr(sparql, "CROSS_ROWS", 0)
    with pytest.raises(sparql.SparqlError):
        sparql.query(_triples(spark, "a p b,c q d"), query)


def test_products_are_whole_at_any_size(spark):
    uri = lambda v: F.struct(F.lit("uri").alias("kind"), v.alias("value"), *[F.lit(None).cast("string").alias(c) for c in ("datatype", "lang")])
    many = spark.range(10_001).select(F.lit("g").alias("g"), uri(F.col("id").cast("string")).alias("s"), F.lit("q").alias("p"), uri(F.lit("w")).alias("o"))
    rows = sparql.query(_triples(spark, "a p b,c p d").unionByName(many), "SELECT ?x ?z WHERE { ?x <p> ?y . ?z <q> ?w }")
    assert rows.count() == 20_002 and rows.distinct().count() == 20_002
    rows = sparql.query(_triples(spark, "a p b,c p d").unionByName(many), "SELECT ?x ?z WHERE { ?x <p> ?y OPTIONAL { ?z <q> ?w } }")
    assert rows.distinct().count() == 20_002


def test_only_unbound_rows_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(sparql, "CROSS_ROWS", 1)  # one row is unbound; the other side has more
    got = _bindings(spark, "n p m,x q r,y q r,z q s,r t c,s t c", "SELECT ?n ?x ?r WHERE { { ?n <p> ?m } UNION { ?x <q> ?r } ?r <t> ?c }")
    assert got == sorted([("n", None, "r"), ("n", None, "s"), (None, "x", "r"), (None, "y", "r"), (None, "z", "s")], key=str)


def test_optional_of_unbound_variables(spark):
    # two variables may be unbound on either side; pairs and lonely rows against the definition
    data = "k v a,k v b,k w c,k w d,k u e,e u c"
    left = "{ ?k <v> ?x } UNION { ?k <w> ?y } UNION { ?k <v> ?x . ?k <w> ?y }"
    for right in ("{ ?l <u> ?y } UNION { ?m <v> ?x }", "{ ?l <w> ?y . ?l <v> ?x } UNION { ?l <u> ?y }", "{ ?l <none> ?y } UNION { ?m <u> ?x }"):
        a, b = (_bindings(spark, data, f"SELECT ?x ?y WHERE {{ {t} }}") for t in (left, right))
        fits = lambda p, q: all(i is None or j is None or i == j for i, j in zip(p, q))
        either = lambda p, q: tuple(j if i is None else i for i, j in zip(p, q))
        pairs = [either(p, q) for p in a for q in b if fits(p, q)]
        assert _bindings(spark, data, f"SELECT ?x ?y WHERE {{ {{ {left} }} {{ {right} }} }}") == sorted(pairs, key=str)
        lonely = [p for p in a if not any(fits(p, q) for q in b)]
        assert _bindings(spark, data, f"SELECT ?x ?y WHERE {{ {{ {left} }} OPTIONAL {{ {right} }} }}") == sorted(pairs + lonely, key=str)


def test_constant_patterns_are_gates(spark):
    data = "a p b,x q y"
    assert sparql.query(_triples(spark, data), "ASK { <a> <p> <b> . ?x <q> ?y }").first()[0] is True
    assert sparql.query(_triples(spark, data), "ASK { <a> <p> <c> . ?x <q> ?y }").first()[0] is False
    assert sparql.query(_triples(spark, data), "ASK { <a> <p> <b> }").first()[0] is True
    assert _bindings(spark, data, "SELECT ?x WHERE { ?x <q> ?y . <a> <p> <c> }") == []


def test_stars_follow_from_bound_ends(spark):
    data = "a n b,b n c,c n a,d n e,k t a,k t d"
    assert _bindings(spark, data, "SELECT ?o WHERE { <k> <t>/<n>* ?o }") == [("a",), ("b",), ("c",), ("d",), ("e",)]
    assert _bindings(spark, data, "SELECT ?s WHERE { ?s <n>* <e> }") == [("d",), ("e",)]
    assert _bindings(spark, data, "SELECT ?x ?o WHERE { <k> <t> ?x . ?o ^<n>* ?x }") == sorted([("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e")])
    assert sparql.query(_triples(spark, data), "ASK { <a> <n>* <e> }").first()[0] is False


def test_graph_with_a_variable(spark):
    got = sparql.query(_graph(spark), "PREFIX x: <x:> SELECT ?g ?n WHERE { GRAPH ?g { <a> x:name ?n } }").first()
    assert (got.g["value"], got.n["value"]) == ("h", "A")


def test_nested_annotations_round_trip(spark):
    sel = "struct<type:string,uri:string,start_path:string,end_path:string,start:bigint,end:bigint,refined_by:struct<type:string,uri:string,vals:array<struct<type:string,uri:string,start_path:string,end_path:string,start:bigint,end:bigint>>>>"
    schema = f"uri string, target struct<type:string,uri:string,source:string,selectors:array<{sel}>>, creator_uri string, bodies array<struct<type:string,uri:string,tag:string,html_frag:string>>"
    refined = ("ListSelector", None, [("OffsetSelector", None, None, None, 3, 5), ("PathSelector", None, "node(/a)", "node(/b)", None, None), ("OffsetSelector", None, None, None, 1, 2)])
    target = ("FragmentTarget", "u:t", "u:doc", [("OffsetSelector", None, None, None, 1, 9, refined), ("PathSelector", None, "char(/a,1)", "char(/a,2)", None, None, None)])
    rows = [("u:1", target, "u:run", [("SimpleTagBody", None, "u:tag", None), ("ReplacedHtmlBody", None, None, "<b>x</b>")]), ("u:2", None, None, None)]
    df = spark.createDataFrame(rows, schema)

    def plain(row, lists=True):
        out = row.asDict(recursive=True)
        for s in (out["target"] or {}).get("selectors") or []:
            s["refined_by"] = s["refined_by"] and s["refined_by"]["vals"]
        if out["target"]:
            out["target"]["selectors"].sort(key=str)
        out["bodies"] = sorted(out["bodies"] or [], key=str)
        return out

    want = sorted((plain(r) for r in df.collect()), key=str)
    by_json = records.from_jsonld(records.to_jsonld(df, records.NESTED_ANNOTATION), records.NESTED_ANNOTATION)
    assert sorted((plain(r) for r in by_json.collect()), key=str) == want
    triples = records.to_triples(df, records.NESTED_ANNOTATION)
    got = sorted((plain(r) for r in records.from_triples(triples, records.NESTED_ANNOTATION).collect()), key=str)
    assert got == want


def test_transitive_load_and_jobs(spark):
    df = spark.createDataFrame([("u:1", "u:t", "u:run", ["u:tag"]), ("u:9", "u:z", None, [])], "uri string, target_uri string, creator_uri string, tags array<string>")
    targets = spark.createDataFrame([("u:t", "u:doc", 1, 2), ("u:z", "u:doc", 3, 4)], "uri string, source string, start long, end long")
    triples = records.to_triples(df, records.ANNOTATION).unionByName(records.to_triples(targets, records.FRAGMENT_TARGET))
    loaded = records.load_transitively(triples, spark.createDataFrame([("u:1",)], "uri string"), (records.ANNOTATION, records.FRAGMENT_TARGET))
    assert {n: [r.uri for r in x.collect()] for n, x in loaded.items()} == {"Annotation": ["u:1"], "FragmentTarget": ["u:t"]}
    every = sinks.records_jsonld(triples, (records.ANNOTATION, records.FRAGMENT_TARGET))
    assert sorted((r.uri, r.type) for r in every.collect()) == [("u:1", "Annotation"), ("u:9", "Annotation"), ("u:t", "FragmentTarget"), ("u:z", "FragmentTarget")]
    some = sinks.records_jsonld(triples, (records.ANNOTATION, records.FRAGMENT_TARGET), query=f"SELECT ?a WHERE {{ ?a <{records.OA}hasTarget> <u:z> }}", variable="a")
    assert sorted(r.uri for r in some.collect()) == ["u:9", "u:z"]


def test_turtle_documents(spark, tmp_path):
    import gzip

    text = '''# Graph: <g:1>
@prefix ex: <e:/> . PREFIX f: <f:/>
ex:a a ex:B ; ex:p "x\\\"y\\n"@en-GB , 5 , 1.5, -2e3 , true ; ex:q [ ex:r ( 1 "two" ex:t ) ] .
<z:> f:w """long "q"
text"""^^ex:dt . _:b1 ex:p _:b1 . ex:x\\/y ex:p 'single', () .'''
    with gzip.open(tmp_path / "one.ttl.gz", "wt") as f:
        f.write(text)
    got = corpora.turtle(spark, str(tmp_path)).collect()
    assert {r.g for r in got} == {"g:1"}
    objects = {(r.s.value, r.p): [] for r in got}
    for r in got:
        objects[r.s.value, r.p].append((r.o.kind, r.o.value, r.o.datatype and r.o.datatype.split("#")[-1], r.o.lang))
    assert ("literal", 'x"y\n', "langString", "en-GB") in objects["e:/a", "e:/p"] and ("literal", "-2e3", "double", None) in objects["e:/a", "e:/p"]
    assert len(objects["e:/a", "e:/p"]) == 5 and ("uri", T.RDF + "nil", None, None) in objects["e:/x/y", "e:/p"]
    heads = spark.createDataFrame(got, corpora.TRIPLE)
    node = objects["e:/a", "e:/q"][0][1]
    assert [x["value"] for x in records.lists(heads, "e:/r").where(F.col("s") == node).first()["items"]] == ["1", "two", "e:/t"]
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", '"x" <b> <c> .', "<a> <b> [ ."):
        with pytest.raises(ValueError):
            corpora.parse_turtle(bad)


def test_graph_store(spark, tmp_path):
    store, triples = corpora.GraphStore(spark, str(tmp_path / "store")), _graph(spark)
    store.create("g:1")
    with pytest.raises(ValueError):
        store.create("g:1")
    store.load(triples, "g:1")
    store.load(triples, "g:2")
    assert store.triples().count() == 8 and {r.g for r in store.triples("g:2").collect()} == {"g:2"}
    store.clear("g:1")
    assert store.triples("g:1").count() == 0 and store.exists("g:1")
    store.replace(triples.limit(1), "g:2")
    store.drop("g:1")
    assert not store.exists("g:1") and store.triples().count() == 1 and store.temporary() != store.temporary()


def test_metadata_and_severities(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id": "0711.0001", "title": "t", "categories": "cs.AI math", "license": null}\n{"id": "x", "categories": " "}\n')
    meta = corpora.metadata(spark, str(tmp_path / "m.json"))
    assert [r.categories for r in meta.collect()] == [["cs.AI", "math"]]
    made = [(r.s.value, r.p.rsplit("#")[-1].rsplit("/")[-1], r.o.value) for r in corpora.metadata_triples(meta, "e:/", "e:/set", "e:/run", {"math": "Mathematics"}).collect()]
    assert ("e:/category/cs.AI", "subTagOf", "e:/category/cs") in made and ("e:/category/math", "label", "Mathematics") in made
    assert ("e:/0711.0001#meta.cat.anno", "hasTarget", "e:/0711.0001") in made and sum(1 for x in made if x[1] == "val") == 2
    (tmp_path / "w.txt").write_text("0711/0711.0001.html\n\nhep-th9901001.html\nodd file\n")
    rows = corpora.severities(spark, {"warning": str(tmp_path / "w.txt")})
    assert rows.count() == 3
    made = [(r.s.value, r.o.value) for r in corpora.severity_triples(rows, "e:/", "e:/run").collect()]
    assert ("e:/hep-th/9901001#meta.severity.anno", "e:/hep-th/9901001") in made and not any("odd" in s for s, _ in made)


def test_documents_from_a_query(spark):
    docs = spark.createDataFrame([("b", "<p>b</p>"), ("c", "<p>c</p>")], "doc_uri string, html string")
    got = corpora.documents_from_query(_triples(spark, "x has c,x has b"), "SELECT ?doc WHERE { <x> <has> ?doc }", docs).collect()
    assert [r.doc_uri for r in got] == ["b", "c"]
    with pytest.raises(Exception, match="no document"):
        corpora.documents_from_query(_triples(spark, "x has z"), "SELECT ?doc WHERE { <x> <has> ?doc }", docs).collect()


def test_terms_are_compacted_and_expanded(spark):
    df = spark.createDataFrame([("e:/1/x",), ("e:/x",), ("z:q",), ("e:/kind",)], "u string")
    prefixes, terms = {"a": "e:/", "b": "e:/1/"}, {"kind": "e:/kind"}
    short = records.compact(F.col("u"), prefixes, terms)
    assert [tuple(r) for r in df.select(short, records.expand(short, prefixes, terms)).collect()] == [("b:x", "e:/1/x"), ("a:x", "e:/x"), ("z:q", "z:q"), ("kind", "e:/kind")]


def test_declarations(spark):
    x = "<math><semantics><mi>x</mi></semantics></math>"
    rel = "<math><semantics><mrow><mi>n</mi><mo>&gt;</mo><mn>0</mn></mrow></semantics></math>"
    html = f'<html><body><div class="ltx_para"><p>Let {x} be a positive integer, so {x} is odd.</p></div><div class="ltx_para"><p>There is an {rel} here.</p></div></body></html>'
    df = spark.createDataFrame([(1, html), (2, None)], "d int, html string")
    got = [(r.kind, r.n, r.identifier, r.polarity) for r in spotters.declarations(df, "d", "html", ["positive integer", "integer"]).orderBy("start").collect()]
    assert sorted(got, key=str) == sorted([("declaration", 0, "x", "universal"), ("restriction", 0, "x", None), ("occurrence", 0, "x", None), ("declaration", 1, "n", "existential")], key=str)


def test_graph_tables_answer_by_predicate(spark):
    people = spark.createDataFrame([("u:1", "A", ["t", "s"]), ("u:2", None, None)], "uri string, name string, tags array<string>")
    cls = records.RecordClass("P", "x:P", (records.Attr("name", "x:name", "string"), records.Attr("tags", "x:tag", many=True)))
    graph = records.Graph((people, cls))
    for p in (T.RDF + "type", "x:name", "x:tag", "x:none"):
        key = lambda df: sorted((r.s.value, r.o.value) for r in df.collect())
        assert key(graph.with_predicate(p)) == key(graph.triples().where(F.col("p") == p))


def test_graph_and_blank_lists(spark):
    q = "PREFIX x: <x:> SELECT ?n WHERE { GRAPH <h> { ?s x:name ?n } ?s x:next [ x:next ?t ] }"
    assert [r.n.value for r in sparql.query(_graph(spark), q).collect()] == ["A"]


def test_runs_resume(spark, tmp_path):
    docs = spark.createDataFrame([(1, "AB cd"), (2, "EF"), (2, "EF")], "doc_id long, text string")
    rules = {"caps": spotters.regex_spotter("doc_id", "text", {"caps": "[A-Z]+"})}
    assert spotters.run(spark, docs, "doc_id", rules, str(tmp_path)) == {"caps": 2}
    more = docs.unionByName(spark.createDataFrame([(3, "GH IJ")], docs.schema))
    assert spotters.run(spark, more, "doc_id", rules, str(tmp_path)) == {"caps": 2}
    assert spotters.results(spark, str(tmp_path), "caps").count() == 4


def test_corpora(spark, tmp_path):
    import zipfile

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.html").write_text("<p>1</p>")
    docs = corpora.html_directory(spark, str(tmp_path / "c"), "e:/")
    resolver = corpora.Resolver()
    resolver.register("e:/", docs)
    assert resolver.document("e:/one").first().html == "<p>1</p>"
    with pytest.raises(KeyError):
        resolver.document("f:/one")
    with pytest.raises(LookupError):
        resolver.document("e:/two")
    (tmp_path / "m" / "0711").mkdir(parents=True)
    (tmp_path / "m" / "0711" / "0711.0001.html").write_text("<p>a</p>")
    with zipfile.ZipFile(tmp_path / "m" / "9901.zip", "w") as z:
        z.writestr("9901/hep-th9901001.html", "<p>b</p>")
    got = {r.doc_uri: r.yymm for r in corpora.year_month(spark, str(tmp_path / "m"), "e:/").collect()}
    assert got == {"e:/0711.0001": "0711", "e:/hep-th/9901001": "9901"}
    assert corpora.paper_id("hep-th/9901001")["name"] == "hep-th9901001" and corpora.paper_id("x") is None


def test_incremental_stream(spark, tmp_path):
    from marginalia.streaming.incremental import process_new

    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(5).write.parquet(src)
    for n in (5, 5, 8):
        if n == 8:
            spark.range(3).write.mode("append").parquet(src)
        process_new(spark, src, "id long", lambda df: df, out, ck)
        assert spark.read.parquet(out).count() == n


def test_nested_samples(spark):
    import hashlib

    rows = spark.range(200).select("id", T.sha256_mod(F.col("id").cast("string"), 10_000).alias("m")).collect()
    assert all(r.m == int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16) % 10_000 for r in rows)


def test_lists_that_stand_together_take_no_rounds(spark, monkeypatch):
    bnode, uri = (lambda v, k=k: (k, v, None, None) for k in ("bnode", "uri"))
    want, rows = {}, []
    for i in range(40):
        cells = [f"c{i}-{j}" for j in range(i % 9)]
        want[f"s{i}"] = [f"v{i}-{j}" for j in range(i % 9)]
        rows.append(("g", uri(f"s{i}"), "x:list", bnode(cells[0]) if cells else uri(T.RDF + "nil")))
        for j, c in enumerate(cells):
            rows += [("g", bnode(c), T.RDF + "first", uri(f"v{i}-{j}")), ("g", bnode(c), T.RDF + "rest", bnode(cells[j + 1]) if j + 1 < len(cells) else uri(T.RDF + "nil"))]
    kind, made = f"g string, s {T.TERM}, p string, o {T.TERM}", []
    got = lambda t: {r.s: [x.value for x in r["items"]] for r in records.lists(t, "x:list").collect()}
    keep = records.written
    monkeypatch.setattr(records, "written", lambda df, label, *a: made.append(label) or keep(df, label, *a))
    assert got(spark.createDataFrame(rows, kind).coalesce(1)) == want and made == ["list-pieces", "list-cells"]
    assert got(spark.createDataFrame(rows, kind).repartition(4, "s", "p", "o")) == want
    # a second list that ends in the first one's tail, from another partition: its chain is entered in the middle
    tail = [("g", uri("t"), "x:list", bnode("d")), ("g", bnode("d"), T.RDF + "first", uri("w")), ("g", bnode("d"), T.RDF + "rest", bnode("c8-5"))]
    both = spark.createDataFrame(rows, kind).coalesce(1).unionByName(spark.createDataFrame(tail, kind).coalesce(1))
    assert got(both) == want | {"t": ["w", *want["s8"][5:]]}


def test_records_meet_their_facts_once(spark):
    cls = records.RecordClass("Thing", "x:Thing", (records.Attr("one", "x:one"), records.Attr("tags", "x:tag", many=True)))
    rows = _triples(spark, f"a {T.RDF}type x:Thing,a x:one 1,a x:tag q,a x:tag p,a x:tag q,b {T.RDF}type x:Thing,c x:one 2,d {T.RDF}type x:Other,d x:one 3,e {T.RDF}type x:Thing,e x:one 4")
    loaded = records.from_triples(rows, cls)
    assert sorted((r.uri, r.one, r.tags) for r in loaded.collect()) == [("a", "1", ["p", "q"]), ("b", None, None), ("e", "4", [])]
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 1
