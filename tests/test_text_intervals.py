import random

from hypothesis import given, settings
from hypothesis import strategies as st
from marginalia.functions import text as X
from marginalia.operators import intervals


def test_protected_words():
    text = "Hello  world. A B Cdef"
    at = text.index("A B C")
    assert [t for t, *_ in X.keep_as_words(text, [(at, at + 5)])] == ["Hello", "world", ".", "A B C", "def"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,()\n\u00a0é"), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=3))
def test_tokens_cover_what_is_not_space(text, ranges):
    kept = X.keep_as_words(text, [(a, min(b, len(text))) for a, b in ranges if a < min(b, len(text))])
    assert all(text[a:b] == t for t, a, b in kept)
    assert all(kept[i][2] <= kept[i + 1][1] for i in range(len(kept) - 1))


def test_tokens_and_spans_agree(spark):
    df = spark.createDataFrame([(1, "Say: (well-known) x."), (2, None), (3, "")], "doc_id long, text string")
    rows = X.word_tokens(df, "doc_id", "text").collect()
    from pyspark.sql import functions as F

    assert [r.token for r in rows] == df.where("doc_id = 1").select(X.tokens(F.col("text"))).first()[0]


def test_sentences(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("One. two is 3.5 long!  Three?\u00a0no. Tail",)], "t string")
    assert df.select(X.sentences(F.col("t"))).first()[0] == ["One.", "two is 3.5 long!", "Three? no."]
    assert df.select(X.sentences(F.col("t"), keep_tail=True)).first()[0][-1] == "Tail"


def _ranges(r, n, name):
    out = []
    for i in range(n):
        a = r.randrange(0, 4000)
        out.append((r.randrange(3), f"{name}{i}", a, a + r.randrange(1, 900)))
    return out


def test_joins_equal_brute_force(spark):
    r = random.Random(5)
    a, b = _ranges(r, 60, "a"), _ranges(r, 60, "b")
    x = spark.createDataFrame(a, "d int, i string, s int, e int")
    y = spark.createDataFrame(b, "d int, j string, t int, u int")
    got = {(p.i, p.j) for p in intervals.overlap_join(x, y, "d", ("s", "e"), ("t", "u"), width=100).collect()}
    assert got == {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and q[2] < p[3]}
    inside = {(p.i, p.j) for p in intervals.contains_join(x, y, "d", ("s", "e"), ("t", "u"), width=100).collect()}
    assert inside == {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[2] and q[3] <= p[3]}
    stabbed = {(p.j, p.i) for p in intervals.stab_join(y, x, "d", "t", ("s", "e"), width=100).collect()}
    assert stabbed == {(q[1], p[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[2] < p[3]}


def test_merge_and_prune(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 5, 6), (1, 8, 9)], "d int, start int, end int")
    assert sorted((r.start, r.end) for r in intervals.merge_overlaps(df, "d").collect()) == [(0, 5), (5, 6), (8, 9)]
    assert sorted((r.start, r.end) for r in intervals.prune_overlaps(df, "d").collect()) == [(0, 3), (5, 6), (8, 9)]


def test_minimize_with_and_without_parity(spark):
    gone = spark.createDataFrame([(1, 1, 3), (1, 4, 7), (1, 7, 9)], "d int, i_start int, i_end int")
    ranges = spark.createDataFrame([(1, "ab", 2, 4), (1, "a", 2, 3), (1, "d", 6, 7)], "d int, id string, start int, end int")
    assert {r.id: (r.start, r.end) for r in intervals.minimize(ranges, gone, "d").collect()} == {"ab": (2, 4), "a": (2, 3), "d": (6, 7)}
    assert {r.id: (r.start, r.end) for r in intervals.minimize(ranges, gone, "d", parity=True).collect()} == {"ab": (3, 4), "a": (3, 3), "d": (7, 7)}


def test_classification(spark):
    gold = spark.createDataFrame([(1, "g1", 0, 5), (1, "g2", 10, 20), (1, "g3", 30, 31), (1, "g4", 9, 8)], "d int, id string, start int, end int")
    pred = spark.createDataFrame([(1, "p1", 0, 5), (1, "p2", 10, 12), (1, "p3", 13, 21), (1, "p4", 50, 60)], "d int, id string, start int, end int")
    got = sorted((r.gold_id or "", r.pred_id or "", r.category) for r in intervals.classify(gold, pred, "d").collect())
    assert got == [("", "p4", "prediction_only"), ("g1", "p1", "precise"), ("g2", "", "golden_in_multimatches"), ("g2", "p2", "multimatch"), ("g2", "p3", "multimatch"), ("g3", "", "golden_only"), ("g4", "", "degenerate")]


def test_failing_documents_become_error_rows(spark, tmp_path):
    from marginalia.operators import spotters

    def letters(value):
        for i, c in enumerate(value):
            if c == "!":
                raise ValueError("bad text")
            yield i, i + 1, c

    docs = spark.createDataFrame([(1, "ab"), (2, "a!"), (3, None), (4, "")], "id long, text string")
    out = str(tmp_path / "run")
    assert spotters.run(spark, docs, "id", {"letters": spotters.function_spotter("id", "text", letters)}, out) == {"letters": 2}
    assert sorted((r.id, r.start, r.end, r.tag) for r in spotters.results(spark, out, "letters").collect()) == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    errors = {r.id: (r.spotter, r.error) for r in spotters.results(spark, out, "errors").collect()}
    assert errors.keys() == {2, 3} and errors[2] == ("letters", "ValueError: bad text")


def test_range_matching_counts_both_sides(spark):
    gold = spark.createDataFrame([(1, "g1", 0, 10), (1, "g2", 20, 30), (1, "g3", 40, 50), (1, "g4", 60, 70), (1, "g5", 9, 8)], "d int, id string, start int, end int")
    predicted = spark.createDataFrame([(1, "p1", 0, 10), (1, "p2", 18, 22), (1, "p3", 28, 45), (1, "p4", 80, 90)], "d int, id string, start int, end int")
    got = sorted((r.category, r.gold_id, r.pred_id) for r in intervals.classify(gold, predicted, "d").fillna("-").collect())
    assert got == [("degenerate", "g5", "-"), ("golden_in_multimatches", "g2", "-"), ("golden_only", "g4", "-"), ("multimatch", "g2", "p2"), ("multimatch", "g2", "p3"), ("overlap", "g3", "p3"), ("precise", "g1", "p1"), ("prediction_in_multimatches", "-", "p3"), ("prediction_only", "-", "p4")]
    docs = spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(100)))], "d int, text string")
    row = intervals.overlap_report(gold, predicted, "d", docs, "text").collect()
    assert [(r.gold_id, r.pred_id, r.gold_text) for r in row] == [("g3", "p3", "opqrstuvwx")]


def test_pruning_goes_on_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(k, a, a + 5) for k in range(4) for a in range(0, 40, 3)]
        got = intervals.prune_overlaps(spark.createDataFrame(rows, "d int, start int, end int"), "d").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in range(4):
        end = 0
        for a in range(0, 40, 3):
            if a >= end:
                want.append((k, a, a + 5))
                end = a + 5
    assert sorted(map(tuple, got)) == want


def test_annotations_by_source(spark):
    import pytest

    annotations = spark.createDataFrame([("a:1", "t:1")], "uri string, target_uri string")
    targets = spark.createDataFrame([("t:1", "d:1", 1, 2)], "uri string, source string, start int, end int")
    assert tuple(intervals.annotations_by_source(annotations, targets).first()) == ("d:1", "a:1", "t:1", 1, 2)
    for bad in (spark.createDataFrame([("a:1", "t:9")], annotations.schema), annotations.unionByName(annotations)):
        with pytest.raises(Exception):
            intervals.annotations_by_source(bad, targets).collect()


def test_token_counts_agree_with_tokens(spark):
    from pyspark.sql import functions as F

    texts = ["Say: (well-known) x.", "", None, " \n", "a\u00a0b ... c\x1cd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.token_counts(F.col("t")).alias("c")).collect():
        tokens = [t for t, *_ in X.keep_as_words(r.t or "", [])]
        assert (r.c.n_tokens, r.c.n_chars, r.c.n_marks) == (len(tokens), sum(map(len, tokens)), sum(t in X.PUNCTUATION for t in tokens))


def test_passes_give_bounded_batches(spark, monkeypatch):
    import pyarrow as pa
    from marginalia.functions.batches import CHARACTERS, ROWS
    from marginalia.operators import dom

    for module in (X, dom):
        monkeypatch.setattr(module, "in_batches", lambda df, function, schema: function)
    df = spark.createDataFrame([(1, "x")], "d long, t string")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x" * 50_000, None, "y x"])], ["d", "t"])
    out = list(X.spans(df, "d", "t", "x")(iter([batch])))
    assert max(b.num_rows for b in out) == ROWS
    rows = [(r["d"], r["i"], r["match"], r["start"], r["end"]) for b in out for r in b.to_pylist()]
    assert rows == [*((1, i, "x", i, i + 1) for i in range(50_000)), (3, 0, "x", 2, 3)]
    out = list(dom._rows(df, "d", "t", "n int, s string", lambda t: ((i, t) for i in range(3)))(iter([pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["a" * 1_000_000] * 20)], ["d", "t"])])))
    assert max(sum(map(len, b.column(2).to_pylist())) for b in out) <= CHARACTERS + 1_000_000
    assert [(r["d"], r["n"]) for b in out for r in b.to_pylist()] == [(d, n) for d in range(20) for n in range(3)]
    assert max(b.num_rows for b in dom._rows(df, "d", "t", "n int", lambda t: ((i,) for i in range(40_000)))(iter([batch]))) == ROWS


def test_protected_lines_take_linear_time():
    import re
    import time

    text = "a License b\nc d.\n\nLicense License\n" + "word " * 40_000 + "\nend License"
    line = re.compile(r"[^\n]*License[^\n]*")
    for part in (text[:60], "License", "", "x\nLicense\n", "no\nlines"):
        assert X.lines_with(part, "License") == [m.span() for m in line.finditer(part)]
        assert X.count_as_words(part, X.lines_with(part, "License")) == len(X.keep_as_words(part, [m.span() for m in line.finditer(part)]))
    began = time.process_time()
    assert X.count_as_words(text, X.lines_with(text, "License")) == 1 + 3 + 1 + 40_000 + 1
    assert time.process_time() - began < 2


def test_token_json_without_gathering(spark):
    from marginalia.sources import sinks

    df = spark.createDataFrame([(1, 'He said "no", \u00e4\\x.\n'), (2, None), (3, " "), (4, "w " * 20_000)], "d long, t string")
    whole = sinks.token_arrays_json(X.token_arrays(df, "d", "t"), "d")
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    want = {r.d: r.json for r in sinks.token_json(X.word_tokens(df, "d", "t"), "d").collect()}
    assert {r.d: r.json for r in whole.collect()} == want and sorted(want) == [1, 4]
