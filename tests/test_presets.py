from marginalia.operators import dom, presets
from pyspark.sql import functions as F

PAGE = '<html><body><h1 class="ltx_title">On <math><mi>x</mi></math></h1><p class="ltx_para">See <cite class="ltx_cite">[1]</cite> and\n <cite class="ltx_cite">[2]</cite>.</p><div class="ltx_bibliography">gone</div></body></html>'


def test_standard_rules(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    text = dom.dnm(df, "page_id", "html", presets.STANDARD).select(presets.normalized(F.col("text"))).first()[0]
    assert text == "On @MathNode:0@\nSee @LtxCite:0@ and @LtxCite:1@.\n"
    row = dom.dnm(df, "page_id", "html", presets.SIMPLE).first()
    assert row.text.startswith("On MathNodeSee LtxCite and") and [r.category for r in row.replaced] == ["MathNode", "LtxCite", "LtxCite"]


def test_styles():
    assert (presets.hyphenated("math group"), presets.camel("math group"), presets.capitals("math group")) == ("math-group", "MathGroup", "MATHGROUP")


def test_targets_get_both_forms(spark):
    rows = [(1, "<a>u<b>vw</b>x</a>", "char(/a/b,0)", "char(/a/b,1)", None, None), (1, "<a>u<b>vw</b>x</a>", None, None, 2, 6), (2, "<a/>", "node(/z)", "node(/z)", None, None)]
    df = spark.createDataFrame(rows, "d int, html string, start_path string, end_path string, start int, end int")
    got = sorted(((r.d, r.start, r.end, r.start_path) for r in presets.targets(df, "d", "html").collect()), key=str)
    assert got == [(1, 2, 6, "node(/a/b)"), (1, 3, 4, "char(/a/b,0)"), (2, None, None, None)]
