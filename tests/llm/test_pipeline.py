"""The pipeline's stages on the driver's smallest tables and on a small table of odd rows, against brute force."""

import collections
import os
import random
import re

import corpus_pipeline
import pytest
from marginalia.llm import quality, toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
WORDS = [f"wort{chr(97 + i % 26)}{i}" for i in range(300)]


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).persist()
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            wrong = [i for i, r in labels.items() if (i in kept) != bool(r.quality)]
            assert len(wrong) <= 2
        if name in ("quality", "toxicity", "near_duplicates"):
            assert docs.count() <= before.count()
    assert seen == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    assert docs.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, position int, __rows int, mix_shard int"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder with small ``documents`` and ``labels``, and odd rows with clashing columns."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(300):
        t = text(40)
        if i % 5 == 0:
            w = t.split()
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["vilefoo", "vilebar", "vilebaz"])
            t = " ".join(w)
        if i % 7 == 0:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, "en", ["a", "b", None][i % 3], len(t)))
        labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    base = text(60)
    near = base.split()
    near[10] = "anders"
    odd = [(None, text(30), "a"), (None, None, None), (1, None, "a"), (2, "", None), (3, " \n", "b"), (4, base, "a"), (5, " ".join(near), "b"), (4, base, "a"), (6, text(30), "b"), (6, text(35), "b"), (7, text(9000), "a"), (8, "vilefoo vilebar vilebaz " + text(20), "a")]
    odd += [(i, text(50), r.choice(["a", "b", None])) for i in range(20, 60)]
    made = [(i, t, "en", s, 1, 0.99, "mine", 7, k % 3, 5) for k, (i, t, s) in enumerate(odd)]
    return sf, spark.createDataFrame(made, SCHEMA), [tuple(x) for x in made]


def _rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_quality_and_toxicity_keep_whole_rows(spark, world):
    sf, docs, rows = world
    tables = [spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")]
    good, tame = quality.train(*tables), toxicity.train(*tables)
    kept = STAGES["quality"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert _rows(kept) == collections.Counter(x for x in rows if good.score([quality.features(x[1])])[0] >= 0.3)
    kept = STAGES["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    want = collections.Counter(x for x in rows if tame.score(x[1]) < 0.3)
    assert _rows(kept) == want and not any(x[0] == 8 for x in want) and any(x[1] is None for x in want)


def test_deduplicate_keeps_one_of_each_group(spark, world):
    sf, docs, rows = world
    got = STAGES["near_duplicates"](spark, docs, sf)
    assert got.columns == docs.columns
    want = collections.Counter(rows)
    fours = sorted(x for x in rows if x[0] == 4)
    want[fours[1]] -= 1  # the same id and text: the least by its columns stays
    for x in rows:
        if x[0] == 5:
            want[x] -= 1
    assert _rows(got) == +want


def test_mix_repeats_whole_rows(spark, world):
    sf, docs, rows = world
    got = STAGES["mixing"](spark, docs, sf)
    assert got.columns == docs.columns
    times = _rows(got)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have = collections.Counter(rows)
    assert all(n <= 2 * have[x] and size(x[1]) for x, n in times.items())
    words = sum(size(x[1]) * n for x, n in times.items())
    # a source may lack its largest document, one of 9000 words
    assert 1.5 * sum(size(x[1]) for x in rows) - 9100 < words <= 1.5 * sum(size(x[1]) for x in rows) + 3


def test_stages_of_an_empty_table(spark, world):
    sf, docs, _ = world
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)


def test_run_equals_its_stages(spark, world):
    sf, _, _ = world
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
    piece = lambda df: collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert piece(corpus_pipeline.run(spark, sf)) == piece(docs)
