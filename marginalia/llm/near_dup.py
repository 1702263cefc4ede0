"""MinHash near-duplicate detection, with DataFrame functions only.

Circulant MinHash: one hash (the first permutation) scatters the shingles, a second one is applied to the scattered
value shifted circularly by 0, 1, 2, ... positions; the minimum over a document of each shift is one coordinate of its
signature, so two permutations stand for all of them.  Coordinates are grouped into bands; documents that agree in a
band are candidates, and every link is confirmed by the exact Jaccard similarity of the full shingle sets.

The candidates of a bucket are not paired with one another.  Texts with equal word sequences are one class from the start.
Then each class meets the smallest class of its buckets, and confirmed links form components, in two rounds.  Only classes that share a
bucket and are still in different components meet after that: those outside a bucket's largest component meet all others, in
chunks of bounded size, and a pair is emitted only if its signatures agree well enough.  What is left uncompared is connected anyway.
Before full sets are fetched, a pair must agree in a share of its signature that a link misses about once in 10^8 pairs.

A long text is never one array of words: it is cut between words into pieces, each with the shingles that begin in it, and its set is
counted and compared as rows.  The shingles and the comparison are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import connected_components, materialize, pick, small, words

#: Words in a shingle.
SHINGLE = 5
#: Bands and coordinates in each: a pair at similarity 0.7 meets in no band once in 600,000 pairs, at 0.8 once in 10^10.
#: Below a hundred columns the aggregate stays in generated code.
BANDS, ROWS = 32, 3
#: Share of the coordinates that must agree, in four bits each, before the full sets are compared: 5.8 deviations below what 0.7 gives over 96.
AGREE = 0.45
#: Bands whose buckets give the first links; the rest only join what these leave apart.
FIRST_BANDS = 8
#: Classes of one bucket that one group of a join holds on either side: a bucket of more is many groups.
CHUNK = 2048
#: Ids that are broadcast at most, some 16 bytes each; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Shingles that are hashed in one row.
LANES = 8
#: Size of the circle on which scattered shingles are shifted.
CIRCLE = (1 << 62) - 1
#: Texts of more bytes are shingled in pieces of at least so many characters, as arrays of all their words don't fit a task's memory.
LONG, PIECE = 1 << 20, 1 << 16
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 70


def _once(value: Column) -> Column:
    """A value that later expressions read, not recompute: the optimizer doesn't move expressions across a generator."""
    return F.explode(F.array(value))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, the digest of the word sequence and the set of shingle hashes, of documents that have words.

    A shingle is a run of five words, or the whole sequence when it is shorter.
    """
    listed = docs.where("doc_id is not null").select("doc_id", _once(words(F.col("text"), lower=True)).alias("w")).where(F.size("w") > 0)
    hashed = listed.select("doc_id", F.size("w").alias("n_words"), _once(F.transform("w", lambda w: F.xxhash64(w))).alias("h"))
    h, n = F.col("h"), F.col("n_words")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
    return hashed.select("doc_id", F.concat(F.hex(F.xxhash64("h")), F.hex(F.xxhash64(F.lit(3), "h"))).alias("digest"), _once(F.array_distinct(F.when(n < SHINGLE, F.array(F.xxhash64(h, F.lit(1)))).otherwise(runs))).alias("s"))


def _pieces(docs: DataFrame) -> DataFrame:
    """doc_id, digest and the set of shingle hashes of each piece, of documents with long texts of five words at least.

    A piece ends with a word, and a shingle belongs to the piece of its first word: the four words after the piece complete the last ones.
    """
    cut = rf"(?s).{{1,{PIECE}}}\S*(?=((?:\s+\S+){{0,{SHINGLE - 1}}}))"
    parts = [F.regexp_extract_all("text", F.lit(cut), F.lit(k)).alias(name) for k, name in ((0, "own"), (1, "after"))]
    cut_up = docs.where("doc_id is not null").select("doc_id", F.md5("text").alias("digest"), *parts).select("doc_id", "digest", F.explode(F.arrays_zip("own", "after")).alias("x"))
    listed = cut_up.select("doc_id", "digest", _once(F.struct(*[words(F.col(f"x.{name}"), lower=True).alias(name) for name in ("own", "after")])).alias("w"))
    hashed = listed.select("doc_id", "digest", F.size("w.own").alias("n"), _once(F.transform(F.concat("w.own", "w.after"), lambda w: F.xxhash64(w))).alias("h"))
    h, starts = F.col("h"), F.least(F.col("n"), F.size("h") - (SHINGLE - 1))
    runs = F.transform(F.sequence(F.lit(0), starts - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
    return hashed.where(starts > 0).select("doc_id", "digest", F.array_distinct(runs).alias("s"))


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents whose sets are built whole, and the pieces of those with long texts; None if there are none."""
    if (docs.agg(F.max(F.octet_length("text"))).first()[0] or 0) <= LONG:
        return docs, None
    # a long text of less than five words is one shingle and goes the short way
    long = F.coalesce((F.octet_length("text") > LONG) & F.col("text").rlike(r"\S\s+" + r"\S+\s+" * (SHINGLE - 2) + r"\S"), F.lit(False))
    return docs.where(~long), materialize(_pieces(docs.where(long)), "pieces")


def _elements(sets: DataFrame) -> DataFrame:
    return sets.select("doc_id", "digest", F.explode("s").alias("x"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, pieces: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, n_shingles, the hash of each band and four bits of each coordinate, sixteen in a long, for documents that have words."""
    whole = _sets(docs).select("doc_id", "digest", F.size("s").alias("n"), "s")
    if pieces is not None:
        n = _elements(pieces).distinct().groupBy("doc_id", "digest").agg(F.count("*").cast("int").alias("n"))
        whole = whole.unionByName(pieces.join(n, ["doc_id", "digest"]).select("doc_id", "digest", "n", "s"))
    # rows of eight shingles: the minimum of a row is taken in one expression, and only then meets the running one
    sets = whole.select("doc_id", "digest", "n", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(LANES))).alias("i"))
    # first permutation: scatter; second: hash of the shifted place.  CIRCLE keeps the sum within a long.
    lanes = [F.xxhash64(F.get("s", F.least(F.col("i") + j, F.size("s") - 1)), F.lit(7)).bitwiseAND(CIRCLE).alias(f"p{j}") for j in range(LANES)]
    shifted = [F.min(F.least(*[F.xxhash64((F.col(f"p{j}") + F.lit(k)).bitwiseAND(CIRCLE)) for j in range(LANES)])).alias(f"m{k}") for k in range(bands * rows)]
    least = sets.select("doc_id", "digest", "n", *lanes).groupBy("doc_id", "digest", "n").agg(*shifted)
    hashes = [F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)]
    return least.select("doc_id", "digest", F.col("n").cast("long").alias("n_shingles"), F.array(*hashes).alias("bands"), F.array(*[_packed(range(k, min(k + 16, bands * rows))) for k in range(0, bands * rows, 16)]).alias("sketch"))


def _packed(places: range) -> Column:
    out = F.lit(0).cast("long")
    for j, k in enumerate(places):
        out = out.bitwiseOR(F.shiftleft(F.col(f"m{k}").bitwiseAND(15), 4 * j))
    return out


def _agree(x: str, y: str, coordinates: int, share: float) -> Column:
    """Whether two sketches agree in at least this share of their coordinates; plain arithmetic on longs."""
    differ = F.lit(0)
    for k in range(-(-coordinates // 16)):
        d = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        differ = differ + F.bit_count(d.bitwiseAND(0x1111111111111111))
    return differ <= F.lit(int((1 - share) * coordinates))


def _alike(pairs: DataFrame, sketches: DataFrame, coordinates: int, share: float = AGREE) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least this share of their coordinates."""
    met = pairs.join(sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("ka")), "a").join(sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("kb")), "b")
    return met.where(_agree("ka", "kb", coordinates, share)).select("a", "b")


def _confirmed_long(pairs: DataFrame, docs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """As ``_confirmed``, with sets as rows, for pairs in which a text is long."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    own = small(ids)
    elements = materialize(_elements(pieces.join(own, "doc_id", "left_semi")).unionByName(_elements(_sets(docs.join(own, "doc_id", "left_semi")))).distinct(), "elements")
    size = elements.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    side = lambda df, d, *x: df.select(F.col("doc_id").alias(d), F.col("digest").alias(f"d{d}"), *x)
    met = side(elements, "a", "x").join(small(pairs.select("a", "b")), "a").join(side(elements, "b", "x"), ["b", "x"])
    counted = met.groupBy("a", "da", "b", "db").agg(F.count("*").alias("i"))
    counted = counted.join(side(size, "a", F.col("n").alias("na")), ["a", "da"]).join(side(size, "b", F.col("n").alias("nb")), ["b", "db"])
    linked = counted.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b", F.lit(True).alias("linked")).distinct()
    return pairs.join(linked, ["a", "b"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked"))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, pieces: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) and whether they are linked, from the full sets of their texts."""
    if pieces is not None:
        # an id for each megabyte of text at most
        ids = F.broadcast(pieces.select("doc_id").distinct())
        in_a, in_b = (ids.select(F.col("doc_id").alias(c), F.lit(True).alias(f"long_{c}")) for c in "ab")
        told = pairs.join(in_a, "a", "left").join(in_b, "b", "left").withColumn("long", F.coalesce("long_a", "long_b", F.lit(False)))
        rest, long = (materialize(told.where(c).select("a", "b"), "told") for c in (~F.col("long"), F.col("long")))
        return _confirmed(rest, docs, percent).unionByName(_confirmed_long(long, docs, pieces, percent))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # their texts are found without moving all others, as long as a table of the ids fits: counted, not guessed
    ids = materialize(ids, "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = materialize(_sets(docs.join(wanted, "doc_id", "left_semi")).select("doc_id", "s"), "sets")
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    counted = met.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    linked = 100 * F.col("i") >= percent * (F.col("t") - F.col("i"))
    # a repeated id with several texts links when any of them does
    return counted.groupBy("a", "b").agg(F.max(linked).alias("linked"))


def _apart(known: DataFrame, sketches: DataFrame, coordinates: int, percent: int, chunk: int) -> DataFrame:
    """Pairs (a, b) of classes that share a bucket, lie in different components and are alike in size and sketch.

    ``known`` has (h, cid, n, label).  Classes of a bucket's largest component don't meet one another, and a bucket is cut into groups of
    at most about ``chunk`` classes on either side; so neither a hot component nor a hot bucket is one task, and every pair that matters meets.
    """
    several = known.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    left = materialize(known.join(several, "h").join(sketches, "cid").select("h", "cid", "n", "label", "sketch"), "open")
    counts = left.groupBy("h", "label").agg(F.count("*").alias("c"))
    tops = counts.groupBy("h").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("top"))
    cut = tops.select("h", "top", F.ceil((F.col("all") - F.col("most")) / chunk).cast("int").alias("px"), F.ceil(F.col("all") / chunk).cast("int").alias("py"))
    placed = left.join(cut, "h")
    part = F.xxhash64("cid", F.lit(17))
    few, every = F.pmod(part, "px").cast("int"), F.pmod(part, "py").cast("int")
    x = placed.where("label <> top").select("h", few.alias("i"), F.explode(F.sequence(F.lit(0), F.col("py") - 1)).alias("j"), F.col("cid").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("sketch").alias("ka"))
    y = placed.select("h", F.explode(F.sequence(F.lit(0), F.col("px") - 1)).alias("i"), every.alias("j"), F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("sketch").alias("kb"), (F.col("label") == F.col("top")).alias("main"))
    # a link needs sizes within the threshold of one another
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    met = x.join(y, ["h", "i", "j"]).where((F.col("la") != F.col("lb")) & (F.col("main") | (F.col("a") < F.col("b"))) & sizes & _agree("ka", "kb", coordinates, AGREE))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, first_bands: int = FIRST_BANDS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_shingles, cid) of documents with words, and (node, label) of the linked classes."""
    docs = pick(docs, ["doc_id", "text"])
    docs, pieces = _split(docs)
    signed = materialize(signatures(docs, bands, rows, pieces), "signatures")
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("cid"))
    owned = signed.select("doc_id", "digest", "n_shingles").join(classes, "digest")
    own = signed.join(classes, (signed.digest == classes.digest) & (signed.doc_id == classes.cid), "left_semi")
    own = own.select(F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"), "bands", "sketch")
    placed = own.select("cid", "n", F.posexplode("bands").alias("band", "h"))
    heads = placed.groupBy("h").agg(F.min("cid").alias("head"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = materialize(placed.join(heads, "h"), "buckets")
    sketches = own.select("cid", "sketch")

    def links(pairs: DataFrame, alike: bool = True) -> DataFrame:
        return materialize(_confirmed(materialize(_alike(pairs, sketches, bands * rows) if alike else pairs, "alike"), docs, percent, pieces), "links")

    def labelled(linked: DataFrame) -> DataFrame:
        label = connected_components(linked).select(F.col("node").alias("cid"), "label")
        return members.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))

    pair = [F.col("head").alias("a"), F.col("cid").alias("b")]
    first = links(members.where(F.col("band") < first_bands).where("cid <> head").select(*pair).distinct())
    # then the heads of all buckets, for classes that these left out of the head's component
    known = labelled(first.where("linked").select("a", "b"))
    own_head = known.where("cid = head").select("h", F.col("label").alias("head_label"))
    second = known.where(F.col("band") >= first_bands).join(own_head, "h").where("label <> head_label").select(*pair).distinct()
    seen = first.unionByName(links(second.join(first.select("a", "b"), ["a", "b"], "left_anti")))
    # last, whatever shares a bucket in different components
    apart = _apart(labelled(seen.where("linked").select("a", "b")), sketches, bands * rows, percent, chunk)
    seen = seen.unionByName(links(apart.join(seen.select("a", "b"), ["a", "b"], "left_anti"), alike=False))
    return owned, connected_components(seen.where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Defined cases: a null or blank text has no shingle and is linked with nothing; a null doc_id keeps its row, counts
    no shingles and is never linked; repeated rows give repeated results, and equal texts are always linked; ties are settled by the
    smallest doc_id; an empty table gives no row; further columns are ignored, whatever their names.
    """
    owned, labels = components(docs, percent, bands, rows)
    per_doc = owned.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("doc_id", "n_shingles", F.coalesce("label", "cid").alias("c"))
    per_doc = per_doc.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("c").alias("c"))
    joined = pick(docs, ["doc_id"]).join(per_doc, "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return joined.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


#: The same result for DuckDB, over all pairs that share a shingle.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as i from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 70 * greatest(a.n, b.n) group by all),
l as (select a, b from p where 100 * i >= 70 * (na + nb - i)),
g as (select a, b from l union all select b, a from l),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, g.b from reach join g on reach.b = g.a)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, c.component_id = s.doc_id as kept
from s join (select a, min(b) as component_id from reach group by a) c on c.a = s.doc_id
"""
