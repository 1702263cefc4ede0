"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

Documents of a source are hashed into blocks.  A source's target fixes its quota of block instances: whole copies of all its blocks, and one
more of those that a keyed permutation puts first, up to the block in which the target lies; of that one the documents count while they fit.
A tree over the output shards splits the exact quotas of every source in two, again and again, each time by a multivariate-hypergeometric
draw, down to how many instances each shard draws from each source.  Those are disjoint runs of the permutation; what the mix
takes of a document is the number of the shards' drawn instances that hold it.  A shard shuffles its rows locally.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import free_name, local_table, materialize, pick, small, words

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input, and the most that a source gives for each of its own.
SHARE, MOST = 1.5, 2.0
#: Documents in a block, on average.
BLOCK_DOCS = 128
#: Levels of the splitting tree, at least: two to that power output shards; and the words of a shard beyond which there are more.
LEVELS, SHARD_WORDS = 5, 1 << 25
#: Bits of the permutation's key that number its buckets: a source's blocks are ranked in so many tasks, not in one.
BUCKET_BITS = 10
SEED = 20_240


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) with each source's target.

    Sources by code point, null last, weigh ``weights`` in turn.  A target stops at ``most`` times the source's size and the excess
    goes to the rest by weight: in the order of size per weight, a source is full as long as its even share would exceed it.
    The table has a row per source; its windows run in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    one = sizes.withColumn("w", weigh).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("all", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    full = F.col("cap") <= level * F.col("w")
    # the first source that isn't full sets the level of all that follow
    one = one.withColumn("level", level).withColumn("open", F.when(~full, F.col("level")))
    held = F.first("open", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    return one.select("source", "source_size", "n_docs", F.when(held.isNull(), F.col("cap")).otherwise(F.least("cap", held * F.col("w"))).alias("target"))


def hypergeometric(draw: random.Random, good: int, bad: int, n: int) -> int:
    """Marked blocks among n drawn without replacement, by inverse transform from the mode.

    Probabilities follow from the mode's by the ratio of neighbours, out to where they are below 2^-80 of it: the law is exact
    to double precision at every size, in a number of steps that grows with the standard deviation.
    """
    total = good + bad
    if not total or not good or not n:
        return 0
    low, high = max(0, n - bad), min(n, good)
    mode = max(low, min(high, (n + 1) * (good + 1) // (total + 2)))
    weights, w, k = {mode: 1.0}, 1.0, mode
    while k < high and w > 2.0**-80:
        w *= (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))
        k += 1
        weights[k] = w
    w, k = 1.0, mode
    while k > low and w > 2.0**-80:
        w *= k * (bad - n + k) / ((good - k + 1) * (n - k + 1))
        k -= 1
        weights[k] = w
    at = draw.random() * math.fsum(weights.values())
    for k, w in weights.items():
        at -= w
        if at < 0:
            return k
    return mode


def split_tree(counts: dict, levels: int = LEVELS, seed: int = SEED) -> list[tuple]:
    """(source key, shard, first, end): the run of its drawn blocks that each shard gets of each source.

    Every node splits its whole vector of block counts: how many blocks go left is fixed by the node's size, and which
    sources they come from is a multivariate-hypergeometric draw, made source by source.
    """
    keys = sorted(counts)
    leaves: list[tuple] = []
    at = dict.fromkeys(keys, 0)

    def descend(node: dict, first: int, width: int) -> None:
        if width == 1:
            for k in keys:
                if node[k]:
                    leaves.append((k, first, at[k], at[k] + node[k]))
                    at[k] += node[k]
            return
        draw = random.Random(f"{seed}/{first}/{width}")
        rest = sum(node.values())
        to_draw = rest // 2
        left = {}
        for k in keys:
            left[k] = hypergeometric(draw, node[k], rest - node[k], to_draw)
            rest -= node[k]
            to_draw -= left[k]
        descend(left, first, width // 2)
        descend({k: node[k] - left[k] for k in keys}, first + width // 2, width // 2)

    descend(dict(counts), 0, 1 << levels)
    return leaves


def _quotas(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, levels: int | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """The rows' keys and sizes; figures of each source; of each drawn block its instances with their shards; the documents that fit of a cut block; the number of shards.

    The third has (s, block, placed, cut): ``placed`` lists (copy, shard) of every instance that a shard draws, ``cut`` says that the one
    beyond the whole copies gives some documents only.  The fourth has (s, k, d, m): so many of the rows with that key fit.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("k"))
    sized = materialize(sized, "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, most)
    base = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size") + 1e-12)).cast("int")
    sources = sources.withColumn("base", base).withColumn("extra", F.round(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))
    sources = materialize(sources.withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS)).withColumnRenamed("source", "s"), "sources")

    blocked = sized.where("size > 0").join(small(sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("k", "n_blocks"))
    key = F.xxhash64("block", F.lit(seed))
    blocks = blocked.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"), F.first("base").alias("base"))
    blocks = materialize(blocks.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKET_BITS)), "block-sizes")
    # the permutation orders blocks by bucket and key; ranks and running sums in two levels
    totals = blocks.groupBy("s", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    earlier, every = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("s")
    totals = totals.select(F.col("s").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.sum("n").over(every).alias("made"))
    within = Window.partitionBy("s", "bucket").orderBy("key", "block")
    ranked = blocks.withColumn("i", F.row_number().over(within) - 1).withColumn("sum", F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.join(totals, F.col("s").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).withColumn("rank", F.col("n0") + F.col("i"))
    # words that a block gives beyond the whole copies: all, none, or what the target still lacks
    gives = F.greatest(F.lit(0), F.least(F.col("words"), F.col("extra") - F.col("w0") - F.col("sum") + F.col("words")))
    ranked = materialize(ranked.select("s", "block", "words", "base", "rank", "made", gives.alias("gives")), "blocks")

    known = ranked.groupBy("s").agg(F.count("*").alias("n"), F.sum((F.col("gives") > 0).cast("long")).alias("d"), F.first("base").alias("base"), F.sum(F.col("words") * F.col("base") + F.col("gives")).alias("w")).collect()  # a row per source
    names = sorted(known, key=lambda r: (r.s is None, r.s or ""))
    quota = {i: r.base * r.n + r.d for i, r in enumerate(names)}
    if levels is None:
        levels = max(LEVELS, (-(-sum(r.w for r in names) // SHARD_WORDS) - 1).bit_length())
    # runs are found by source and bin: a bin is as wide as a source's mean run, so that a run lies in two or three
    wide = {i: max(1, q >> levels) for i, q in quota.items()}
    leaves = [(names[i].s, wide[i], shard, first, end) for i, shard, first, end in split_tree(quota, levels, seed)]
    runs = local_table(spark, leaves, "rs string, wide long, shard int, first long, end long") if leaves else spark.sql("select cast(null as string) rs, 1L wide, 0 shard, 0L first, 0L end where false")
    binned = runs.select("rs", "shard", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / F.col("wide")), F.floor((F.col("end") - 1) / F.col("wide")))).alias("rbin"))
    widths = local_table(spark, [(r.s, wide[i]) for i, r in enumerate(names)], "ws string, wide long") if names else spark.sql("select cast(null as string) ws, 1L wide where false")
    # instances: the copies of all blocks one after the other, in the order of the permutation, then the drawn ones
    instances = ranked.select("s", "block", "rank", "made", "base", "gives", "words", F.explode(F.sequence(F.lit(0), F.col("base"))).alias("copy")).where("copy < base or gives > 0")
    instances = instances.withColumn("instance", F.col("copy") * F.col("made") + F.col("rank")).join(small(widths), F.col("s").eqNullSafe(F.col("ws")))
    met = instances.withColumn("bin", F.floor(F.col("instance") / F.col("wide"))).join(small(binned), F.col("s").eqNullSafe(F.col("rs")) & (F.col("bin") == F.col("rbin")))
    cut = (F.col("copy") == F.col("base")) & (F.col("gives") < F.col("words"))
    placed = met.where("instance >= first and instance < end").groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("placed"), F.max(cut).alias("cut"), F.max("gives").alias("gives"))
    placed = materialize(placed, "placed")

    # at most one cut block a source, of some hundred documents: the largest first, each while it fits; equal rows count as one entry
    cuts = placed.where("cut").select(F.col("s").alias("cs"), F.col("block").alias("cb"), "gives")
    inside = blocked.join(small(cuts), F.col("s").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb"))).groupBy("s", "size", "k", "doc_id").agg(F.count("*").alias("n"), F.first("gives").alias("gives"))
    listed = inside.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("size", "k", "doc_id", "n")), asc=False).alias("all"), F.first("gives").alias("gives"))

    def fold(acc: Column, x: Column) -> Column:
        m = F.least(x["n"], F.floor(acc["room"] / x["size"]))
        return F.when(m > 0, F.struct((acc["room"] - m * x["size"]).alias("room"), F.concat(acc["got"], F.array(F.struct(x["k"].alias("k"), x["doc_id"].alias("d"), m.alias("m")))).alias("got"))).otherwise(acc)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    start = F.struct(F.col("gives").alias("room"), F.array().cast(f"array<struct<k:bigint,d:{id_type},m:bigint>>").alias("got"))
    fits = materialize(listed.select("s", F.explode(F.aggregate("all", start, fold)["got"]).alias("g")).select(F.col("s").alias("fs"), F.col("g.k").alias("fk"), F.col("g.d").alias("fd"), F.col("g.m").alias("m")), "fits")
    return sized, sources, placed, fits, 1 << levels


def _allotted(rows: DataFrame, sources: DataFrame, placed: DataFrame, fits: DataFrame) -> DataFrame:
    """``rows`` with (__source, __doc, __k, __full) and their figures, __same and __shards: the shards whose instances hold the row, by copy.

    A block is one key of the join, so that a hot source is spread over as many keys as it has blocks.
    """
    figures = sources.select(F.col("s").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("n_blocks").alias("__n"), F.col("base").alias("__base"))
    known = rows.join(small(figures), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__block", F.pmod("__k", "__n"))
    drawn = placed.select(F.col("s").alias("__ps"), F.col("block").alias("__pb"), F.col("placed").alias("__placed"), F.col("cut").alias("__cut"))
    joined = known.join(drawn, F.col("__source").eqNullSafe(F.col("__ps")) & (F.col("__block") == F.col("__pb")), "left")
    whole = F.when(F.col("__full") & F.col("__placed").isNotNull(), F.transform("__placed", lambda p: p["shard"])).otherwise(F.array().cast("array<int>"))
    plain = joined.where(~F.coalesce("__cut", F.lit(False))).withColumn("__same", F.lit(1)).withColumn("__shards", whole)
    # rows of a cut block: equal ones are told apart by number, as many as fit
    some = joined.where("__cut").withColumn("__same", F.row_number().over(Window.partitionBy("__source", "__k", "__doc").orderBy("__block")))
    some = some.join(small(fits), F.col("__source").eqNullSafe(F.col("fs")) & (F.col("__k") == F.col("fk")) & F.col("__doc").eqNullSafe(F.col("fd")), "left")
    held = F.filter("__placed", lambda p: (p["copy"] < F.col("__base")) | (F.col("__same") <= F.coalesce("m", F.lit(0))))
    some = some.withColumn("__shards", F.when(F.col("__full"), F.transform(held, lambda p: p["shard"])).otherwise(F.array().cast("array<int>")))
    return plain.unionByName(some.select(plain.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, shards (those that draw it, in the order of copies, joined by commas).

    Defined cases: a null text has size 0 and is never drawn; null sources are one source, the last; repeated rows are documents of
    their own; a source without words has the target 0; an empty table gives no row; further columns are ignored.
    The result depends on the rows and the seed only.
    """
    sized, *quotas, _ = _quotas(pick(docs, ["doc_id", "source", "text"]), weights, share, most, levels, seed)
    rows = sized.select(F.col("source").alias("__source"), F.col("doc_id").alias("__doc"), "size", F.col("k").alias("__k"), (F.col("size") > 0).alias("__full"))
    all_ = _allotted(rows, *quotas)
    return all_.select(F.col("__doc").alias("doc_id"), "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.size("__shards") * F.col("size")).alias("taken"), F.array_join("__shards", ",").alias("shards"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken: the input's columns, then ``mix_shard`` and ``mix_position``.

    A partition holds one shard, in the order of positions, which are a keyed hash.  Defined cases as in ``mix``; columns of the input keep their
    names and values, and where one is called like the operator's own, that one gets underscores until it is free.
    """
    _, *quotas, shards = _quotas(pick(docs, ["doc_id", "source", "text"]), weights, share, most, levels, seed)
    names = list(docs.columns)
    shard, position = free_name(names, "mix_shard"), free_name(names, "mix_position")
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "source", "text")}
    full = F.coalesce(at["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = own.select("*", at["source"].alias("__source"), at["doc_id"].alias("__doc"), F.xxhash64(at["doc_id"], at["text"], F.lit(seed)).alias("__k"), full.alias("__full"))
    chosen = _allotted(rows, *quotas).where(F.size("__shards") > 0).select(*own.columns, "__k", "__same", F.posexplode("__shards").alias("__copy", "__shard"))
    chosen = chosen.withColumn("__position", F.xxhash64("__k", "__same", "__copy", F.lit(seed + 1)))
    ordered = chosen.repartitionById(shards, F.col("__shard")).sortWithinPartitions("__position")
    return ordered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("__shard").alias(shard), F.col("__position").alias(position))
