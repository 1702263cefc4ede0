"""Interval algebra on half-open ranges [start, end) of a document: joins, merging and pruning.

Every join has the document as its equality key and, so that one long document doesn't meet itself as a whole, a bin of its offsets as a
second: a range lies in each bin it touches, and a pair is reported in the bin of its later start only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters in a bin.
BIN = 1024


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_range: tuple[str, str], b_range: tuple[str, str], width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of rows of one document whose ranges overlap.  The four range columns must have different names."""
    x, y = _binned(a, *a_range, width), _binned(b, *b_range, width)
    later = F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width)
    meet = (F.col(a_range[0]) < F.col(b_range[1])) & (F.col(b_range[0]) < F.col(a_range[1])) & (F.col("__bin") == later)
    pairs = x.join(y, [key, "__bin"]).where(meet).drop("__bin")
    if how == "inner":
        return pairs
    return a.join(pairs.drop(*[c for c in a.columns if c not in (key, *a_range)]), [key, *a_range], how)


def stab_join(points: DataFrame, ranges: DataFrame, key: str, point: str, ranged: tuple[str, str], width: int = BIN) -> DataFrame:
    """Points with the ranges that contain them."""
    x = points.withColumn("__bin", F.floor(F.col(point) / width))
    y = _binned(ranges, *ranged, width)
    return x.join(y, [key, "__bin"]).where((F.col(ranged[0]) <= F.col(point)) & (F.col(point) < F.col(ranged[1]))).drop("__bin")


def contains_join(outer: DataFrame, inner: DataFrame, key: str, outer_range: tuple[str, str], inner_range: tuple[str, str], width: int = BIN) -> DataFrame:
    """Pairs in which the outer range contains the whole inner one."""
    y = inner.withColumn("__bin", F.floor(F.col(inner_range[0]) / width))
    x = _binned(outer, *outer_range, width)
    return x.join(y, [key, "__bin"]).where((F.col(outer_range[0]) <= F.col(inner_range[0])) & (F.col(inner_range[1]) <= F.col(outer_range[1]))).drop("__bin")


def merge_overlaps(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Unions of properly overlapping ranges; ranges that only touch stay apart."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order))
    return island.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def prune_overlaps(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Greedy choice by (start, end): a range stays if it begins at or after the end of the last one that stayed.

    One pass over sorted ranges; nothing of a document is gathered.
    """
    from pyspark.sql.types import StructType

    own = df.select(key, start, end)

    def chosen(batches):
        import pyarrow as pa

        last, reach = object(), None  # of the document at hand: it may go on in the next batch
        for batch in batches:
            keep = []
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                stays = k != last or a >= reach
                if stays:
                    last, reach = k, b
                keep.append(stays)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return own.repartition(F.col(key)).sortWithinPartitions(key, start, end).mapInArrow(chosen, StructType(own.schema.fields))


def asof(points: DataFrame, marks: DataFrame, key: str, point: str, mark: str, values: list[str]) -> DataFrame:
    """Each point with the values of the last mark at or before it: one union and a window, linear in both sides."""
    left = points.select(*[F.col(c) for c in points.columns], F.col(point).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    right = marks.select(F.col(key), F.col(mark).alias("__at"), F.lit(0).alias("__kind"), F.struct(*values).alias("__v"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__kind = 1")
    return seen.select(*points.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def classify(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Match gold and predicted ranges (key, id, start, end) of each document.

    By the number of predictions that a gold range overlaps: none, ``golden_only``; one, ``precise`` when equal and ``overlap`` otherwise; more,
    ``multimatch`` for each pair and ``golden_in_multimatches`` once.  A prediction without gold range is ``prediction_only``, one with several
    is ``prediction_in_multimatches``.  Ranges that begin after their end are ``degenerate``.  Returns (key, gold_id, pred_id, category).

    The pairs are joined once: either side's ranges are added to them, and the degrees are counts over windows.
    """
    gold_type, pred_type = gold.schema["id"].dataType, predicted.schema["id"].dataType
    no_gold, no_pred = F.lit(None).cast(gold_type), F.lit(None).cast(pred_type)
    g = gold.where("start <= end").select(key, F.col("id").alias("gold_id"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    p = predicted.where("start <= end").select(key, F.col("id").alias("pred_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    same = (F.col("g_start") == F.col("p_start")) & (F.col("g_end") == F.col("p_end"))
    pairs = overlap_join(g, p, key, ("g_start", "g_end"), ("p_start", "p_end")).select(key, "gold_id", "pred_id", same.alias("same"))
    own_gold = g.select(key, "gold_id", no_pred.alias("pred_id"), F.lit(False).alias("same"))
    met = pairs.unionByName(own_gold).withColumn("n_pred", F.count("pred_id").over(Window.partitionBy(key, "gold_id")))
    own_pred = p.select(key, no_gold.alias("gold_id"), "pred_id", F.lit(False).alias("same"), F.lit(0).cast("long").alias("n_pred"))
    # rows of gold ranges alone have no prediction: they are told apart, so that they aren't one group
    by_pred = Window.partitionBy(key, "pred_id", F.when(F.col("pred_id").isNull(), F.col("gold_id")))
    every = met.unionByName(own_pred).withColumn("n_gold", F.count("gold_id").over(by_pred))
    pair, of_gold = F.col("gold_id").isNotNull() & F.col("pred_id").isNotNull(), F.col("pred_id").isNull()
    category = (
        F.when(pair, F.when(F.col("n_pred") > 1, "multimatch").when(F.col("same"), "precise").otherwise("overlap"))
        .when(of_gold, F.when(F.col("n_pred") == 0, "golden_only").when(F.col("n_pred") > 1, "golden_in_multimatches"))
        .otherwise(F.when(F.col("n_gold") == 0, "prediction_only").when(F.col("n_gold") > 1, "prediction_in_multimatches"))
    )
    out = every.select(key, "gold_id", "pred_id", category.alias("category")).where("category is not null")
    bad_gold = gold.where("start > end").select(key, F.col("id").alias("gold_id"), no_pred.alias("pred_id"), F.lit("degenerate").alias("category"))
    bad_pred = predicted.where("start > end").select(key, no_gold.alias("gold_id"), F.col("id").alias("pred_id"), F.lit("degenerate").alias("category"))
    return out.unionByName(bad_gold).unionByName(bad_pred)


def overlap_report(gold: DataFrame, predicted: DataFrame, key: str, documents: DataFrame, text: str) -> DataFrame:
    """(key, gold_id, pred_id, gold_range, pred_range, gold_text, pred_text) of pairs that overlap without being equal, with both passages."""
    pairs = classify(gold, predicted, key).where("category = 'overlap'")
    g = gold.select(key, F.col("id").alias("gold_id"), F.struct("start", "end").alias("gold_range"))
    p = predicted.select(key, F.col("id").alias("pred_id"), F.struct("start", "end").alias("pred_range"))
    cut = lambda r: F.substr(F.col(text), F.col(r)["start"] + 1, F.col(r)["end"] - F.col(r)["start"])
    both = pairs.join(g, [key, "gold_id"]).join(p, [key, "pred_id"]).join(documents.select(key, text), key)
    return both.select(key, "gold_id", "pred_id", "gold_range", "pred_range", cut("gold_range").alias("gold_text"), cut("pred_range").alias("pred_text"))


def annotations_by_source(annotations: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, uri, target_uri, start, end): annotations with the ranges of their targets, by document; a missing target or a repeated IRI raises."""
    ranged = targets.select(F.col("uri").alias("target_uri"), "source", "start", "end", F.lit(True).alias("__known"))
    joined = annotations.select("uri", "target_uri").join(ranged, "target_uri", "left").withColumn("__n", F.count("*").over(Window.partitionBy("uri")))
    bad = F.when(F.col("__known").isNull(), F.concat(F.lit("no target "), F.coalesce("target_uri", F.lit("null")))).when(F.col("__n") > 1, F.concat(F.lit("repeated "), F.col("uri")))
    return joined.withColumn("source", F.when(bad.isNotNull(), F.raise_error(F.coalesce(bad, F.lit("")))).otherwise(F.col("source"))).select("source", "uri", "target_uri", "start", "end")


def minimize(ranges: DataFrame, invisible: DataFrame, key: str, parity: bool = False) -> DataFrame:
    """Shrink ranges (key, id, start, end) past invisible ones (key, i_start, i_end, disjoint).

    A start in an invisible range moves to its last point, an end in one to its begin; with ``parity`` the start moves one further, to the
    range's exclusive end.
    """
    hit = invisible.select(key, "i_start", "i_end")
    s = stab_join(ranges.select(key, "id", "start"), hit, key, "start", ("i_start", "i_end")).groupBy(key, "id").agg((F.max("i_end") - (0 if parity else 1)).alias("to_start"))
    e = stab_join(ranges.select(key, "id", "end"), hit, key, "end", ("i_start", "i_end")).groupBy(key, "id").agg(F.min("i_start").alias("to_end"))
    joined = ranges.join(s, [key, "id"], "left").join(e, [key, "id"], "left")
    return joined.select(key, "id", F.coalesce("to_start", "start").alias("start"), F.coalesce("to_end", "end").alias("end"))


def length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))
