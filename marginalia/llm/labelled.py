"""Labelled documents to learn from: all of them, or bounded deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import pick

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 12_000


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo a divisor; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def known(labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """(doc_id, y) of all labelled ids that aren't held out.  Ids whose labels contradict one another, and null labels, teach nothing."""
    found = pick(labels, ["doc_id", label]).where(f"doc_id is not null and {label} in (0, 1)").where(remainder(divisor) != held_out)
    return found.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").drop("z")


def sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, per_class: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled rows of each class that aren't held out.

    The rows are those first by a hash of the id: the same on each run, and spread over the table.  Of several texts with one id the least by
    code points teaches.
    """
    ids = known(labels, label, divisor, held_out)
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class ids of two numbers: well under a megabyte
    return pick(docs, ["doc_id", "text"]).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
