"""From raw documents to packed training sequences: every stage applies one operator of ``marginalia.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it back from Parquet.  All but the last
return the columns of ``documents``.  Models are fitted on the labelled rows of the raw ``documents`` table, so that what
one stage removes can still teach the next.

What holds for all stages: further columns stay as they are, whatever their names (a user's ``score``, ``shard`` or ``position`` among them);
an empty table gives an empty one of the same columns; texts of any length count whole.  The rest is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import packing
from marginalia.llm import quality as quality_model
from marginalia.llm import toxicity as toxicity_model
from marginalia.llm.common import materialize, pick, table
from marginalia.llm.mixing import mixed
from marginalia.llm.near_dup import near_duplicates

#: No SQL expresses learned scores or a packing search; tests compare the stages with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the threshold.

    A null text is scored as an empty one; null ids and repeated rows are judged like any other, each for itself; equal texts share their fate.
    """
    model = quality_model.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality_model.scored(docs, model)
    return pick(scored.where(F.col(scored.columns[-1]) >= quality_model.THRESHOLD), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below the threshold.

    A null or empty text holds no evidence and stays; null ids and repeated rows are judged like any other, each for itself.
    """
    model = toxicity_model.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity_model.scored(docs, model)
    return pick(scored.where(F.col(scored.columns[-1]) < toxicity_model.THRESHOLD), docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Null and blank texts are linked with nothing and stay; rows without an id stay, as they can't be told apart.  Rows that repeat an id and its text
    are one document: of those that differ elsewhere, the least by their columns as JSON stays.  Different texts of one kept id all stay.
    """
    ids = materialize(near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("__rows")), "kept-ids")
    single = docs.join(ids.where("__rows = 1").select("doc_id"), "doc_id", "left_semi")
    several = pick(docs.join(ids.where("__rows > 1").select("doc_id"), "doc_id", "left_semi"), docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = several.groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select("__row.*")
    return pick(single, docs.columns).unionByName(least).unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them: a partition for each shard, in the order of its positions.

    Null and blank texts have no words and are never drawn; null sources are one source; repeated rows are documents of their own; null ids are
    mixed like any other.
    """
    return pick(mixed(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; null ids and repeated rows are packed each; only documents longer than a sequence are cut.
    """
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", deduplicate), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
