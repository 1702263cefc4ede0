"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports it.  Intermediate results that are
read more than once are cut from their lineage by writing them as Parquet to
the folder that the cluster names in ``spark.checkpoint.dir``: every executor
can read that folder, so a lost executor never loses them.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII capitals and the six ASCII white-space characters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set only where the session names none and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, on storage that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    if path := df.__dict__.get("_written"):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Letters outside ASCII that might have a lower case of their own.
_OTHER_CAPITALS = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Nd}\p{Z}]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and all else as it is; ``lower`` is many times faster than ``translate`` and equal where no other capital occurs."""
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def words(text: Column, lower: bool = False) -> Column:
    """The runs of characters other than space and U+0009 to U+000D, as an array; null gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(ascii_lower(text) if lower else text, r"\s+"), "")


def bucket(*columns: Column, n: int) -> Column:
    """A stable bucket number from 0 to n - 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node that it reaches.

    Alternates large-star and small-star contraction (Kiveris et al., 2014) until the edges stop changing, so the
    rounds grow with the logarithm of the longest path.  A hub's neighbours are never gathered: its minimum is a
    pre-aggregated ``min`` that is joined back.

    Returns (node, label) for every node with an edge to another node.
    """

    def stars(pairs: DataFrame, small: bool) -> DataFrame:
        # pairs hold (u, v) with u > v, once each
        if small:
            low = pairs.groupBy("u").agg(F.min("v").alias("m"))
            joined = pairs.join(low, "u")
            new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        else:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            new = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = new.unionByName(low.select("u", F.col("m").alias("v")))
        return new.where("u > v").distinct()

    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pairs = materialize(pairs, "cc")
    before = _signature(pairs)
    for _ in range(max_rounds):
        after = materialize(stars(stars(pairs, small=False), small=True), "cc")
        now = _signature(after)
        discard(pairs)
        pairs = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not converge")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that extra or clashing columns of an input never meet the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Rows of a table that is broadcast at most: some tens of megabytes of a few narrow columns.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows, counted; as it is, for a shuffle join, beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of rows that the driver made.

    As an Arrow table it is a local relation.  A list goes through Python workers of another kind than those of functions on columns: a further daemon
    and its workers then hold memory on every executor.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [[]] * len(types)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types), schema)


#: Bytes of rows after which a batch for a Python function ends.  Spark's own bound is 64 MB, of which the executor and its worker each hold copies and
#: keep the memory for the stages that follow.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, function: Callable, schema: StructType | str, tokenizes: bool = False) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size; a longer row is a batch of its own.  A bound that the session sets stands.

    A worker waits for further tasks, so it gives back what batches took when the function ends, and a function that doesn't tokenize first drops the
    encoders that tasks before it left.
    """

    def released(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if not tokenizes:
            from marginalia.llm.tokens import forget

            forget()
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(released, schema)


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, with as many underscores as it takes to differ from all taken names."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
