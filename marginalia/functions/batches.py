"""Python functions over Arrow batches: what goes in and what comes out is bounded, whatever the number of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Bytes of rows after which a batch for a Python function ends; Spark's own bound is 64 MB, of which rows of Python objects take many times as much.
BATCH_BYTES = 4 << 20
#: Rows and characters of a result after which a batch of it ends; a longer row is a batch of its own.
ROWS, CHARACTERS = 16_384, 4 << 20


def in_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size; a longer row is a batch of its own.  A bound that the session sets stands.

    A worker waits for further tasks, so it gives back what batches took when the function ends.
    """

    def released(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from function(batches)
        pa.default_memory_pool().release_unused()

    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(released, schema)
