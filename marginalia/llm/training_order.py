"""Training-order materialisation: token sequences in fixed-stride shards, in the order of a keyed permutation.

Every sequence has a number: its place in its partition of the input, after all that earlier partitions could hold.  A balanced Feistel network on the
smallest even number of bits that holds the bound of these numbers, with cycle-walking back into the range, permutes them; a sequence's global slot is its
rank in the permuted order.  Tasks take ranges of permuted numbers, whole shards each, so texts are tokenized once: how many sequences there are need not be known
before the first is written.  A shard is a file of records of one stride, of about as many slots as asked for, and the manifest names the first slot of each, so a
reader finds slot s of the shard that begins at slot f at byte (s - f) * stride and can resume anywhere.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, pick, shared_path, small
from marginalia.llm.tokens import default_path, encoder

#: Tokens of a record, bytes of a token and records of a shard.
SEQUENCE, WIDTH, SHARD_SLOTS = 512, 2, 8192
END_ID, PAD = 1, b"\0"
MANIFEST = "manifest.json"
KEY, ROUNDS = 0x5EED_0F_0DDE5, 6
#: Tasks that write: with more shards than that each takes several in turn, one open at a time.
WRITERS = 50_000


def feistel(index, n: int, key: int = KEY, rounds: int = ROUNDS):
    """The slots of an array of numbers below n: a permutation of 0 to n - 1."""
    import numpy as np

    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [(key + (r + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1) for r in range(rounds)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            z = (right + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        x = once(np.asarray(index, dtype=np.uint64))
        out = np.flatnonzero(x >= n)
        while len(out):
            x[out] = once(x[out])
            out = out[x[out] >= n]
    return x.astype(np.int64)


def _records(ids: bytes, sequence: int, width: int, end: bytes) -> list[bytes]:
    """The 32-bit ids with the end id, cut to records of narrower ids (unpadded)."""
    import numpy as np

    wide = np.frombuffer(ids + end, dtype="<u4")
    narrow = wide.astype(f"<u{width}").tobytes()
    return [narrow[i : i + sequence * width] for i in range(0, len(narrow), sequence * width)]


def _bounds(docs: DataFrame, sequence: int) -> tuple[dict[int, int], int]:
    """How many sequences each partition of the input holds at most, and about how many there are in all.

    A token covers a byte at least of the normalised text, which has at most three bytes for each of the original's.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    most = F.floor((3 * size + 1 + sequence - 1) / sequence)
    rows = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(most).alias("most"), F.sum(F.ceil((size / 4 + 1) / sequence)).alias("about")).collect()  # a row per task
    return {r.part: r.most for r in rows}, sum(r.about for r in rows)


def write_shards(docs: DataFrame, path: str | None = None, out: str | None = None, sequence: int = SEQUENCE, width: int = WIDTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, stable: bool = False) -> DataFrame:
    """Write the shards and return their index: slot, shard, byte_offset, doc_id, chunk, n_tokens, ids_crc32.

    ``stable`` says that the input is a plain scan of files, whose partitions are the same whenever it is read; otherwise it is first written
    out.  A task writes its shards under temporary names and renames them when whole, so a repeated or lost task leaves the same files; names that a
    lost one left behind are removed at the end.  The files go to ``out``, by default a new folder in the shared one.

    Defined cases: a null or empty text is one record of its end id; null ids and repeated rows are written each; long texts take as many
    records as they need, in slots of their own; an empty table gives no shard and no row; further columns are ignored.
    """
    spark = docs.sparkSession
    path = path or default_path()
    out = out or shared_path(spark, "shards")
    docs = pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not stable:
        docs = materialize(docs, "ordered")
    bounds, about = _bounds(docs, sequence)
    first, total = {}, 0
    for part in sorted(bounds):
        first[part] = total
        total += bounds[part]
    end, shards = END_ID.to_bytes(4, "little"), max(1, -(-about // shard_slots))
    span = max(1, -(-total // shards))  # permuted numbers of a shard

    def placed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of, at = encoder(path), first.get(part, 0)
        stop = at + bounds.get(part, 0)
        for batch in batches:
            rows = [(d, k, r) for d, text in zip(batch.column(0).to_pylist(), batch.column(1)) for k, r in enumerate(_records(ids_of.encode(text.as_py()), sequence, width, end))]
            if at + len(rows) > stop:
                raise RuntimeError("the input's partitions changed between two readings")
            order = feistel(np.arange(at, at + len(rows)), total, key) if rows else np.array([], dtype=np.int64)
            at += len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(order), pa.array(order // span), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                ["order", "shard", "doc_id", "chunk", "ids"],
            )

    def written(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(out)
        system.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        file, name, shard, place, stride = None, "", -1, 0, sequence * width

        def close() -> None:
            if file is not None:
                file.close()
                system.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")

        for batch in batches:
            records, places = batch.column(4).to_pylist(), []
            for own, record in zip(batch.column(1).to_pylist(), records):
                if own != shard:
                    close()
                    shard, place, name = own, 0, f"shard-{own:08d}.bin"
                    file = system.open_output_stream(f"{folder}/.{name}.{attempt}")
                file.write(record.ljust(stride, PAD))
                places.append(place)
                place += 1
            columns = [batch.column(1), pa.array(places, pa.int64()), batch.column(2), batch.column(3), pa.array([len(r) // width for r in records], pa.int64()), pa.array(list(map(zlib.crc32, records)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "place", "doc_id", "chunk", "n_tokens", "ids_crc32"])
        close()

    each = -(-shards // WRITERS)  # consecutive shards of a task
    ranged = docs.mapInArrow(placed, "order long, shard long, doc_id long, chunk long, ids binary").repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int"))
    index = materialize(ranged.sortWithinPartitions("order").mapInArrow(written, "shard long, place long, doc_id long, chunk long, n_tokens long, ids_crc32 long"), "index")
    # a row per shard, of two numbers: the manifest, which every reader needs
    firsts, n = [], 0
    for r in index.groupBy("shard").count().orderBy("shard").collect():
        firsts.append((r.shard, n))
        n += r["count"]
    if not firsts:
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, doc_id long, chunk long, n_tokens long, ids_crc32 long")
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(out)
    for left in system.get_file_info(fs.FileSelector(folder)):
        if left.base_name.startswith(".shard-"):
            system.delete_file(left.path)
    with system.open_output_stream(f"{folder}/.manifest") as f:
        f.write(json.dumps({"sequence": sequence, "width": width, "slots": n, "shards": firsts}).encode())
    system.move(f"{folder}/.manifest", f"{folder}/{MANIFEST}")
    begins = small(spark.createDataFrame(firsts, "shard long, first long"))
    return index.join(begins, "shard").select((F.col("first") + F.col("place")).alias("slot"), "shard", (F.col("place") * (sequence * width)).alias("byte_offset"), "doc_id", "chunk", "n_tokens", "ids_crc32")


def read_slots(folder: str, first: int, count: int):
    """Records of consecutive slots as an array of ids, read by seeking: what a resumed trainer does."""
    import numpy as np
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    sequence, width, shards = manifest["sequence"], manifest["width"], manifest["shards"]
    stop, rows = min(first + count, manifest["slots"]), []
    at = bisect.bisect_right([s[1] for s in shards], first) - 1
    while first < stop:
        shard, begin = shards[at]
        take = min(stop, shards[at + 1][1] if at + 1 < len(shards) else stop) - first
        with system.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek((first - begin) * sequence * width)
            rows.append(np.frombuffer(f.read(take * sequence * width), dtype=f"<u{width}").reshape(-1, sequence))
        first, at = first + take, at + 1
    return np.concatenate(rows) if rows else np.zeros((0, sequence), dtype=f"<u{width}")
