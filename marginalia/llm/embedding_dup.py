"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are made unit vectors and turned to their principal axes, so that the leading coordinates hold most of every inner product.
Each belongs to the tile of its nearest centre.  Unit vectors with cosine c are sqrt(2 - 2c) apart, so a vector that lies farther than
that from the plane midway between its centre and another one has no link in the other tile and isn't sent there.  Two tiles are compared in
blocks of bounded size: the product of the leading coordinates plus that of the suffix norms bounds the cosine, and only for pairs whose bound
reaches the threshold are further coordinates accumulated, in double precision, until the bound falls below it or the product is whole.

Equal vectors are one class from the start.  A pair of blocks returns each vector's number of links and the root of its linked group, never the
links themselves.  Neither the centres nor the sizes change the result: what is skipped has no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import connected_components, materialize, pick

COSINE = 0.9
#: Bytes of one side of a block comparison, at most about this many; and the tiles that a small table is still cut into.
BLOCK_BYTES, LEAST_TILES = 16 << 20, 8
#: Tiles at most, and vectors for each that the centres are fitted on: the sample is bounded, the result doesn't depend on it.
TILES, SAMPLE_PER_TILE = 256, 64
#: Rows and columns of the inner products that are in memory at once.
STRIP = 1024
#: Shares of the coordinates after which the bound is taken: the first in single precision for all pairs, the rest for what is left.
STEPS = (0.375, 0.625)
#: Room for rounding in the bounds; the last word is the whole product in double precision.
SINGLE, DOUBLE = 1e-5, 1e-9

KEYED = "vec_id long, print binary, unit binary"


def units(x):
    """Rows made unit vectors; by their largest component first, so that no square overflows or vanishes."""
    import numpy as np

    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def _cleaned(batches: Iterator) -> Iterator:
    """(vec_id, digest of the vector, unit vector) of rows with an id and a finite vector that isn't zero."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        known = np.array([i.is_valid for i in ids], dtype=bool) if ids.null_count else np.ones(len(ids), dtype=bool)
        by_width: dict[int, list[int]] = {}
        lengths = column.value_lengths().to_pylist()
        for k, n in enumerate(lengths):
            if n and known[k]:
                by_width.setdefault(n, []).append(k)
        out_ids, prints, rows = [], [], []
        for width, places in by_width.items():
            values = column.take(pa.array(places)).flatten()
            x = np.asarray(values.fill_null(float("nan")), dtype=float).reshape(-1, width) + 0.0  # -0.0 and 0.0 are equal
            sound = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[sound]
            out_ids += [ids[k].as_py() for k, ok in zip(places, sound) if ok]
            prints += [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
            rows += [r.tobytes() for r in units(x)] if len(x) else []
        yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(rows, pa.binary())], ["vec_id", "print", "unit"])


def _matrix(column, width: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=float).reshape(-1, width)


def _axes(vectors: DataFrame, width: int):
    """Principal axes of all unit vectors (columns, the widest first) from per-partition second moments, and their number."""
    import numpy as np

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, mean, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += x.T @ x
            mean += x.sum(0)
            n += len(x)
        values = np.concatenate([total.ravel(), mean, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "v"])

    rows = vectors.select("unit").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # width^2 + width + 1 numbers
    values = np.zeros(width * width + width + 1)
    for r in rows:
        values[r.at] = r.v
    total, mean, n = values[: width * width].reshape(width, width), values[width * width : -1], int(values[-1])
    _, axes = np.linalg.eigh(total / max(1, n) - np.outer(mean, mean) / max(1, n) ** 2)
    return axes[:, ::-1].copy(), n


def centres(sample, tiles: int, rounds: int = 6):
    """Distinct centres of about ``tiles`` groups of the sample: farthest-first starts, then means of the nearest."""
    import numpy as np

    if len(sample) <= 1 or tiles <= 1:
        return sample[:1] if len(sample) else np.zeros((1, sample.shape[1]))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    draw = np.random.default_rng(5)
    while len(chosen) < tiles and far.max() > 1e-9:
        chosen.append(int(draw.choice(len(sample), p=far / far.sum())))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    c = sample[chosen]
    for _ in range(rounds):
        own = (-2 * sample @ c.T + (c**2).sum(1)).argmin(1)
        c = np.array([sample[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
    return np.unique(c, axis=0)


def reached(x, c, cosine: float):
    """The tile of each unit vector, and a mask of the tiles in which it may have links."""
    import numpy as np

    far = (c**2).sum(1) - 2 * x @ c.T  # squared distances but for what all share
    own = far.argmin(1)
    between = np.sqrt(np.maximum(0.0, (c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1)[None, :]))
    plane = (far - far[np.arange(len(x)), own][:, None]) / np.maximum(2 * between[own], 1e-12)
    mask = plane <= np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    mask[np.arange(len(x)), own] = True
    return own, mask


def compare(a, b, same: bool, cosine: float = COSINE, steps: tuple[float, ...] = STEPS, strip: int = STRIP):
    """Linked index pairs of two blocks of turned unit vectors, strip by strip: arrays (i, j); within one block only i < j."""
    import numpy as np

    width = a.shape[1]
    cuts = sorted({max(1, min(width, round(s * width))) for s in steps} | {width})
    ends = [[np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts] for x in (a, b)]
    # the suffix norm is one more coordinate: a single product gives the bound of every pair
    lead = [np.ascontiguousarray(np.c_[x[:, : cuts[0]], e[0]], dtype=np.float32) for x, e in zip((a, b), ends)]
    for i0 in range(0, len(a), strip):
        for j0 in range(i0 if same else 0, len(b), strip):
            bound = lead[0][i0 : i0 + strip] @ lead[1][j0 : j0 + strip].T
            at = np.flatnonzero(bound.ravel() >= cosine - SINGLE)
            if not len(at):
                continue
            if len(at) > bound.size // 8:  # a crowded strip: the whole product at once
                whole = a[i0 : i0 + strip] @ b[j0 : j0 + strip].T
                i, j = np.nonzero(whole >= cosine)
                i, j = i0 + i, j0 + j
            else:
                i, j = i0 + at // bound.shape[1], j0 + at % bound.shape[1]
                s, start = np.zeros(len(i)), 0
                for k, stop in enumerate(cuts):
                    s = s + np.einsum("ij,ij->i", a[i, start:stop], b[j, start:stop])
                    keep = s + ends[0][k][i] * ends[1][k][j] >= cosine - DOUBLE if stop < width else s >= cosine
                    i, j, s, start = i[keep], j[keep], s[keep], stop
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def join_roots(root, u, v) -> None:
    """Merge the groups of linked pairs: ``root`` has the smallest member of each one's group, flat before and after."""
    import numpy as np

    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root[:] = up


def links(vectors: DataFrame, cosine: float = COSINE, block_bytes: int = BLOCK_BYTES, tiles: int = TILES) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links) and edges (a, b) that connect the linked, of rows (vec_id, copies, unit): distinct unit vectors of any width."""
    import numpy as np

    spark = vectors.sparkSession
    # vectors of the most frequent width are turned and tiled; those of any other are one tile each width
    common = vectors.groupBy(F.length("unit").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = common.w // 8 if common else 1
    main = vectors.where(F.length("unit") == 8 * width)
    axes, n = _axes(main, width)
    most = max(64, block_bytes // (8 * width))
    n_tiles = max(1, min(tiles, max(min(LEAST_TILES, n // 64), -(-n // most))))
    picked = main.orderBy(F.xxhash64("vec_id")).limit(n_tiles * SAMPLE_PER_TILE).select("unit").collect() if n else []
    middles = centres(np.frombuffer(b"".join(bytes(r.unit) for r in picked), dtype=float).reshape(-1, width) @ axes, n_tiles)
    count = len(middles)

    def turned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw = batch.column(2).to_pylist()
            own, cells, rows = np.zeros(len(raw), dtype=np.int64), [[-len(r)] for r in raw], list(raw)
            at = np.array([k for k, r in enumerate(raw) if len(r) == 8 * width], dtype=np.int64)
            if len(at):
                x = np.frombuffer(b"".join(raw[k] for k in at), dtype=float).reshape(-1, width) @ axes
                tile, mask = reached(x, middles, cosine)
                own[at] = tile
                for k, t, m, r in zip(at.tolist(), tile.tolist(), mask, x):
                    cells[k] = [min(t, o) * count + max(t, o) for o in np.flatnonzero(m).tolist()]
                    rows[k] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(cells, pa.list_(pa.int64())), pa.array(rows, pa.binary())], ["vec_id", "copies", "own", "cells", "unit"])

    placed = materialize(vectors.select("vec_id", "copies", "unit").mapInArrow(turned, "vec_id long, copies long, own long, cells array<long>, unit binary"), "turned")
    second = (F.col("cell") >= 0) & (F.floor(F.col("cell") / count) != F.col("own"))
    sides = placed.select(F.explode("cells").alias("cell"), "own", F.length("unit").alias("w")).groupBy("cell", second.alias("second")).agg(F.count("*").alias("n"), F.max("w").alias("w"))
    # at most tiles * (tiles + 1) rows, and one for each other width
    held: dict[int, list[int]] = {}
    for r in sides.collect():
        held.setdefault(r.cell, [0, 0])[r.second] = -(-r.n // max(64, block_bytes // r.w))
    parts = []
    for cell, (a, b) in held.items():
        alone = cell < 0 or cell // count == cell % count
        if alone or (a and b):
            parts.append((cell, a, a if alone else b, alone))
    table = spark.createDataFrame(parts or [(0, 0, 0, True)], "cell long, pa int, pb int, alone boolean")
    sent = placed.select("vec_id", "copies", "own", "unit", F.explode("cells").alias("cell")).join(F.broadcast(table), "cell").withColumn("second", second)
    hashed = F.xxhash64("vec_id")
    sent = sent.withColumn("part", F.when(F.col("second"), F.pmod(hashed, F.col("pb"))).otherwise(F.pmod(hashed, F.col("pa"))).cast("int"))
    sent = sent.where("pa > 0 and pb > 0").withColumn("q", F.explode(F.sequence(F.lit(0), F.when(F.col("second"), F.col("pa")).otherwise(F.col("pb")) - 1)))
    low = F.when(F.col("alone"), F.least("part", "q")).when(F.col("second"), F.col("q")).otherwise(F.col("part"))
    high = F.when(F.col("alone"), F.greatest("part", "q")).when(F.col("second"), F.col("part")).otherwise(F.col("q"))
    met = sent.select("cell", low.alias("p"), high.alias("q"), "alone", "second", "part", "vec_id", "copies", "unit")

    def compared(key, group):
        import pyarrow as pa

        _, p, q = (k.as_py() for k in key)
        ids, copies = np.asarray(group["vec_id"]), np.asarray(group["copies"]).astype(float)
        x = _matrix(group["unit"], len(group["unit"][0].as_py()) // 8)
        order = np.argsort(ids, kind="stable")  # roots are the smallest places, so the smallest ids
        ids, copies, x = ids[order], copies[order], x[order]
        if group["alone"][0].as_py():
            part = np.asarray(group["part"])[order]
            left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        else:
            other = np.asarray(group["second"].combine_chunks().cast(pa.int8()))[order]
            left, right = np.flatnonzero(other == 0), np.flatnonzero(other == 1)
        same = p == q and group["alone"][0].as_py()
        degree, root = np.zeros(len(ids)), np.arange(len(ids))
        for i, j in compare(x[left], x[left] if same else x[right], same, cosine):
            u, v = left[i], left[j] if same else right[j]
            degree += np.bincount(u, copies[v], len(ids)) + np.bincount(v, copies[u], len(ids))
            join_roots(root, u, v)
        hit = np.flatnonzero(degree)
        return pa.Table.from_arrays([pa.array(ids[hit]), pa.array(degree[hit].astype(np.int64)), pa.array(ids[root[hit]])], ["a", "n", "b"])

    found = materialize(met.groupBy("cell", "p", "q").applyInArrow(compared, "a long, n long, b long"), "cosine-links")
    return found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links")), found.where("a <> b").select("a", "b")


def embedding_near_duplicates(vectors: DataFrame, cosine: float = COSINE, block_bytes: int = BLOCK_BYTES, tiles: int = TILES) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Defined cases: null, empty and zero vectors and those with null or non-finite components link with nothing; very small and very large
    components count like any other; vectors meet only those of their own width; equal vectors are linked with one another; a null vec_id keeps
    its row without links; repeated ids share a component and the sum of their links; an empty table gives no row; labels and further columns are ignored.
    """
    own = pick(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    keyed = materialize(own.mapInArrow(_cleaned, KEYED), "vectors")
    classes = keyed.groupBy("print").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
    distinct = materialize(keyed.join(classes, "print").where("vec_id = cid").dropDuplicates(["print"]).select("vec_id", "copies", "unit"), "distinct")
    degrees, edges = links(distinct, cosine, block_bytes, tiles)
    labels = connected_components(edges)
    by_class = classes.join(degrees.withColumnRenamed("vec_id", "cid"), "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    by_class = by_class.select("print", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("label", "cid").alias("c"))
    per_id = keyed.select("vec_id", "print").join(by_class, "print").groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    component = F.coalesce("c", "vec_id")
    return own.select("vec_id").join(per_id, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


#: The same result for DuckDB: every pair of distinct vectors, components by repeated least labels.
ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0 and list_bool_and([x is not null and isfinite(x) for x in embedding])),
u as (select vec_id, list_transform(e, lambda x: x / m) as e from (select vec_id, e, list_max([abs(x) for x in e]) as m from v) where m > 0),
n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum([y * y for y in e]))) as e from u),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) >= 0.9),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, l.b from reach join l on reach.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, c.component_id, c.component_id = e.vec_id as kept
from embeddings e join (select a, min(b) as component_id from reach group by a) c on c.a = e.vec_id
"""
