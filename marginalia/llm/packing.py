"""Best-fit packing of documents into fixed-length training sequences by bin completion.

Token lengths are whole numbers up to the capacity, so the packing problem is fully described by how many pieces have
each length: a table of at most ``capacity`` rows, whatever the corpus.  The driver solves that table by bin completion
and the pieces are then matched with the planned places by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import in_batches, local_table, materialize, pick
from marginalia.llm.tokens import default_path, encoder

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
#: Fillings that the search branches on around the largest piece, the fullest; and how many it looks at to find them.
WIDTH, LOOKED_AT = 4, 60
#: Steps of the search after the first incumbent, for each length that occurs.  It ends sooner at the lower bound, where nothing is left to gain.
STEPS_PER_LENGTH = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, pos long"
#: The widest plan has a few thousand patterns of a few lengths; the ranges of places are broadcast, bounded by this.
Pattern = tuple[tuple[int, ...], int]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document, in order: only documents longer than the capacity are cut."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        ids_of, end, part, pos = encoder(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), part, pos))
                    pos += 1
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "pos"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pieces, PIECES, tokenizes=True)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing on the table of lengths: each piece goes to the sequence with the least room that holds it.

    Sequences of equal contents are moved together, so the steps grow with the number of lengths, not of pieces.
    """
    rooms: dict[int, list[Pattern]] = {}  # room -> patterns that leave it, and how many sequences have them
    open_: list[int] = []  # the rooms that some sequence has, in order

    def leave(room: int, pattern: tuple[int, ...], times: int) -> None:
        if not rooms.setdefault(room, []):
            bisect.insort(open_, room)
        rooms[room].append((pattern, times))

    for n in sorted(counts, reverse=True):
        count = counts[n]
        while count:
            at = bisect.bisect_left(open_, n)
            if at == len(open_):  # nothing holds it: open sequences, each filled with as many as it takes
                most = capacity // n
                if count >= most:
                    leave(capacity - most * n, (n,) * most, count // most)
                if count % most:
                    leave(capacity - count % most * n, (n,) * (count % most), 1)
                break
            room = open_[at]
            pattern, times = rooms[room].pop()
            if not rooms[room]:
                del open_[at]
            used = min(count, times)
            if times > used:
                leave(room, pattern, times - used)
            leave(room - n, (*pattern, n), used)
            count -= used
    return [p for patterns in rooms.values() for p in patterns]


def fillings(room: int, left: list[int], width: int = WIDTH, looked_at: int = LOOKED_AT) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with pieces of which ``left[n]`` have length n, the fullest first.

    A filling is dominated if a piece still fits beside it, or if one of its pieces can be swapped for a larger one that fits: whatever
    the other leaves over packs no worse.  A single piece that fits exactly dominates all others.  They are enumerated largest piece first,
    which makes the best-fit filling the first; a branch that can't waste less than the ``width`` best so far is left.
    """
    if room <= 0:
        return [()]
    if left[room]:
        return [(room,)]
    lengths = [n for n in range(room, 0, -1) if left[n]]
    if not lengths:
        return [()]
    found: list[tuple[int, tuple[int, ...]]] = []
    seen = 0

    def free(n: int, chosen: list[int]) -> bool:
        return left[n] > chosen.count(n)

    def dominated(chosen: list[int], waste: int) -> bool:
        if any(n <= waste and free(n, chosen) for n in lengths[::-1][: len(chosen) + 1]):
            return True
        return any(free(n, chosen) for p in set(chosen) for n in range(p + 1, p + waste + 1))

    def extend(chosen: list[int], rest: int, start: int) -> None:
        nonlocal seen
        grown = False
        for at in range(start, len(lengths)):
            n = lengths[at]
            if n > rest or not free(n, chosen):
                continue
            if seen >= looked_at or (len(found) >= width and found[-1][0] == 0):
                return
            grown = True
            chosen.append(n)
            extend(chosen, rest - n, at)
            chosen.pop()
        if not grown:
            seen += 1
            if not (len(found) >= width and rest >= found[-1][0]) and not dominated(chosen, rest):
                found.append((rest, tuple(chosen)))
                found.sort(key=lambda f: f[0])
                del found[width:]

    extend([], room, 0)
    return [f for _, f in found] or [()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH, steps_per_length: int = STEPS_PER_LENGTH) -> list[Pattern]:
    """Patterns of lengths and how often each is used, so that every piece has a place in as few sequences as found.

    Best fit gives the incumbent; if it meets the lower bound, nothing can be better.  Else depth-first bin completion: the largest piece left is
    completed by its undominated fillings, the fullest first; a pattern is used as often as its lengths last, so a step empties a length and the
    depth doesn't grow with the corpus.  A branch is cut when its waste leaves no room for fewer sequences than the incumbent.  The search ends
    at the lower bound or after ``steps_per_length`` steps for each length, and the incumbent stands, at most as far from the bound as best fit.
    """
    best = best_fit(counts, capacity)
    fewest = sum(times for _, times in best)
    total = sum(n * c for n, c in counts.items())
    bound = max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    used = waste = 0
    steps = steps_per_length * len(counts)
    done: list[Pattern] = []

    def options(largest: int) -> list[Pattern]:
        top = next((n for n in range(largest, 0, -1) if left[n]), 0)
        if not top:
            return []
        left[top] -= 1
        ways = fillings(capacity - top, left, width)
        left[top] += 1
        made = [(top, *way) for way in ways]
        return [(p, min(left[n] // p.count(n) for n in set(p))) for p in made][::-1]

    stack = [options(capacity)]
    while stack and fewest > bound and steps > 0:
        if stack[-1]:
            pattern, times = stack[-1].pop()
            lost = times * (capacity - sum(pattern))
            steps -= 1
            if total + waste + lost > (fewest - 1) * capacity:
                continue
            done.append((pattern, times))
            used, waste = used + times, waste + lost
            for n in pattern:
                left[n] -= times
            stack.append(options(pattern[0]))
            if not stack[-1] and used < fewest:
                best, fewest = list(done), used
            continue
        stack.pop()
        if done:
            pattern, times = done.pop()
            used, waste = used - times, waste - times * (capacity - sum(pattern))
            for n in pattern:
                left[n] += times
    return best


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of these ranks take that place in consecutive sequences."""
    rows, rank, first = [], {}, 0
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            r = rank.get(n, 0)
            rows.append((n, r, r + times, first, at))
            rank[n] = r + times
            at += n
        first += times
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is its end id alone; a null doc_id keeps its rows; repeated rows are packed each;
    ties between equal lengths are settled by the order of the input's partitions; an empty table gives no row; further columns are ignored.
    """
    cut_ = materialize(cut(pick(docs, ["doc_id", "text"]), path or default_path(), capacity, end_id), "pieces")
    # rank within a length in two levels, so that a length that a third of all pieces share is never in one task
    counted = cut_.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counted.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r.length: r.n for r in cut_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = places(plan(counts, capacity))
    ranges = local_table(docs.sparkSession, rows, "length long, lo long, hi long, first long, offset long")
    ranked = cut_.withColumn("k", F.row_number().over(Window.partitionBy("length", "part").orderBy("pos")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    placed = ranked.join(F.broadcast(ranges), "length").where("rank >= lo and rank < hi")
    sequence = (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset")
