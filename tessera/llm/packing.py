"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens (a longer one is cut, the short piece first). Packing
needs only how many pieces there are of each length, at most ``capacity`` numbers whatever the input's size:

1. Take the longest length left. Its gap is looked up among the sums of one, two and three lengths that are
   still available (a hash index of sums per gap); a combination that fills the gap exactly is consumed as
   often as the counts allow.
2. What has no exact complement goes to best fit: a sequence opened by the longest piece is filled with the
   longest length that still fits, again and again, and the same filling is repeated as often as counts allow.

The result is a bounded table of runs: "of length l, the pieces ranked r .. r+m-1 go to sequences s .. s+m-1 at
offset o". A piece's rank among those of its length is its place in its task plus the pieces of that length in
earlier tasks (a window over one row per task and length), so a length that a third of all pieces share is
never brought together. Pieces with their ids are written once to the shared folder; the plan is made from the
written table, so reruns of tasks cannot shift ranks.

Edge cases: null text is empty (only the end id), a repeated document is packed as often as it comes, null ids
stay null, an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.encode import coder

CAPACITY = 1024


def pieces(docs: DataFrame, vocabulary: str, kind: str = "bytes", end_id: int | None = 2,
           capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian u32), task, place (among the task's pieces of that
    length). Written to the shared folder."""

    def cut_up(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task, code, seen = TaskContext.get().partitionId(), coder(vocabulary, kind), defaultdict(int)
        for batch in batches:
            out = defaultdict(list)
            for key, ids in zip(batch.column(0).to_pylist(), code.documents(batch.column(1), end_id)):
                n = len(ids)
                cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out["doc_id"].append(key)
                    out["piece"].append(i)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids"].append(ids[a:b].astype("<u4").tobytes())
                    out["task"].append(task)
                    out["place"].append(seen[b - a])
                    seen[b - a] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    import pyarrow as pa
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("task", pa.int64()), ("place", pa.int64())])
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut_up, "doc_id long, piece int, start long, length long, ids binary, task long, place long")
    return cut(made, "pack-pieces", codec="zstd")


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, how often) that use up ``counts``: exact complements, then best fit.

    Small pieces spent early on exact triples can be missing for the last large ones, so the plan is made with
    complements of at most one, two and three lengths and the shortest is taken."""
    return min((_combinations(counts, capacity, most) for most in (1, 2, 3)), key=lambda p: sum(n for _, n in p))


def _combinations(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] += n
    sizes = np.flatnonzero(have)
    sums: dict[int, list[int]] = defaultdict(list)          # pair sum -> larger lengths, descending
    for a in sizes[::-1].tolist() if most > 1 else ():
        for b in sizes[(sizes <= a) & (sizes + a < capacity)].tolist():
            sums[a + b].append(a)
    out: list[tuple[tuple[int, ...], int]] = []

    def pair(gap: int, used: tuple[int, ...]):
        """An available pair of lengths with this sum, beside the lengths already used."""
        for a in sums.get(gap, ()):
            if have[a] > used.count(a) and have[gap - a] > used.count(gap - a) + (a == gap - a):
                return a, gap - a
        return None

    def complement(first: int, parts: int):
        """``first`` and exactly ``parts`` lengths that fill its gap."""
        gap = capacity - first
        if parts == 1:
            return (first,) if gap == 0 else (first, gap) if have[gap] > (gap == first) else None
        if parts == 2:
            two = pair(gap, (first,))
            return (first, *two) if two else None
        for c in sizes[(sizes < gap) & (have[sizes] > 0)][::-1].tolist():
            if have[c] > (c == first):
                two = pair(gap - c, (first, c))
                if two and two[0] <= c:
                    return first, c, *two
        return None

    def consume(lengths: tuple[int, ...]):
        times = min(int(have[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            have[x] -= times
        out.append((lengths, times))

    for parts in range(1, most + 1):
        for first in sizes[::-1].tolist():
            while have[first]:
                found = complement(first, parts)
                if not found:
                    break
                consume(found)
    while have.any():
        first = int(np.flatnonzero(have)[-1])
        filling, gap, left = [first], capacity - first, have.copy()
        left[first] -= 1
        while gap:
            fit = np.flatnonzero(left[:gap + 1])
            if not len(fit):
                break
            best = int(fit[-1])
            times = min(int(left[best]), gap // best)
            filling += [best] * times
            left[best] -= times
            gap -= best * times
        consume(tuple(filling))
    return out


def runs(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """The plan as runs, sorted by (length, rank)."""
    used, rows, sequence = defaultdict(int), [], 0
    for lengths, times in combinations(counts, capacity):
        offset = 0
        for x in lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def assign(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (see ``pieces``) with sequence_id and offset."""
    per_task = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(per_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-ranks")
    counts = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = made.sparkSession.sparkContext.broadcast(runs(counts, capacity))
    ranked = made.join(first.drop("n"), ["task", "length"]).withColumn("rank", F.col("first") + F.col("place"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd
        p = plan.value
        bits = np.int64(1) << 40                              # rank below 2**40 pieces of one length
        at = np.searchsorted(p["length"] * bits + p["rank"], length.to_numpy() * bits + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": p["sequence"][at] + rank.to_numpy() - p["rank"][at], "offset": p["offset"][at]})

    place_type = place("length", "rank")
    out = ranked.withColumn("__p", place_type)
    return out.select(*[c for c in made.columns if c not in ("task", "place")],
                      F.col("__p.sequence_id").alias("sequence_id"), F.col("__p.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary) of every sequence; a sequence holds at most ``capacity`` tokens."""
    return (packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
