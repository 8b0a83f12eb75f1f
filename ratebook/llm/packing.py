"""Best-fit packing by bin completion.

How full a sequence gets depends on lengths alone, and lengths are at most the capacity. So the fillings are
searched over the histogram of lengths (at most ``capacity`` rows, whatever the table's size): around the
largest length left, the undominated completions are enumerated largest first, branches that can't leave less
waste than the incumbent are pruned, and the best-fit completion is the first incumbent. A filling is
repeated as often as its lengths last. Best-fit decreasing over the whole histogram is the incumbent of the whole: the
packing of fewer sequences is taken. Rows then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ratebook.llm.common import bounded_batches, stored
from ratebook.llm.tokens import encoder

#: Branches looked at per filling before its incumbent is taken (None: all). Search effort only: every piece is packed.
EFFORT = 2_000


def complete(counts: np.ndarray, room: int, effort: int | None = EFFORT) -> list[int]:
    """Lengths, longest first, that fill ``room`` best from ``counts`` (by length); longer ones win ties.

    Best fit gives the incumbent. A branch takes the longest length that fits, then the next shorter; it is
    cut where even its room filled to the last token wastes no less than the incumbent, or where what is left
    of the lengths is too little. An exact single completion is taken at once: it dominates every other.
    """
    have = np.flatnonzero(counts[:room + 1])[::-1]
    have = have[have > 0]
    if not len(have):
        return []
    if have[0] == room:
        return [room]
    left = counts
    best: list[int] = []
    rest = room
    for size in have.tolist():  # best fit: as many as fit of each length, from the longest
        k = min(int(left[size]), rest // size)
        best += [size] * k
        rest -= size * k
        if rest < int(have[-1]):
            break
    waste = rest
    if not waste:
        return best
    tail = np.cumsum((have * left[have])[::-1])[::-1]
    sizes, looked = have.tolist(), 0
    stack = [(room, 0, ())]  # room left, first length allowed, lengths taken with their numbers
    while stack and waste and (effort is None or looked < effort):
        space, i, taken = stack.pop()
        looked += 1
        used = dict(taken)
        if space and left[space] > used.get(space, 0) and space <= (sizes[i] if i < len(sizes) else 0):
            best = [s for s, k in (*taken, (space, 1)) for _ in range(k)]
            return sorted(best, reverse=True)
        if space < waste:
            waste, best = space, [s for s, k in taken for _ in range(k)]
        while i < len(sizes) and sizes[i] > space:
            i += 1
        if i == len(sizes) or space - int(tail[i]) >= waste:
            continue
        size = sizes[i]
        stack.append((space, i + 1, taken))  # without this length, looked at last
        for k in range(1, min(int(left[size]), space // size) + 1):
            stack.append((space - k * size, i + 1, (*taken, (size, k))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, how often) by best-fit decreasing. Sequences of one content are one entry, so a length is dealt at
    once: the tightest sequences that it fits take as many of it as fit, then the next tighter ones."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted((k for k, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in by_room if r >= size), default=None)
            if room is None:
                held, times, room = (), n, capacity
            else:
                held, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            k = room // size
            full = min(times, n // k)
            if full:
                by_room.setdefault(room - k * size, []).append(((*held, *[size] * k), full))
            n -= full * k
            rest = min(n, k - 1) if full < times else 0
            if rest:
                by_room.setdefault(room - rest * size, []).append(((*held, *[size] * rest), 1))
                n -= rest
            if held and times - full - bool(rest):
                by_room.setdefault(room, []).append((held, times - full - bool(rest)))
    return [(list(held), times) for entries in by_room.values() for held, times in entries]


def fillings(counts: dict[int, int], capacity: int, effort: int | None = EFFORT) -> list[tuple[list[int], int]]:
    """(lengths, how often) covering the histogram exactly: bin completion, or best fit where that takes fewer."""
    found, plain = completions(counts, capacity, effort), best_fit(counts, capacity)
    return found if sum(n for _, n in found) <= sum(n for _, n in plain) else plain


def completions(counts: dict[int, int], capacity: int, effort: int | None = EFFORT) -> list[tuple[list[int], int]]:
    """(lengths, how often) by completing the largest length left, again and again."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out = []
    for size in range(capacity, 0, -1):
        while left[size]:
            left[size] -= 1
            rest = complete(left, capacity - size, effort)
            left[size] += 1
            filling = [size, *rest]
            need = np.bincount(filling, minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((left[used] // need[used]).min())
            left[used] -= times * need[used]
            out.append((filling, times))
    return out


def places(counts: dict[int, int], capacity: int, effort: int | None = EFFORT) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, first sequence, per sequence, offset): where the ranks of a length go."""
    out, taken, first = [], dict.fromkeys(counts, 0), 0
    for filling, times in fillings(counts, capacity, effort):
        offset = 0
        for size in dict.fromkeys(filling):
            k = filling.count(size)
            out.append((size, taken[size], taken[size] + k * times, first, k, offset))
            taken[size] += k * times
            offset += k * size
        first += times
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with their end id, cut only above the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, False)
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, enc.kind)
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            columns = zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows) if rows else [()] * 5,
                          (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, values, kind in columns})

    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, shard_rows: int = 100_000, effort: int | None = EFFORT) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Ranks within a length are found in two steps, so that a length with a third of all rows isn't ranked in
    one task: rows are ranked within (length, shard), and shard sizes are summed up. The table of places has a
    few rows a length and is joined as one array a length, ``capacity`` rows at most. Equal rows share a
    shard and take different ranks. An empty table stays empty.
    """
    spark = pieces.sparkSession
    kept = stored(pieces, "pieces")
    shards = max(1, -(-kept.count() // shard_rows)) * 16
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    sizes = kept.groupBy("length", "shard").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = places(counts, capacity, effort)
    of_length = (spark.createDataFrame(rows, "length long, lo long, hi long, first long, per long, at long")
                 .groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "per", "at"))).alias("spots")))
    bases = sizes.select("length", "shard", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = (kept.withColumn("r", F.row_number().over(W.partitionBy("length", "shard").orderBy("doc_id", "start")) - 1)
              .join(bases, ["length", "shard"]).withColumn("rank", F.col("base") + F.col("r"))
              .join(F.broadcast(of_length), "length"))
    spot = ranked.withColumn("s", F.filter("spots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0])
    q = F.col("rank") - F.col("s.lo")
    return spot.select(
        *pieces.columns, (F.col("s.first") + F.floor(q / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + q % F.col("s.per") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, effort: int | None = EFFORT) -> DataFrame:
    """Every document as pieces with a place; null texts are empty and hold the end id alone; extra columns are not read."""
    return pack(pieces(docs, vocabulary, end_id, capacity), capacity, effort=effort)
