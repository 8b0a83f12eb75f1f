"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Anchors and candidates are dealt to the cells of a grid; a cell holds a bounded number of each. Its anchor-candidate
tiles are multiplied by Strassen's recursion on 64-bit integers, padded with zeros, so scores are exact. A first
pass keeps each anchor's best rows of its own label, a second one each positive's best rows of other labels inside
its window of scores. Both keep a heap of k rows per anchor or positive; heaps of tiles and cells merge into one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ratebook.llm.common import stored

#: Rows of a tile's two sides, and the most rows that a cell of the grid gets of each.
TILE = (512, 2048)
CELL = (2048, 16384)
_FEWEST = 1024
_LONG = np.iinfo(np.int64)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 16) -> np.ndarray:
    """a @ b by seven products of half the size, until a side is ``leaf`` or less; odd sides are padded with zeros.

    64-bit sums wrap around and come back, so every entry that fits into 64 bits is exact.
    """
    n, d, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, d, m) <= leaf:
        return a @ b
    if n % 2 or d % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, d % 2)))
        b = np.pad(b, ((0, d % 2), (0, m % 2)))
        return strassen(a, b, leaf)[:n, :m]
    i, k, j = n // 2, d // 2, m // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((n, m), a.dtype)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b; sums beyond 64 bits are taken in long integers and end at the limits."""
    bound = a.shape[1] * int(max(abs(int(a.max())), abs(int(a.min())))) * int(max(abs(int(b.max())), abs(int(b.min())))) if a.size and b.size else 0
    if bound < 1 << 62:
        return strassen(a, np.ascontiguousarray(b.T))
    exact = strassen(a.astype(object), b.T.astype(object))
    return np.clip(exact, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def merged(k: int, *heaps: np.ndarray) -> np.ndarray:
    """One heap of heaps: the first k entries per owner by falling score, then id, then row.

    An entry is a row (owner, score, id, row).
    """
    x = np.concatenate(heaps)
    x = x[np.lexsort((x[:, 3], x[:, 2], -x[:, 1].astype(object) if len(x) and x[:, 1].min() == _LONG.min else -x[:, 1], x[:, 0]))]
    starts = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]]) if len(x) else np.zeros(0, np.int64)
    return x[np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)])) < k]


def _best(k: int, s: np.ndarray, fits: np.ndarray, owner: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The heap of one tile: of each line of s its best k columns among those that fit. Columns are in order of id and row."""
    if s.shape[1] > k:
        low = np.where(fits, s, _LONG.min)
        border = np.partition(low, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above = fits & (s > border)
        tied = fits & (s == border)
        fits = above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k))
    i, j = np.nonzero(fits)
    return merged(k, np.column_stack([owner[i], s[i, j], ids[j], rows[j]]))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    return x


_NO_ENTRIES = np.zeros((0, 4), np.int64)


def _tiles(left: pd.DataFrame, right: pd.DataFrame):
    """(anchors, candidates, scores) tile by tile; candidates in order of id and row."""
    right = right.sort_values(["vec_id", "row"], ignore_index=True)
    width = max((len(v) for side in (left, right) for v in side["q"]), default=0)
    for i in range(0, len(left), TILE[0]):
        a = left[i:i + TILE[0]]
        x = _matrix(a["q"], width)
        for j in range(0, len(right), TILE[1]):
            b = right[j:j + TILE[1]]
            yield a, b, scores(x, _matrix(b["q"], width))


def _positive_heaps(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        heap = _NO_ENTRIES
        for a, b, s in _tiles(left, right):
            fits = (a["label"].to_numpy()[:, None] == b["label"].to_numpy()) & (a["row"].to_numpy()[:, None] != b["row"].to_numpy())
            heap = merged(k, heap, _best(k, s, fits, a["row"].to_numpy(), b["vec_id"].to_numpy(), b["row"].to_numpy()))
        return pd.DataFrame(heap, columns=["anchor", "score", "id", "row"])

    return run


def _window_heaps(k: int, low: int, high: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[int, np.ndarray] = {}
        for a, b, s in _tiles(left, right):
            other = a["label"].to_numpy()[:, None] != b["label"].to_numpy()
            for slot in range(max((len(p) for p in a["positives"]), default=0)):
                has = np.array([len(p) > slot for p in a["positives"]])
                held = [int(p[slot]) for p, there in zip(a["positives"], has) if there]
                # 100 score >= low positive and <= high positive, without leaving 64 bits.
                least = np.array([max(_LONG.min, min(_LONG.max, -(-low * p // 100))) for p in held], np.int64)
                most = np.array([max(_LONG.min, min(_LONG.max, high * p // 100)) for p in held], np.int64)
                t = s[has]
                fits = other[has] & (t >= least[:, None]) & (t <= most[:, None])
                found = _best(k, t, fits, a["row"].to_numpy()[has], b["vec_id"].to_numpy(), b["row"].to_numpy())
                heaps[slot] = merged(k, heaps.get(slot, _NO_ENTRIES), found)
        out = [pd.DataFrame(h, columns=["anchor", "score", "id", "row"]).assign(slot=slot) for slot, h in heaps.items()]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["anchor", "score", "id", "row", "slot"], dtype="int64")

    return run


def _first(df: DataFrame, k: int, *owner: str) -> DataFrame:
    """Heaps of all cells merged: the first k per owner, with their rank."""
    order = W.partitionBy(*owner).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(x: Column, scale: int) -> Column:
    """floor(scale * x) as a 64-bit integer; what lies beyond its range takes its ends."""
    return F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, scale: int = 256, positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, cell: tuple[int, int] = CELL) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each positive's hard negatives.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` and ``label`` are expressions over them. Scores are
    inner products of the components times ``scale``, floored; a shorter vector is padded with zeros. An anchor's
    positives are its first rows of the same label, a positive's negatives the first rows of another label whose
    score is between ``low`` and ``high`` per cent of its own; ties go by vec_id. Every anchor meets every row.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; an empty vector
    scores 0 with all. Rows equal in id, label and vector count once; others that share an id are rows of their
    own, and of an anchor's repeats with other content each is another row. Anchors without positives and
    positives without negatives give no row; neither does an empty table. Extra columns aren't read.
    """
    v = F.col("embedding")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                    F.transform(v, lambda x: quantised(x, scale)).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .where("label IS NOT NULL").dropDuplicates(["vec_id", "label", "q"]))
    # Row numbers must not change when a task runs again, so they are given to the table as it is written.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "hard-negative-rows")
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tall = max(1, math.ceil(size["anchors"] / cell[0]))
    wide = max(1, math.ceil(size["n"] / cell[1]), min(math.ceil(parts / tall), math.ceil(size["n"] / _FEWEST)))

    def dealt(column: str, count: int, others: str, other_count: int) -> list[Column]:
        """The row's own line of cells, and a copy for each cell of that line."""
        return [F.pmod(F.xxhash64("row"), F.lit(count)).alias(column),
                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_count - 1).cast("long"))).alias(others)]

    candidates = rows.select("row", "vec_id", "label", "q", *dealt("wide", wide, "tall", tall))
    anchors = rows.where("anchor").select(*(F.col(c).alias(c) for c in ("row", "vec_id", "label", "q")))

    def met(left: DataFrame, run, schema: str) -> DataFrame:
        left = left.select("*", *dealt("tall", tall, "wide", wide))
        return left.groupBy("tall", "wide").cogroup(candidates.groupBy("tall", "wide")).applyInPandas(run, schema)

    found = _first(met(anchors, _positive_heaps(positives), "anchor long, score long, id long, row long"), positives, "anchor")
    found = stored(found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                (F.col("rank") - 1).cast("long").alias("slot")), "positives")
    held = found.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    windows = met(anchors.join(held, "row"), _window_heaps(negatives, low, high), "anchor long, score long, id long, row long, slot long")
    best = _first(windows, negatives, "anchor", "slot")
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (best.join(found, ["anchor", "slot"]).join(names, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
