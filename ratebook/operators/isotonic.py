"""Isotonic regression without a driver-sized model.

Points are cut into ranges of the prediction; adjacent violators are pooled within each range. Ranges are then
merged pairwise, level by level. Merging two monotone pieces makes one new block at most: the blocks of the left
piece above a value v and those of the right piece below it, where v is their common mean. That v is the root of a
falling function which sums over blocks give for many values at once, so it is bracketed by a few counting passes;
no block travels. The step function stays a table, one row per block, and is applied by ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.functions.columns import col
from ratebook.operators.splits import stored

#: Values at which the sums of a pass are taken, per pair of pieces.
SLICES = 64
#: Rows that one task orders along the step function; ranges with more are dealt to several tasks.
ROWS_PER_TASK = 1_000_000


def pooled(x: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first x, last x, sum, weight) of the blocks after pooling adjacent violators; x is in order."""
    first, last, sums, weights = [], [], [], []
    for a, b, c in zip(x.tolist(), s.tolist(), w.tolist()):
        lo = a
        while sums and sums[-1] * c >= b * weights[-1]:  # the mean before is not below this one
            lo = first.pop()
            last.pop()
            b += sums.pop()
            c += weights.pop()
        first.append(lo)
        last.append(a)
        sums.append(b)
        weights.append(c)
    return tuple(np.array(v, float) for v in (first, last, sums, weights))


@dataclass(frozen=True)
class Piece:
    """A block that spans ranges: it covers all that lies between its ends."""

    lo: float
    hi: float
    s: float
    w: float
    first: int
    last: int

    @property
    def v(self) -> float:
        return self.s / self.w


def _blocks(points: DataFrame, ranges: int) -> DataFrame:
    """(part, lo, hi, s, w, v) pooled within ranges of x; ``part`` numbers the ranges in order of x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = None, 0
        for pdf in batches:
            if len(pdf):
                part = int(pdf["part"].iloc[0])
                more = pooled(*(pdf[c].to_numpy() for c in ("x", "s", "w")))
                held = more if held is None else _append(held, more)
        if held is not None:
            lo, hi, s, w = held
            yield pd.DataFrame({"part": part, "lo": lo, "hi": hi, "s": s, "w": w, "v": s / w})

    dealt = points.repartitionByRange(ranges, "x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id())
    return dealt.mapInPandas(run, "part int, lo double, hi double, s double, w double, v double")


def _append(a: tuple, b: tuple) -> tuple:
    """Two runs of blocks, each monotone, as one: blocks of the second that violate are pooled into the first."""
    lo, hi, s, w = (list(v) for v in a)
    for k in range(len(b[0])):
        l, h, x, y = b[0][k], b[1][k], b[2][k], b[3][k]
        if s[-1] * y < x * w[-1]:  # from here on the second run is above the first
            return tuple(np.concatenate([np.array(p, float), q[k:]]) for p, q in zip((lo, hi, s, w), b))
        while s and s[-1] * y >= x * w[-1]:
            l = lo.pop()
            hi.pop()
            x += s.pop()
            y += w.pop()
        lo.append(l)
        hi.append(h)
        s.append(x)
        w.append(y)
    return tuple(np.array(v, float) for v in (lo, hi, s, w))


class _Merge:
    """The merge tree over ranges: what spans ranges is a short list here, all other blocks stay in their table."""

    def __init__(self, blocks: DataFrame, parts: list[int]):
        self.blocks, self.parts = blocks, parts
        self.pieces: list[Piece] = []
        self.passes = 0
        self.received = 0

    def _open(self) -> DataFrame:
        """Blocks that no piece covers. What a piece leaves of a range is one interval of it."""
        spark = self.blocks.sparkSession
        left = {p: [-math.inf, math.inf] for p in self.parts}
        for piece in self.pieces:
            for p in range(piece.first, piece.last + 1):
                if p in left:
                    if p == piece.first:
                        left[p][1] = min(left[p][1], piece.lo)
                    if p == piece.last:
                        left[p][0] = max(left[p][0], piece.hi)
                    if piece.first < p < piece.last:
                        left[p] = [math.inf, -math.inf]
        table = spark.createDataFrame([(p, a, b) for p, (a, b) in left.items()], "part int, _from double, _to double")
        return self.blocks.join(F.broadcast(table), "part").where("lo > _from AND hi < _to").drop("_from", "_to")

    def run(self) -> list[Piece]:
        level = 1
        while (1 << (level - 1)) <= max(self.parts, default=0):
            self._merge(level)
            level += 1
        return sorted(self.pieces, key=lambda p: p.lo)

    def _merge(self, level: int) -> None:
        half = 1 << (level - 1)
        group, right = F.shiftright("part", level), F.expr(f"(part & {half}) <> 0")
        rows = self._open().select(group.alias("g"), right.alias("right"), "v", "s", "w", "lo", "hi", "part")
        # The greatest value on the left and the least on the right decide whether a pair meets at all.
        ends: dict[int, list[float]] = {}
        found = rows.groupBy("g", "right").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()
        self._count(found)
        own = [(p.first >> level, bool(p.first & half), p) for p in self.pieces if p.first >> level == p.last >> level
               and bool(p.first & half) == bool(p.last & half)]
        for g, side, low, high in [(r["g"], r["right"], r["low"], r["high"]) for r in found] + [(g, side, p.v, p.v) for g, side, p in own]:
            e = ends.setdefault(g, [-math.inf, math.inf])
            if side:
                e[1] = min(e[1], low)
            else:
                e[0] = max(e[0], high)
        # The common mean lies between the least value on the right and the greatest on the left.
        open_ = {g: (low, high) for g, (high, low) in ends.items() if high >= low and math.isfinite(high) and math.isfinite(low)}
        if not open_:
            return
        root = self._roots(rows, {g: [p for q, _, p in own if q == g] for g in open_}, open_, half)
        spark = rows.sparkSession
        table = spark.createDataFrame([(int(g), float(v)) for g, v in root.items()], "g long, v0 double")
        taken = (F.col("right") & (F.col("v") <= F.col("v0"))) | (~F.col("right") & (F.col("v") >= F.col("v0")))
        sums = rows.withColumn("g", F.col("g").cast("long")).join(F.broadcast(table), "g").where(taken).groupBy("g").agg(
            F.sum("s").alias("s"), F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.min("part").alias("first"), F.max("part").alias("last")).collect()
        self._count(sums)
        new = {r["g"]: Piece(r["lo"], r["hi"], r["s"], r["w"], r["first"], r["last"]) for r in sums}
        for g, side, p in own:
            if g in root and (p.v <= root[g] if side else p.v >= root[g]):
                q = new.get(g)
                new[g] = p if q is None else Piece(min(p.lo, q.lo), max(p.hi, q.hi), p.s + q.s, p.w + q.w, min(p.first, q.first), max(p.last, q.last))
                self.pieces.remove(p)
        self.pieces += [p for p in new.values()]

    def _roots(self, rows: DataFrame, pieces: dict[int, list[Piece]], open_: dict[int, tuple[float, float]], half: int) -> dict[int, float]:
        """For each pair the value v at which the pull of the left blocks above it, the sum of w (value - v), balances
        that of the right blocks below it. The pull falls with v and bends only at blocks' values."""
        spark = rows.sparkSession
        out: dict[int, float] = {}
        while open_:
            edges = {g: np.unique(np.linspace(a, b, SLICES + 1)) for g, (a, b) in open_.items()}
            table = spark.createDataFrame([(int(g), [float(e) for e in v]) for g, v in edges.items()], "g long, edges array<double>")
            at = F.size(F.filter("edges", lambda e: e < F.col("v")))  # slice k is from edge k - 1, exclusive, to edge k
            sums = (rows.withColumn("g", F.col("g").cast("long")).join(F.broadcast(table), "g").groupBy("g", "right", at.alias("at"))
                    .agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
            self._count(sums)
            by: dict[int, list[tuple]] = {g: [] for g in edges}
            for r in sums:
                by[r["g"]].append((r["right"], r["at"], r["s"], r["w"], r["low"], r["high"]))
            for g, e in edges.items():
                by[g] += [(bool(p.first & half), int((e < p.v).sum()), p.s, p.w, p.v, p.v) for p in pieces[g]]
            narrower = {}
            for g, e in edges.items():
                pull = [sum(s - v * w for right, at_, s, w, _, _ in by[g] if (at_ <= k if right else at_ > k)) for k, v in enumerate(e)]
                k = next((i for i, p in enumerate(pull) if p <= 0), len(e) - 1)
                inside = {v for _, at_, _, _, low, high in by[g] if at_ == k for v in (low, high)}
                if k and len(inside) > 1 and e[k - 1] < (e[k - 1] + e[k]) / 2 < e[k]:
                    narrower[g] = (e[k - 1], e[k])
                else:
                    # The first edge is the least value on the right: with no pull there both sides only touch.
                    out[g] = self._balance(by[g], k, max(inside, default=e[k])) if k else float(e[0])
            open_ = narrower
        return out

    @staticmethod
    def _balance(sums: list[tuple], k: int, value: float) -> float:
        """The root within slice k, in which ``value`` is the only value that blocks have."""

        def mean(*sides: bool) -> float:
            some = [(s, w) for right, at, s, w, _, _ in sums if (at < k if right else at > k) or (at == k and right in sides)]
            weight = sum(w for _, w in some)
            return sum(s for s, _ in some) / weight if weight else value

        # Below the value its left blocks pull too, above it the right ones.
        return mean(False) if mean(False) < value else mean(True) if mean(True) > value else value

    def _count(self, rows: list) -> None:
        self.passes += 1
        self.received += len(rows)


@dataclass(frozen=True)
class IsotonicCalibrator:
    """The fitted step function as a table of blocks (part, lo, hi, v); ``borders`` are the last x of the ranges."""

    blocks: DataFrame
    borders: tuple
    n: int
    prediction: str
    received: int

    @classmethod
    def fit(cls, df: DataFrame, prediction: str, target: str = "y_true", at_least: int = 50, ranges: int | None = None) -> "IsotonicCalibrator":
        """Rows are first reduced to one weighted point per distinct prediction, which loses nothing; rows with a null
        or NaN are left out. ``ranges`` is the number of tasks that pool, at most 512."""
        spark = df.sparkSession
        ranges = min(512, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
        x, y = col(prediction).cast("double"), col(target).cast("double")
        rows = df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
        points = rows.groupBy("x").agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
        blocks = stored(_blocks(points, ranges), "isotonic-blocks")
        parts = blocks.groupBy("part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("w").alias("w")).orderBy("part").collect()
        n = int(sum(r["w"] for r in parts))
        if n < at_least:
            raise ValueError(f"a calibrator needs {at_least} rows, got {n}")
        merge = _Merge(blocks, [r["part"] for r in parts])
        pieces = merge.run()
        rows = merge._open().select("part", "lo", "hi", "v")
        if pieces:  # a piece stands in every range it touches, so that rows find it in their own
            held = [(p, q.lo, q.hi, q.v) for q in pieces for p in [r["part"] for r in parts] if q.first <= p <= q.last]
            rows = rows.unionByName(spark.createDataFrame(held, "part int, lo double, hi double, v double"))
        return cls(stored(rows, "isotonic-steps"), tuple(r["hi"] for r in parts), n, prediction, len(parts) + merge.received)

    def steps(self) -> DataFrame:
        """(lo, hi, v) of every block."""
        return self.blocks.select("lo", "hi", "v").distinct()

    def transform(self, df: DataFrame, output: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
        """Adds the calibrated value: a block's value within it, linear between two blocks, constant beyond the ends.

        Rows meet the blocks of their range in order of x. Ranges with many rows are dealt to several tasks, each
        with the range's blocks. A null prediction gives null; NaN counts as above all.
        """
        spark = df.sparkSession
        x = col(self.prediction).cast("double")
        parts = [r["part"] for r in self.blocks.select("part").distinct().orderBy("part").collect()]
        place = F.least(F.size(F.filter(F.array(*[F.lit(b) for b in self.borders]), lambda b: b < x)), F.lit(len(parts) - 1))
        part = F.element_at(F.array(*[F.lit(p) for p in parts]), place + 1)
        rows = df.withColumns({"_x": x, "_part": F.when(x.isNotNull(), part)})
        many = {r["_part"]: -(-r["n"] // rows_per_task) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect() if r["_part"] is not None}
        # Range ends also see the nearest block of the next range on either side.
        ends = self.blocks.groupBy("part").agg(F.min_by(F.struct("lo", "hi", "v"), "lo").alias("first"), F.max_by(F.struct("lo", "hi", "v"), "lo").alias("last"))
        ends = {r["part"]: (r["first"], r["last"]) for r in ends.collect()}
        around = [(p, *map(float, ends[q][side])) for i, p in enumerate(parts) for j, side in ((i - 1, 1), (i + 1, 0))
                  if 0 <= j < len(parts) for q in [parts[j]]]
        blocks = self.blocks
        if around:
            blocks = blocks.unionByName(spark.createDataFrame(around, "part int, lo double, hi double, v double")).distinct()
        # Each block also carries where the next one begins, so rows look back only.
        along = Window.partitionBy("part").orderBy("lo")
        blocks = blocks.withColumns({"next_lo": F.lead("lo").over(along), "next_v": F.lead("v").over(along)})
        least = float(ends[parts[0]][0]["v"])
        salts = spark.createDataFrame([(int(p), int(many.get(p, 1))) for p in parts], "part int, salts int")
        blocks = blocks.join(F.broadcast(salts), "part").select(
            F.col("part").alias("_part"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("salts"), F.lit(1)) - 1)).alias("_salt"),
            F.col("lo").alias("_x"), F.struct("hi", "v", "next_lo", "next_v").alias("_block"))
        limits = F.create_map(*[F.lit(v) for p in parts for v in (int(p), max(1, int(many.get(p, 1))))])
        own = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
        salt = F.pmod(own, F.coalesce(F.element_at(limits, F.col("_part")), F.lit(1))).cast("int")
        rows = rows.withColumns({"_salt": salt, "_row": F.struct(*[F.col(f"`{c}`") for c in df.columns])})
        both = rows.select("_part", "_salt", "_x", "_row").unionByName(blocks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)), allowMissingColumns=True)
        # Blocks stand before rows of the same x.
        order = Window.partitionBy("_part", "_salt").orderBy("_x", F.col("_row").isNotNull())
        block = F.last("_block", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        placed = both.where("_part IS NOT NULL").withColumn("_a", block).where("_row IS NOT NULL")
        a, x = (lambda name: F.col(f"_a.{name}")), F.col("_x")
        between = a("v") + (a("next_v") - a("v")) * (x - a("hi")) / (a("next_lo") - a("hi"))
        value = (F.when(F.col("_a").isNull(), F.lit(least))
                 .when((x <= a("hi")) | a("next_lo").isNull() | F.isnan("_x"), a("v")).otherwise(between))
        done = placed.select("_row.*", value.alias(output))
        lost = rows.where("_part IS NULL").select("_row.*", F.lit(None).cast("double").alias(output))
        return done.unionByName(lost)
