"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c are at most epsilon = sqrt(2 - 2c) apart. Vectors are turned to their principal
axes, laid on a grid of that width along the leading ones, sorted by cells in lexicographic order and cut into
blocks. Pairs of blocks (sequence intervals) are joined recursively: an interval pair whose bounding boxes are
more than epsilon apart is skipped, otherwise both are halved until they are small. Boxes cover the leading
coordinates and the norm of the rest. In small intervals products of more coordinates and of the rests' norms, which
bound a cosine from above, discard most pairs; exact cosines in double precision decide on the others.

Blocks lie in groups of neighbours, and two groups meet in one task, so a block is sent once for each group that
holds a block near it and not once for each such block. Groups meet in rounds, each of which sends a copy of the
vectors at most; a round's shuffle is gone before the next begins, so disk follows the vectors and not their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ratebook.llm.common import bounded_batches, connected_components, roots, stored

_SAME = "node long, ids array<long>, vector binary, weight long, low long"
_BLOCK = "block long, rows long, nodes binary, weights binary, vectors binary, low array<double>, high array<double>"
#: Bytes of the vectors of a group at most; smaller tables get up to ``_TASKS`` groups a core, for the sake of more tasks.
_GROUP, _TASKS = 64 << 20, 4
#: Bytes that a round may send, if that is more than a copy of the vectors; rows of a list that is broadcast.
_ROUND, _LIST = 128 << 20, 1_000_000
#: Links that a task holds before it contracts them.
_HELD = 1 << 18


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Spark removes the shuffles of what is written meanwhile as soon as it's written, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _matrix(vectors: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _principal_axes(vectors: DataFrame, kind: type, n: int) -> np.ndarray:
    """Leading eigenvectors (d x n) of the second moments of all vectors; one d x d matrix reaches the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = _units(_matrix(batch.column(0).to_pylist(), kind))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    rows = vectors.select("vector").mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((r["i"] for r in rows), default=-1)
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :n].copy()


def _coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates and the norm of the rest: a map under which no distance grows and no product falls."""
    p = x @ axes
    return np.column_stack([p, np.sqrt(np.maximum((x * x).sum(axis=1) - (p * p).sum(axis=1), 0))])


def _n_axes(d: int, cosine: float) -> int:
    """Axes of the products: were all directions alike, a product reached the bound at four standard deviations."""
    return min(d, math.ceil(((4 + math.sqrt(16 + 4 * max(0.0, 1 - cosine) * d)) / 2) ** 2))


class _Block:
    """A block in a task: its vectors, their coordinates for products, and the boxes of its intervals."""

    def __init__(self, nodes: bytes, weights: bytes, x: np.ndarray, axes: np.ndarray, leading: int, leaf: int):
        self.nodes, self.weights, self.x, self.leaf = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64), x, leaf
        self.links = np.zeros(len(x), np.int64)
        units = _units(x)
        self.wide = _coordinates(units, axes).astype(np.float32)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._enclose(0, len(x), _coordinates(units, axes[:, :leading]))

    def halves(self, lo: int, hi: int) -> list[tuple[int, int]]:
        return [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)] if hi - lo > self.leaf else [(lo, hi)]

    def _enclose(self, lo: int, hi: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = self.halves(lo, hi)
        if len(parts) == 1:
            box = p[lo:hi].min(0), p[lo:hi].max(0)
        else:
            (low, high), (low2, high2) = (self._enclose(*part, p) for part in parts)
            box = np.minimum(low, low2), np.maximum(high, high2)
        self.boxes[lo, hi] = box
        return box


def _join(a: _Block, b: _Block, of_a: tuple[int, int], of_b: tuple[int, int], epsilon: float, cosine: float, found) -> None:
    """Calls found(rows of a, rows of b) with the links of an interval of each."""
    (low, high), (low2, high2) = a.boxes[of_a], b.boxes[of_b]
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    if gap @ gap > epsilon * epsilon * (1 + 1e-9) + 1e-12:
        return
    (a0, a1), (b0, b1) = of_a, of_b
    if max(a1 - a0, b1 - b0) <= a.leaf:
        p, q = a.wide[a0:a1], b.wide[b0:b1]
        close = p @ q.T >= np.float32(cosine - 1e-5 - 2e-7 * p.shape[1])  # single precision errs by less
        i, j = np.divmod(np.flatnonzero(close), close.shape[1])
        if a is b and a0 == b0:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        x, y = _units(a.x[a0:a1]), _units(b.x[b0:b1])
        s = (x @ y.T)[i, j] if len(i) * 8 > close.size else np.einsum("ij,ij->i", x[i], y[j])
        near = s >= cosine - 1e-9
        i, j, s = i[near], j[near], s[near]
        unsure = s < cosine + 1e-9
        if unsure.any():  # one order of summation decides on the border
            s[unsure] = [math.fsum((x[k] * y[l]).tolist()) for k, l in zip(i[unsure], j[unsure])]
            i, j = i[s >= cosine], j[s >= cosine]
        if len(i):
            found(i + a0, j + b0)
        return
    for left in a.halves(*of_a):
        for right in b.halves(*of_b):
            if a is not b or left[0] <= right[0]:
                _join(a, b, left, right, epsilon, cosine, found)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, leading: int = 8, block_rows: int = 4096, leaf: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are joined once, with their number as weight. A pair of groups of blocks gives the number of links per
    vector and a spanning forest of its links, never the pairs themselves. Null, empty or zero vectors
    and those with null or non-finite components link with nothing; they have no links and are their own component.
    Vectors are compared with those of their own length, one length after the other. A null vec_id is never smallest: its component_id
    is null and kept false if it's alone. Repeated rows link with each other; extra columns aren't read.
    """
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    kind, name = (np.float32, "float") if single else (np.float64, "double")
    v = F.transform(F.col("embedding"), lambda x: x.cast(name))
    sound = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.array_max(F.transform(v, F.abs)) > 0),
        F.lit(False))
    # + 0.0 makes the two zeros one.
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(sound, F.transform(v, lambda x: (x + F.lit(0.0)).cast(name))).alias("v"))
    bounded_batches(rows)
    with _shuffles_removed(spark):
        same = stored(_numbered(rows), "vectors")
        one = same.where("vector IS NOT NULL")
        lengths = [r["d"] for r in one.select(F.length("vector").alias("d")).distinct().orderBy("d").collect()]
        parts = [_linked(one if len(lengths) == 1 else one.where(F.length("vector") == d), kind, d // kind().itemsize, cosine, leading, block_rows, leaf)
                 for d in lengths]
    out = same.where("node IS NULL").select(F.explode("ids").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if parts:
        linked = parts[0]
        for part in parts[1:]:
            linked = linked.unionByName(part)
        named = one.select("node", "weight", "low").join(linked, "node", "left").select(
            "node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
        out = out.unionByName(same.select("node", "ids").join(named, "node").select(F.explode("ids").alias("vec_id"), "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of ids that have equal vectors, a node's. Its last row has the vector, the number of its ids and the
    smallest. Ids without a sound vector have no node.

    Equal vectors of a batch go as one row, so a vector that is very common is few rows of the task that numbers it.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, v = batch.column(0), batch.column(1)
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            groups: dict[bytes | None, list[int]] = {}
            for i, valid in enumerate(v.is_valid().to_pylist()):
                groups.setdefault(flat[ends[i]:ends[i + 1]].tobytes() if valid else None, []).append(i)
            cuts = np.cumsum([0, *map(len, groups.values())])
            members = ids.take(pa.array([i for g in groups.values() for i in g], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(groups), pa.binary()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), members)], ["vector", "ids"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by vector, those without first; a vector's rows may run over several batches."""
        node, held, weight, low, out = TaskContext.get().partitionId() << 40, None, 0, None, []

        def give(last: bool):
            nonlocal node, weight, low
            vector, ids = held
            if vector is None:
                out.append((None, ids, None, None, None))
                return
            weight += len(ids)
            low = min((i for i in (*ids, low) if i is not None), default=None)
            out.append((node, ids, vector, weight, low) if last else (node, ids, None, None, None))
            if last:
                node, weight, low = node + 1, 0, None

        def batch():
            columns = zip(*out) if out else [()] * 5
            kinds = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "ids", "vector", "weight", "low"])

        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held is not None:
                    give(row[0] != held[0])
                held = row
            yield batch()
            out.clear()
        if held is not None:
            give(True)
            yield batch()

    at = F.when(F.col("vector").isNull(), F.xxhash64("ids")).otherwise(F.xxhash64("vector"))
    return (rows.mapInArrow(packed, "vector binary, ids array<long>").repartition(at).sortWithinPartitions("vector").mapInArrow(numbered, _SAME))


def _blocks(one: DataFrame, kind: type, axes: np.ndarray, leading: int, epsilon: float, block_rows: int) -> DataFrame:
    """Blocks of vectors of one length in grid order."""
    axes = axes[:, :leading]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes sort like the cells, then like the coordinates."""
        for batch in batches:
            if len(batch):
                p = _units(_matrix(batch.column(1).to_pylist(), kind)) @ axes
                cell = (np.floor(p / epsilon).astype(np.int32).astype(np.int64) + (1 << 31)).astype(">u4")
                at = (np.clip(p + 1, 0, 2) * 32767).astype(">u2")
                order = [c.tobytes() + k.tobytes() for c, k in zip(cell, at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order, pa.binary())], ["node", "vector", "weight", "at"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, block = [], 0, TaskContext.get().partitionId() << 40

        def cut(table: pa.Table):
            nonlocal block
            vectors = table.column(1).to_pylist()
            p = _coordinates(_units(_matrix(vectors, kind)), axes)
            block += 1
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "rows": pa.array([len(vectors)], pa.int64()),
                **{name: pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for name, c in (("nodes", 0), ("weights", 2))},
                "vectors": pa.array([b"".join(vectors)], pa.binary()),
                "low": pa.array([p.min(0)], pa.list_(pa.float64())), "high": pa.array([p.max(0)], pa.list_(pa.float64()))})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            number += len(batch)
            if number >= block_rows:
                whole = pa.Table.from_batches(held)
                while number >= block_rows:
                    yield cut(whole.slice(0, block_rows))
                    whole = whole.slice(block_rows)
                    number -= block_rows
                held = whole.to_batches()
        if number:
            yield cut(pa.Table.from_batches(held))

    ordered = (one.select("node", "vector", "weight").mapInArrow(cells, "node long, vector binary, weight long, at binary")
               .repartitionByRange("at").sortWithinPartitions("at"))
    return stored(ordered.mapInArrow(blocks, _BLOCK), "blocks")


def _linked(one: DataFrame, kind: type, d: int, cosine: float, leading: int, block_rows: int, leaf: int) -> DataFrame:
    """(node, n, component_id) of the nodes of one length that have links with others."""
    spark, epsilon = one.sparkSession, math.sqrt(2 - 2 * cosine)
    axes = _principal_axes(one, kind, max(leading, _n_axes(d, cosine)))
    tiles = _blocks(one, kind, axes, leading, epsilon, block_rows)
    number, total = tiles.agg(F.count("*"), F.sum("rows")).first()
    size = total * d * kind().itemsize
    groups = max(-(-size // _GROUP), min(number, _TASKS * spark.sparkContext.defaultParallelism)) | 1
    before = F.coalesce(F.sum("rows").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    boxes = stored(tiles.select("block", "low", "high", F.floor(before * groups / total).cast("int").alias("group")), "boxes")
    # Blocks meet over the cells of the first axis they cover, widened by one on one side; the boxes then decide.
    cell = lambda c, k: F.floor(F.col(c)[0] / epsilon) + k
    left = boxes.select("block", "group", "low", "high", F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("c"))
    right = boxes.select(F.col("block").alias("other"), F.col("group").alias("group2"), F.col("low").alias("low2"), F.col("high").alias("high2"),
                         F.explode(F.sequence(cell("low", -1), cell("high", 1))).alias("c"))
    gap = F.aggregate(F.arrays_zip("low", "high", "low2", "high2"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(
        F.lit(0.0), z["low"] - z["high2"], z["low2"] - z["high"]), 2))
    near = left.join(right, "c").where("block <= other").where(gap <= epsilon ** 2 * (1 + 1e-9) + 1e-12)
    # The cells that a block must go to, from both sides: groups i and i + k meet in cell k * groups + i. Groups are odd in number, so each pair meets once.
    meets = F.explode(F.array(F.struct("block", "group", F.col("group2").alias("other")),
                              F.struct(F.col("other").alias("block"), F.col("group2").alias("group"), F.col("group").alias("other"))))
    k = F.pmod(F.col("m.other") - F.col("m.group"), F.lit(groups))
    ahead = k <= groups // 2
    at = F.when(ahead, k * groups + F.col("m.group")).otherwise((groups - k) * groups + F.col("m.other"))
    meets = stored(near.select(meets.alias("m")).select("m.block", at.alias("cell"), (ahead & (k > 0)).alias("second")).distinct(), "meets")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, the group that is held before the one that passes by; in the first cells a group meets itself."""

        def records():
            for batch in batches:
                c, second, *columns = (batch.column(i).to_pylist() for i in range(5))
                vectors = batch.column(5)
                for i in range(len(batch)):
                    yield c[i], second[i], _Block(columns[1][i], columns[2][i], np.frombuffer(vectors[i].as_buffer(), kind).reshape(-1, d), axes, leading, leaf)

        for c, rows in groupby(records(), lambda r: r[0]):
            blocks: list[_Block] = []
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            us, vs, held = [], [], 0

            def found(i, j):
                nonlocal us, vs, held
                np.add.at(a.links, i, b.weights[j])
                np.add.at(b.links, j, a.weights[i])
                us.append(a.nodes[i])
                vs.append(b.nodes[j])
                held += len(i)
                if held > _HELD + 4 * sum(len(x.nodes) for x in blocks):
                    us, vs, held = contracted()

            def contracted():
                nodes, low = roots(np.concatenate(us), np.concatenate(vs))
                return [low[nodes != low]], [nodes[nodes != low]], int((nodes != low).sum())

            for _, second, a in rows:
                if not second:
                    blocks.append(a)
                for b in blocks if second or first + c < groups else ():
                    _join(a, b, (0, len(a.x)), (0, len(b.x)), epsilon, cosine, found)
                if second and a.links.any():
                    seen.append((a.nodes[a.links > 0], a.links[a.links > 0]))
            seen += [(b.nodes[b.links > 0], b.links[b.links > 0]) for b in blocks if b.links.any()]
            if seen:
                nodes, n = (np.concatenate(x) for x in zip(*seen))
                (u,), (v,), _ = contracted()
                yield pa.RecordBatch.from_pydict({"u": np.concatenate([nodes, u]), "v": np.concatenate([nodes, v]),
                                                  "n": np.concatenate([n, np.zeros(len(u), np.int64)])})

    cells = groups * (groups // 2 + 1)
    step = min(cells, max(1, max(_ROUND, size) * groups // (2 * size)))
    found = None
    for first in range(0, cells, step):
        sent = meets.where(F.col("cell").between(first, first + step - 1)).select("block", (F.col("cell") - first).cast("int").alias("cell"), "second")
        met = tiles.join(F.broadcast(sent) if 2 * step * number <= _LIST * groups else sent, "block").select(
            "cell", "second", "block", "nodes", "weights", "vectors")
        met = met.repartitionById(step, "cell").sortWithinPartitions("cell", "second", "block")
        now = stored(met.mapInArrow(links, "u long, v long, n long"), "links")
        found = now if found is None else found.unionByName(now)
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    linked = connected_components(found.where("n = 0").select("u", "v")).join(counts, "node").join(one.select("node", "low"), "node")
    least = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    return linked.join(least, "root").select("node", "n", "component_id")
