"""SimHash near-duplicates by pivot distance tables.

Fingerprints of ``64 * words`` bits are linked at ``most`` or fewer differing bits. The table of a fingerprint
holds its Hamming distances to a fixed set of pivots. By the triangle inequality two fingerprints whose
distances to any pivot differ by more than ``most`` can't be linked, so the largest coordinate difference
discards a pair without looking at the fingerprints; what survives is verified bit by bit.

Which pairs meet at all leaves none out. For few differing bits it is a matter of keys: of ``most + 2`` bands of the
bits, two linked fingerprints agree on two at least, so each pair of bands is a key. For a similarity (48 of 256
bits) such bands have five bits and tell nothing apart; there every pair of blocks of fingerprints meets, and a
product of their first bits, which is a bound, discards all but about three pairs in a thousand; of these the pivot
tables discard before all bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ratebook.llm.common import bounded_batches, checkpointed, connected_components, roots, stored

PIVOTS = 16
#: Fingerprints of a key that are compared in one task; larger keys are split into pairs of chunks.
CHUNK = 4096
_STEP = 1 << 15
#: Bands of fewer bits are no keys: all pairs meet, in blocks.
_BAND = 8
#: Fingerprints of a block at most; smaller tables get up to ``_BLOCKS`` of at least ``_LEAST``, for the sake of more tasks.
BLOCK = 1 << 17
_BLOCKS, _LEAST = 8, 1 << 12
#: Rows of a tile, words of a fingerprint in its product, candidates that are verified at once.
_TILE, _FIRST, _HELD = 1 << 11, 2, 1 << 18


@dataclass(frozen=True)
class Scheme:
    shingle: int = 4
    words: int = 1
    most: int = 4

    @property
    def keyed(self) -> bool:
        return 64 * self.words >= _BAND * (self.most + 2)

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """Keys (n x number of keys) of fingerprints (n x words): the pairs of most + 2 bands."""
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
        total = bits.shape[1]
        edges = [round(total * i / (self.most + 2)) for i in range(self.most + 3)]
        bands = [(*range(edges[i], edges[i + 1]), *range(edges[j], edges[j + 1])) for i, j in combinations(range(self.most + 2), 2)]
        return np.column_stack([bits[:, list(b)].astype(np.int64) @ (1 << np.arange(len(b), dtype=np.int64)) for b in bands])


#: The contract's fingerprints, and those for a similarity of 0.8 on shingles of five words: their share of
#: differing bits is arccos(2s / (1 + s)) / pi = 0.151; 48 of 256 leaves room for the spread of the estimate.
EXACT = Scheme()
SIMILAR = Scheme(shingle=5, words=4, most=48)


def pivots(words: int = 1, n: int = PIVOTS) -> np.ndarray:
    """Fixed fingerprints (n x words), half of the bits set on average."""
    return np.array([[xxhash.xxh64_intdigest(f"pivot {i} {w}".encode()) for w in range(words)] for i in range(n)], np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words are on the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    return distances(prints[:, None, :], pivots(prints.shape[1])[None])


def fingerprint(text: str | None, shingle: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """Bit-wise majority over the XXH64 of all word shingles, repeats included; zero without words.

    Further words of a longer fingerprint take the bits of the hash mixed anew.
    """
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.zeros(words, np.uint64)
    rows = [b" ".join(tokens)] if len(tokens) <= shingle else map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(row, seed) for row in rows), np.uint64)
    out = np.zeros(words, np.uint64)
    for w in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _STEP):
            h = hashes[at:at + _STEP]
            if w:
                h = (h ^ (h >> np.uint64(29 + w))) * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h = h ^ (h >> np.uint64(32))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        out[w] = np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, fp) of every row, fp as big-endian words. Null text has no words; words are split at ASCII white
    space and only A-Z is lower-cased."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), scheme.shingle, scheme.words).astype(">u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["doc_id", "fp"])

    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id long, fp binary")


#: Groups up to this size are compared pair by pair.
_SMALL = 128


def _matrix(fps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64).reshape(len(fps), -1)


def nodes(prints: np.ndarray) -> np.ndarray:
    """A long for each fingerprint: itself if it's one word, else its hash, as ``node_column`` has it."""
    if prints.shape[1] == 1:
        return prints[:, 0].view(np.int64)
    hashes = [xxhash.xxh64_intdigest(row.tobytes(), 42) for row in prints.astype(">u8")]
    return np.array(hashes, np.uint64).view(np.int64)


def node_column(scheme: Scheme):
    return F.conv(F.hex("fp"), 16, -10).cast("long") if scheme.words == 1 else F.xxhash64("fp")


def linked(prints: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among distinct fingerprints, as index pairs.

    In a small group the table discards pairs and their bits decide. In a larger one the search goes out from one fingerprint and takes along whatever it reaches, so the work within a dense
    group follows its size and not its pairs. Those not reached yet stand in the order of their distance to
    the first pivot; only those within ``most`` of it are looked at, then the other pivots' coordinates
    discard, then the bits decide.
    """
    if len(prints) <= _SMALL:
        i, j = np.triu_indices(len(prints), 1)
        for c in range(table.shape[1]):
            near = np.abs(table[i, c] - table[j, c]) <= most
            if near.all():  # at a wide radius the coordinates discard little: leave it to the bits
                break
            i, j = i[near], j[near]
        near = distances(prints[i], prints[j]) <= most
        of, low = roots(i[near], j[near])
        return low[of != low], of[of != low]
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    first = table[:, 0]
    alive = np.ones(len(prints), bool)
    us, vs = [], []
    for start in range(len(order)):
        if not alive[start]:
            continue
        alive[start] = False
        reached = [start]
        while reached:
            x = reached.pop()
            lo, hi = np.searchsorted(first, [first[x] - most, first[x] + most + 1])
            near = np.flatnonzero(alive[lo:hi]) + lo
            if len(near):
                near = near[np.abs(table[near] - table[x]).max(axis=1) <= most]
            if len(near):
                near = near[distances(prints[near], prints[x]) <= most]
            if len(near):
                alive[near] = False
                us.append(np.full(len(near), order[x]))
                vs.append(order[near])
                reached += near.tolist()
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def near_links(distinct: DataFrame, scheme: Scheme, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between nodes of distinct ``fp``, enough to connect what the links found connect.

    Each fingerprint goes to every key. A key with more than ``chunk`` fingerprints is dealt over chunks by a
    hash, and every pair of chunks is one group, so no group grows with the table and no pair is left out. The
    table of such keys has less than (number of keys / chunk) rows a fingerprint.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = scheme.keys(_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], ["fp", "keys"])

    keys = stored(distinct.select("fp").mapInArrow(keyed, "fp binary, keys array<long>"), "keys").select(
        "fp", F.posexplode("keys").alias("band", "key"))
    hot = stored(keys.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(
        "band", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "hot-keys")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    dealt = (keys.join(hot, ["band", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("mine", mine)
             .withColumn("pair", F.explode(pairs)).select(F.xxhash64("band", "key", "pair.i", "pair.j").alias("cell"), "fp"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell may run over several batches."""

        def found(cell, prints):
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            a = cuts[:-1][np.diff(cuts) == 2]  # pairs: those at once
            a = a[np.abs(pivot_table(prints[a]) - pivot_table(prints[a + 1])).max(axis=1, initial=0) <= scheme.most]
            a = a[distances(prints[a], prints[a + 1]) <= scheme.most]
            us, vs = [a], [a + 1]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 2:
                    u, v = linked(prints[a:b], pivot_table(prints[a:b]), scheme.most)
                    us.append(a + u)
                    vs.append(a + v)
            of, low = roots(*(nodes(prints[np.concatenate(at)]) for at in (us, vs)))
            return pa.RecordBatch.from_pydict({"u": pa.array(low[of != low], pa.int64()), "v": pa.array(of[of != low], pa.int64())})

        held = None
        for batch in batches:
            if not len(batch):
                continue
            now = (batch.column(0).to_numpy(), _matrix(batch.column(1)))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
            if last:
                yield found(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
        if held is not None:
            yield found(*held)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(links, "u long, v long")


def _signs(prints: np.ndarray) -> np.ndarray:
    """The first words of fingerprints, a bit as +1 or -1: a product is the number of equal bits less that of differing ones."""
    return np.unpackbits(np.ascontiguousarray(prints[:, :_FIRST]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _table(prints: np.ndarray) -> np.ndarray:
    """``pivot_table`` of a block, a tile at a time."""
    return np.concatenate([np.zeros((0, PIVOTS), np.int16), *(pivot_table(prints[i:i + _TILE]) for i in range(0, len(prints), _TILE))])


def linked_blocks(a: np.ndarray, b: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between the fingerprints a and b (b None: among a), as indices into a, then b.

    Tiles of products name the pairs whose first bits differ in ``most`` at most, of those the pivot tables discard,
    then all bits decide. What is found is contracted as it comes, so memory does not follow the number of links.
    """
    other, shift = (a, 0) if b is None else (b, len(a))
    table = _table(a)
    others = table if b is None else _table(b)
    us, vs, held = [], [], 0
    for i in range(0, len(a), _TILE):
        left = _signs(a[i:i + _TILE])
        for j in range(i if b is None else 0, len(other), _TILE):
            near = left @ _signs(other[j:j + _TILE]).T >= left.shape[1] - 2 * most
            close = np.flatnonzero(np.triu(near, 1) if b is None and i == j else near)
            for at in range(0, len(close), _HELD):
                u, v = np.divmod(close[at:at + _HELD], near.shape[1])
                u, v = i + u, j + v
                kept = np.abs(table[u] - others[v]).max(axis=1, initial=0) <= most
                u, v = u[kept], v[kept]
                right = distances(a[u], other[v]) <= most
                of, low = roots(u[right], shift + v[right])
                us.append(low[of != low])
                vs.append(of[of != low])
                held += len(us[-1])
            if held > 4 * (shift + len(other)) + _HELD:
                of, low = roots(np.concatenate(us), np.concatenate(vs))
                us, vs = [low[of != low]], [of[of != low]]
                held = len(us[0])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def block_links(distinct: DataFrame, scheme: Scheme, block: int = BLOCK) -> DataFrame:
    """As ``near_links`` without keys: every pair of distinct fingerprints meets in a cell of a grid of blocks.

    A hash deals a fingerprint to its block, and the block goes to one cell with every block. A task holds two blocks
    and a tile of products however large the table is; the pairs compared grow with its square.
    """
    n = distinct.count()
    blocks = max(1, -(-n // block), min(_BLOCKS, n // _LEAST))
    mine = F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int")
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    dealt = (distinct.select("fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
             .select((high * (high + 1) / 2 + low).cast("int").alias("cell"), (F.col("mine") > F.col("other")).alias("upper"), "fp"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell may run over several batches."""

        def found(parts):
            upper, prints = (np.concatenate(x) for x in zip(*parts))
            a, b = prints[~upper], prints[upper]
            if len(a) and len(b):
                u, v = linked_blocks(a, b, scheme.most)
                prints = np.concatenate([a, b])
            else:
                u, v = linked_blocks(prints, None, scheme.most)
            return pa.RecordBatch.from_arrays([pa.array(nodes(prints[u]), pa.int64()), pa.array(nodes(prints[v]), pa.int64())], ["u", "v"])

        now, parts = None, []
        for batch in batches:
            cell, upper = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            prints = _matrix(batch.column(2))
            for c in np.unique(cell):
                if parts and c != now:
                    yield found(parts)
                    parts = []
                now = c
                parts.append((upper[cell == c], prints[cell == c]))
        if parts:
            yield found(parts)

    return dealt.repartitionById(blocks * (blocks + 1) // 2, "cell").sortWithinPartitions("cell").mapInArrow(links, "u long, v long")


def near_duplicates(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable by links.

    Copies share a fingerprint and are grouped before anything is compared. Documents without words share the
    zero fingerprint and are linked like any other; null doc_id are kept and never smallest; repeated rows stay;
    extra columns are not read; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, scheme), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    distinct = checkpointed(distinct.withColumn("node", node_column(scheme)))
    parts = connected_components((near_links if scheme.keyed else block_links)(distinct, scheme), contract=False)
    rooted = distinct.join(parts, "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
