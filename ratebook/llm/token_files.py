"""Token id files with Elias-Fano document boundaries.

A table of documents is encoded, cut into blocks in ascending ``doc_id`` order and written through Spark as
one binary record per block. Each record holds the concatenated ids, the starts of its documents as an
Elias-Fano sequence and their ``doc_id`` as another. An Elias-Fano sequence of n values below u takes about
2 + log2(u / n) bits a value; every 64th set bit of its upper part is sampled, so ``select`` reads one sample
and scans a few bytes.

Record layout, little-endian: magic ``RBTK``, version u16, bytes per id u16, documents u64, null ids u64, ids
u64, smallest doc_id i64, then the two sequences and the ids. A sequence: values u64, low bits u8, length of
the upper part u64, lower part, upper part, samples u32 each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ratebook.llm.common import bounded_batches
from ratebook.llm.tokens import encoder
from ratebook.session import work_path

MAGIC = b"RBTK"
SAMPLE = 64
_HEAD = struct.Struct("<4sHHQQQq")
_SEQUENCE = struct.Struct("<QBQ")


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        return (_SEQUENCE.pack(self.n, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes()
                + self.samples.astype("<u4").tobytes())

    @classmethod
    def load(cls, blob: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, high_bytes = _SEQUENCE.unpack_from(blob, at)
        at += _SEQUENCE.size
        parts = []
        for kind, count in (("u1", (n * low_bits + 7) // 8), ("u1", high_bytes), ("<u4", -(-n // SAMPLE))):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, low_bits, *parts), at

    def _low(self, i: int) -> int:
        bits = range(i * self.low_bits, (i + 1) * self.low_bits)
        return sum((int(self.low[b >> 3]) >> (b & 7) & 1) << k for k, b in enumerate(bits))

    def select(self, i: int) -> int:
        """Value i: from the nearest sample on, bytes are skipped by their count of set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = at >> 3, int(self.high[at >> 3]) >> (at & 7) << (at & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i << self.low_bits) | self._low(i)

    def select_group(self, g: int) -> np.ndarray:
        """The values from sample g to the next, in one read of the bytes between them; their low bits fill whole bytes."""
        first, last = g * SAMPLE, min((g + 1) * SAMPLE, self.n)
        byte = int(self.samples[g]) >> 3
        end = (int(self.samples[g + 1]) >> 3) + 1 if g + 1 < len(self.samples) else len(self.high)
        skip = int(self.samples[g]) & 7
        at = byte * 8 + skip + np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")[skip:])[:last - first]
        low = self.low[first * self.low_bits // 8:(last * self.low_bits + 7) // 8]
        bits = np.unpackbits(low, bitorder="little")[:(last - first) * self.low_bits].reshape(last - first, self.low_bits)
        return ((at - np.arange(first, last)) << self.low_bits) + bits @ (1 << np.arange(self.low_bits))

    def __iter__(self) -> Iterator[int]:
        """All values in order, one sample's group of them at a time: no table of the whole sequence is made."""
        for g in range(len(self.samples)):
            yield from self.select_group(g).tolist()


def pack_block(doc_ids: list[int | None], ids: list[bytes], kind: np.dtype) -> bytes:
    """One record from documents in ascending order, nulls first."""
    lengths = np.array([len(b) // kind.itemsize for b in ids], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    head = _HEAD.pack(MAGIC, 1, kind.itemsize, len(ids), len(ids) - len(known), int(starts[-1]), base)
    return head + EliasFano.of(starts).dump() + EliasFano.of(known - base).dump() + b"".join(ids)


def unpack_block(blob: bytes) -> tuple[Iterator[int | None], EliasFano, np.ndarray]:
    """Document ids as they are read, their boundaries (one more than documents) and the ids of a record."""
    magic, version, width, docs, nulls, n, base = _HEAD.unpack_from(blob)
    if (magic, version) != (MAGIC, 1):
        raise ValueError("not a token block")
    bounds, at = EliasFano.load(memoryview(blob), _HEAD.size)
    known, at = EliasFano.load(memoryview(blob), at)
    doc_ids = chain(repeat(None, nulls), (base + i for i in known))
    return doc_ids, bounds, np.frombuffer(blob, f"<u{width}", n, at)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, block_ids: int = 1 << 18, path: str | None = None) -> str:
    """Encodes every whole text and writes the blocks; returns their folder.

    Texts are dealt by ranges of ``doc_id`` and sorted there, each document ends with ``end_id`` and stays in
    one block; a block is closed once it has ``block_ids`` ids. A null or empty text has the end id alone;
    null ``doc_id`` come first; repeated rows are repeated documents; extra columns are not read.
    """
    path = path or work_path(docs.sparkSession, "token-files")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, True)
        end = np.array([end_id], enc.kind).tobytes()
        part, seq, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()),
                "n_ids": pa.array([size], pa.int64()), "record": pa.array([pack_block(doc_ids, ids, enc.kind)], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(enc.encode(text.as_py()) + end)
                size += len(ids[-1]) // enc.kind.itemsize
                if size >= block_ids:
                    yield block()
                    seq, doc_ids, ids, size = seq + 1, [], [], 0
        if doc_ids:
            yield block()

    bounded_batches(docs)
    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(blocks, "part int, seq long, n_ids long, record binary")
     .write.option("compression", "zstd").parquet(path))
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, start counted over all of them.

    Offsets within a block and its document ids are selected from their Elias-Fano sequences as the ids are read,
    64 at a time; ids are widened a document at a time. What lies before a block is a sum over the
    block heads: per part first, and over the parts' sums next, one row a part.
    """
    blocks = spark.read.parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, record in zip(*(batch.column(i) for i in range(3))):
                doc_ids, bounds, ids = unpack_block(record.as_py())
                rows = ((d, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for d, (a, b) in zip(doc_ids, pairwise(bounds)))
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.as_py()] * len(some), pa.int32()), pa.array([seq.as_py()] * len(some), pa.int64()),
                         *(pa.array(c, pa.int64()) for c in zip(*some))], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = blocks.select("part", "seq", "record").mapInArrow(
        documents, "part int, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = blocks.select("part", "seq", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(W.orderBy("part")).alias("part_base"))
    bases = heads.withColumn("base", before(W.partitionBy("part").orderBy("seq"))).join(parts, "part").select(
        "part", "seq", (F.col("base") + F.col("part_base")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
