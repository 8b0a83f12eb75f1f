"""Benchmark decontamination with an FM-index per training shard.

A shard is the documents one task reads until it has enough words. Its words become symbols: those of the
benchmark keep a number each, and any others are one symbol, as no window holds them. Over the shard's symbols
stand the Burrows-Wheeler transform in a wavelet matrix and every eighth suffix position. All windows of the
benchmark are searched backwards at once, their occurrences are located by walking to a sampled position, and
the word spans are merged per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ratebook.llm.common import bounded_batches

#: A byte that isn't 0-9, a-z or part of a non-ASCII character separates words; A-Z are lower-cased.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class WaveletMatrix:
    """rank(symbol, position) over a sequence of small integers, for many queries at once."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        s = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            one_lo, one_hi = ones[lo], ones[hi]
            lo = np.where(bit, zeros + one_lo, lo - one_lo)
            hi = np.where(bit, zeros + one_hi, hi - one_hi)
        return hi - lo


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by doubling; only suffixes that are still tied are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    key = s[order]
    head = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    group = np.repeat(head, np.diff(np.append(head, n)))  # rank of a tie: where it begins
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 1
    tied = np.flatnonzero(np.diff(np.append(head, n)).repeat(np.diff(np.append(head, n))) > 1)
    while len(tied):
        at = order[tied]
        nxt = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        # Places of the tied groups don't change, so the sorted keys fill them in sequence.
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[at] = start
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        step *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a sequence of symbols 1..symbols-1; 0 ends it."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = 8):
        s = np.append(sequence, 0).astype(np.int64)
        order = suffix_order(s)
        self.last = s[order - 1]  # the Burrows-Wheeler transform
        self.matrix = WaveletMatrix(self.last, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        self.n = len(s)
        self.sampled = order % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [lo, hi) of right-aligned phrases (0 where a phrase is shorter), from the last symbol on."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            c = phrases[live, -back]
            lo[live] = self.before[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.before[c] + self.matrix.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back to the next sampled one, counting the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            at = rows[walking]
            c = self.last[at]
            rows[walking] = self.before[c] + self.matrix.rank(c, at)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.places[self.slot[rows]] + steps


class Phrases:
    """Distinct windows of benchmark items: ``n`` consecutive words, or a shorter item whole."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        found: dict[tuple[bytes, ...], dict] = {}
        for item, text in items:
            w = words(text)
            for at in range(min(1, len(w)) if len(w) < n else len(w) - n + 1):
                found.setdefault(tuple(w[at:at + n]), {})[item] = None
        self.vocabulary = {w: i + 2 for i, w in enumerate(dict.fromkeys(w for p in found for w in p))}
        self.owners = [list(o) for o in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), n), np.int64)
        for row, phrase in zip(self.table, found):
            row[n - len(phrase):] = [self.vocabulary[w] for w in phrase]
        self.shortest = int(self.lengths.min()) if len(found) else 0

    def hits(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[dict]]:
        """Per document of a shard: its number of words, merged hit spans [from, to) in words, items found."""
        counts, symbols, where = [], [], []
        base = 0
        for text in texts:
            w = words(text)
            counts.append(len(w))
            if len(w) and len(self.owners):
                s = np.fromiter(map(self.vocabulary.get, w, [1] * len(w)), np.int64, len(w))
                # Runs of benchmark words that are shorter than any window hold none.
                cut = np.flatnonzero(np.diff(np.concatenate([[0], (s > 1).astype(np.int8), [0]])))
                for a, b in cut.reshape(-1, 2)[np.diff(cut.reshape(-1, 2), axis=1)[:, 0] >= self.shortest]:
                    symbols += (s[a:b], [1])
                    where += (np.arange(base + a, base + b), [-1])
            base += len(w)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        spans, items = [np.zeros((0, 2), np.int64)] * len(texts), [{} for _ in texts]
        if not symbols:
            return counts, spans, items
        index = FMIndex(np.concatenate(symbols), len(self.vocabulary) + 2)
        places = np.concatenate(where)
        lo, hi = index.search(self.table, self.lengths)
        phrase = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        if not len(rows):
            return counts, spans, items
        first = places[index.locate(rows)]
        doc = np.searchsorted(starts, first, "right") - 1
        for d, p in np.unique(np.column_stack([doc, phrase]), axis=0).tolist():
            items[d].update(dict.fromkeys(self.owners[p]))
        change = np.zeros(base + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + self.lengths[phrase], -1)
        hit = np.cumsum(change)[:-1] > 0
        for d in np.unique(doc).tolist():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[starts[d]:starts[d + 1]].astype(np.int8), [0]])))
            spans[d] = edges.reshape(-1, 2)
        return counts, spans, items


def _phrase_blocks(benchmark: DataFrame, n: int, block_words: int) -> list[Phrases]:
    """The benchmark as query blocks of about ``block_words`` words each, so that what is sent out stays bounded."""
    b = benchmark.select(F.col("item_id"), F.col("text").cast("string"))
    size = b.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // (4 * block_words)))
    blocks = (b.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else b for k in range(parts))
    return [Phrases([tuple(r) for r in block.collect()], n) for block in blocks]


def search(docs: DataFrame, benchmark: DataFrame, n: int = 10, shard_words: int = 1 << 20, block_words: int = 1 << 20) -> DataFrame:
    """The documents' rows with n_words, spans (array of [from, to) in words) and items (sorted as strings).

    Every shard is searched for every query block; a benchmark of one block needs no shuffle, more are merged
    per document. Null texts have no words; null items are searched like others but aren't listed; repeated
    rows and ties are found each; an empty benchmark hits nothing. Clashing columns are replaced.
    """
    bounded_batches(docs)
    docs = docs.drop("n_words", "spans", "items").withColumn("text", F.col("text").cast("string"))
    blocks = _phrase_blocks(benchmark, n, block_words)
    fields = "n_words long, spans array<array<long>>, items array<string>"

    def searched(phrases: Phrases):
        columns = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(columns.index("text"))
                at, size, a = [], 0, 0
                for i in range(len(batch)):
                    size += len(texts[i].as_py() or "")
                    if size >= 6 * shard_words or i == len(batch) - 1:
                        at.append((a, i + 1))
                        a, size = i + 1, 0
                for a, b in at:
                    counts, spans, items = phrases.hits(texts[a:b].to_pylist())
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(counts, pa.int64()), pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64()))),
                         pa.array([sorted(str(k) for k in x if k is not None) for x in items], pa.list_(pa.string()))],
                        [*columns, "n_words", "spans", "items"])

        schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(fields).fields])
        return docs.mapInArrow(run, schema)

    if len(blocks) == 1:
        return searched(blocks[0])
    own = docs.columns
    docs = docs.withColumn("_found_row", F.monotonically_increasing_id())  # one scan feeds all blocks in the same order
    found = None
    for phrases in blocks:
        part = searched(phrases)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("_found_row").agg(
        F.first(F.struct(*own)).alias("_own"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("spans", _merged_spans(F.col("spans"))).select("_own.*", "n_words", "spans", "items")


def _merged_spans(spans):
    """Sorted union of [from, to) spans that may overlap or touch."""
    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<bigint>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(F.element_at(done, -1), -1) >= s[0]),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(
            F.element_at(done, -1)[0], F.greatest(F.element_at(F.element_at(done, -1), -1), s[1]))))).otherwise(
                F.concat(done, F.array(s))))


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of searched documents."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def without_words(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them."""
    ends = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:ends[a][0]])
        at = ends[b - 1][1]
    return "".join([*out, text[at:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents' own columns, with hit words taken out of ``text`` until none is left.

    What a removal brings together may be a window again, so a changed document is searched anew; each round
    shortens it. Other rows and columns stay as they are.
    """
    bounded_batches(docs)
    blocks = _phrase_blocks(benchmark, n, 1 << 20)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            todo = list(range(len(texts)))
            while todo:
                changed = set()
                for phrases in blocks:
                    _, spans, _ = phrases.hits([texts[i] for i in todo])
                    for i, s in zip(todo, spans):
                        if len(s):
                            texts[i] = without_words(texts[i], s.tolist())
                            changed.add(i)
                todo = sorted(changed)
            yield pa.RecordBatch.from_arrays(
                [c if i != at else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns)], columns)

    return docs.mapInArrow(run, docs.schema)
