"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is aligned in a corpus.

Texts are encoded by both vocabularies and go on as Arrow lists: flattened with their parent indices, turned to byte
ends by cumulative sums per document. Ends that both have are found by a hash join on (document, end) and cut the
tokens into groups. Pairs of ids are counted per batch by Arrow's group_by; Spark merges these partial counts.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ratebook.llm import tokens
from ratebook.llm.common import bounded_batches, stored

#: Bytes of text aligned at once; a longer text is aligned alone.
SLICE = 1 << 20
#: Pairs whose counts are sent to the tasks at once (at most 68 MB); further ones follow in further rounds.
SENT = 4_000_000
#: Groups of more possible links than this have equal ids collapsed before their links are made.
_MANY_LINKS = 1 << 12
#: Counts that a task holds before it hands them on.
_HELD = 2_000_000


class PieceEncoder:
    """Ids of a sentencepiece model and the bytes of each."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


class SpacedEncoder:
    """Ids of a byte-level vocabulary for a space and a text; strings of special tokens are plain text.

    The vocabulary's own merges, in the order of their ids, run in tiktoken, which keeps no words in memory.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocabulary, special = made["model"]["vocab"], {t["id"] for t in made["added_tokens"]}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in made["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of the vocabulary are not in the order of its merges")
        byte = {c: b for b, c in tokens._byte_letters().items()}
        spelled = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if i not in special}
        self.bytes = [spelled.get(i, b"") for i in range(1 + max(spelled.keys() | special))]
        self.library = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, special_tokens={},
                                         mergeable_ranks={b: i for i, b in spelled.items()})

    def encode(self, text: str) -> list[int]:
        return self.library.encode_ordinary(" " + text)


def _path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Aligner:
    """Both vocabularies with their tables: bytes and their number per id, and the decimal ids with what follows them."""

    def __init__(self, a: str, b: str):
        self.a, self.b = SpacedEncoder(_path(a)), PieceEncoder(_path(b))
        self.texts = [pa.array(e.bytes, pa.binary()) for e in (self.a, self.b)]
        self.sizes = [pc.binary_length(t).cast(pa.int64()) for t in self.texts]
        self.width = len(self.b.bytes)
        self.pair = pa.int32() if len(self.a.bytes) * self.width < 1 << 31 else pa.int64()
        self.listed = pa.array([f"{i}{c}" for e, last in ((self.a, "|"), (self.b, ";")) for i in range(len(e.bytes)) for c in (",", last)])

    def _lists(self, encoder, known: pa.Array, texts: list[str | None]) -> pa.ListArray:
        """Ids per text; texts whose tokens do not spell a space and the text have none, nor have null and empty ones."""
        ids = [np.array(encoder.encode(t), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, ids)])
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        spelled = known.take(flat)
        at = np.frombuffer(spelled.buffers()[1], np.int32)[:len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        data = memoryview(spelled.buffers()[2] or b"").cast("B")
        same = [t and data[at[ends[i]]:at[ends[i + 1]]] == b" " + t.encode() for i, t in enumerate(texts)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), np.array([bool(s) for s in same], bool)

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        n = len(texts)
        (a, same_a), (b, same_b) = (self._lists(e, known, texts) for e, known in zip((self.a, self.b), self.texts))
        keep = pa.array(same_a & same_b)
        empty = pa.scalar([], a.type)
        sides = []
        for lists, sizes in zip((a, b), self.sizes):
            lists = pc.if_else(keep, lists, empty)
            flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
            # Byte ends within the document: the running sum less what the documents before it have.
            run = pc.cumulative_sum(sizes.take(flat)).to_numpy()
            count = pc.list_value_length(lists).to_numpy()
            first = np.cumsum(count) - count
            base = np.r_[0, run][first] if len(run) else np.zeros(n, np.int64)
            end = run - base[doc.to_numpy()]
            sides.append((flat.to_numpy(), doc.to_numpy(), end, count))
        (a_id, a_doc, a_end, n_a), (b_id, b_doc, b_end, n_b) = sides
        left, right = (pa.table({"doc": d, "end": e}) for d, e in ((a_doc, a_end), (b_doc, b_end)))
        shared = left.join(right, ["doc", "end"], join_type="left semi", use_threads=False)
        cut = np.sort(shared["doc"].to_numpy() << 32 | shared["end"].to_numpy())
        a_group, b_group = (np.searchsorted(cut, d << 32 | e) for d, e in ((a_doc, a_end), (b_doc, b_end)))
        in_a, in_b = (np.bincount(g, minlength=len(cut)) for g in (a_group, b_group))
        group_doc = cut >> 32
        n_groups = np.bincount(group_doc, minlength=n)
        link_ends = np.r_[0, np.cumsum(in_a * in_b)][np.r_[0, np.cumsum(n_groups)]]
        pairs, times = self._pairs(a_id, a_group, in_a, b_id, b_group, in_b, group_doc, n)
        return {"n_a": pa.array(n_a.astype(np.int64)), "n_b": pa.array(n_b.astype(np.int64)), "n_groups": pa.array(n_groups.astype(np.int64)),
                "n_links": pa.array(np.diff(link_ends)), "groups": self._listing(a_id, a_group, in_a, b_id, b_group, in_b, n_a + n_b),
                "pairs": pairs, "times": times}

    def _pairs(self, a_id, a_group, in_a, b_id, b_group, in_b, group_doc, n: int) -> tuple[pa.ListArray, pa.ListArray]:
        """The distinct linked pairs of each document and how many of its links have them."""
        a, b = ((i, g, np.ones(len(i), np.int64)) for i, g in ((a_id, a_group), (b_id, b_group)))
        large = in_a * in_b > _MANY_LINKS
        if large.any():
            a, b = _collapsed(*a, large), _collapsed(*b, large)
        b_count = np.bincount(b[1], minlength=len(in_b))
        b_first = np.cumsum(b_count) - b_count
        repeat = b_count[a[1]]
        i = np.repeat(np.arange(len(a[0])), repeat)
        j = np.arange(len(i)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + b_first[a[1]][i]
        links = pa.table({"doc": group_doc[a[1]][i], "pair": a[0][i].astype(np.int64) * self.width + b[0][j], "times": a[2][i] * b[2][j]})
        found = links.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])
        order = np.argsort(found["doc"].to_numpy(), kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(found["doc"].to_numpy(), minlength=n))].astype(np.int32)
        made = [pa.array(found[c].to_numpy()[order]).cast(kind) for c, kind in (("pair", self.pair), ("times_sum", pa.int64()))]
        return tuple(pa.ListArray.from_arrays(pa.array(ends), v) for v in made)

    def _listing(self, a_id, a_group, in_a, b_id, b_group, in_b, n_tokens) -> pa.Array:
        """Per document its groups as text: ids of the one vocabulary, |, ids of the other, groups parted by a semicolon."""
        a_at = np.arange(len(a_id)) + (np.cumsum(in_b) - in_b)[a_group]
        b_at = np.arange(len(b_id)) + np.cumsum(in_a)[b_group]
        code = np.empty(len(a_id) + len(b_id), np.int64)
        last = lambda g: np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool)
        code[a_at] = a_id.astype(np.int64) * 2 + last(a_group)
        code[b_at] = 2 * len(self.a.bytes) + b_id.astype(np.int64) * 2 + last(b_group)
        text = self.listed.take(pa.array(code))
        ends = np.r_[0, np.cumsum(n_tokens)]
        at = np.frombuffer(text.buffers()[1], np.int32)[ends] if len(code) else np.zeros(len(ends), np.int32)
        data = memoryview(text.buffers()[2] or b"")
        return pa.array([str(data[i:max(i, j - 1)], "ascii") for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())


def _collapsed(ids: np.ndarray, group: np.ndarray, times: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal ids of a large group become one, with their number."""
    some = large[group]
    t = pa.table({"group": group[some], "id": ids[some], "times": times[some]}).group_by(["group", "id"], use_threads=False).aggregate([("times", "sum")])
    ids, group, times = (np.r_[x[~some], t[c].to_numpy()] for x, c in ((ids, "id"), (group, "group"), (times, "times_sum")))
    order = np.argsort(group, kind="stable")
    return ids[order], group[order], times[order]


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row of (doc_id, text).

    ``a`` is a byte-level vocabulary, ``b`` a sentencepiece model (names of public tokenizers or paths). ``groups`` lists
    the groups, ``pairs`` a document's distinct linked pairs as a's id times b's size plus b's id, ``times`` its links
    with each. Texts that are null or empty, or that one of the two does not spell again byte for byte, have no tokens:
    zeros and an empty listing. Rows are independent; repeated rows and null ids count as documents; extra columns
    aren't read. A group's links are counted, not listed one by one, where they are many.
    """
    bounded_batches(docs)
    code = "int" if aligner(a, b).pair == pa.int32() else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, side="right")))
                found = both.align(texts.slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *found.values()], ["doc_id", *found])
                start = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<{code}>, times array<long>")


def pair_counts(aligned: DataFrame, a: str, b: str) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked; best if no pair of the same id of a is in more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        rows = 0
        for batch in batches:
            flat = pc.list_flatten(batch.column(0)).cast(pa.int64())
            if len(flat):
                part = pa.table({"pair": flat}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
                held.append(part.rename_columns(["pair", "n"]))
                rows += len(part)
            if rows > _HELD:
                held = [merged()]
                rows = len(held[0])
                if rows > _HELD // 2:
                    yield from held[0].combine_chunks().to_batches(100_000)
                    held, rows = [], 0
        if held:
            yield from merged().combine_chunks().to_batches(100_000)

    width = aligner(a, b).width
    counts = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # One id of a has at most as many pairs as b has ids, so its window is bounded.
    own = W.partitionBy(F.floor(F.col("pair") / width))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, sent: int = SENT) -> DataFrame:
    """``aligned`` with n_best (links with a best pair) and count_sum (the sum of their pairs' counts over all links).

    The counts go to the tasks in rounds of about ``sent`` pairs; each round adds to both columns.
    """
    rounds = max(1, math.ceil(counts.count() / sent))
    out = aligned.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    context = aligned.sparkSession.sparkContext
    for k in range(rounds):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == k).toArrow()
        pair = part["pair"].to_numpy()
        order = np.argsort(pair)
        table = context.broadcast((pair[order], part["n"].to_numpy()[order], part["best"].to_numpy(zero_copy_only=False)[order]))
        out = out.mapInArrow(_adder(table, out.columns), out.schema)
        if k < rounds - 1:
            out = stored(out, "link-scores")
    return out


def _adder(table, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(names)}
            flat, times = pc.list_flatten(at["pairs"]).to_numpy(), pc.list_flatten(at["times"]).to_numpy()
            ends = np.r_[0, np.cumsum(pc.list_value_length(at["pairs"]).to_numpy())]
            if len(keys):
                found = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                times = np.where(keys[found] == flat, times, 0)
                for name, share in (("count_sum", n[found]), ("n_best", best[found])):
                    run_ = np.r_[0, np.cumsum(times * share)]
                    at[name] = pa.array(at[name].to_numpy() + run_[ends[1:]] - run_[ends[:-1]])
            yield pa.RecordBatch.from_arrays([at[c] for c in names], names)

    return run


def align(docs: DataFrame, a: str, b: str, sent: int = SENT) -> DataFrame:
    """``alignments`` of the documents with their link scores and the SHA-256 of their listing (empty without tokens)."""
    aligned = alignments(docs, a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = stored(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "alignments")
    counts = stored(pair_counts(kept, a, b), "pair-counts")
    return link_scores(kept, counts, sent).drop("pairs", "times")
