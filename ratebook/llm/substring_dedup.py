"""Removal of repeated passages by relative Lempel-Ziv parsing.

Every window of ``window`` words has an anchor, its smallest word sequence by hash (the leftmost of equal ones).
Neighbouring windows with one anchor make a passage, so each window is in one passage and equal windows are in
passages of equal anchors, at the same distance from them. Passages whose anchor stands elsewhere too are dealt to
reference blocks by anchor. A block is indexed by a suffix array; each passage is factored greedily against the
rest of the block, factors of a window's length or more are repeats, and windows across the border of two factors
are looked up by themselves. Equal passages meet as one with their number; they are repeats as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ratebook.llm.common import bounded_batches, stored

WINDOW, ANCHOR = 35, 8
#: Forms of a passage around one anchor that go to one block; anchors with more have their windows counted one by one.
MOST_FORMS = 4096
#: Words of a reference block, beyond which the next anchor opens another one.
BLOCK_WORDS = 200_000
#: Keys (at most 24 MB of them) that are sent to every task to spare a shuffle; more of them are joined.
MOST_SENT = 1_000_000
_SLICE = 1 << 20
_REMEMBERED = 300_000
_PLACE = np.uint64((1 << 30) - 1)
_BASE = 0x9E3779B97F4A7C15
_KEY = ["_k1", "_k2"]


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    got = list(map(known.get, words))
    if None in got:
        for i, h in enumerate(got):
            if h is None:
                got[i] = h = xxhash.xxh3_64_intdigest(words[i])
                if len(known) < _REMEMBERED:
                    known[words[i]] = h
    return np.array(got, np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        made.append(np.multiply.accumulate(x))
    return tuple(made)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def passages(h: np.ndarray, sizes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, form) of every passage of texts whose word hashes stand in h one after another.

    ``form`` is a hash of the whole passage, ``windows`` + ``window`` - 1 words from ``start`` on.
    """
    n = len(h)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    power, inverse = (p[:n] for p in _powers(1 << max(20, (n - 1).bit_length())))
    run = np.r_[np.uint64(0), np.cumsum(h * power)]
    gram = _mixed((run[anchor:] - run[:-anchor]) * inverse[:n - anchor + 1], 1)
    # The order of the hashes, equal ones by place; how much of a hash decides must not depend on the input's size.
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    span, width = 1, window - anchor + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:span - width], low[width - span:])
    at = (low & _PLACE).astype(np.int64)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.arange(len(at)) + window <= ends[own[:len(at)]]
    new = at[1:] != at[:-1]
    first = np.flatnonzero(whole & np.r_[True, new | ~whole[:-1]])
    last = np.flatnonzero(whole & np.r_[new | ~whole[1:], True])
    count = last - first + 1
    form = _mixed((run[last + window] - run[first]) * inverse[first] + count.astype(np.uint64), 2)
    text = own[first]
    return text, first - (ends - sizes)[text], count, gram[at[first]].view(np.int64), form.view(np.int64)


class Block:
    """A reference block: passages of word numbers, indexed by a suffix array."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.ends = np.cumsum(sizes)
        self.first = self.ends - sizes
        self.own = np.repeat(np.arange(len(sizes)), sizes)
        self.left = self.ends[self.own] - np.arange(len(words))
        # Classes of equal beginnings of 1, 2, 4 ... words; the last ones order the suffixes.
        self.classes = [np.unique(words, return_inverse=True)[1]]
        span = 1
        while len(words) and span < self.left.max():
            c = self.classes[-1]
            after = np.zeros(len(c), np.int64)
            longer = np.flatnonzero(self.left > span)
            after[longer] = c[longer + span] + 1
            self.classes.append(np.unique(c * (c.max() + 2) + after, return_inverse=True)[1])
            span *= 2
        self.order = np.argsort(self.classes[-1], kind="stable")
        self.place = np.empty(len(words), np.int64)
        self.place[self.order] = np.arange(len(words))
        owner = self.own[self.order]
        opens = np.r_[True, owner[1:] != owner[:-1]] if len(words) else np.zeros(0, bool)
        runs = np.flatnonzero(opens)
        run = np.cumsum(opens) - 1
        #: The nearest suffixes before and after each one that belong to another passage.
        self.before = np.r_[-1, runs[1:] - 1][run] if len(words) else runs
        self.after = np.r_[runs[1:], -1][run] if len(words) else runs

    def _common(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and at the places ``at`` of the order begin with alike."""
        j = self.order[at]
        most = np.where(at >= 0, np.minimum(self.left[i], self.left[j]), 0)
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            fits = np.flatnonzero(same + (1 << k) <= most)
            fits = fits[self.classes[k][i[fits] + same[fits]] == self.classes[k][j[fits] + same[fits]]]
            same[fits] += 1 << k
        return same

    def longest(self, i: np.ndarray) -> np.ndarray:
        """Length of the longest match of the words from i on in another passage of the block."""
        place = self.place[i]
        return np.maximum(self._common(i, self.before[place]), self._common(i, self.after[place]))

    def factors(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, start, length) of the greedy factors of the passages ``which``, side by side; a lone word is a factor of 1."""
        found = []
        at = self.first[which]
        while len(which):
            size = np.maximum(1, self.longest(at))
            found.append((which, at, size))
            at = at + size
            going = at < self.ends[which]
            which, at = which[going], at[going]
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))

    def repeated(self, which: np.ndarray, window: int) -> np.ndarray:
        """For each passage of ``which`` its windows that stand in another passage, as bits from its first window on."""
        passage, start, size = self.factors(which)
        starts = [np.repeat(start, np.maximum(0, size - window + 1)) + _counted(np.maximum(0, size - window + 1))]
        order = np.lexsort((start, passage))
        passage, start, size = passage[order], start[order], size[order]
        # A repeated window across a border ends no later than the factor behind the border.
        border = start[1:]
        lowest = np.maximum(start[:-1] + 1, border - window + 1)
        number = np.where(passage[1:] == passage[:-1], np.minimum(border - 1, border + size[1:] - window) - lowest + 1, 0)
        number = np.maximum(0, number)
        across = np.repeat(lowest, number) + _counted(number)
        starts.append(across[self.longest(across) >= window])
        starts = np.concatenate(starts)
        bits = np.zeros(len(self.ends), np.int64)
        np.bitwise_or.at(bits, self.own[starts], np.int64(1) << (starts - self.first[self.own[starts]]))
        return bits[which]


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _key(text: Column) -> list[Column]:
    """96 bits of a text."""
    return [F.xxhash64(text).alias(_KEY[0]), F.hash(text, F.lit(7)).alias(_KEY[1])]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + _SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _anchored(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(k1, k2, start, windows, anchor, form) of every passage of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for batch in _slices(whole, 2):
                words = [(t or "").encode().split() for t in batch.column(2).to_pylist()]
                sizes = np.array([len(w) for w in words], np.int64)
                text, start, count, at, form = passages(word_hashes([w for ws in words for w in ws], known), sizes, window, anchor)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(count, pa.int32()),
                     pa.array(at), pa.array(form)], [*_KEY, "start", "windows", "anchor", "form"])

    return docs.select(*_KEY, "text").mapInArrow(run, "_k1 long, _k2 int, start int, windows int, anchor long, form long")


def _matching(rows: DataFrame, keys: DataFrame, on: list[str], most_sent: int) -> DataFrame:
    """Rows whose key is among the distinct ``keys``: looked up in every task if they are few, else joined."""
    small = keys.count() <= most_sent
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi")


def _contents(docs: DataFrame, forms: DataFrame, window: int, most_sent: int) -> DataFrame:
    """``forms`` with the words of each, read from the text that their smallest occurrence names."""
    wanted = stored(forms.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "form", "n", "start", "windows")).alias("wanted")), "wanted-forms")
    texts = _matching(docs.select(*_KEY, "text"), wanted.select(*_KEY), _KEY, most_sent).dropDuplicates(_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 0):
                out = []
                for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = text.encode().split()
                    out += [{"anchor": w["anchor"], "form": w["form"], "n": w["n"], "windows": w["windows"],
                             "words": b" ".join(words[w["start"]:w["start"] + w["windows"] + window - 1]).decode()} for w in wanted]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("anchor", pa.int64()), ("form", pa.int64()), ("n", pa.int64()),
                                                                 ("windows", pa.int32()), ("words", pa.string())]))

    return texts.join(wanted, _KEY).select("text", "wanted").mapInArrow(run, "anchor long, form long, n long, windows int, words string")


def _factored(forms: DataFrame, window: int, block_words: int) -> DataFrame:
    """(anchor, form, bits) of the forms that occur once, by parsing them against the block of their anchor."""

    def parse(rows: pd.DataFrame) -> pd.DataFrame:
        words = [w.encode().split() for w in rows["words"]]
        number: dict[bytes, int] = {}
        x = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
        single = np.flatnonzero(rows["n"].to_numpy() == 1)
        bits = Block(x, np.array([len(w) for w in words], np.int64)).repeated(single, window)
        return rows.iloc[single][["anchor", "form"]].assign(bits=bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += int((pdf["windows"] + window - 1).sum())
            if size > block_words:  # all but the last anchor, which may go on
                rows = pd.concat(held, ignore_index=True)
                whole = (rows["anchor"] != rows["anchor"].iloc[-1]).to_numpy()
                if whole.any():
                    yield parse(rows[whole].reset_index(drop=True))
                held = [rows[~whole].reset_index(drop=True)]
                size = int((held[0]["windows"] + window - 1).sum())
        if size:
            yield parse(pd.concat(held, ignore_index=True))

    dealt = forms.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(run, "anchor long, form long, bits long")


def _counted_windows(forms: DataFrame, window: int) -> DataFrame:
    """The same for anchors of very many forms: each window is its own passage and counted, wherever it lies."""
    words = F.split("words", " ")
    rows = forms.select("anchor", "form", "n", words.alias("w"), F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("j"))
    window_words = F.slice("w", F.col("j") + 1, F.lit(window))
    rows = rows.select("anchor", "form", "n", "j", F.xxhash64(window_words).alias("w1"), F.xxhash64(F.lit(1), window_words).alias("w2"))
    often = rows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    return (rows.where("n = 1").join(often, ["w1", "w2"]).groupBy("anchor", "form")
            .agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits")))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_forms: int = MOST_FORMS,
            block_words: int = BLOCK_WORDS, most_sent: int = MOST_SENT) -> DataFrame:
    """(k1, k2, spans): for each text, by its key, the starts of passages with repeated windows and which of them are.

    ``docs`` has the keys and the text. Bit j of ``bits`` stands for the window from word ``start`` + j on.
    """
    found = _anchored(docs, window, anchor)
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    occurrences = stored(_matching(found, often, ["anchor"], most_sent), "passages")
    forms = stored(occurrences.groupBy("anchor", "form").agg(
        F.count("*").alias("n"), F.min(F.struct(*_KEY, "start", "windows")).alias("at")).select("anchor", "form", "n", "at.*"), "forms")
    per_anchor = forms.groupBy("anchor").agg(F.count("*").alias("forms")).where("forms > 1")
    mixed = _contents(docs, forms.join(per_anchor.select("anchor"), "anchor", "left_semi"), window, most_sent)
    many = per_anchor.where(F.col("forms") > most_forms).select("anchor")
    mixed = stored(mixed.join(many.withColumn("many", F.lit(True)), "anchor", "left"), "reference-passages")
    parts = [
        forms.where("n > 1").select("anchor", "form", (F.expr("shiftleft(1L, windows)") - 1).alias("bits")),
        _factored(mixed.where("many IS NULL").drop("many"), window, block_words),
        _counted_windows(mixed.where("many").drop("many"), window),
    ]
    bits = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("bits <> 0")
    return (occurrences.select(*_KEY, "start", "anchor", "form").join(bits, ["anchor", "form"]).select(*_KEY, "start", "bits").distinct()
            .groupBy(*_KEY).agg(F.collect_list(F.struct("start", "bits")).alias("spans")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_forms: int = MOST_FORMS,
                   block_words: int = BLOCK_WORDS, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: the text without the words of windows that start elsewhere too.

    Words are what lies between ASCII white space, unchanged; ``kept`` joins those left by one space. A window is
    ``window`` words of one document; it goes wherever its words start at another place, in the same document or
    not, so of copies none is spared. Null and empty texts, and those of fewer words than a window, lose nothing
    (null: no words, kept is empty); repeated rows are copies of each other; null ids stay; extra columns aren't
    read. Passages are held equal by 128 bits of hash, texts by 96; parsing compares the words themselves.
    """
    if window - anchor + 1 > 62:
        raise ValueError("a passage holds at most 62 windows")
    bounded_batches(docs)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_key(text))
    spans = stored(repeats(docs.where("text IS NOT NULL"), window, anchor, most_forms, block_words, most_sent), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                kept, n_words, n_kept = [], [], []
                for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    words = (t or "").encode().split()
                    n_words.append(len(words))
                    if found:
                        bits = np.array([f["bits"] for f in found], np.int64)
                        starts = np.concatenate([f["start"] + np.flatnonzero(bits[i] >> np.arange(62) & 1) for i, f in enumerate(found)])
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    n_kept.append(len(words))
                    kept.append(b" ".join(words).decode())
                n = np.array(n_words, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n - np.array(n_kept, np.int64)), pa.array(kept, pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept"])

    keys = spans.select(*_KEY)
    if keys.count() <= most_sent:  # texts without repeats stay where they are
        hit = docs.join(F.broadcast(keys), _KEY, "left_semi").join(spans, _KEY)
        rest = docs.join(F.broadcast(keys), _KEY, "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
        docs = hit.select("doc_id", "text", "spans").unionByName(rest.select("doc_id", "text", "spans"))
    else:
        docs = docs.join(spans, _KEY, "left").select("doc_id", "text", "spans")
    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
