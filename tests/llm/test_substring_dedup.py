"""Repeated passages against a table of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from ratebook.llm import queries, substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(texts, window=35):
    split = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def removed(df, **more):
    return sorted((tuple(r) for r in S.remove_repeats(df, **more).collect()), key=str)


def corpus(draw, n, vocabulary, window):
    """Texts of common passages, near copies, exact copies and runs."""
    word = lambda: draw.choice(vocabulary)
    shared = [[word() for _ in range(draw.randint(window // 2, 4 * window))] for _ in range(4)]
    texts = []
    for _ in range(n):
        w = [word() for _ in range(draw.randint(0, 3 * window))]
        for _ in range(draw.randint(0, 2)):
            p = list(draw.choice(shared))
            for _ in range(draw.randint(0, 2)):
                p[draw.randrange(len(p))] = word()
            at = draw.randint(0, len(w))
            w[at:at] = p
        texts.append(draw.choice([" ", "  ", "\n"]).join(w))
    return texts + texts[:n // 5] + ["x " * 4 * window, "a b " * 2 * window, None, "", " \n", "é\x1c\xa0y " * 3 * window]


@pytest.mark.parametrize("window, vocabulary, more", [
    (35, 400, {}), (35, 400, {"most_forms": 1}), (35, 400, {"block_words": 100, "most_sent": 0}), (12, 2, {}), (12, 3, {"most_forms": 2})])
def test_same_words_as_all_windows(spark, window, vocabulary, more):
    draw = random.Random(window + vocabulary)
    texts = corpus(draw, 60, [f"w{i}" for i in range(vocabulary)], window)
    df = spark.createDataFrame([(i if i % 9 else None, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, start int, anchor string").repartition(5)
    want = sorted(((i if i % 9 else None, n, r, k) for i, (n, r, k) in enumerate(by_hand(texts, window))), key=str)
    assert removed(df, window=window, **more) == want
    assert sum(r for _, _, r, _ in want) and any(0 < r < n for _, n, r, _ in want)


def test_factors_are_greedy_and_cover():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 30)
    x = rng.integers(0, 3, sizes.sum())
    block = S.Block(x, sizes)
    parts = np.split(x, np.cumsum(sizes)[:-1])

    def longest(p, i):
        best = 0
        for q, other in enumerate(parts):
            for j in range(len(other) if q != p else 0):
                k = 0
                while i + k < len(parts[p]) and j + k < len(other) and parts[p][i + k] == other[j + k]:
                    k += 1
                best = max(best, k)
        return best

    passage, start, size = block.factors(np.arange(30))
    for p in range(30):
        at = 0
        for s, k in sorted(zip(start[passage == p] - block.first[p], size[passage == p])):
            assert s == at and k == max(1, longest(p, at))
            at += k
        assert at == sizes[p]
    for window in (3, 5, 8):
        bits = block.repeated(np.arange(30), window)
        for p in range(30):
            assert [bool(bits[p] >> i & 1) for i in range(len(parts[p]))] == [longest(p, i) >= window for i in range(len(parts[p]))]


def test_no_texts(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert S.remove_repeats(df.limit(0)).count() == 0
    assert removed(df) == [(1, 3, 0, "a b c")]


def test_op13_over_all_documents(spark, data):
    rows = pq.read_table(f"{data}/documents.parquet").to_pylist()
    want = {d["doc_id"]: (n, r, hashlib.sha256(k.encode()).hexdigest()) for d, (n, r, k) in zip(rows, by_hand([d["text"] for d in rows]))}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op13_substring_dedup(spark, data).collect()}
    assert got == want and any(w[1] for w in want.values())
