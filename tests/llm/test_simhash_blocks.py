"""The pipeline's near copies: every pair of fingerprints within the radius is linked, whatever bits differ."""

import numpy as np
import pytest

from ratebook.llm import simhash
from ratebook.llm.common import roots


def prints(seed=3, lone=300, pairs=400):
    """Lone fingerprints, and pairs that differ in 40 to 56 bits at random places."""
    draw = np.random.default_rng(seed)
    bits = draw.integers(0, 2, (lone + pairs, 256), dtype=np.uint8)
    near = bits[lone:].copy()
    for row in near:
        row[draw.permutation(256)[:draw.integers(40, 57)]] ^= 1
    return np.unique(np.packbits(np.concatenate([bits, near]), axis=1).view(np.uint64), axis=0)


def brute(a, most):
    apart = simhash.distances(a[:, None], a[None])
    return np.nonzero(np.triu(apart <= most, 1))


def groups(u, v):
    of, low = roots(np.asarray(u, np.int64), np.asarray(v, np.int64))
    return {(int(x), int(y)) for x, y in zip(of, low) if x != y}


@pytest.mark.parametrize("block", [1 << 17, 150])
def test_no_pair_within_the_radius_is_left_out(spark, block):
    a = prints()
    i, j = brute(a, simhash.SIMILAR.most)
    assert len(i) > 150
    df = spark.createDataFrame([(bytearray(row.astype(">u8").tobytes()),) for row in a], "fp binary")
    got = simhash.block_links(df, simhash.SIMILAR, block).toPandas()
    ids = simhash.nodes(a)
    assert groups(got.u, got.v) == groups(ids[i], ids[j])


def test_the_operator_links_all_of_them(spark, monkeypatch):
    """Through near_duplicates, whose fingerprints are given here."""
    a = prints(5)
    rows = [(n, bytearray(row.astype(">u8").tobytes())) for n, row in enumerate(a)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, scheme: spark.createDataFrame(rows, "doc_id long, fp binary"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(None).collect()}
    of, low = roots(*brute(a, simhash.SIMILAR.most))
    assert got == {n: n for n in range(len(a))} | {int(x): int(y) for x, y in zip(of, low)}


def test_tiles_and_contraction(monkeypatch):
    monkeypatch.setattr(simhash, "_TILE", 64)
    monkeypatch.setattr(simhash, "_HELD", 50)
    a = prints(7)
    a = np.concatenate([a, a[:1] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))[:, None] * np.array([1, 0, 0, 0], np.uint64)])
    i, j = brute(a, 48)
    assert groups(*simhash.linked_blocks(a, None, 48)) == groups(i, j)
    cut = len(a) // 2
    across = (i < cut) & (j >= cut)
    assert groups(*simhash.linked_blocks(a[:cut], a[cut:], 48)) == groups(i[across], j[across])


def test_pivot_tables_discard_before_the_bits(monkeypatch):
    """A fingerprint whose table says that it is far from all others is linked with none, whatever its bits say."""
    a = prints(9)
    i, j = brute(a, 48)
    table, far = simhash.pivot_table, a[i[0]]
    monkeypatch.setattr(simhash, "pivot_table", lambda p: table(p) + 500 * (p == far).all(axis=1)[:, None])
    kept = (i != i[0]) & (j != i[0])
    assert groups(*simhash.linked_blocks(a, None, 48)) == groups(i[kept], j[kept]) != groups(i, j)
    cut = len(a) // 2
    across = kept & (i < cut) & (j >= cut)
    assert groups(*simhash.linked_blocks(a[:cut], a[cut:], 48)) == groups(i[across], j[across])
