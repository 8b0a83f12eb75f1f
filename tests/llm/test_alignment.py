"""Alignment of two tokenizers against the plain definition, with the libraries' own ids."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ratebook.llm import alignment, queries

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path(B))


def by_hand(libraries, texts):
    lib_a, lib_b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    docs, count = [], Counter()
    for text in texts:
        groups = []
        if text:
            ia, ib = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)
            ba = [bytes(byte[c] for c in lib_a.id_to_token(i)) for i in ia]
            bb = [bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == b" " + text.encode():
                ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (ba, bb))
                shared = sorted(set(ends_a) & set(ends_b))
                at = {e: n for n, e in enumerate(shared)}
                groups = [([], []) for _ in shared]
                for side, (ids, ends) in enumerate(((ia, ends_a), (ib, ends_b))):
                    for i, e in zip(ids, ends):
                        groups[at[min(x for x in shared[max(0, at.get(e, 0)):] if x >= e)]][side].append(i)
        docs.append(groups)
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        listing = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(listing.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(df, **more):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, A, B, **more).collect()}


def test_merges_give_the_librarys_ids(libraries):
    draw = random.Random(5)
    a = alignment.SpacedEncoder(public_tokenizers.path(A))
    for _ in range(4000):
        text = "".join(draw.choice("ab éΣ.,\n\t '’-_)(1½İ日#$  \r\xa0\x00▁<s>{;ll") for _ in range(draw.randint(1, 16)))
        assert a.encode(text) == libraries[0].encode(" " + text, add_special_tokens=False).ids, repr(text)


ODD = [None, "", " ", "\n", "a", "▁x", "a  b \n c", "日本語のテキスト 日本", "x<|endoftext|>y <s>", "tab\there\r\nend ", "word " * 3000 + "end",
       "é́ \x00 ﻿z", "🙂🙂🙂 ok", "q" * 500, "the cat the cat the cat", "the cat the cat the cat"]


def test_odd_texts_and_rounds(spark, libraries):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int")
    want = dict(enumerate(by_hand(libraries, ODD)))
    assert aligned(df) == want
    assert aligned(df, sent=7) == want  # many rounds of counts
    assert alignment.align(df.limit(0), A, B).count() == 0
    again = alignment.align(df.where("doc_id >= 14").selectExpr("CAST(NULL AS long) AS doc_id", "text"), A, B).collect()
    assert [r["count_sum"] for r in again] == [2 * again[0]["n_links"]] * 2


def test_large_groups_count_their_links(libraries, monkeypatch):
    both = alignment.aligner(A, B)
    texts = ["日本語のテキスト " * 40, "plain words here, and more of them."]
    want = both.align(texts)
    monkeypatch.setattr(alignment, "_MANY_LINKS", 0)
    got = both.align(texts)
    for c in want:
        if c in ("pairs", "times"):
            continue
        assert got[c].to_pylist() == want[c].to_pylist()
    for d in range(2):
        pairs = lambda x: sorted(zip(x["pairs"][d].as_py(), x["times"][d].as_py()))
        assert pairs(got) == pairs(want)


def test_op11_over_all_documents(spark, data, libraries):
    rows = pq.read_table(f"{data}/documents.parquet").to_pylist()
    want = {r["doc_id"]: w for r, w in zip(rows, by_hand(libraries, [r["text"] for r in rows]))}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, data).collect()}
    assert got == want and any(w[3] for w in want.values())
