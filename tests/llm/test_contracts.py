"""Every corpus query over whole tables against a plain version."""

import hashlib
import re
import zlib
from collections import defaultdict

import base64
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from ratebook.llm import queries

Q = queries.queries()


@pytest.fixture(scope="module")
def rows(data):
    return lambda name: pq.read_table(f"{data}/{name}.parquet").to_pylist()


def result(spark, data, name):
    return [r.asDict() for r in Q[name](spark, data).collect()]


def components(nodes, links):
    low = {n: n for n in nodes}

    def top(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        low[b] = a
    return {n: top(n) for n in nodes}


def test_op1_is_the_text_of_the_article(spark, data, rows):
    import html

    got = {r["page_id"]: r for r in result(spark, data, "op1_html_text")}
    pages = rows("pages")
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        text = re.sub(r"</?(?:p|h1|br)>", " ", article)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", text)).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_op2_has_all_base_spans(spark, data, rows):
    got = {r["doc_id"]: r for r in result(spark, data, "op2_secret_scan")}
    kinds = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    some = 0
    for d in rows("documents"):
        spans, n = [], {}
        for i, (kind, pattern) in enumerate(kinds.items()):
            found = [m for m in pattern.finditer(d["text"] or "")
                     if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]]
            n[kind] = len(found)
            spans += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in found]
        listed = ",".join(s for _, _, s in sorted(spans))
        r = got[d["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(n.values())
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(",")) and r["n_weak"] == len(r["spans"].split(",")) * (r["spans"] != "") - len(spans)
        some += len(spans)
    assert some


def test_op3_reads_back_every_id(spark, data, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in result(spark, data, "op3_token_files")}
    start = 0
    for d in sorted(rows("documents"), key=lambda d: d["doc_id"]):
        ids = np.array(tok.encode(d["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[d["doc_id"]] == {"doc_id": d["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def plain_print(text, k, seed=42):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), seed) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op4_links_all_near_fingerprints(spark, data, rows):
    docs = rows("documents")
    prints = {d["doc_id"]: plain_print(d["text"], 4) for d in docs}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components(ids, links)
    got = result(spark, data, "op4_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_op6_learns_the_languages(spark, data, rows):
    got = {r["doc_id"]: r for r in result(spark, data, "op6_language_id")}
    docs = rows("documents")
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, d["text"] or "")))
    held = [d for d in docs if got[d["doc_id"]]["held_out"] and d["lang"] and got[d["doc_id"]]["lang_pred"] != "und"]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.95
    assert np.mean([r["rejected"] for r in got.values()]) < 0.02


def test_op7_packs_every_piece_once(spark, data, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(result(spark, data, "op7_packing"), key=lambda r: (r["doc_id"], r["piece"]))
    want = []
    for d in sorted(rows("documents"), key=lambda d: d["doc_id"]):
        ids = np.array(tok.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d["doc_id"], i, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for i, a in enumerate(range(0, len(ids), 4096))]
    assert [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_op8_finds_all_links(spark, data, rows):
    vectors = rows("embeddings")
    ids = [v["vec_id"] for v in vectors]
    x = np.array([v["embedding"] for v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in result(spark, data, "op8_embedding_join")}
    assert got == {i: (int(n), want[i], want[i] == i) for i, n in zip(ids, near.sum(axis=1))}


def test_op9_reads_back_every_record_in_order(spark, data, rows):
    pages = rows("pages")
    last = {}
    for p in pages:
        last[p["html"] or ""] = max(last.get(p["html"] or "", -1), p["page_id"])
    got = result(spark, data, "op9_warc")
    want = {p["page_id"]: (len((p["html"] or "").encode()), base64.b32encode(hashlib.sha1((p["html"] or "").encode()).digest()).decode(),
                           *(("response", None) if last[p["html"] or ""] == p["page_id"] else ("revisit", last[p["html"] or ""]))) for p in pages}
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(pages)
    keys = [(r["urlkey"].encode(), r["timestamp"], r["page_id"]) for r in got]
    assert keys == sorted(keys)


def test_op10_hits_every_window(spark, data, rows):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for b in rows("benchmark"):
        w = words(b["text"])
        for i in range(min(1, len(w)) if len(w) < 10 else len(w) - 9):
            windows[tuple(w[i:i + 10])].add(b["item_id"])
    sizes = {len(p) for p in windows}
    got = {r["doc_id"]: r for r in result(spark, data, "op10_decontamination")}
    some = 0
    for d in rows("documents"):
        w, hit, items = words(d["text"]), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    items |= windows[tuple(w[i:i + k])]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert got[d["doc_id"]] == {"doc_id": d["doc_id"], "n_words": len(w), "n_hit": len(hit), "n_items": len(items),
                                    "items_sha256": digest, "contaminated": bool(hit)}
        some += bool(hit)
    assert some


def test_pipeline_stages_do_their_part(spark, data, rows, tmp_path):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
    before = {d["doc_id"]: d for d in rows("documents")}
    assert set(seen["language_id"].doc_id) >= {i for i, d in before.items() if len((d["text"] or "").split()) > 20}
    assert len(seen["line_dedup"]) == len(seen["language_id"])
    texts = [t for t in seen["line_dedup"].text if t]
    assert set(seen["simhash"].text) >= {t for t in texts if len(t.split()) > 400 and texts.count(t) > 1}
    assert seen["simhash"].text.is_unique
    ends = {tuple(re.findall(r"[^\W_]+", (b["text"] or "").lower()))[:10] for b in rows("benchmark")}
    for t in seen["decontamination"].text:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        assert not any(tuple(w[i:i + 10]) in ends for i in range(len(w)))
    assert set(seen["packing"].doc_id) == set(seen["decontamination"].doc_id)
    assert (seen["decontamination"].n_chars == seen["decontamination"].text.str.len()).all()
