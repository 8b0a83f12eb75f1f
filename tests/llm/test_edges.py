"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and pieces by brute force."""

import base64
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratebook.llm import (
    common, decontamination, embedding_join, html_text, language_id, line_dedup, packing, queries, secret_scan, simhash, token_files, tokens, warc,
)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, n_removed int, rejected int, n_words int, "
          "length string, row int, node int, hash int, host int")
LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "   ", "!!! ###", LONG, "One line that many sites have got.\nAnd more.", "a\tb\r\nc  d", "ΣΊΣΥΦΟΣ İstanbul é"]
    rows = [(i, t, ["en", None, "fr"][i % 3], f"s{i}" if i % 4 else None, None) for i, t in enumerate(texts)]
    rows += rows[:6] + [(None, "no id at all here", "en", "s", 1)] * 2 + [(20 + i, "One line that many sites have got.", "en", f"t{i}", 3) for i in range(6)]
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, "x", 4, 5, 6, 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word word word"), (2, None), (3, ""), (None, "no id at all here")], "item_id long, text string")


def empty(df):
    return df.limit(0)


def test_documents_of_every_kind(spark, odd, items):
    n = odd.count()
    runs = {
        "secrets": lambda d: secret_scan.scan(d),
        "tokens": lambda d: token_files.read_token_files(spark, token_files.write_token_files(d, "byte_bpe_50k.json", 0)),
        "prints": lambda d: simhash.near_duplicates(d, simhash.EXACT),
        "similar": lambda d: simhash.near_duplicates(d),
        "lines": lambda d: line_dedup.remove_boilerplate(d),
        "language": lambda d: language_id.predict(d, language_id.fit(d)),
        "search": lambda d: decontamination.report(decontamination.search(d, items)),
        "removal": lambda d: decontamination.remove_hits(d, items),
    }
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(empty(odd)).count() == 0, name
    packed = packing.pack_documents(odd, "word_bpe_49k.json", 1)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack_documents(empty(odd), "word_bpe_49k.json", 1).count() == 0


def test_stages_keep_columns_and_clashing_values(spark, odd, data):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, data)
        if name != "packing":
            assert out.columns == odd.columns
            assert out.select("score", "n_removed", "n_words", "length").distinct().collect() == [(0.5, 1, 4 - 1, "x")]
        assert stage(spark, empty(odd), data).count() == 0
    left = corpus_pipeline.near_duplicates(spark, odd, data)
    assert left.where("doc_id IS NULL").count() == 1 and left.where("doc_id = 0").count() == 1
    apart = odd.limit(0).unionByName(spark.createDataFrame(
        [(1, "one text about the harbour and the ships in it"), (1, "quite another text on bread, salt and butter"), (None, "a third one, which nobody has given a number")] * 2,
        "doc_id long, text string"), allowMissingColumns=True)
    assert corpus_pipeline.near_duplicates(spark, apart, data).select("doc_id", "text").distinct().count() == 3
    assert corpus_pipeline.near_duplicates(spark, apart, data).count() == 3


def test_lines_stay_in_their_first_document(odd):
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(odd).collect()}
    assert got[5]["text"] == "One line that many sites have got.\nAnd more." and got[5]["n_removed"] == 0
    assert all(got[i]["text"] == "" and got[i]["n_removed"] == 1 for i in range(20, 26)) and got[0]["text"] is None


def test_joined_lines_are_those_looked_up(spark, odd, data):
    for docs in (odd, spark.read.parquet(f"{data}/documents.parquet")):
        ways = [line_dedup.remove_boilerplate(docs, min_sites=3, most_sent=n) for n in (0, 10 ** 6)]
        assert ways[0].exceptAll(ways[1]).count() == 0 and ways[1].exceptAll(ways[0]).count() == 0
        assert ways[0].where("n_removed > 0").count() > 0


def test_indented_and_short_lines_have_one_answer(spark):
    line = "Share this page with friends"
    rows = [(i, f"    {line}", f"s{i}") for i in range(6)] + [(50, line, "s50"), (51, f"{line}\n    {line}  \n x", "s51"), (52, "    Share this", "s52")]
    rows += [(60 + i, "       Share", f"u{i}") for i in range(7)]  # spaces around a line make no words
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted((r[0], r[2], r[3]) for r in con.sql(queries.oracle_sql()["op5_line_dedup"]).select("doc_id, n_lines, n_removed, n_chars_kept").fetchall())
    for most in (0, 10 ** 6):
        got = sorted((r["doc_id"], r["n_removed"], len(r["text"])) for r in line_dedup.remove_boilerplate(df, most_sent=most).collect())
        assert got == want
    assert (50, 1, 0) in want and (51, 2, 2) in want and (52, 0, 14) in want and (60, 0, 12) in want


def test_secrets_need_their_complement(spark):
    rows = [(1, "user: alice1 pwd: hunter2x"), (2, "pwd: hunter2x"), (3, "user: alice1" + " " * 400 + "pwd: hunter2x"),
            (4, "user: alice1\n\npwd: hunter2x"), (5, "db at postgres://h/x, pass = abcd1"), (6, "token = 0123456789abcdef0")]
    got = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_weak"] for i in range(1, 7)] == [1, 0, 0, 0, 1, 0]
    assert got[1]["spans"] == "weak:13:26" and got[6]["spans"] == "assign:0:25,hex:8:25"


def test_secrets_of_long_texts_and_repeated_rows(spark):
    text = "\n\n".join(f"user: alice{i} pwd: hunter{i}x token=0123456789abcdef{i:04d} pass: {'z' * (i % 9)}" for i in range(20_000))
    base = secret_scan.base_spans(text)
    started = time.perf_counter()
    found = secret_scan.parts(text, base)
    assert time.perf_counter() - started < 5  # was quadratic: minutes
    few = text[:text.index("user: alice300 ")]
    base = secret_scan.base_spans(few)
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", few)]
    for role, scope, a, b in secret_scan.parts(few, base):
        assert scope == sum(at < a for at in breaks)
        assert role != "weak" or not any(a < e and s < b for k, s, e in base if k == "assign")
    assert found[:200] == [p for p in found[:200] if p[0] == "weak"] and len({p[1] for p in found}) == 20_000
    rows = [(1, "user: alice1 pwd: hunter2x")] * 3 + [(None, "user: alice1 pwd: hunter2x"), (None, "pwd: hunter2x"), (1, "pwd: hunter2x")]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_weak"], r["spans"]) for r in got) == [
        (0, 0, ""), (0, 1, "weak:13:26"), (1, 0, ""), *[(1, 1, "weak:13:26")] * 3]


def test_token_blocks_and_selection():
    rng = np.random.default_rng(0)
    for values in ([], [0], [0, 0, 5], np.sort(rng.integers(0, 10 ** 6, 1000)), np.arange(300) * 3, [7] * 100, [0] * 64 + [2 ** 40], [9] * 128):
        ef, _ = token_files.EliasFano.load(memoryview(token_files.EliasFano.of(np.array(values)).dump()), 0)
        assert list(ef) == [ef.select(i) for i in range(len(values))] == list(values)
    blob = token_files.pack_block([None, -5, 3], [b"\x01\x00", b"", b"\x02\x00\x03\x00"], np.dtype("<u2"))
    ids, bounds, words = token_files.unpack_block(blob)
    assert (list(ids), list(bounds), words.tolist()) == ([None, -5, 3], [0, 1, 1, 3], [1, 2, 3])


@pytest.mark.parametrize("name, byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_give_the_librarys_ids(name, byte_level):
    enc, draw = tokens.encoder(name, byte_level), random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice("ab éΣ.,\n\t '’-_)(1½İ日#$  \r\xa0\x1c") for _ in range(draw.randint(1, 14)))
        want = enc.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), enc.kind).tolist() == want, text


def test_packing_of_hard_lengths():
    for counts in ({4096: 3}, {2049: 5, 2047: 2, 1: 3}, {1366: 9, 1365: 4, 7: 1}, {i: 2 for i in range(1, 4097, 37)}):
        found = packing.fillings(counts, 4096)
        used = {}
        for lengths, times in found:
            assert sum(lengths) <= 4096
            for size in lengths:
                used[size] = used.get(size, 0) + times
        assert used == counts
        bound = max(-(-sum(k * n for k, n in counts.items()) // 4096), sum(n for k, n in counts.items() if k > 2048))
        assert sum(t for _, t in found) <= bound + 1
    draw = random.Random(7)
    for low, high, n in ((820, 2049, 500), (1100, 1699, 600), (1, 4096, 300), (500, 900, 400)):
        for _ in range(5):
            lengths = [draw.randint(low, high) for _ in range(n)]
            counts = {k: lengths.count(k) for k in set(lengths)}
            bins = []
            for size in sorted(lengths, reverse=True):  # item by item
                fit = min((b for b in bins if b >= size), default=None)
                if fit is None:
                    bins.append(4096 - size)
                else:
                    bins.remove(fit)
                    bins.append(fit - size)
            plain = packing.best_fit(counts, 4096)
            used = {}
            for held, times in plain:
                for size in held:
                    used[size] = used.get(size, 0) + times
            assert used == counts and sum(t for _, t in plain) == len(bins)
            assert sum(t for _, t in packing.fillings(counts, 4096)) <= len(bins)
    assert packing.fillings({3: 4, 2: 4}, 5, None) == [([3, 2], 4)]


def test_chunks_of_a_large_key_lose_no_link(spark):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    for _ in range(600):
        x = rng.choice(np.array(list(prints), np.uint64))
        for b in rng.integers(0, 62, 3):
            x ^= np.uint64(1) << np.uint64(b)
        prints.add(int(x))
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(bytearray(int(p).to_bytes(8, "big")),) for p in prints], "fp binary")
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 4)
    want = dict(zip(*(x.tolist() for x in common.roots(i, j))))
    for chunk in (4096, 20):
        links = simhash.near_links(df, simhash.EXACT, chunk).toPandas()
        got = dict(zip(*(x.tolist() for x in common.roots(links.u.to_numpy(), links.v.to_numpy()))))
        groups = {}
        for n, p in enumerate(prints.view(np.int64).tolist()):
            groups.setdefault(want[n], set()).add(got.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3)] + [(300 + i, 400 - i) for i in range(10)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 180)) and got[400] == 300


def test_vectors_of_every_kind(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]),
            (9, [1.0, 2.0, 3.0]), (None, [0.0, 1.0]), (11, [-1.0, 0.0]), (12, [1e-200, 0.0]), (3, [1.0, 0.0]), (13, [0.0, float("inf")])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicates(df).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (12, 4, 1, False), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 11, 13)]
    longer = spark.createDataFrame([(20, [1.0, 2.0, 3.0], "x"), (21, [1.0], "x"), (22, [5.0], "x")], df.schema)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_duplicates(df.unionByName(longer)).collect()}
    assert (found[9], found[20], found[21], found[22], found[1]) == ((1, 9), (1, 9), (1, 21), (1, 21), (4, 1))
    assert got == sorted(want, key=str)
    assert embedding_join.near_duplicates(empty(df)).count() == 0


def test_small_blocks_join_like_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 6)).repeat(10, axis=0) + rng.normal(size=(300, 6)) * 0.15
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    small = embedding_join.near_duplicates(df, leading=2, block_rows=16, leaf=4).orderBy("vec_id").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r.n_links for r in small] == ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()


def test_pages_of_every_kind(spark):
    menu = "<div><p>Home sweet home</p></div>"
    rows = [(i, f"http://h.com/{i}", f"<body>{menu}<p>Page  {i}&amp;more<br>x<b>y</b>z</p><form>f</form></body>") for i in range(25)]
    rows += [(100, None, None), (101, "u", ""), (102, "http://h2.com", f"<body>{menu}a<script>var x='</p>'</script><!-- c -->b</body>"),
             (103, "http://h2.com", "<nav>m</nav><article><h1>T</h1><div class='comments'>no</div>t<p>u<p>v</article>out"), (103, "x", "a &lt;b&gt; <"),
             (104, "y", "<div class=\"sidebar x\">s</div><p hidden>h</p><p>k" + " w" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {(r.page_id, r.url): r for r in html_text.extract(df).collect()}
    assert len(got) == len(rows)
    assert got[3, "http://h.com/3"].text == "Page 3&more xyz"
    assert (got[100, None].text, got[101, "u"].text) == ("", "")
    assert got[102, "http://h2.com"].text == "Home sweet home ab"
    assert (got[103, "http://h2.com"].text, got[103, "x"].text) == ("T t u v", "a <b> <")
    assert got[104, "y"].text == "k" + " w" * 100_000 and got[104, "y"].n_chars == 200_001
    assert html_text.extract(empty(df)).count() == 0


def test_hostile_pages_are_read_in_linear_time():
    import time

    for page, want in (("x" + "<a " * 20_000, "x"), ("<div>" * 20_000 + "deep " * 40_000, ("deep " * 40_000).strip()),
                       ("<b>y " * 20_000 + "</i>" * 20_000, ("y " * 20_000).strip()), ("<p>z</div>" * 20_000, ("z " * 20_000).strip()),
                       ('<a t="' * 20_001 + ">q", "q"), ("<!--" * 20_000, "")):
        began = time.perf_counter()
        assert html_text.parse(page)[0] == want
        assert time.perf_counter() - began < 2
    assert html_text.parse("<p title=don't>keep me</p><p class='x'>and me</p>1 < 2 <3")[0] == "keep me and me 1 < 2 <3"
    assert html_text.parse("<article><div class='social-history'>a</div><p id='related-work'>b</p><div class='share'>c</div></article>")[0] == "a b"


def test_templates_are_learned_without_markup(spark):
    """Menus, notices and footers of unmarked elements, some with other words on every page, and articles in a plain block."""
    draw = random.Random(8)
    words = lambda n: " ".join(draw.choice("abcdefghij") * draw.randint(2, 7) for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        host = "http://a.org" if i % 3 else "http://b.net"
        body = [words(draw.randint(30, 60)) for _ in range(draw.randint(1, 4))]
        title = words(4)
        story = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body)
        rows.append((i, f"{host}/{i}", f"<body><div id=top><ul><li>Home<li>{words(1)}</ul></div><div class=wrap><div class=story>{story}</div>"
                                       f"<div class=hint>{words(5)}</div></div><div>All rights reserved</div></body>"))
        want[i] = " ".join([title, *body])
    rows += [(500, "http://few.com/x", "<body><div id=top>Home</div><div class=wrap>rare</div></body>")]
    rows += [(600 + i, f"http://copies.com/{i}", "<body><div class=story><h1>Same</h1><p>The same article, sixty times over.</p></div></body>") for i in range(60)]
    plain = [(700 + i, f"http://plain.com/{i}", f"<body><h1>{words(3)}</h1>" + "".join(f"<div class=sec>{words(30)}</div>" for _ in range(6)) + "</body>") for i in range(30)]
    rows += plain
    want |= {i: " ".join(re.sub("<[^>]*>", " ", page).split()) for i, _, page in plain}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for markup in (True, False):
        got = {r.page_id: r.text for r in html_text.extract(df, markup=markup).collect()}
        assert {i: got[i] for i in want} == want
        assert got[500] == "Home rare" and got[600] == "Same The same article, sixty times over."


def test_articles_found_by_templates_alone(spark, data):
    pages = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/pages.parquet")
    marked, learned = ({r.page_id: r for r in html_text.extract(pages, markup=m).collect()} for m in (True, False))
    hosts = {}
    for r in marked.values():
        hosts.setdefault(r.url.split("/")[2].lower(), []).append(r.page_id)
    ids = [i for v in hosts.values() if len(v) >= 20 for i in v]
    assert len(ids) > 1500 and all(learned[i].text == marked[i].text for i in ids)


def test_other_languages_and_no_languages_are_rejected(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    held_out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out))
    apart = language_id.predict(docs.where(held_out & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]")), model)
    assert apart.where("rejected").count() == 0 and apart.count() > 200
    draw = random.Random(0)
    odd = [base64.b64encode(draw.randbytes(375)).decode(), "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес. " * 8,
           "今天天气很好我们一起去公园散步吧" * 35, "def f(x):\n    return [i ** 2 for i in range(x) if i % 3 == 0]\n\nclass A(object):\n    pass\n" * 6,
           "Det var en gång en gammal man som bodde i ett litet hus vid skogen och han hade en katt som hette Måns. " * 5]
    assert all(model.predict(t)[2] for t in odd) and min(map(len, odd)) >= 500


def test_archives_of_every_kind(spark, tmp_path):
    bodies = ["", None, "x", "x", "a\r\n\r\nb", "end\r\n", "end\r\n\r\n", "\r\n\r\n\r\n", "é" * 50_000, "WARC/1.1\r\n\r\n"]
    rows = [(i, f"http://www.a.com:80/{i % 3}?q", b) for i, b in enumerate(bodies)] + [(None, None, "x"), (3, "http://b.com", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int")
    got = warc.read_archives(spark, warc.write_archives(df)).collect()
    assert sorted(str((r.page_id, r.payload_bytes)) for r in got) == sorted(str((i, len((b or "").encode()))) for i, _, b in rows)
    by = {r.page_id: r for r in got if r.page_id != 3}
    assert (by[0].record_type, by[0].refers_to, by[1].record_type, by[2].refers_to, by[None].refers_to) == ("revisit", 1, "response", 3, 3)
    assert warc.read_archives(spark, warc.write_archives(df, min_bytes=2)).where("record_type = 'revisit'").count() == 0
    assert warc.histories(warc.read_archives(spark, warc.write_archives(empty(df)))).count() == 0
    ordered = [(r.urlkey, r.timestamp) for r in warc.histories(warc.read_archives(spark, warc.write_archives(df)), run_rows=2).collect()]
    assert ordered == sorted(ordered) and len(ordered) == len(rows)
    draw = random.Random(4)
    for k in range(9):
        runs = [sorted(draw.choices(range(50), k=draw.randint(0, 8))) for _ in range(k)]
        assert list(warc.loser_tree(runs, lambda v: v)) == sorted(v for run in runs for v in run)


def feed(runs, block, start=0, stop=None):
    """The rows of sorted runs between two places of their common order, by need."""
    rows = [(r, (v, r, a), (run[a // block * block - 1], r, a // block * block - 1) if a >= block else None, v)
            for r, run in enumerate(runs) for a, v in enumerate(run)]
    chosen = {row[1] for row in sorted(rows, key=lambda row: row[1])[start:stop]}
    return iter(sorted((row for row in rows if row[1] in chosen), key=lambda row: (row[2] is not None, row[2] or (), row[1][1:])))


def test_merge_holds_a_block_a_run():
    draw = random.Random(3)
    for top, n in ((10 ** 9, 5_000), (3, 5_000), (0, 5_000), (40, 300)):
        runs = [sorted(draw.randint(0, top) for _ in range(draw.choice((n, n // 2, 1)))) for _ in range(9)]
        every = sorted((v, r, a) for r, run in enumerate(runs) for a, v in enumerate(run))
        for start, stop in ((0, None), (len(every) // 3, 2 * len(every) // 3), (7, 8), (5, 5)):
            source = warc._Feed(feed(runs, 16, start, stop))
            got = [key for key, _ in warc.loser_tree(source.runs, lambda item: item[0])]
            assert got == every[start:stop] and source.held == 0 and source.next is None
            assert source.most_held <= 2 * 16 * len(runs)


def test_histories_of_hot_urls_keep_every_row_in_order(spark):
    draw = random.Random(4)
    rows = [(draw.choice((None, draw.randint(0, 50))), "u", draw.choice(("com,a)/", "com,a)/", "com,b)/é", None)), draw.choice(("2024", "2023", None)))
            for _ in range(3_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, urlkey string, timestamp string").repartition(5)
    by_key = lambda r: (r[2] is not None, (r[2] or "").encode(), r[3] is not None, r[3] or "", r[0] is not None, r[0] or 0)
    merging, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(merging, "false")  # few rows are one range otherwise
    try:
        got = warc.histories(df, run_rows=300, block_rows=7).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(merging, before)
    assert [tuple(r)[:4] for r in got] == sorted(rows, key=by_key)
    sizes = Counter(r["part"] for r in got)
    assert len(sizes) > 1 and max(sizes.values()) < 1_500
    assert [r["place"] for r in got] == [i for part in sorted(sizes) for i in range(sizes[part])]


def test_benchmark_in_blocks_finds_the_same(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    one = decontamination.report(decontamination.search(docs, bench)).orderBy("doc_id").collect()
    many = decontamination.report(decontamination.search(docs, bench, shard_words=2000, block_words=200)).orderBy("doc_id").collect()
    assert one == many and any(r.contaminated for r in one)
    clashing = docs.selectExpr("doc_id", "text", "1 AS copies", "map(1, 2) AS m")
    again = decontamination.search(clashing.unionByName(clashing), bench, shard_words=2000, block_words=200)
    assert again.count() == 2 * docs.count() and again.columns[:4] == clashing.columns


def test_index_against_search_by_hand():
    draw = random.Random(1)
    for n in (1, 2, 50, 400):
        for k in (1, 2, 5):
            s = np.array([draw.randint(1, k) for _ in range(n)])
            x = np.append(s, 0)
            assert decontamination.suffix_order(x).tolist() == sorted(range(n + 1), key=lambda i: x[i:].tolist())
            index = decontamination.FMIndex(s, k + 1)
            phrase = np.array([[0, *(draw.randint(1, k) for _ in range(3))]])
            lo, hi = index.search(phrase, np.array([3]))
            want = [i for i in range(n) if s[i:i + 3].tolist() == phrase[0, 1:].tolist()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want
