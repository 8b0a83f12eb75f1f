"""Main text of web pages by removal of site templates.

Every block element has two hashes: of its slot (the path of tags, classes and ids that leads to it) and of its content
(tag, words and the content of its parts). Both are counted per host. A content that recurs on a large share of a
host's pages is template, and so is a slot that does, unless it holds the article: a container with most of a page's
text, or what markup calls article or main. Template subtrees are deleted from all pages of their host; what markup
itself calls navigation, header, footer, sidebar, notice, advert, form or comment goes as well.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ratebook.llm.common import bounded_batches, stored

# A tag as HTML reads it: a quote opens a value only right behind the equals sign. Nothing is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+)*+)[\s/]*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)|(?=>|\Z)))?+""")
_RAW = frozenset("script style title textarea noscript iframe template".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strong strike sub "
                    "sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("nav header footer aside form button select dialog menu svg head object canvas audio video label input".split())
_MAIN = frozenset(("article", "main"))
_LEFT_OUT_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
                            "header masthead footer sidebar aside widget cookie cookies consent notice popup modal newsletter subscribe share "
                            "sharing social related comment comments disqus replies pagination".split())
_LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_WORD = re.compile(r"[a-z]+")
#: Ends of these don't reach out of the block that holds them.
_SCOPED = _INLINE | {"p"}
#: Elements that may hold the article.
_CONTAINERS = frozenset("html body div section article main table tbody tr td center".split())
#: Elements of running text, which are template by their content only, never by their place.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in reversed(list(_ATTRIBUTE.finditer(text)))} if text else {}


def _left_out(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """What markup keeps out of the text. In an article only whole class names count, as authors use the words too."""
    if tag in _LEFT_OUT or "hidden" in attributes or attributes.get("role") in _LEFT_OUT_ROLES or attributes.get("aria-hidden") == "true":
        return True
    names = attributes.get("class", "").split() + attributes.get("id", "").split()
    return any(not _LEFT_OUT_WORDS.isdisjoint((n,) if in_main else _WORD.findall(n)) for n in names)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, open, void and end. What an unclosed tag or comment swallows is lost."""
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        after = page[start + 1:start + 2]
        if after.isascii() and after.isalpha() or after == "/" and page[start + 2:start + 3].isascii() and page[start + 2:start + 3].isalpha():
            m = _TAG.match(page, start)
            if m is None:
                return
            at = m.end()
            name = m[2].lower()
            if m[1]:
                yield "end", name, ""
            elif name in _RAW:
                end = _RAW_END[name].search(page, at)
                if end is None:
                    return
                at = end.end()
            else:
                yield "void" if name in _VOID or page[at - 2] == "/" and name not in _MAIN else "open", name, m[3]
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return
            at = end + 3
        elif after in ("!", "?", "/"):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<", ""
            at = start + 1


class Element:
    """An open element: its slot, where its text and letters begin, whether it is left out, an article, holds one, or
    lies where nothing is template; ``block`` is the nearest element around its text that has a content hash."""

    __slots__ = ("tag", "slot", "parent", "start", "before", "left", "article", "main", "kept", "content", "block")

    def __init__(self, tag, slot, parent, start, before, left, article, kept, above):
        self.tag, self.slot, self.parent, self.start, self.before = tag, slot, parent, start, before
        self.left, self.article, self.main, self.kept = left, article, article, kept
        self.block = above.block if tag in _INLINE else self
        self.content = None if tag in _INLINE else xxhash.xxh64(tag)


def parse(page: str | None, template: frozenset[int] = frozenset(), holders: frozenset[int] = frozenset(), inner: frozenset[int] = frozenset(),
          markup: bool = True) -> tuple[str, list[tuple[int, int | None, int, bool, bool]]]:
    """The page's text without template subtrees, and (hash, parent slot, thousandths of the letters, holds a marked
    article, may hold one) of its blocks.

    Rows of contents have no parent slot. ``holders`` are slots that are never template, inside ``inner`` nothing is.
    With ``markup`` off neither left-out elements nor marked articles count.
    """
    out: list[str] = []
    main: list[str] = []
    rows: list[tuple[int, int | None, int, bool, bool]] = []
    stack: list[Element] = [Element("#", 0, None, 0, 0, False, False, False, None)]
    open_ = Counter()
    in_main = letters = skipping = 0
    has_main = False

    def close() -> None:
        nonlocal skipping, in_main
        e = stack.pop()
        open_[e.tag] -= 1
        above = stack[-1]
        above.main |= e.main
        gone, size = e.left, letters - e.before
        if e.content is not None:
            out.append(" ")
            if size and e.tag not in ("html", "body"):
                content = e.content.intdigest() - (1 << 63)
                above.block.content.update(content.to_bytes(8, "little", signed=True))
                if not e.kept:
                    rows.append((content, None, size, e.main, False))
                    if e.tag not in _RUNNING:
                        rows.append((e.slot, e.parent, size, e.main, e.tag in _CONTAINERS))
                    gone = gone or not e.main and e.slot not in holders and (content in template or e.slot in template)
        if gone:
            out[e.start:] = [" "]
        skipping -= e.left
        if e.article:
            in_main -= 1
            if not in_main:
                main.extend([" ", *out[e.start:]])

    for kind, name, attributes in _tokens(page or ""):
        if kind == "text":
            text = _html.unescape(name)
            words = text.split()
            if words:
                letters += sum(map(len, words))
                stack[-1].block.content.update(" ".join(words).encode("utf-8", "replace"))
            out.append(text)
        elif kind == "end":
            if open_[name]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == name:
                        while len(stack) > depth:
                            close()
                        break
                    if name in _SCOPED and stack[depth].tag not in _SCOPED:
                        break
        else:
            if name not in _INLINE:
                if open_["p"]:
                    for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                        if stack[depth].tag == "p":
                            while len(stack) > depth:
                                close()
                            break
                        if stack[depth].tag not in _SCOPED:
                            break
                out.append(" ")
            if kind == "void":
                continue
            found = _attributes(attributes)
            left = markup and _left_out(name, found, in_main > 0)
            article = markup and name in _MAIN and not left and not skipping
            skipping += left
            if article:
                in_main += 1
                has_main = True
            above = stack[-1]
            slot = above.slot
            if name not in _INLINE:
                label = " ".join([name, *sorted(found.get("class", "").split()), "#" + found.get("id", "")])
                slot = xxhash.xxh64_intdigest(label, seed=above.slot & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
            kept = above.kept or above.slot in inner or above.article
            open_[name] += 1
            stack.append(Element(name, slot, above.slot, len(out), letters, left, article, kept, above))
    while len(stack) > 1:
        close()
    total = max(letters, 1)
    return " ".join("".join(main if has_main else out).split()), [(h, p, size * 1000 // total, *more) for h, p, size, *more in rows]


def extract(pages: DataFrame, min_pages: int = 20, share: float = 0.6, most_text: float = 0.3, markup: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, text from the whole html.

    A subtree belongs to a host's template if ``min_pages`` of its pages and the given share of them have its slot or
    its content, and it holds no article; a slot besides may hold no more than ``most_text`` of the text on average. So a
    host has at most (blocks a page) / share template hashes, and they are joined as one array a host. A container
    that recurs and holds half of the text is where the article is: inside the innermost one nothing is template.
    Null html is an empty text; a null url is a host of its own; repeated rows stay; extra columns aren't read.
    """
    bounded_batches(pages)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host)
    counts, sizes = _counts(rows, markup)
    often = counts.where(F.col("n") >= min_pages).join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    is_content, mean = F.col("parent").isNull(), F.col("letters") / F.col("n") / 1000
    holds = F.col("container") & (F.col("peak") / F.col("n") / 1000 >= 0.5)
    found = stored(often.groupBy("host").agg(
        F.collect_set(F.when(~F.col("main") & (is_content | (mean < most_text)), F.col("hash"))).alias("template"),
        F.collect_set(F.when(holds, F.col("hash"))).alias("holders"),
        # A holder with a holder inside is not the innermost one.
        F.array_except(F.collect_set(F.when(holds, F.col("hash"))), F.collect_set(F.when(holds, F.col("parent")))).alias("inner")), "templates")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[frozenset(v or ()) for v in batch.column(i).to_pylist()] for i in (3, 4, 5)]
            got = [parse(page.as_py(), *known, markup)[0] for page, *known in zip(batch.column(2), *sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()),
                                              pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(found, "host", "left").select("page_id", "url", "html", "template", "holders", "inner").mapInArrow(
        texts, "page_id long, url string, text string, n_chars long")


def _counts(rows: DataFrame, markup: bool) -> tuple[DataFrame, DataFrame]:
    """(host, hash, parent, n, letters, peak, main, container) of all blocks, n in pages, and (host, pages): letters of all
    blocks of a slot, peak of the largest one, in thousandths added up over the pages."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            letters: Counter = Counter()
            peak: Counter = Counter()
            article: dict = {}
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[h, None, None, False] += 1  # counts the page
                largest: dict[tuple, int] = {}  # of the blocks of one slot
                for hash_, parent, size, main, container in parse(page.as_py(), markup=markup)[1]:
                    key = (h, hash_, parent, container)
                    letters[key] += size
                    largest[key] = max(largest.get(key, 0), size)
                    article[key] = article.get(key, False) or main
                for key, size in largest.items():
                    held[key] += 1
                    peak[key] += size
            keys = list(held)
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in keys], pa.string()), "hash": pa.array([k[1] for k in keys], pa.int64()),
                "parent": pa.array([k[2] for k in keys], pa.int64()), "n": pa.array([held[k] for k in keys], pa.int64()),
                "letters": pa.array([letters[k] for k in keys], pa.int64()),
                "peak": pa.array([peak[k] for k in keys], pa.int64()), "main": pa.array([article.get(k, False) for k in keys], pa.bool_()),
                "container": pa.array([k[3] for k in keys], pa.bool_())})

    found = rows.select("host", "html").mapInArrow(subtrees, "host string, hash long, parent long, n long, letters long, peak long, main boolean, container boolean")
    counts = stored(found.groupBy("host", "hash", "parent", "container").agg(
        F.sum("n").alias("n"), F.sum("letters").alias("letters"), F.sum("peak").alias("peak"), F.bool_or("main").alias("main")).where("n > 1 OR hash IS NULL"), "blocks")
    return (counts.where("hash IS NOT NULL"),
            counts.where("hash IS NULL").select("host", F.col("n").alias("pages")))
