"""Secret scans with multipart credential linking.

Strong patterns report by themselves. A weak candidate, a short value behind a credential's name, says nothing
alone: it is reported only when a complementary part, an access identifier or an endpoint, is within reach in
the same scope (a paragraph). Parts are intervals; weak ones meet the others by an interval join over
(document, scope, stretch of text).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ratebook.llm.common import bounded_batches, stored

_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs that are long enough
_NAMES = ("password", "passwd", "secret", "token", "api")
_WEAK = re.compile(r"""(?ai:\b(pwd|pass|passphrase|credential|auth|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"""([^\s"',;<>]{4,64}))""")
_IDENTIFIER = re.compile(r"""(?ai:\b(user|username|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,}))""")
_ENDPOINT = re.compile(r"""(?a:\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+)"""
                       r"""|(?ai:\b(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})""")
#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "weak")
_SCOPE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost non-overlapping per kind, by start and kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES) or not text.isascii():
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(role, scope, start, end): weak candidates outside the base spans, and what may complement them.

    Without a weak candidate nothing can be linked, and the other roles aren't looked for.
    """
    weak = []
    if ":" in text or "=" in text:
        assigned = [(s, e) for k, s, e in base if k == "assign"]  # ascending and apart, so the last that starts before b decides
        starts = [s for s, _ in assigned]
        for a, b in (m.span() for m in _WEAK.finditer(text)):
            i = bisect_left(starts, b)
            if not i or assigned[i - 1][1] <= a:
                weak.append((a, b))
    if not weak:
        return []
    breaks = [m.start() for m in _SCOPE.finditer(text)]
    rows = [("weak", *s) for s in weak] + [("identifier", s, e) for k, s, e in base if k == "access"]
    rows += [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)]
    rows += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return [(role, bisect_left(breaks, a), a, b) for role, a, b in rows]


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak) of every row.

    Null texts are empty; repeated rows are scanned each and get equal results; extra columns aren't read.
    ``reach`` is the most code points between a weak candidate and its complement. Rows are told apart by a number
    given while they are scanned and stored with their parts: task and place, so no two rows share one.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.struct([("role", pa.string()), ("scope", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                out.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(listed.encode()).hexdigest(), listed,
                            [dict(zip(("role", "scope", "start", "end"), p)) for p in parts(text, base)]))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), part)
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "base", "parts")
            numbers = pa.array(range(row, row + len(out)), pa.int64())
            row += len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers, *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["doc_id", "row", *names])

    bounded_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stored(rows.mapInArrow(found, "doc_id long, row long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, "
                                  "parts array<struct<role: string, scope: long, start: long, end: long>>"), "secret-parts")
    each = rows.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    stretch = lambda c: F.floor(c / reach)
    weak = each.where("role = 'weak'").select("row", "scope", F.col("start").alias("a"), F.col("end").alias("b")).withColumn(
        "at", F.explode(F.sequence(stretch(F.col("a") - reach), stretch(F.col("b") + reach))))
    others = each.where("role <> 'weak'").select("row", "scope", "start", "end").withColumn(
        "at", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("end")))))
    linked = (weak.join(others, ["row", "scope", "at"]).where((F.col("start") - F.col("b") <= reach) & (F.col("a") - F.col("end") <= reach))
              .select("row", "a", "b").distinct().groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("weak")))
    order = F.array(*(F.lit(k) for k in KINDS))
    span = lambda kind, a, b: F.struct(a.cast("long").alias("a"), F.array_position(order, kind).alias("k"), b.cast("long").alias("b"))
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: span(
        F.split(s, ":")[0], F.split(s, ":")[1], F.split(s, ":")[2]))
    more = F.transform("weak", lambda s: span(F.lit("weak"), s["a"], s["b"]))
    listed = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda s: F.concat_ws(
        ":", F.element_at(order, s["k"].cast("int")), s["a"].cast("string"), s["b"].cast("string"))), ",")
    return rows.join(linked, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.when(F.col("weak").isNull(), F.col("base")).otherwise(listed).alias("spans"),
        F.coalesce(F.size("weak"), F.lit(0)).cast("long").alias("n_weak")).withColumn("n_weak", F.greatest("n_weak", F.lit(0).cast("long")))
