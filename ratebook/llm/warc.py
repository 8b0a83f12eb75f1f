"""WARC archives with revisits, and capture histories by external index merge.

Records are written through Spark's text sink: the four bytes that end a WARC record are its line separator,
so the files are plain (or gzipped) WARC. Reading takes them up again piece by piece by their Content-Length.
The captures of each archive file give sorted runs; runs are dealt by ranges of (URL key, timestamp) and every
range is merged by a loser tree, block by block, so the partitions in sequence are one globally ordered index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratebook.llm.common import bounded_batches, stored
from ratebook.session import work_path

_END = "\r\n\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122's name space for URLs
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_ROW = "page_id long, url string, urlkey string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels turned round, without scheme, user, www, default port, fragment; lower case."""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url or "")
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    port = "" if m[2] in (None, "80", "443") else ":" + m[2]
    return ",".join(reversed(host.split("."))) + port + ")" + (m[3].lower() or "/")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def _record(page_id: int | None, url: str | None, page: str | None, refers_to: int | None) -> str:
    """One record without its end; a revisit has no block and names what it refers to."""
    payload = (page or "").encode()
    date = (_EPOCH + timedelta(seconds=(page_id or 0) % (10 ** 9))).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    lines += [] if url is None else ["WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url)]
    if refers_to is None:
        block = page or ""
    else:
        block = ""
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {len(block.encode())}"]) + _END + block


def write_archives(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> str:
    """Writes a record per row and returns the archives' folder.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the response; smaller
    payloads are responses all. Null html is an empty payload; rows with the same page_id and payload are each a
    response if theirs is the largest; a null page_id is the response only if all of its payload are null.
    """
    bounded_batches(pages)
    path = path or work_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.sha1("html"))
    last = keyed.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    last = stored(last.where("n > 1").drop("n"), "payloads")
    refers = F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, refs = (batch.column(i).to_pylist() for i in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([pa.array(
                [_record(i, u, h.as_py(), r) for i, u, h, r in zip(ids, urls, batch.column(2), refs)], pa.string())], ["value"])

    (keyed.join(last, "key", "left").select("page_id", "url", "html", refers.alias("refers")).mapInArrow(records, "value string")
     .write.option("lineSep", _END).option("compression", "gzip").text(path))
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures (page_id, url, urlkey, timestamp, payload_bytes, payload_digest, record_type, refers_to) of all records.

    Gzipped files aren't split, so the pieces of a file come in sequence; a payload may hold the separator
    itself and is put together by its length. A response's digest is computed from its bytes and has to be
    the one its header gives.
    """

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict[str, str] | None = None
        block: list[bytes] = []
        have, broken = 0, False
        for batch in batches:
            rows = []
            for piece in batch.column(0):
                piece = piece.as_py()
                if head is None:
                    if broken:
                        piece, broken = piece.removeprefix("\r\n"), False
                        if not piece:  # the end of the file
                            continue
                    first, *lines = piece.split("\r\n")
                    if first != "WARC/1.1":
                        raise ValueError("not the start of a WARC record")
                    head = dict(line.split(": ", 1) for line in lines)
                    block, have = [], 0
                    continue
                data = piece.encode()
                have += len(data) + (4 if block else 0)
                block.append(data)
                if have == int(head["Content-Length"]) - 2:  # it ends in a line break, taken for half of the separator
                    block[-1] += b"\r\n"
                    have, broken = have + 2, True
                if have < int(head["Content-Length"]):
                    continue
                payload = _END.encode().join(block)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = head["WARC-Type"]
                if len(payload) != int(head["Content-Length"]) or kind == "response" and _digest(payload) != digest:
                    raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                number = lambda name: int(head[name]) if name in head else None
                url = head.get("WARC-Target-URI")
                size = len(payload) if kind == "response" else number("X-Payload-Length")
                rows.append((number("X-Page-Id"), url, url_key(url), re.sub(r"\D", "", head["WARC-Date"]), size, digest, kind, number("X-Refers-To-Page")))
                head = None
            names = [f.split()[0] for f in _ROW.split(", ")]
            kinds = [pa.int64() if f.endswith("long") else pa.string() for f in _ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)
        if head is not None:
            raise ValueError("the archive ends within a record")

    return spark.read.option("lineSep", _END).schema("value string").text(path).mapInArrow(captures, _ROW)


def loser_tree(runs: list[Iterator], key) -> Iterator:
    """Merges sorted runs, each an iterator: inner nodes keep the loser of their match, so a step replays one path of
    the tree. A run is asked for its next item only after the one before was taken; of equal keys the earlier run's comes first."""
    k, end = len(runs), object()
    runs = [iter(run) for run in runs]
    heads: list = [None] * k
    keys: list[tuple] = [()] * k

    def advance(i: int) -> None:
        # A key of (1,) is above every (0, key): an exhausted run loses always.
        heads[i] = item = next(runs[i], end)
        keys[i] = (1,) if item is end else (0, key(item), i)

    for i in range(k):
        advance(i)
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while k and keys[best] != (1,):
        yield heads[best]
        advance(best)
        node = (best + k) // 2
        while node:
            if keys[losers[node]] < keys[best]:
                best, losers[node] = losers[node], best
            node //= 2


def _order(urlkey: str | None, timestamp: str | None, page_id: int | None) -> tuple:
    """Spark's order of the three columns: nulls first, texts by their bytes."""
    return urlkey is not None, (urlkey or "").encode(), timestamp is not None, (timestamp or "").encode(), page_id is not None, page_id or 0


_KEY = ("urlkey", "timestamp", "page_id")


class _Feed:
    """The runs of a range as iterators over one stream of their rows, which comes in the order of need.

    A row's need is the last row of the block before its own in its run: its block is wanted when that row has left.
    A run whose rows in hand are used up reads on only as far as needs up to its last row go, so what waits in hand
    is about a block a run, however long the range is. Keys end in run and place, so no two are equal.
    """

    def __init__(self, stream: Iterator[tuple]):
        """``stream`` gives (run, key, need, row) by need; the need of a run's first block is None."""
        self.stream, self.next = stream, next(stream, None)
        self.waiting: dict[int, deque] = {}
        self.held = self.most_held = 0
        least = None  # a run that begins in an earlier range needs a row below all of this one
        while self.next is not None and (self.next[2] is None or least is None or self.next[2] < least):
            least = self.next[1] if least is None else min(least, self.next[1])
            self.waiting.setdefault(self.next[0], deque())
            self._take()
        self.runs = [self._run(rows) for _, rows in sorted(self.waiting.items())]

    def _take(self) -> None:
        run, key, _, row = self.next
        self.waiting[run].append((key, row))
        self.held += 1
        self.most_held = max(self.most_held, self.held)
        self.next = next(self.stream, None)

    def _run(self, rows: deque) -> Iterator[tuple]:
        last = None
        while True:
            while not rows and self.next is not None and self.next[2] <= last:
                self._take()
            if not rows:
                return
            last, _ = found = rows.popleft()
            self.held -= 1
            yield found


def histories(captures: DataFrame, run_rows: int = 20_000, block_rows: int = 256) -> DataFrame:
    """The captures in global order of (urlkey, timestamp, page_id), nulls first, with their place in their partition.

    Each task sorts what it reads in runs of ``run_rows``, cut in blocks of ``block_rows``. Runs are dealt by ranges of
    the key and, within equal keys, of the run, so neither a URL with very many captures nor rows that are all alike meet
    in one task. A range's rows come ordered by when the merge needs their block (Spark sorts and spills); the loser
    tree holds about a block a run and hands its rows out in batches. Repeated rows stay, in the order of their runs.
    """
    columns = captures.columns
    own = {c: f"_{c}_before" for c in _KEY}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, task = [], 0, TaskContext.get().partitionId()

        def cut(table: pa.Table):
            nonlocal number
            keys = [_order(*k) for k in zip(*(table.column(c).to_pylist() for c in _KEY))]
            table = table.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64())).combine_chunks()
            number += 1
            place = np.arange(len(keys))
            before = pa.array(place // block_rows * block_rows - 1, mask=place < block_rows)
            more = {"_run": pa.array(np.full(len(keys), (task << 32) + number)), "_at": pa.array(place), "_first": pa.array(place < block_rows),
                    **{own[c]: table.column(c).take(before) for c in _KEY}}
            for name, values in more.items():
                table = table.append_column(name, values)
            return table.to_batches()

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while len(table) >= run_rows:
                yield from cut(table.slice(0, run_rows))
                table = table.slice(run_rows)
            held = table.to_batches()
        if held and sum(map(len, held)):
            yield from cut(pa.Table.from_batches(held))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in captures.schema.fields)
    kind = {f.name: f.dataType.simpleString() for f in captures.schema.fields}
    dealt = (captures.mapInArrow(runs, f"{kinds}, _run long, _at long, _first boolean, " + ", ".join(f"{own[c]} {kind[c]}" for c in _KEY))
             .repartitionByRange(*_KEY, "_run", "_at")
             .sortWithinPartitions(F.col("_first").desc(), *own.values(), "_run", "_at"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        schema = head.schema

        def rows() -> Iterator[tuple]:
            for batch in chain([head], batches):
                values = [batch.column(i).to_pylist() for i in range(len(columns))]
                keys = zip(*(values[columns.index(c)] for c in _KEY))
                needs = zip(*(batch.column(schema.get_field_index(own[c])).to_pylist() for c in _KEY))
                run, at = (batch.column(schema.get_field_index(c)).to_pylist() for c in ("_run", "_at"))
                for r, a, key, need, row in zip(run, at, keys, needs, zip(*values)):
                    start = a // block_rows * block_rows
                    yield r, (*_order(*key), r, a), (*_order(*need), r, start - 1) if start else None, row

        out = pa.schema([*(schema.field(c) for c in columns), ("place", pa.int64())])
        found = loser_tree(_Feed(rows()).runs, itemgetter(0))
        place = 0
        while some := list(islice(found, 2_000)):
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*(row for _, row in some)), out)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(range(place, place + len(some)), pa.int64())], schema=out)
            place += len(some)

    return dealt.mapInArrow(merged, f"{kinds}, place long")
