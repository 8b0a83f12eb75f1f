"""Line deduplication by the spread of a line over sites.

Lines are compared by a hash of their normal form. A HyperLogLog sketch of the sites is kept per line hash;
sketches merge by aggregation, before the shuffle as well. Lines whose estimate is within the sketch's error
of the threshold get an exact distinct count. Lines on enough sites are boilerplate and go from every document
but the one with the smallest ``doc_id`` that has them, so that what they say stays once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ratebook.llm.common import bounded_batches, stored

#: Boilerplate lines (16 bytes each) that are sent to every task; more of them are joined with the texts instead.
MOST_SENT = 1_000_000


def normal_form(line: Column) -> Column:
    return F.lower(F.trim(line))


def line_hash(line: Column, min_words: int) -> Column:
    """Hash of a line's normal form; null where that has fewer than ``min_words`` words, parted by single spaces."""
    line = normal_form(line)
    return F.when(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= min_words - 1, F.xxhash64(line))


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, site, hash) of every line of ``min_words`` words or more; null texts have none."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.explode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line")).select(
            "doc_id", "site", line_hash(F.col("line"), min_words).alias("hash")).where("hash IS NOT NULL")


def boilerplate(docs: DataFrame, min_sites: int = 5, min_words: int = 5, lg_k: int = 10) -> DataFrame:
    """(hash, n_sites, first_doc) of the lines that are on ``min_sites`` distinct sites or more.

    Lines of fewer than ``min_words`` words are too common by chance to say anything and aren't counted. A null
    source is a site of its own; a null doc_id is never first.
    """
    found = lines(docs, min_words)
    spread = stored(found.groupBy("hash").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("doc_id").alias("first_doc"))
                    .select("hash", F.hll_sketch_estimate("sketch").alias("n_sites"), "first_doc")
                    .where(F.col("n_sites") > 1), "line-spread")
    margin = 1 + int(min_sites * 4 * 1.04 / 2 ** (lg_k / 2))  # four standard errors of the sketch
    near = spread.where(F.abs(F.col("n_sites") - min_sites) <= margin)
    exact = (found.select("hash", "site").distinct().join(near.select("hash"), "hash", "left_semi")
             .groupBy("hash").agg(F.count("*").alias("exact")))
    return (spread.join(exact, "hash", "left").withColumn("n_sites", F.coalesce("exact", "n_sites"))
            .where(F.col("n_sites") >= min_sites).select("hash", "n_sites", "first_doc"))


def _by_join(docs: DataFrame, flagged: DataFrame, min_words: int) -> DataFrame:
    """``docs`` with ``_kept``: the lines left of a document that loses some, else null."""
    hits = lines(docs, min_words).join(flagged, "hash").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    per_doc = stored(hits.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("hash").alias("_flagged")), "flagged-lines")
    kept = F.filter(F.split("text", "\n", -1), lambda line: ~F.coalesce(F.array_contains("_flagged", line_hash(line, min_words)), F.lit(False)))
    changed = F.col("_flagged").isNotNull() & F.col("text").isNotNull()
    joined = docs.join(per_doc, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left")
    return joined.withColumn("_kept", F.when(changed, kept)).drop("_doc", "_flagged")


def _by_lookup(docs: DataFrame, flagged: DataFrame, min_words: int) -> DataFrame:
    """The same with the flagged lines in every task, so that no text is shuffled."""
    rows = sorted((r["hash"], r["first_doc"]) for r in flagged.select("hash", "first_doc").collect())
    known = np.array([h for h, _ in rows], np.int64)
    first = np.array([-1 if d is None else d for _, d in rows], np.int64)
    nobody = np.array([d is None for _, d in rows], bool)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(len(columns))
            flat = hashes.flatten()
            short, flat = flat.is_null().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy()
            sizes = hashes.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), sizes)
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            gone = (known[at] == flat) & ~short if len(known) else np.zeros(len(flat), bool)
            doc = batch.column(len(columns) + 1)
            ids, missing = doc.fill_null(0).to_numpy()[owner], doc.is_null().to_numpy(zero_copy_only=False)[owner]
            if len(known):
                gone &= nobody[at] | missing | (first[at] != ids)
            ends = np.cumsum(sizes)
            kept: list[list[str] | None] = [None] * len(batch)
            texts = batch.column(columns.index("text"))
            for i in np.unique(owner[gone]).tolist():
                mask = gone[ends[i] - sizes[i]:ends[i]]
                kept[i] = [line for line, out in zip(texts[i].as_py().split("\n"), mask) if not out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(kept, pa.list_(pa.string()))], [*columns, "_kept"])

    line_hashes = F.transform(F.split("text", "\n", -1), lambda line: line_hash(line, min_words))
    schema = T.StructType([*docs.schema.fields, T.StructField("_kept", T.ArrayType(T.StringType()))])
    return docs.select(*columns, line_hashes.alias("_hashes"), F.col("doc_id").cast("long").alias("_doc")).mapInArrow(run, schema)


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, min_words: int = 5, lg_k: int = 10, counts: bool = True,
                       most_sent: int = MOST_SENT) -> DataFrame:
    """The documents' own columns and, with ``counts``, n_lines and n_removed: boilerplate lines are taken out of ``text``.

    Only documents with a flagged line change; other texts stay as they are, to the last character. Null texts
    stay null and have no lines, repeated rows are treated alike, a line repeated within its first document
    stays there, an empty table stays empty. Clashing columns of the added names are replaced. Up to
    ``most_sent`` flagged lines are looked up in every task, more are joined; both give the same rows.
    """
    bounded_batches(docs)
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    docs = docs.withColumn("text", F.col("text").cast("string"))
    flagged = stored(boilerplate(docs, min_sites, min_words, lg_k), "boilerplate")
    found = _by_lookup(docs, flagged, min_words) if flagged.count() <= most_sent else _by_join(docs, flagged, min_words)
    changed, size = F.col("_kept").isNotNull(), F.size(F.split("text", "\n", -1))
    more = [F.when(F.col("text").isNull(), 0).otherwise(size).alias("n_lines"),
            F.when(changed, size - F.size("_kept")).otherwise(0).alias("n_removed")] if counts else []
    text = F.when(changed, F.array_join("_kept", "\n")).otherwise(F.col("text")).alias("text")
    return found.select(*(text if c == "text" else F.col(c) for c in columns), *more)
