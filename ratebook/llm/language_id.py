"""Language identification by the nearest centroid.

A text is the TF-IDF vector of its hashed byte n-grams (one to three bytes of the lower-cased text, anything
but letters as one space), normalised. A language is several centroids, found by spherical k-means over a
bounded sample of its labelled texts; document frequencies cover every labelled text. The label of the centroid
with the largest cosine is the prediction, and the cosine the score. A text without letters is ``und``. One
that is farther from its centroid than texts of its length ever are among the training texts is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ratebook.llm.common import bounded_batches, stored

WIDTH = 4096
BANDS = 24
_STEP = 1 << 20
_PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the text's n-grams by hash; grams across a step of a very long text are all counted."""
    b = _PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, len(b), _STEP):
        part = b[at:at + _STEP + 2].astype(np.uint32)
        mine = min(_STEP, len(b) - at)
        gram = part
        for n in (1, 2, 3):
            if n > 1:  # gram i holds the bytes i .. i + n - 1
                gram = (gram[:-1] << np.uint32(8)) + part[n - 1:]
            hashed = ((gram + np.uint32(n << 27)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(hashed[:mine], minlength=WIDTH)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).astype(np.float32)


def band(counts: np.ndarray) -> int:
    """The order of magnitude of a text's length, in grams."""
    return min(BANDS - 1, int(counts.sum()).bit_length())


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray  # by band: a smaller cosine is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not has_letter(text) or not self.langs:
            return "und", 0.0, True
        counts = gram_counts(text)
        cosines = self.centroids @ vector(counts, self.idf)
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[best], score, score < self.floors[band(counts)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts at the mean and then at the text farthest from all starts so far."""
    starts = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        unit = np.stack(starts) / np.linalg.norm(np.stack(starts), axis=1, keepdims=True)
        far = (x @ unit.T).max(axis=1)
        starts.append(x[np.argsort(far, kind="stable")[len(far) // 20]])  # not an outlier: the 5 % quantile
    c = np.stack(starts)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        new = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(labelled: DataFrame, per_language: int = 1000, centroids: int = 3, rounds: int = 20, slack: float = 0.5) -> Model:
    """Fits on (text, lang) rows; rows with a null lang, or a text without letters, teach nothing.

    Document frequencies come from every row. The centroids of a language come from about ``per_language`` of
    its texts (the bound; chosen by a hash of the text, so equal texts go together), in one task a language.
    The rejection floor of a length band is ``slack`` times the smallest best cosine of all its sampled texts. Of
    centroids at the same cosine the first by language wins. Only sums, centroids and floors reach the driver.
    """
    bounded_batches(labelled)
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if has_letter(t):
                    df += gram_counts(t) > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"gram": pa.array(np.arange(-1, WIDTH), pa.int32()), "n": pa.array([n, *df.tolist()], pa.int64())})

    total = np.zeros(WIDTH + 1, np.int64)
    for r in rows.select("text").mapInArrow(frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[r["gram"] + 1] = r["n"]
    idf = np.log((1 + total[0]) / (1 + total[1:])) + 1
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model(idf, np.zeros((0, WIDTH), np.float32), [], np.zeros(BANDS))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, c) for lang, t in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()) if has_letter(t)
                     for c in [gram_counts(t)]]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang for lang, _ in found], pa.string()), "band": pa.array([band(c) for _, c in found], pa.int32()),
                "v": pa.array([vector(c, idf).tobytes() for _, c in found], pa.binary())})

    sample = stored(rows.where(chosen).mapInArrow(vectors, "lang string, band int, v binary"), "language-sample")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["v"].sort_values()])
        c = _clusters(x, centroids, rounds)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": [row.astype(np.float32).tobytes() for row in c]})

    found = sorted((r["lang"], bytes(r["c"])) for r in sample.groupBy("lang").applyInPandas(cluster, "lang string, c binary").collect())
    c = np.stack([np.frombuffer(b, np.float32) for _, b in found]) if found else np.zeros((0, WIDTH), np.float32)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.frombuffer(v, np.float32) for v in pdf["v"]])
                yield pd.DataFrame({"band": pdf["band"], "best": (x @ c.T).max(axis=1).astype(float)})

    floors = np.full(BANDS, np.inf)
    for r in sample.select("v", "band").mapInPandas(nearest, "band int, best double").groupBy("band").agg(F.min("best").alias("best")).collect():
        floors[r["band"]] = r["best"]
    # A band that nothing taught takes the floor of the next shorter one; texts shorter than any aren't rejected.
    last = 0.0
    for k in range(BANDS):
        last = floors[k] = last if np.isinf(floors[k]) else floors[k]
    return Model(idf, c, [lang for lang, _ in found], slack * floors)


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and rejected, prefixed; only ``text`` is looked at.

    ``und`` with score 0, rejected: null text, no letter, or nothing learned. Clashing columns of these names
    are replaced.
    """
    bounded_batches(docs)
    added = [prefix + c for c in ("lang_pred", "score", "rejected")]
    columns = [c for c in docs.columns if c not in added]
    rows = docs.select(*columns)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(at)]
            lang, score, rejected = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*columns, *added])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*rows.schema.fields, *map(T.StructField, added, kinds)])
    return rows.mapInArrow(run, schema)
