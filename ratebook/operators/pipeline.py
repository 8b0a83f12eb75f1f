"""The whole feature pipeline: features, imputation, pruning, encoding, scaling."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.config import KEY, POLICY_COLUMNS, TARGET
from ratebook.functions import features
from ratebook.operators import transforms as t
from ratebook.operators.forest import IsolationForest
from ratebook.operators.splits import stored

ENCODED = ("region", "bmi_category", "age_group")
#: A column of more distinct values is continuous.
CONTINUOUS = 10


def continuous_columns(df: DataFrame, apart: Sequence[str] = (), over: int = CONTINUOUS) -> list[str]:
    """Numeric columns of more than ``over`` distinct values; a task hands on one value more than that at most."""
    columns = t.numeric_columns(df, apart)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, set] = {c: set() for c in columns}
        for pdf in batches:
            for c, held in seen.items():
                if len(held) <= over:
                    held.update(pdf[c].dropna().unique()[:over + 1].tolist())
        pairs = [(c, v) for c, held in seen.items() for v in sorted(held)[:over + 1]]
        yield pd.DataFrame(pairs, columns=["feature", "value"])

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = doubles.mapInPandas(values, "feature string, value double").groupBy("feature").agg(F.count_distinct("value").alias("n")).collect()
    many = {r["feature"] for r in counts if r["n"] > over}
    return [c for c in columns if c in many]


@dataclass(frozen=True)
class FeaturePipeline:
    """Learned parameters in the order they apply; ``transform`` is one lazy projection."""

    imputer: t.Imputer
    variance: t.VarianceFilter
    labels: t.LabelEncoder
    onehot: t.OneHot
    target: t.TargetTransform
    variance_after: t.VarianceFilter
    products: t.Products
    collinear: t.CollinearityFilter
    scaler: t.Scaler
    columns: tuple

    @classmethod
    def fit(cls, df: DataFrame, target: str = TARGET, method: str = "yeo-johnson", products: bool = False,
            outliers: float | None = None) -> "FeaturePipeline":
        """``products`` adds products of all continuous columns, the most varying ones kept. ``outliers`` is the share of
        rows that an isolation forest on the encoded columns leaves out of the fit; replaying keeps every row."""
        # The six inputs and the target are kept between the passes, so that their source is read once, and
        # dealt anew: a narrow source comes in few parts, and the features are far more work than its bytes.
        inputs = df.select(KEY, *POLICY_COLUMNS, target)
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        inputs = inputs.repartition(parts, *inputs.columns).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return cls._fit(inputs, target, method, products, outliers)
        finally:
            inputs.unpersist()

    @classmethod
    def _fit(cls, df: DataFrame, target: str, method: str, products: bool, outliers: float | None) -> "FeaturePipeline":
        rows = features.featured(df)
        imputer = t.Imputer.fit(rows)
        rows = imputer.transform(rows)
        variance = t.VarianceFilter.fit(rows)
        rows = variance.transform(rows)
        labels = t.LabelEncoder.fit(rows)
        onehot = t.OneHot.fit(rows, [c for c in ENCODED if c in rows.columns])
        rows = onehot.transform(labels.transform(rows))
        # Written once: the passes below would each work out every feature again, within ever larger expressions.
        rows = stored(rows, "encoded")
        if outliers:
            columns = t.numeric_columns(rows, (KEY, target))
            odd = IsolationForest.fit(rows, columns, contamination=outliers)
            normal = stored(odd.flag(rows).where("NOT outlier").select(KEY), "normal-rows")
            rows, df = (r.join(normal, KEY, "left_semi") for r in (rows, df))
        shape = t.TargetTransform.fit(df, target, method)
        rows = features.with_domain_interactions(rows)
        after = t.VarianceFilter.fit(rows)
        rows = after.transform(rows)
        exempt = list(onehot.names)
        grown = t.Products((), {})
        if products:
            grown = t.Products.fit(rows, continuous_columns(rows, (KEY, target, *onehot.names)))
            rows = stored(grown.transform(rows), "grown")
            exempt += [grown.name(p) for p in grown.pairs]
        collinear = t.CollinearityFilter.fit(rows, target, exempt=exempt)
        rows = collinear.transform(rows)
        names = tuple(c for c in rows.columns if c not in (KEY, target))
        scaler = t.Scaler.fit(rows, names)
        return cls(imputer, variance, labels, onehot, shape, after, grown, collinear, scaler, names)

    def transform(self, df: DataFrame) -> DataFrame:
        """Key, the fitted columns in their fitted order, and the transformed target if present."""
        missing = [c for c in ("age", "sex", "bmi", "children", "smoker", "region") if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        rows = self.variance.transform(self.imputer.transform(features.featured(df)))
        rows = self.onehot.transform(self.labels.transform(rows))
        rows = self.variance_after.transform(features.with_domain_interactions(rows))
        rows = self.collinear.transform(self.products.transform(rows))
        label = [self.target.apply(TARGET).alias("target_z")] if TARGET in df.columns else []
        return self.scaler.transform(rows).select(KEY, *self.columns, *label)

    def to_json(self) -> str:
        state = dataclasses.asdict(self)
        state["products"] = {"pairs": self.products.pairs, "variances": self.products.variances}
        return json.dumps(state)

    @classmethod
    def from_json(cls, text: str) -> "FeaturePipeline":
        s = json.loads(text)
        return cls(
            t.Imputer(**s["imputer"]), t.VarianceFilter(**s["variance"]), t.LabelEncoder(**s["labels"]), t.OneHot(**s["onehot"]),
            t.TargetTransform(**s["target"]), t.VarianceFilter(**s["variance_after"]),
            t.Products(tuple(tuple(p) for p in s["products"]["pairs"]), s["products"]["variances"]),
            t.CollinearityFilter(*(tuple(v) for v in s["collinear"].values())),
            t.Scaler({k: tuple(v) for k, v in s["scaler"]["params"].items()}), tuple(s["columns"]))
