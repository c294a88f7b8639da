"""Feature preparation: reports, column classes, and transforms that are fitted once and applied anywhere.

Quantiles are exact and interpolated linearly, and all columns' come from one ordering of their values over partitions. What is fitted is
a small table of numbers per column, so applying it is a projection of literals.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from voltweave.operators.ranking import quantiles

CLIP = (0.001, 0.999)


def feature_columns(df: DataFrame, meta: list[str]) -> list[str]:
    """Numeric columns that are no keys, labels or other meta data."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in meta]


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, nulls: null and NaN counts per column."""
    missing = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")))
    one = df.agg(*[missing(c).alias(c) for c in columns])
    return one.unpivot([], [F.col(c) for c in columns], "name", "nulls")


def correlation_report(df: DataFrame, columns: list[str], label: str, most: int) -> DataFrame:
    """name, corr: the columns of largest absolute correlation with the label; columns without spread have none."""
    one = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double"))).alias(c) for c in columns])
    long = one.unpivot([], [F.col(c) for c in columns], "name", "corr").where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    return long.orderBy(F.col("corr").desc(), "name").limit(most)


def column_classes(df: DataFrame, columns: list[str], pct_words: tuple[str, ...] = ("pct", "prob")) -> dict[str, str]:
    """binary: only 0 and 1 besides nulls (all-null columns too); pct: by name; else continuous. One pass over the data."""
    row = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(c) for c in columns]).first()
    kind = lambda c: "binary" if row[c] else "pct" if any(w in c for w in pct_words) else "continuous"
    return {c: kind(c) for c in columns}


def one_row_columns(df: DataFrame, least_share: float = 0.1) -> list[str]:
    """Columns with values in at least a share of the rows, and in one at least."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] >= max(1.0, least_share * row["_n"])]


def excluded(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Drops rows with these values; rows without a value stay."""
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def filled(columns: list[str], fallback: dict[str, str] | None = None) -> dict[str, Column]:
    """Null, NaN and infinite values replaced by the fallback column's, then by 0."""
    clean = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(None)).otherwise(F.col(c).cast("double"))
    return {c: F.coalesce(clean(c), *([clean(fallback[c])] if fallback and c in fallback else []), F.lit(0.0)) for c in columns}


@dataclass
class Scaling:
    """Fitted bounds, medians and ranges by column."""

    classes: dict[str, str]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    ranges: dict[str, float] = field(default_factory=dict)
    fallback: dict[str, str] = field(default_factory=dict)

    def _logged(self, values: dict[str, Column]) -> dict[str, Column]:
        out = {}
        for c, v in values.items():
            if c in self.bounds:
                v = F.least(F.greatest(v, F.lit(self.bounds[c][0])), F.lit(self.bounds[c][1]))
            out[c] = F.log1p(F.greatest(v, F.lit(0.0))) if self.classes[c] == "continuous" else v
        return out

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], clip: bool = True, fallback: dict[str, str] | None = None, pct_words: tuple[str, ...] = ("pct", "prob")) -> Scaling:
        """Classes come from the data before filling, statistics from the filled values."""
        out = cls(column_classes(df, columns, pct_words), fallback=fallback or {})
        values = filled(columns, fallback)
        if clip:
            some = [c for c in columns if out.classes[c] == "continuous"]
            if some:
                out.bounds = {c: (low, high) for c, (low, high) in quantiles(df.select(*[values[c].alias(c) for c in some]), some, list(CLIP)).items()}
        logged = out._logged(values)
        found = quantiles(df.select(*[logged[c].alias(c) for c in columns]), columns, [0.25, 0.5, 0.75])
        for c in columns:
            low, mid, high = found.get(c, (0.0, 0.0, 0.0))
            out.medians[c], out.ranges[c] = mid, (high - low) or 1.0
        return out

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The scaled features beside some columns as they are; features that df lacks count as 0."""
        absent = [c for c in self.classes if c not in df.columns]
        df = df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df
        logged = self._logged(filled(list(self.classes), self.fallback))
        scaled = [((logged[c] - F.lit(self.medians[c])) / F.lit(self.ranges[c])).alias(c) for c in self.classes]
        return df.select(*keep, *scaled)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Scaling:
        x = json.loads(text)
        x["bounds"] = {k: tuple(v) for k, v in x["bounds"].items()}
        return cls(**x)
