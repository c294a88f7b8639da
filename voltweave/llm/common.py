"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
#: Labels that are learnt, at most: the most frequent ones.
MOST_LABELS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole texts can be long, so batches that go to Python hold few rows and few bytes.

    A plan reads these settings when it runs, after its function has returned, so they stay set; only lower bounds replace them.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(f"spark.sql.execution.arrow.{key}") or "0") or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text, so in fold 0 and never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text, empty for null: Python gets them without decoding."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def decode(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def scored(fields: str, f: Callable[[pd.Series], pd.DataFrame]) -> Callable[[Column], Column]:
    """A vectorised struct function of one binary column."""
    return F.pandas_udf(f, fields)  # type: ignore[call-overload]


def stratified(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About per_class rows of each of the MOST_LABELS most frequent labels (all rows of smaller classes), picked by a hash of key.

    The same rows on every run and in every layout. Rows of equal keys go together, so `bounded` must follow where keys repeat.
    """
    span = float(2**53)
    most = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), label).limit(MOST_LABELS)
    share = {r[label]: min(1.0, 1.1 * per_class / r["n"]) for r in most.collect()}
    if not share:
        return df.limit(0)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(2**53)) / F.lit(span)
    wanted = F.lit(False)
    for value, part in sorted(share.items(), key=lambda x: str(x[0])):
        wanted = wanted | ((F.col(label) == F.lit(value)) & (draw < F.lit(part)))
    return df.where(wanted)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """At most so many rows, those that hash lowest: the same on every run and in every layout."""
    return df.orderBy(F.xxhash64(*df.columns), *df.columns).limit(rows)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About so many rows (all if there are fewer), those whose key hashes below a share found from the count."""
    n = df.count()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(23)), F.lit(2**53)) / F.lit(float(2**53))
    return df.where(draw < F.lit(min(1.0, 1.1 * rows / n))) if n else df.limit(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
