"""From raw documents to a training mixture, in five stages that are each written and read again.

Documents without a telling language go; of each class of near copies one stays; documents that contain a benchmark item go;
personal data is replaced by its kind in brackets; and the sources are mixed to their target weights. Every stage works on
all that its predecessor kept. All but the last return the columns of documents; the last returns these with size,
source_size, target and taken, for the documents that the mix takes; where documents has a column of such a name, that stays
and the mix's is called mix_size, and so on.

Null texts have no language and go in the first stage. Every stage judges rows by their texts: rows whose id repeats or is
null are documents of their own, and near copies of each other only if their texts are. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.llm import decontam, langid, mixing, pii, setjoin
from voltweave.llm.common import fresh, table
from voltweave.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def with_row_ids(docs: DataFrame, row: str = "_id") -> DataFrame:
    """Adds a column, named by row, that no two rows share: doc_id where that is of one row, else a hash of the row, numbered if equal rows are left."""
    known = fresh(docs.withColumn(row, F.lit(0)), "_known")
    repeated = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").select(F.col("doc_id").alias(known)), "mix-repeated")
    if repeated.isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    of_one = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col(known)), "left_anti").withColumn(row, F.col("doc_id").cast("long"))
    hashed = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col(known)), "left_semi").withColumn(row, F.xxhash64("doc_id", "source", "text"))
    equal = materialise(hashed.groupBy(row).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(row).alias(known)), "mix-equal")
    alone = hashed.join(equal, F.col(row) == F.col(known), "left_anti")
    numbered = hashed.join(equal, F.col(row) == F.col(known), "left_semi").withColumn(row, F.xxhash64(row, F.monotonically_increasing_id()))
    return of_one.unionByName(alone).unionByName(materialise(numbered, "mix-numbered"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = fresh(docs, "_id")
    whole = with_row_ids(docs, row)
    taken = mixing.mix(whole.select(F.col(row).alias("doc_id"), "source", "text")).where("taken > 0")
    added = {c: c if fresh(docs, c) == c else fresh(docs, f"mix_{c}") for c in ("size", "source_size", "target", "taken")}
    return whole.join(taken.select(F.col("doc_id").alias(row), *(F.col(c).alias(name) for c, name in added.items())), row).drop(row)


STAGES = [
    ("language", identify_language),
    ("near copies", join_near_copies),
    ("decontamination", drop_benchmark),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Languages and personal data are learnt and the mix is drawn, which SQL can't express: tests hold each stage, and run(),
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
