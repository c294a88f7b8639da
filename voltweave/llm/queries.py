"""The registered queries of the corpus operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltweave.llm import decontam, langid, licenses, media, mixing, pii, setjoin, tokens, toxicity, warc
from voltweave.llm.common import table
from voltweave.plans.queries_graph import labels_sql


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.query(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.query(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.query(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROUNDS = 10

OP3_SQL = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as materialized (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from sh group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select x as u, y as v from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 85 * (p.n + q.n - i)),
e as materialized (select u, v from links union all select v, u from links), d as materialized (select doc_id as id from documents),
{labels_sql("d", "e", _ROUNDS)}
select documents.doc_id, coalesce(n, 0) as n_shingles, c as component_id from documents left join n using (doc_id) join l{_ROUNDS} on id = documents.doc_id"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, {1 + 5 * g}, 5))::bigint >> {15 - 5 * k}) & 31)::bigint, 1)" for g in range(8) for k in range(4))

OP4_SQL = f"""with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages), m as (select *, max(page_id) over (partition by hex) as keep from p)
select page_id, cast(strlen(body) as bigint) as payload_bytes, {_BASE32} as payload_digest, case when page_id = keep then 'response' else 'revisit' end as record_type, case when page_id <> keep then keep end as refers_to from m"""


def oracle_sql() -> dict[str, str]:
    """Of the others, parts learnt or drawn, or spans and features, are beyond SQL."""
    return {"op3_jaccard": OP3_SQL, "op4_warc": OP4_SQL}
