"""Hard inputs: shared stems, long runs, large groups, damaged archives, dirty labels; and the queries' SQL."""

from __future__ import annotations

import gzip
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltweave.llm import common, decontam, media, mixing, pii, queries, tokens, warc

SF = "/root/testdata/sf0.001"


def edits(a: bytes, b: bytes) -> int:
    """The least edits that turn a into a substring of b."""
    row = [0] * (len(b) + 1)
    for i in range(1, len(a) + 1):
        new = [i]
        for j in range(1, len(b) + 1):
            new.append(min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("common_places, slice_, one_by_one", [(32, 1 << 21, 16), (2, 50, 0)])
def test_items_with_a_shared_stem_are_found_exactly(monkeypatch, common_places, slice_, one_by_one):
    monkeypatch.setattr(decontam, "COMMON", common_places)
    monkeypatch.setattr(decontam, "SLICE", slice_)
    monkeypatch.setattr(decontam, "ONE_BY_ONE", one_by_one)
    rng = random.Random(4)
    letters = "abcdefgh "
    stem = "which of the following answers is the right one for the question "
    items = [(i, stem + "".join(rng.choice(letters) for _ in range(rng.choice([9, 9, 30, 90])))) for i in range(40)]
    index = decontam.Index.of(items)
    for _ in range(12):
        parts = []
        for _ in range(2):
            s = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 9)):
                p = rng.randrange(len(s))
                s[p : p + rng.randint(0, 1)] = rng.choice(letters)
            parts.append("".join(s))
        doc = decontam.normal(" zz ".join(parts))
        best = dict(decontam.scan([doc], index)).get(0, {})
        for n, item in enumerate(index.items):
            d = edits(item, doc)
            assert (n in best) == (d <= index.k[n]), (item, doc)
            assert n not in best or best[n][0] == d


def test_many_items_of_one_stem_need_bounded_memory():
    stem = "what is the right answer to the following question about a subject "
    rng = random.Random(1)
    index = decontam.Index.of([(i, stem + "".join(rng.choice("abcdefgh ") for _ in range(250))) for i in range(1500)])
    text = decontam.normal((stem + "xv ") * 300)
    assert list(decontam.candidates(text, index)) == []  # the stem alone is not looked up


@pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary file")
def test_runs_of_white_space_have_any_length(monkeypatch):
    encoder = tokens.Encoder(tokens.load_ranks())
    for text in (" " * 1_000_000 + "x", "a" + "\n" * 700_000, "a　" + "\t \n" * 300_000 + "'s"):
        n_bytes, n_chars, n_tokens, n_sections, _, _, counts = tokens.token_record(encoder, text.encode())
        assert (n_bytes, n_chars, counts.sum(), n_sections) == (len(text.encode()), len(text), n_tokens, text.count("\n") + (text[-1] != "\n"))
    monkeypatch.setattr(tokens, "LONG_RUN", re.compile(tokens.LONG_RUN.pattern.replace("{2000,}", "{2,}")))
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice([" ", "  ", "\n", " \n\t", "a", "B2", "'s", "!?", "é", " ", " " * 5, "\x1c", "\x0b", "\x85"]) for _ in range(40))
        whole = np.cumsum(encoder.lengths[np.asarray(encoder.encoding.encode_ordinary(text), np.int64)])
        assert encoder.ends(text).tolist() == whole.tolist()


def test_attribution_equals_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        size = rng.randint(1, 40)
        cuts = lambda: np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}))
        ends, sections = cuts(), cuts()
        counts, crossing = tokens.attribute(ends, sections)
        want, over = [0] * len(sections), []
        for t, end in enumerate(ends.tolist()):
            start = ends[t - 1] if t else 0
            shares = [max(0, min(end, e) - max(start, sections[s - 1] if s else 0)) for s, e in enumerate(sections.tolist())]
            want[shares.index(max(shares))] += 1
            over += [t] if sum(x > 0 for x in shares) > 1 else []
        assert counts.tolist() == want and crossing.tolist() == over


def test_no_text_crowds_others_out_of_the_training_windows():
    texts = ["1 " * 80_000] + [f"call {i:04d} now" for i in range(1000)]
    windows = pii.training_windows(texts)
    assert len(windows) <= pii.CORPUS_WINDOWS and sum(n == 0 for n, _ in windows) == pii.DOC_WINDOWS
    assert {n for n, _ in windows} == set(range(1001))
    many = pii.training_windows([f"{i} " * 200 for i in range(1000)])
    assert len(many) == pii.CORPUS_WINDOWS and max(n for n, _ in many) > 990


def test_spans_of_a_text_do_not_depend_on_its_neighbours():
    model = pii.fit(["write to a.b@c.org or +1 212 555 0100"] * 20)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["é", "mail", "joe@site.example", "(212) 555-0199", "10.0.0.1", "v1.2", "word" * 30]) for _ in range(rng.choice([0, 3, 600]))) for _ in range(8)]
    together = pii.all_spans(texts, model)
    assert together == [pii.all_spans([t], model)[0] for t in texts]
    assert pii.encode("aé€ 𝒳1").tolist() == [97, 128, 129, 32, 128, 49]


def records(n: int, size: int = 3000) -> list[bytes]:
    rng = random.Random(n)
    return [warc.make_record(i, f"http://x/{i}", rng.randbytes(size), None, False) for i in range(n)]


def test_a_member_of_many_records_is_salvaged_within():
    whole = records(20)
    pages = lambda b: [int(r.headers["x-page-id"]) for r in warc.salvage(b) if r.kind != "gap"]
    assert pages(gzip.compress(b"".join(whole))) == list(range(20))
    damaged = bytearray(b"".join(whole))
    damaged[len(whole[0]) * 7 + 900] ^= 1
    out = list(warc.salvage(gzip.compress(bytes(damaged))))
    gap, = [r for r in out if r.kind == "gap"]
    start = sum(map(len, whole[:7]))
    assert pages(gzip.compress(bytes(damaged))) == [i for i in range(20) if i != 7]
    assert gap.inner == (start, start + len(whole[7])) and gap.reason == "payload digest"
    member = gzip.compress(b"".join(whole))
    cut = member[: len(member) // 2] + warc.member(warc.make_record(99, "http://y", b"later", None, False))
    got = pages(cut)
    assert got[-1] == 99 and got[:-1] == list(range(len(got) - 1)) and 8 <= len(got) - 1 <= 10


def test_reading_takes_time_in_proportion():
    import time

    def seconds(n: int) -> float:
        b = b"".join(map(warc.member, records(n, 20_000)))
        began = time.time()
        assert sum(1 for _ in warc.salvage(b)) == n
        return time.time() - began

    assert seconds(1600) < 12 * max(seconds(400), 0.02)  # 16 if it copied what follows each record


def test_pages_of_all_sizes_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", ((100, 3), (1000, 2), (1 << 62, 1)))
    rows = [(i, f"http://x/{i}", "z" * (i * 37 % 3000)) for i in range(60)] + [(60, None, None), (61, "u", "z" * 37)]
    got = {r["page_id"]: r for r in warc.query(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    last: dict = {}
    for i, _, html in rows:
        last[html or ""] = i
    assert {i: (r["payload_bytes"], r["refers_to"]) for i, r in got.items()} == {i: (len(html or ""), None if last[html or ""] == i else last[html or ""]) for i, _, html in rows}


def test_equal_rows_of_the_mix_are_numbered_in_parts(spark, monkeypatch):
    rows = [(None, "a b c", "s")] * 57 + [(1, "a b", "s"), (2, None, "s"), (None, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MANY", 10)
    assert sorted(map(repr, mixing.mix(docs).collect())) == whole and len(whole) == len(rows)


def test_batches_are_bounded_by_bytes(spark):
    common.bounded_batches(spark)
    big = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("b"))

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [sum(len(x) for x in pdf["b"])]})

    most = max(r["n"] for r in big.mapInPandas(sizes, "n long").collect())
    seen = F.pandas_udf(lambda s: pd.Series([sum(map(len, s))] * len(s)), "long")
    assert max(most, big.select(seen("b").alias("n")).agg(F.max("n")).first()[0]) <= common.BATCH_BYTES + (1 << 20)


def test_labels_may_be_many(spark):
    rows = [(i, "en") for i in range(500)] + [(i, f"dirt{i}") for i in range(400)]
    got = common.stratified(spark.createDataFrame(rows, "k long, lang string"), "lang", "k", 100)
    labels = {r["lang"] for r in got.collect()}
    assert "en" in labels and len(labels) <= common.MOST_LABELS
    same = spark.createDataFrame([(7, "en")] * 300 + [(8, "en")] * 5, "k long, lang string")
    assert common.bounded(same, 20).count() == 20
    assert common.fresh(same, "K") == "_K" and common.fresh(same, "z") == "z"


def test_types_are_told_from_content_and_declaration(spark):
    gz = gzip.compress(b"hello")
    rows = [(gz, "image/png"), (b"plain text", "image/png"), (b"plain text", "text/html"), (b"\x00\x01", None), (None, "image/gif"), (gz[:-1], "application/gzip"), (b"x" + gz, "text/csv")]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary, t string").coalesce(1).select(media.corrected_types(F.col("b"), F.col("t"))).collect()]
    assert got == ["application/gzip", "text/plain", "text/html", "application/octet-stream", "application/x-empty", "application/octet-stream", "text/csv"]
    one = spark.createDataFrame([("abc", "image/png"), ("abc", None)], "text string, t string").select(media.stored_media(F.col("text"), F.col("t")).alias("m")).select("m.feature").collect()
    assert ["declared=image/png;fixed=1" in r[0] for r in one] == [True, False] and all("content=text/plain" in r[0] for r in one)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, spark, duck):
    df = queries.queries()[name](spark, SF)
    result = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


def test_payload_hashes_are_those_of_the_bytes(spark):
    rows = warc.query(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r["page_id"]: r["payload_digest"] for r in rows} == {i: warc.base32_sha1(b) for i, b in html.items()}
