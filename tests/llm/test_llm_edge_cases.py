"""Every operator over nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import pytest

from voltweave.llm import decontam, langid, licenses, media, mixing, pii, setjoin, tokens, toxicity, warc

LONG = "alpha beta gamma delta " * 8000
WORD = "x" * 120_000
DOCS = [
    (1, "the cat sat on the mat and the dog ran", "en", "a", 10),
    (1, "the cat sat on the mat and the dog ran", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "der hund und die katze sind im haus", "de", None, 5),
    (4, "   \n\t ", "de", "b", 6),
    (5, LONG, "en", "b", len(LONG)),
    (6, WORD, None, "b", len(WORD)),
    (7, "the cat sat on the mat and the dog ran", "en", "c", 10),
    (8, "12345 67890 !!!", "en", "c", 15),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "size", "n", "sig", "_r", "token", "component_id", "taken", "target", "lang_pred", "feature", "start", "p", "block", "_id", "_rows", "text_"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, None, 1), (7, 1, None), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog ran"), (1, "the cat sat on the mat and the dog ran"), (2, None), (3, "short"), (None, "der hund und die katze sind im haus")], "item_id long, text string")


def _all(labels, benchmark):
    return {
        "op1": lambda d: toxicity.query(d, labels),
        "op2": mixing.query,
        "op3": setjoin.query,
        "op5": pii.query,
        "op6": licenses.query,
        "op7": media.query,
        "op8": tokens.query,
        "op9": lambda d: decontam.query(d, benchmark),
        "op10": langid.query,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op6", "op7", "op8", "op9", "op10"])
def test_clashing_columns_change_nothing(name, docs, clashing, labels, benchmark):
    f = _all(labels, benchmark)[name]
    key = lambda rows: sorted(map(repr, rows))
    plain = key(f(docs).collect())
    assert plain == key(f(clashing).collect())
    if name != "op9":
        assert len(plain) == len(DOCS)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables_give_empty_results(name, none, labels, benchmark):
    assert _all(labels, benchmark)[name](none).collect() == []


def test_toxicity_of_empty_texts_is_a_score(docs, labels):
    rows = toxicity.query(docs, labels).collect()
    assert len(rows) == len(DOCS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_language_of_texts_without_letters_is_undetermined(docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.query(docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (8, "und")} <= got
    assert all(x[1] != "und" for x in got if x[0] in (1, 7))


def test_set_join_classes(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in setjoin.query(docs).collect())
    of = {x[1]: (x[2], x[3]) for x in got if not x[0]}
    assert of[1] == (7, 1) and of[7] == (7, 1)
    assert of[2] == (0, 2) and of[3] == (0, 3) and of[4] == (0, 4)
    assert of[6] == (1, 6) and of[8] == (1, 8)
    assert of[5] == (4, 5)
    assert [x for x in got if x[0]][0][3] is None


def test_one_of_each_class_stays(docs):
    kept = sorted(r["doc_id"] for r in setjoin.keep_one_of_each(docs).where("doc_id is not null").collect())
    assert kept == [1, 2, 3, 4, 5, 6, 8]


def _prose(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 100003}" for i in range(n))


def test_near_copies_are_judged_by_text_and_not_by_id(spark):
    near = lambda seed: _prose(seed).rsplit(" ", 1)[0] + " changed"
    rows = [(9, _prose(i)) for i in range(5)]  # unrelated texts under one id
    rows += [(1, _prose(5)), (9, near(5)), (9, _prose(6)), (12, near(6))]  # the repeated id has a copy of a lesser id, and of a greater one
    rows += [(None, _prose(7)), (None, near(7)), (None, _prose(8)), (20, _prose(9)), (None, near(9)), (-3, _prose(10)), (4, near(10))]
    rows += [(30, _prose(11))] * 3 + [(31, None), (31, ""), (None, " ")]
    kept = [(r["doc_id"], r["text"]) for r in setjoin.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    classes = {}  # least id, null last, of each class of texts
    for i, t in rows:
        if t and t.strip():
            classes.setdefault(t.rsplit(" ", 1)[0], []).append((i is None, i or 0))
    assert sorted((i is None, i or 0, t.rsplit(" ", 1)[0]) for i, t in kept if t and t.strip()) == sorted((*min(x), t) for t, x in classes.items())
    assert sorted((i or 0 for i, t in kept if not (t and t.strip()))) == [0, 31, 31]
    words = spark.createDataFrame([("b", _prose(1)), ("a", near(1)), ("ab", near(1)), ("b", _prose(2))], "doc_id string, text string")
    assert sorted((r["doc_id"], r["text"]) for r in setjoin.keep_one_of_each(words).collect()) == [("a", near(1)), ("b", _prose(2))]


def test_the_mix_keeps_rows_of_one_id_apart(spark):
    import corpus_pipeline

    rows = [(i if i < 50 else 50 if i < 75 else None, _prose(i if i % 5 else 0, 20 + i % 7), "a" if i % 2 else "b", None, None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    ids = [r["_id"] for r in corpus_pipeline.with_row_ids(docs).collect()]
    assert len(set(ids)) == len(ids) == len(rows)
    taken = corpus_pipeline.mix_sources(spark, docs, "").collect()
    seen = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["text"], x["source"])
    left = sorted(map(seen, docs.collect()))
    for r in taken:  # no row comes twice
        left.remove(seen(r))
        assert r["size"] == len(r["text"].split()) and 0 < r["taken"] <= 2 * r["size"]
    assert taken


def test_decontamination_of_edge_cases(docs, benchmark):
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.query(docs, benchmark).where("doc_id is not null").collect())
    assert got == [(1, 1, 0), (1, 1, 0), (7, 1, 0)]
    nameless = decontam.query(docs, benchmark).where("doc_id is null").collect()
    assert [(r["item_id"], r["edits"]) for r in nameless] == [(None, 0)]


def test_mixing_keeps_bounds(docs):
    rows = mixing.query(docs).collect()
    assert len(rows) == len(DOCS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.query(docs.repartition(7)).collect()))


def test_media_and_tokens_of_empty_text(docs):
    m = {r["doc_id"]: r for r in media.query(docs).collect()}
    assert (m[2]["n_bytes"], m[2]["payload_bytes"]) == (0, 64) and m[2]["payload_sha256"] == m[3]["payload_sha256"]
    t = {r["doc_id"]: r for r in tokens.query(docs).collect()}
    assert (t[2]["n_tokens"], t[2]["n_sections"]) == (0, 1)
    assert sum(t[5]["section_tokens"]) == t[5]["n_tokens"]


def test_pages_with_nulls_ties_and_repeats(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (None, "http://d", "same"), (5, "http://e f\n", "x" * 100_000), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.query(pages).collect()), key=repr)
    assert (False, 1, 4, "revisit", 2) in got and got.count((False, 2, 4, "response", None)) == 2
    assert (True, 0, 4, "revisit", 2) in got and (True, 0, 5, "response", None) in got
    assert (False, 3, 0, "revisit", 4) in got and (False, 4, 0, "response", None) in got
    assert len(got) == len(rows)
    assert warc.query(pages.limit(0)).collect() == []


def test_pii_of_edge_cases(spark, none):
    rows = [(1, None), (2, ""), (3, WORD + "@" + WORD), (4, "7" * 120_000), (5, "+1 (212) 555-0100, a.b@c.org; 1.2.3.4 and 4111 1111 1111 1111"), (5, "+1 (212) 555-0100, a.b@c.org; 1.2.3.4 and 4111 1111 1111 1111")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in pii.query(d).collect()]
    five = [r for r in got if r["doc_id"] == 5]
    assert len(got) == len(rows) and five[0] == five[1]
    assert (five[0]["n_email"], five[0]["n_ip"], five[0]["n_card"], five[0]["n_phone"]) == (1, 1, 1, 1)
    assert {r["spans"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert pii.query(none).collect() == []


def test_licences_of_edge_cases(docs):
    rows = licenses.query(docs).collect()
    assert len(rows) == len(DOCS)
    assert all(r["score"] == 0 and r["labels"] == "" for r in rows)
