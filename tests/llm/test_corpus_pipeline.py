"""The pipeline, stage by stage and whole, against brute force over a small fixture with planted cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voltweave.llm import decontam, langid, mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"en": "the of ing er and th on tion re at ha ou".split(), "de": "der und sch ein ich ung keit ver zu ie".split()}
ITEMS = [(1, "a train leaves the station at noon and travels sixty miles an hour until it meets another"), (2, "which planet of the solar system has the largest number of known moons"), (None, None)]


def word(rng: random.Random, lang: str) -> str:
    return "".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4)))


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(word(rng, lang) for _ in range(n))


def fixture() -> list[tuple]:
    rng = random.Random(12)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append([i, prose(rng, lang, rng.randint(20, 90)), lang if i % 7 else None, rng.choice(["web", "books", "code", None]), None])
    for i in range(0, 12, 2):  # near copies of greater ids, one of a lesser id, exact ones
        near = rows[i][1].split()
        near[-1] = "changed"
        rows.append([100 + i, " ".join(near), rows[i][2], "web", None])
    rows.append([-5, rows[20][1] + " end", "en", "code", None])
    rows += [[200, rows[21][1], "en", "web", None], [200, rows[21][1], "en", "web", None], [None, rows[22][1], "en", "books", None]]
    rows += [[210, prose(rng, "en", 30) + " " + ITEMS[0][1] + " " + prose(rng, "en", 30), "en", "web", None], [211, ITEMS[1][1].replace("largest", "larges").upper() + "!", "en", "web", None]]
    rows += [[220, prose(rng, "en", 20) + " write to jane.roe@mail.example or +1 (212) 555-0147, from 10.1.2.3, card 4111 1111 1111 1111 " + prose(rng, "en", 9), "en", "books", None]]
    rows += [[230, None, "en", "web", None], [231, "", None, None, None], [232, " 12 34 !", "de", "web", None], [None, None, None, None, None]]
    return [(a, t, c, d, len(t) if t is not None else None) for a, t, c, d, _ in rows]


@pytest.fixture(scope="module", autouse=True)
def quick_fit():
    """The tagger's accuracy is tested elsewhere."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "MADE_WINDOWS", 250)
        patch.setattr(pii, "EPOCHS", 2)
        yield


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(fixture(), SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def rows_of(df) -> Counter:
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())


def identified(docs) -> Counter:
    model = langid.train(docs)
    scores = langid.Scores(model)
    told = {t: langid.predict(model, scores, t or "") for t in {r["text"] for r in docs.collect()}}
    return Counter(x for x in rows_of(docs).elements() if told[x[1]][0] != "und" and told[x[1]][1] >= 0.3)


def shingles(text: str) -> frozenset:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each(rows: Counter) -> tuple[Counter, list[list[tuple]]]:
    """Rows without words, and the classes of the others, each a list of candidates of least id."""
    texts = sorted({x[1] or "" for x in rows})
    sets = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    classes: dict[str, list[tuple]] = {}
    for x in rows:
        if sets[x[1] or ""]:
            classes.setdefault(find(x[1]), []).append(x)
    least = lambda x: (x[0] is None, x[0] or 0)
    return Counter({x: n for x, n in rows.items() if not sets[x[1] or ""]}), [[x for x in c if least(x) == min(map(least, c))] for c in classes.values()]


def same_choice(got: Counter, rows: Counter) -> None:
    wordless, classes = one_of_each(rows)
    rest = got - wordless
    assert got - rest == wordless and sum(rest.values()) == len(classes)
    assert all(sum(x in rest for x in c) == 1 for c in classes)


def leaks(text: str) -> bool:
    for _, item in ITEMS:
        if item:
            a, b = decontam.normal(item), decontam.normal(text or "")
            row = [0] * (len(b) + 1)
            for i in range(1, len(a) + 1):
                new = [i]
                for j in range(1, len(b) + 1):
                    new.append(min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1))
                row = new
            if min(row) <= decontam.budget(len(a)):
                return True
    return False


def test_every_stage_equals_brute_force(spark, docs, tables):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near copies", "decontamination", "personal data", "mixing"]
    kept = stage["language"](spark, docs, tables)
    assert kept.columns == docs.columns and rows_of(kept) == identified(docs)
    assert {230, 231, 232}.isdisjoint(x[0] for x in rows_of(kept)) and {0, 1, 220} <= {x[0] for x in rows_of(kept)}
    single = stage["near copies"](spark, docs, tables)
    assert single.columns == docs.columns
    same_choice(rows_of(single), rows_of(docs))
    clean = stage["decontamination"](spark, docs, tables)
    assert clean.columns == docs.columns
    assert rows_of(clean) == Counter(x for x in rows_of(docs).elements() if not leaks(x[1]))
    assert rows_of(docs).keys() - rows_of(clean).keys() == {x for x in rows_of(docs) if x[0] in (210, 211)}
    model = pii.train(docs)
    hidden = {t: pii.redact(t, b + a) for t in {x[1] for x in rows_of(docs)} if t is not None for b, a in pii.all_spans([t], model)}
    private = stage["personal data"](spark, docs, tables)
    assert private.columns == docs.columns
    want = Counter({(i, hidden.get(t), lang, s, None if t is None else len(hidden[t])): n for (i, t, lang, s, _), n in rows_of(docs).items()})
    assert rows_of(private) == want
    text, = [x[1] for x in rows_of(private) if x[0] == 220]
    assert all(f"[{k}]" in text for k in ("EMAIL", "PHONE", "IP", "CARD")) and pii.base_spans(text) == []


def mixed(rows: Counter, got: list) -> None:
    """Sizes, targets and bounds of a mix, by the rule as stated."""
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    names = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(words(x[1]) * n for x, n in rows.items() if x[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = {s: rest * weight[s] / sum(weight[t] for t in names if t not in capped) for s in names if s not in capped}
        if not (over := {s for s, x in free.items() if x > 2 * sizes[s]}):
            break
        capped |= over
    taken: Counter = Counter()
    left = Counter(rows)
    for r in got:
        x = (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
        left[x] -= 1
        assert left[x] >= 0 and r["size"] == words(r["text"]) and r["taken"] in (r["size"], 2 * r["size"])
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(free.get(r["source"], 2 * sizes[r["source"]]))
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - free.get(s, 2 * sizes[s])) <= 45


def test_the_whole_run_equals_the_stages_in_turn(spark, docs, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    left = identified(docs)
    wordless, classes = one_of_each(left)
    out = {(r["doc_id"], r["source"]) for r in got}
    assert not wordless and {210, 211}.isdisjoint(i for i, _ in out)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, tables)
    rows = rows_of(kept)
    assert sum(rows.values()) == sum(not leaks(c[0][1]) for c in classes)
    mixed(rows, got)


def test_clashing_names_empty_tables_and_null_columns(spark, docs, tables, tmp_path):
    names = ["_id", "_known", "_n", "_key", "_doubt", "_rows", "_stays", "_lang_found", "_leak", "size", "target", "taken", "score", "component_id"]
    wide = docs.withColumns({c: F.lit("clash") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        plain, got = stage(spark, docs, tables), stage(spark, wide, tables)
        if name == "mixing":
            assert got.columns == [*wide.columns, "mix_size", "source_size", "mix_target", "mix_taken"]
            assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in plain.collect())
        else:
            assert got.columns == wide.columns and rows_of(got) == rows_of(plain)
        assert got.where(F.coalesce(*(F.when(F.col(c) != "clash", F.lit(c)) for c in names)).isNotNull()).isEmpty()
    folder = str(tmp_path)
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert len(stage(spark, nothing, folder).collect()) == {"language": 0, "mixing": 0}.get(name, 3)
