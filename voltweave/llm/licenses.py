"""Licence scans by a positional index of rare words.

The licence templates below are indexed by word and position. One pass over all documents counts in how many each licence
word occurs; that gives the words' inverse document frequencies. In the second pass each document looks up, for every
template whose mandatory key phrases it holds, that template's RARE words of highest IDF and the rarest word of each phrase,
so no template crowds out another. Every occurrence votes for (template, document position - template position).
Alignments that enough of the words agree on, or all looked-up words of one phrase, up to SLACK inserted or missing words, are
candidates: wherever a key phrase stands is one. A candidate counts if most of the template's words stand in its window in
order, and every mandatory key phrase is there, its words consecutive.

Besides, the base labels: places where a fixed phrase's words stand consecutively.

Defined cases: null and empty texts have no words, no labels and score 0; phrases are found wherever their words follow each
other, punctuation and case aside; ties of IDF go to the word that sorts first; equal texts get equal results. Other columns are not
looked at, and documents are read whole.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.llm.common import bounded_batches, scored, utf8

#: Phrases of the base scan and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: (notice text, mandatory key phrases). Public licence notices and opening passages (fixed values).
TEMPLATES: dict[str, tuple[str, list[str]]] = {
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "without restriction including without limitation"]),
    "mit-notice": ("released under the mit license", ["mit license"]),
    "apache-2-notice": ("licensed under the apache license version 2 0", ["apache license version 2"]),
    "apache-2-text": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2", "except in compliance with the license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    "gpl-3-notice": ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "gpl-text": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ["terms of the gnu general public license", "free software foundation"]),
    "lgpl-text": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2"]),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    "cc-by-nc-notice": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
}

RARE, SLACK = 12, 2
#: Share of a template's words that must stand in its window in order.
COVER = 0.8

_DROP = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_SPACES = bytes.maketrans(_DROP, b" " * len(_DROP))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACES).split()


class Index:
    """Postings of the templates: word to (template, position)."""

    def __init__(self) -> None:
        self.labels = list(TEMPLATES)
        self.words = [words_of(TEMPLATES[k][0].encode()) for k in self.labels]
        self.keys = [[b" " + b" ".join(words_of(p.encode())) + b" " for p in TEMPLATES[k][1]] for k in self.labels]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for i, w in enumerate(words):
                self.postings[w].append((t, i))
        self.vocabulary = frozenset(self.postings)
        self.phrases = [[frozenset(key.split()) for key in keys] for keys in self.keys]


INDEX = Index()
NEEDLES = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in PHRASES.items()]


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """Word position and label of every place of a base phrase; joined: words between single spaces."""
    out = []
    for needle, label in NEEDLES:
        at, seen, counted = joined.find(needle), 0, 0
        while at >= 0:
            seen += joined.count(b" ", counted, at)
            counted = at
            out.append((seen, label))
            at = joined.find(needle, at + 1)
    return out


def template_hits(words: list[bytes], idf: dict[bytes, float], index: Index = INDEX) -> dict[str, float]:
    """Label and coverage of the templates that a document's words contain."""
    present = index.vocabulary.intersection(words)
    held = [t for t, phrases in enumerate(index.phrases) if all(p <= present for p in phrases)]
    if not held:
        return {}
    joined = b" " + b" ".join(words) + b" "
    held = [t for t in held if all(key in joined for key in index.keys[t])]
    rank = {w: k for k, w in enumerate(sorted(present, key=lambda w: (-idf.get(w, 0.0), w)))}
    wanted: dict[int, set[bytes]] = {}
    for t in held:
        rare = sorted(present.intersection(index.words[t]), key=rank.__getitem__)[:RARE]
        wanted[t] = set(rare).union(min(p, key=rank.__getitem__) for p in index.phrases[t])
    asked, votes = set().union(*wanted.values()), defaultdict(list)
    for at, w in enumerate(words):
        if w in asked:
            for t, i in index.postings[w]:
                if t in wanted and w in wanted[t]:
                    votes[t].append((at - i, i))
    out: dict[str, float] = {}
    for t, found in votes.items():
        template = index.words[t]
        need = math.ceil(COVER * len(wanted[t]))
        phrases = [p & wanted[t] for p in index.phrases[t]]
        found.sort()
        offsets, done = [x for x, _ in found], -len(template) - 1
        for k, (offset, _) in enumerate(found):
            if offset <= done:
                continue
            agreed = {template[i] for _, i in found[k : bisect_right(offsets, offset + SLACK)]}
            if len(agreed) < need and not any(p <= agreed for p in phrases):
                continue
            done = offset
            window = words[max(0, offset - SLACK) : max(0, offset + len(template) + 2 * SLACK)]
            text = b" " + b" ".join(window) + b" "
            if not all(key in text for key in index.keys[t]):
                continue
            cover = sum(m.size for m in SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks()) / len(template)
            if cover >= COVER:
                out[index.labels[t]] = max(out.get(index.labels[t], 0.0), cover)
                done = offset + SLACK
    return out


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, over all documents; as many figures as the templates have words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(INDEX.vocabulary.intersection(words_of(bytes(text))))
                counts[b""] += 1
        if counts:
            yield pd.DataFrame({"word": [w.decode() for w in counts], "n": list(counts.values())})

    rows = docs.select(utf8(F.col("text")).alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(text: bytes, idf: dict[bytes, float]) -> tuple:
    words = words_of(text)
    places = base_places(b" " + b" ".join(words) + b" ") if words else []
    base = {label for _, label in places}
    hits = template_hits(words, idf)
    starts = [at for at, _ in places]
    score = 1.0 if base else max(hits.values(), default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(hits))), score


def query(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    df, n = document_frequencies(docs)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in INDEX.vocabulary}
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan(bytes(t), idf) for t in texts], columns=names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scored(FIELDS, run)(utf8(F.col("text"))).alias("_s")).select("doc_id", "_s.*")
