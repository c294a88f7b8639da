"""Benchmark decontamination by the q-gram lemma, in diagonal bands, verified by banded alignment.

Texts and benchmark items are compared as lower-case words between single spaces. An item of m bytes may differ from its
copy by k = EDIT_RATE * m edits. By the q-gram lemma such a copy shares at least m - Q + 1 - k * Q of the item's q-grams with
the text, and they lie on at most k + 1 neighbouring diagonals (text position minus item position). So shared q-grams are
counted in bands of 2k + 2 diagonals that overlap by half; a band that reaches the bound is a candidate region, and an
alignment restricted to the band's diagonals gives the edit distance. No copy within the budget is lost.

Q-grams that more than COMMON places of the benchmark hold (stems that many items share) aren't looked up, as far as an item's
bound allows: leaving out n of an item's q-grams lowers its bound by n, and it must stay 1 at least. Look-ups are counted in
slices of SLICE, regions aligned in batches of items of one length, so memory is bounded however many items share a stem.

The benchmark is streamed to the driver in blocks of at most BLOCK_BYTES; each block's index goes to the executors and makes
one pass over the documents. Texts are searched whole.

Items of fewer than LEAST_BYTES bytes have no budget and too few q-grams: they are found word for word, at word boundaries.

Defined cases: null and empty texts contain nothing; items without a word (null ones too) are never found; an excerpt of an item
is no copy unless what it leaves out is within the budget; items whose budget would make the bound useless get the largest budget that doesn't; repeated
items count once per id, equal texts under several ids once for each; repeated documents are reported repeatedly. Of several
copies of an item in a document the one with fewest edits is reported, the first among equals. An empty benchmark finds
nothing. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.llm.common import bounded_batches, decode, fresh, splitmix, utf8

Q = 12
EDIT_RATE = 0.06
LEAST_BYTES = 24
BLOCK_BYTES = 4 << 20
#: Texts are scanned together up to so many bytes.
SCAN_BYTES = 1 << 20
BITS = 22
#: Places of the benchmark that may hold a q-gram that is always looked up; look-ups counted at a time; bands aligned singly.
COMMON, SLICE, ONE_BY_ONE = 32, 1 << 21, 16
_DROP = bytes(x for x in range(128) if not chr(x).isalnum())
_SPACES = bytes.maketrans(_DROP, b" " * len(_DROP))
_GAP = b"\x00" * Q
_TABLE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = np.uint64(0xD6E8FEB86659FD93)


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_SPACES).split())


def qgram_hashes(data: bytes) -> np.ndarray:
    """A hash of the Q = 12 bytes from each position on."""
    h = _TABLE[np.frombuffer(data, np.uint8)]
    if len(h) < Q:
        return h[:0]
    with np.errstate(over="ignore"):
        h2 = h[:-1] * _A + h[1:]
        a2 = _A * _A
        h4 = h2[:-2] * a2 + h2[2:]
        a4 = a2 * a2
        h8 = h4[:-4] * a4 + h4[4:]
        return h8[: len(h) - Q + 1] * a4 + h4[8 : 8 + len(h) - Q + 1]


def budget(m: int) -> int:
    """Edits that an item of m bytes may have: its share, but never so many that the lemma's bound falls below 1."""
    return min(int(EDIT_RATE * m), max(0, (m - Q) // Q))


@dataclass
class Index:
    ids: list
    items: list[bytes]
    k: np.ndarray
    need: np.ndarray
    hashes: np.ndarray  #: sorted, one for each posting
    owner: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    longest: int
    short: dict[bytes, dict[int, dict[bytes, list[int]]]]  #: first word, length, item: numbers of the items that are too short for q-grams

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Index:
        pairs = sorted({(i, normal(t)) for i, t in rows if t}, key=lambda x: (str(x[0]), x[1]))
        pairs = [(i, t) for i, t in pairs if t]
        items = [t for _, t in pairs]
        parts = [qgram_hashes(t if len(t) >= LEAST_BYTES else b"") for t in items]
        short: dict[bytes, dict[int, dict[bytes, list[int]]]] = {}
        for n, t in enumerate(items):
            if len(t) < LEAST_BYTES:
                short.setdefault(t.split(b" ", 1)[0], {}).setdefault(len(t), {}).setdefault(t, []).append(n)
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(p) for p in parts]).astype(np.int32)
        place = np.concatenate([np.arange(len(p)) for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
        m = np.array([len(t) for t in items], np.int64)
        k = np.array([budget(len(t)) for t in items], np.int64)
        need = m - Q + 1 - k * Q
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        often = times[which] if len(hashes) else np.zeros(0, np.int64)
        order = np.lexsort((-often, owner))  # an item's most common q-grams first
        nth = np.arange(len(order)) - np.concatenate(([0], np.cumsum([len(p) for p in parts])))[owner[order]] if len(order) else order
        out = order[(often[order] > COMMON) & (nth < need[owner[order]] - 1)]
        need -= np.bincount(owner[out], minlength=len(items))
        kept = np.ones(len(hashes), bool)
        kept[out] = False
        hashes, owner, place = hashes[kept], owner[kept], place[kept]
        order = np.argsort(hashes, kind="stable")
        bitmap = np.zeros(1 << BITS, bool)
        bitmap[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return Index([i for i, _ in pairs], items, k, need, hashes[order], owner[order], place[order], bitmap, int(m.max(initial=0)), short)


def candidates(data: bytes, index: Index) -> Iterator[tuple[int, int, int]]:
    """Item number, and first and last diagonal, of each band that reaches the bound."""
    h = qgram_hashes(data)
    at = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(at) or not len(index.hashes):
        return
    low = np.searchsorted(index.hashes, h[at], side="left")
    count = np.searchsorted(index.hashes, h[at], side="right") - low
    at, low, count = at[count > 0], low[count > 0], count[count > 0]
    shift = index.longest + 2  # makes diagonals and bands positive
    slices = np.unique(np.searchsorted(np.cumsum(count), np.arange(SLICE, int(count.sum()) + SLICE, SLICE), side="right").clip(1, len(at)))
    keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = 0
    for last in slices.tolist():
        a, lo, c = at[first:last], low[first:last], count[first:last]
        posting = np.repeat(lo - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        item = index.owner[posting].astype(np.int64)
        band = (np.repeat(a, c) - index.place[posting] + shift) // (index.k[item] + 1)
        new, n = np.unique(np.concatenate(((item << 40) + band, (item << 40) + band - 1)), return_counts=True)
        if len(keys):
            new, n = np.concatenate((keys, new)), np.concatenate((total, n))
            keys, which = np.unique(new, return_inverse=True)
            total = np.bincount(which, weights=n).astype(np.int64)
        else:
            keys, total = new, n
        item = keys >> 40
        width = index.k[item] + 1
        high = ((keys & ((1 << 40) - 1)) + 2) * width - 1 - shift
        beyond = at[last] if last < len(at) else np.iinfo(np.int64).max
        done = high + index.longest < beyond  # no later q-gram can be in the band
        for i, h, w in zip(*(x[done & (total >= index.need[item])].tolist() for x in (item, high, width)), strict=True):
            yield i, h + 1 - 2 * w, h
        keys, total = keys[~done], total[~done]
        first = last


def align(item: bytes, region: bytes, low: int, high: int) -> tuple[int, int]:
    """The least edits that turn item into a substring of region, and that substring's end.

    Only cells with low <= region position - item position <= high are filled.
    """
    a, r = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    n = high - low + 1
    far = len(item) + n + 1
    columns = np.arange(n)
    padded = np.full(len(r) + 2 * n + abs(low) + len(a) + 2, 0, np.int16)
    shift = n + abs(low)
    padded[shift : shift + len(r)] = r
    inside = np.zeros(len(padded) + 1, bool)
    inside[shift : shift + len(r) + 1] = True
    row = np.where(inside[shift + low : shift + low + n], 0, far)
    for i in range(len(a)):
        start = shift + i + low  # of the region byte on the first diagonal
        diagonal = row + (padded[start : start + n] != a[i])
        skipped = np.append(row[1:], far) + 1  # item byte without partner
        best = np.where(inside[start + 1 : start + 1 + n], np.minimum(diagonal, skipped), far)
        row = np.minimum.accumulate(best - columns) + columns  # region bytes without partner
    row = np.where(inside[shift + len(a) + low : shift + len(a) + low + n], row, far)
    j = int(row.argmin())
    return int(row[j]), len(a) + low + j


def close_enough(text: bytes, found: list[tuple[int, int, int]], index: Index) -> list[tuple[int, int, int]]:
    """The bands in which an item's copy lies within its budget, told for all bands of items of one length at a time."""
    out = []
    bytes_of = np.frombuffer(text, np.uint8).astype(np.int16)
    for _, group in itertools.groupby(sorted(found, key=lambda x: (len(index.items[x[0]]), x)), key=lambda x: len(index.items[x[0]])):
        bands = list(group)
        m, n = len(index.items[bands[0][0]]), bands[0][2] - bands[0][1] + 1
        step = max(1, (1 << 18) // (m + n))
        for at in range(0, len(bands), step):
            part = bands[at : at + step]
            items = np.frombuffer(b"".join(index.items[i] for i, _, _ in part), np.uint8).reshape(len(part), m)
            low = np.array([x[1] for x in part], np.int64)
            columns = np.arange(n)
            far = m + n + 1
            place = low[:, None] + columns
            row = np.where((place >= 0) & (place <= len(text)), 0, far)
            for i in range(m):
                place = low[:, None] + (i + columns)  # of the text byte on each diagonal
                byte = np.where((place >= 0) & (place < len(text)), bytes_of[place.clip(0, len(text) - 1)], -1)
                skipped = np.concatenate((row[:, 1:], np.full((len(part), 1), far)), axis=1) + 1  # item byte without partner
                best = np.where((place >= -1) & (place < len(text)), np.minimum(row + (byte != items[:, i : i + 1]), skipped), far)
                row = np.minimum.accumulate(best - columns, axis=1) + columns  # text bytes without partner
            place = low[:, None] + (m + columns)
            least = np.where((place >= 0) & (place <= len(text)), row, far).min(axis=1)
            out += [x for x, d in zip(part, least.tolist(), strict=True) if d <= index.k[x[0]]]
    return out


def verify(item: bytes, text: bytes, first: int, last: int, k: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the item's copy in text on diagonals first to last; None beyond k edits."""
    lo, hi = max(0, first), min(len(text), last + len(item) + 1)
    region = text[lo:hi]
    at = region.find(item)
    if at >= 0:
        return 0, lo + at, lo + at + len(item)
    edits, end = align(item, region, first - lo, last - lo)
    if edits > k:
        return None
    back, length = align(item[::-1], region[:end][::-1], -k, k)
    return edits, lo + end - length, lo + end


def matches(text: bytes, found: list[tuple[int, int, int]], index: Index) -> dict[int, tuple[int, int, int]]:
    """Item number to (edits, start, end) of its best copy, from candidate bands."""
    best: dict[int, tuple[int, int, int]] = {}
    for i, first, last in close_enough(text, found, index) if len(found) > ONE_BY_ONE else found:
        hit = verify(index.items[i], text, first, last, int(index.k[i]))
        if hit and (i not in best or hit < best[i]):
            best[i] = hit
    return best


def short_matches(text: bytes, index: Index) -> dict[int, tuple[int, int, int]]:
    """Item number to (0, start, end) of the first place of each short item."""
    best: dict[int, tuple[int, int, int]] = {}
    at = 0
    for word in text.split(b" "):
        for length, items in index.short.get(word, {}).items():
            end = at + length
            if text[end : end + 1] in (b"", b" "):
                for i in items.get(text[at:end], ()):
                    best.setdefault(i, (0, at, end))
        at += len(word) + 1
    return best


def scan(texts: list[bytes], index: Index) -> Iterator[tuple[int, dict[int, tuple[int, int, int]]]]:
    """Number and matches of each normalised text that has any; short texts are scanned together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SCAN_BYTES):
            size += len(texts[end]) + len(_GAP)
            end += 1
        starts = np.cumsum([0] + [len(t) + len(_GAP) for t in texts[at:end]])
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        for i, first, last in candidates(_GAP.join(texts[at:end]), index):
            # a band belongs to every text that its diagonals can reach
            t = max(0, int(np.searchsorted(starts, first, side="right")) - 1)
            while t < end - at and starts[t] <= last + len(index.items[i]):
                by_text.setdefault(t, []).append((i, first - int(starts[t]), last - int(starts[t])))
                t += 1
        for t in range(end - at) if index.short else sorted(by_text):
            best = matches(texts[at + t], by_text.get(t, []), index)
            if index.short:
                best |= short_matches(texts[at + t], index)
            if best:
                yield at + t, best
        at = end


def character_map(text: str) -> list[int]:
    """The character of the text that each byte of normal(text) comes from."""
    out: list[int] = []
    space = True
    for at, char in enumerate(text):
        for b in char.lower().encode().translate(_SPACES):
            if b != 32:
                out.append(at)
                space = False
            elif not space:
                out.append(at)
                space = True
    return out[:-1] if space and out else out


FIELDS = "doc_id long, item_id long, start long, end long, edits int, item_bytes int"


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    rows: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(r["text"]) > BLOCK_BYTES:
            yield Index.of(rows)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield Index.of(rows)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: place in characters, end exclusive, and edits."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), utf8(F.col("text")).alias("text"))
    out = None
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                texts = [decode(t) for t in pdf["text"]]
                found = []
                for n, best in scan([normal(t) for t in texts], index):
                    chars = character_map(texts[n])
                    doc = pdf["doc_id"].iat[n]
                    for i, (edits, start, end) in best.items():
                        found.append((None if doc is None else int(doc), index.ids[i], chars[start], chars[end - 1] + 1, edits, len(index.items[i])))
                if found:
                    yield pd.DataFrame(found, columns=[x.split()[0] for x in FIELDS.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(run, FIELDS)
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def _has_item(shared: Broadcast):
    @F.pandas_udf("boolean")
    def has(text: pd.Series) -> pd.Series:
        flags = np.zeros(len(text), bool)
        for n, _ in scan([normal(decode(t)) for t in text], shared.value):
            flags[n] = True
        return pd.Series(flags)

    return has


def contaminated(docs: DataFrame, benchmark: DataFrame) -> Column:
    """Whether the text column of docs contains a benchmark item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = F.lit(False)
    for index in blocks(benchmark):
        out = out | _has_item(spark.sparkContext.broadcast(index))(utf8(F.col("text")))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark item."""
    leak = fresh(docs, "_leak")
    return docs.withColumn(leak, contaminated(docs, benchmark)).where(~F.col(leak)).select(*docs.columns)


query = find
