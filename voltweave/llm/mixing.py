"""Mixing sources to target weights by balanced sampling with the cube method.

Every source's target follows from its weight; a source never gives more than twice its words. A document of a source
with target / size = r is taken floor(r) times for sure and once more with probability r - floor(r). Which documents get
that extra copy is decided by the cube method: the vector of inclusion probabilities moves along the null space of the
balancing constraints (words, documents) until probabilities reach 0 or 1. With two constraints three undecided documents
suffice for a move, so a block of any documents can be flown by itself and leaves two undecided ones; those of all blocks
meet in the blocks of the next level, which are fewer by the factor BLOCK / 3. In a source's last block the landing picks,
among all ways to decide the last documents, the one nearest to the target words, and swaps a few documents of that block
if that brings the words nearer still. No group is larger than a block, however large a source.

Defined cases: a null text has size 0; null sources form one source, the last; null ids and ids that repeat are kept, rows
equal in id, source and size are decided together (as many extra copies as their probabilities sum to, up to rounding) and
come back as so many rows; an empty table gives an empty result; a source without words has target 0. All draws are hashes
of the source's rank and the block, so reruns and other partitionings agree. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.operators.ranking import dense_rank_global
from voltweave.session import materialise

#: Documents flown together.
BLOCK = 1000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Swaps tried at the landing, at most.
SWAPS = 16
EPS = 1e-9
#: Equal rows that one array may number.
MANY = 10_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: its rank by code point (null last), documents, words, and target words."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    ranked = materialise(dense_rank_global(per, [F.col("source").asc_nulls_last()], "source_rank"), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(MOST)
    level = 0.0  # words per unit of weight; it only rises, so a capped source stays capped
    while True:
        above = F.lit(level) * F.col("weight") > cap
        row = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break
        new = (SHARE * row["all"] - (row["capped"] or 0.0)) / row["free"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def fly(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities in the null space of (words, documents) until at most two lie strictly between 0 and 1."""
    p = p.astype(np.float64).copy()
    window: list[int] = []
    todo = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    draws = rng.random(len(p) + 8)
    at = 0
    while True:
        while len(window) < 3:
            nxt = next(todo, None)
            if nxt is None:
                return p
            window.append(nxt)
        a, b, c = (float(sizes[i]) for i in window)
        u = (b - c, c - a, a - b)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(window, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(window, u, strict=True) if x)
        step = up if draws[at % len(draws)] * (up + down) < down else -down
        at += 1
        for i, x in zip(window, u, strict=True):
            p[i] += step * x
        for i in list(window):
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = round(p[i])
                window.remove(i)


def land(sizes: np.ndarray, p: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Decides the last documents so that the words come nearest to their expectation, then swaps documents towards it."""
    want = float((sizes * start).sum())
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.where((p > EPS) & (p < 1 - EPS), 0.0, np.round(p))
    base = float((sizes * out).sum())
    best = min(itertools.product((0, 1), repeat=len(left)), key=lambda s: (abs(base + float((sizes[left] * s).sum()) - want), s))
    out[left] = best
    free = (start > EPS) & (start < 1 - EPS)
    for _ in range(SWAPS):
        gap = float((sizes * out).sum()) - want  # above 0: too many words
        change = np.where(free, sizes * (1 - 2 * out), 0.0)
        gain = abs(gap) - np.abs(gap + change)
        i = int(gain.argmax())
        if gain[i] <= 0:
            break
        out[i] = 1 - out[i]
    return out


def _fly_block(level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
        sizes, start = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64)
        p = fly(sizes, start, np.random.default_rng([int(key[0]) % 2**32, int(key[1]), level]))
        if int(pdf["blocks"].iloc[0]) == 1:
            p = land(sizes, p, start)
        return pdf.assign(p=p)

    return run


def _each_row(groups: DataFrame) -> DataFrame:
    """As many rows, numbered from 1 in _row, as each group of equal rows has; groups of more than MANY go through several tasks."""
    few = groups.where(F.col("rows") <= MANY).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    parts = groups.where(F.col("rows") > MANY).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / MANY))))
    many = parts.repartition("_part").withColumn("_row", F.explode(F.sequence(F.col("_part") * MANY + 1, F.least("rows", (F.col("_part") + 1) * MANY))))
    return few.unionByName(many.drop("_part"))


def mix(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialise(docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    targets = source_targets(sizes.select("doc_id", "source", (F.col("size") * F.col("rows")).alias("size")))
    targets = targets.select(F.col("source").alias("_source"), "source_rank", "source_size", "source_docs", "target")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    work = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("ratio", ratio)
    extra = (F.col("ratio") - F.floor("ratio")) * F.col("rows")
    work = work.select(
        "doc_id", "size", "rows", "source_rank", "source_size", "target", F.floor("ratio").cast("long").alias("copies"),
        F.floor(extra).cast("long").alias("sure"), (extra - F.floor(extra)).alias("p"),
        F.xxhash64("doc_id", "size", F.lit(5)).alias("tie"), F.ceil(F.col("source_docs") / BLOCK).cast("long").alias("blocks"),
    )
    most = targets.agg(F.max("source_docs")).first()[0] or 0
    left, done, level = math.ceil(most / BLOCK), [], 0
    while True:
        block = F.pmod(F.xxhash64("tie", F.lit(level)), F.greatest(F.col("blocks"), F.lit(1)))
        flown = work.withColumn("block", block)
        schema = flown.schema
        flown = materialise(flown.groupBy("source_rank", "block").applyInPandas(_fly_block(level), schema), f"mix-{level}").drop("block")
        if left <= 1:
            done.append(flown)
            break
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(flown.where(~open_))
        work = flown.where(open_).withColumn("blocks", F.ceil(F.col("blocks") * 3 / BLOCK).cast("long"))
        left, level = math.ceil(left * 3 / BLOCK), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = _each_row(out)
    takes = F.col("copies") + (F.col("_row") <= F.col("sure") + F.round("p").cast("long")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * takes).alias("taken"))


query = mix
