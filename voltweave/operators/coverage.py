"""Cells that a layer of shapes certainly covers or certainly leaves free, as a grid of bits that every task holds.

Where shapes lie many deep, nearly all that passes over them is answered by the grid alone: no row is shuffled for it. The grid never
decides what it is not sure of; that goes to the exact operators, with the shapes near it only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voltweave.operators import spatial_join as sj

#: Cells of a grid at most; those of a layer that spreads farther are wider.
CELLS = 1 << 24
#: Pieces into which a segment is cut at most; a longer one counts as unsure.
PIECES = 4096
#: Rows that are tested at once.
ROWS = 20_000
ENDS = ["x1", "y1", "x2", "y2"]


class Grid:
    """Square cells over an extent."""

    def __init__(self, x0: float, y0: float, x1: float, y1: float, cell: float) -> None:
        self.cell = max(float(cell), float(np.sqrt(max(x1 - x0, 0.0) * max(y1 - y0, 0.0) / CELLS)), (x1 - x0) / CELLS, (y1 - y0) / CELLS)
        self.x0, self.y0 = float(x0), float(y0)
        self.nx, self.ny = int((x1 - x0) / self.cell) + 1, int((y1 - y0) / self.cell) + 1

    def count(self, diff: np.ndarray, box: tuple[np.ndarray, ...], inside: bool) -> None:
        """Adds boxes (minx to maxy) to a lattice of differences: the cells wholly inside them, or all that they touch."""
        at = [(v - o) / self.cell for v, o in zip(box, (self.x0, self.y0) * 2, strict=True)]
        a, b, c, d = (np.ceil(at[0] + 1e-6), np.ceil(at[1] + 1e-6), np.floor(at[2] - 1e-6), np.floor(at[3] - 1e-6)) if inside else (np.floor(at[0] - 1e-6), np.floor(at[1] - 1e-6), np.floor(at[2] + 1e-6) + 1, np.floor(at[3] + 1e-6) + 1)
        a, c, b, d = (np.clip(v, 0, n).astype(np.int64) for v, n in ((a, self.nx), (c, self.nx), (b, self.ny), (d, self.ny)))
        some = (c > a) & (d > b)
        a, b, c, d = a[some], b[some], c[some], d[some]
        flat = diff.reshape(-1)
        for row, col, sign in ((b, a, 1), (b, c, -1), (d, a, -1), (d, c, 1)):
            np.add.at(flat, row * (self.nx + 1) + col, np.int32(sign))


def extent(df: DataFrame) -> tuple[float, float, float, float] | None:
    """minx, miny, maxx, maxy of all boxes; None without any. One plain aggregate: a filter would repeat the columns' expressions."""
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    row = df.agg(F.min(known("minx")), F.min(known("miny")), F.max(known("maxx")), F.max(known("maxy"))).first()
    return None if any(v is None for v in row) else tuple(min(max(float(v), -1e15), 1e15) for v in row)


def marked(df: DataFrame, columns: list[str], shapes: Callable[[dict], Iterator[tuple[np.ndarray, ...]]], grid: Grid, inside: bool) -> np.ndarray:
    """Which cells lie wholly inside one of the boxes that rows come to, or are touched by one. Tasks put out bits; the driver gets a grid's."""
    spec, parts = grid, max(1, min(64, grid.ny))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        diff = np.zeros((spec.ny + 1, spec.nx + 1), np.int32)
        for pdf in batches:
            rows = {c: pdf[c].to_numpy(float) for c in columns}
            for box in shapes(rows):
                known = np.isfinite(box).all(axis=0)
                spec.count(diff, tuple(v[known] for v in box), inside)
        np.cumsum(diff, axis=0, out=diff)
        np.cumsum(diff, axis=1, out=diff)
        found = np.array_split(diff[:-1, :-1] > 0, parts)
        yield pd.DataFrame({"part": range(parts), "bits": [np.packbits(f).tobytes() for f in found]})

    def either(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(run, "part int, bits binary")
    got = {r[0]: r[1] for r in rows.groupBy("part").applyInPandas(either, "part int, bits binary").collect()}
    out = np.zeros((grid.ny, grid.nx), bool)
    for k, piece in enumerate(np.array_split(out, parts)):
        if k in got:
            piece[:] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=piece.size).reshape(piece.shape).astype(bool)
    return out


def _all_around(cells: np.ndarray, beyond: bool) -> np.ndarray:
    """Cells that are set together with their eight neighbours."""
    wide = np.pad(cells, 1, constant_values=beyond)
    rows = wide[:-2] & wide[1:-1] & wide[2:]
    return rows[:, :-2] & rows[:, 1:-1] & rows[:, 2:]


class Cover:
    """Where shapes cover a plane for sure, or leave it free: cells of which this holds with their neighbours, so that it holds for
    whatever is within a cell's width of a place in them."""

    def __init__(self, grid: Grid, inside: np.ndarray, touched: np.ndarray | None = None) -> None:
        self.grid = grid
        self.sure = _all_around(inside, False)
        self.free = None if touched is None else _all_around(~touched, True)

    def __getstate__(self) -> dict:
        bits = lambda a: None if a is None else np.packbits(a)
        return {"grid": self.grid, "sure": bits(self.sure), "free": bits(self.free)}

    def __setstate__(self, state: dict) -> None:
        self.grid = g = state["grid"]
        cells = lambda b: None if b is None else np.unpackbits(b, count=g.nx * g.ny).reshape(g.ny, g.nx).astype(bool)
        self.sure, self.free = cells(state["sure"]), cells(state["free"])

    def pieces(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many equal pieces each segment is cut into, and for all pieces in order whether they are covered, and free, for sure."""
        g = self.grid
        with np.errstate(invalid="ignore", over="ignore"):
            long = np.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / (1.998 * g.cell)
            fits = np.isfinite(long) & (long <= PIECES) & (np.abs(x1 - g.x0) < 1e15) & (np.abs(y1 - g.y0) < 1e15)
        n = np.where(fits, np.maximum(np.ceil(np.where(fits, long, 1.0)), 1.0), 1.0).astype(np.int64)
        who = np.repeat(np.arange(len(n)), n)
        t = (np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[who]
        at = lambda a, b, o: np.floor((np.where(fits, a, o)[who] + t * np.where(fits, b - a, 0.0)[who] - o) / g.cell).astype(np.int64)
        col, row = at(x1, x2, g.x0), at(y1, y2, g.y0)
        within = (col >= 0) & (col < g.nx) & (row >= 0) & (row < g.ny)
        place = np.where(within, row * g.nx + col, 0)
        sure = within & self.sure.reshape(-1)[place] & fits[who]
        if self.free is None:
            return n, sure, np.zeros(len(sure), bool)
        # all that is touched lies in the grid: beyond its outermost cells and their neighbours everything is free
        beyond = (col < -1) | (col > g.nx) | (row < -1) | (row > g.ny)
        return n, sure, (beyond | (within & self.free.reshape(-1)[place])) & fits[who]

    def shares(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What share of each segment is covered at least, and at most."""
        low, high = np.zeros(len(x1)), np.ones(len(x1))
        for p in range(0, len(x1), ROWS):
            q = slice(p, p + ROWS)
            n, sure, free = self.pieces(x1[q], y1[q], x2[q], y2[q])
            start = np.cumsum(n) - n
            if len(n):
                low[q] = np.add.reduceat(sure.astype(np.int32), start) / n
                high[q] = 1.0 - np.add.reduceat(free.astype(np.int32), start) / n
        return low, high


def _boxes(rows: dict) -> Iterator[tuple[np.ndarray, ...]]:
    yield tuple(rows[c] for c in sj.BOX)


def _squares(half: float, apart: float) -> Callable[[dict], Iterator[tuple[np.ndarray, ...]]]:
    """Squares around places along segments, both ends among them."""

    def run(rows: dict) -> Iterator[tuple[np.ndarray, ...]]:
        x, y, dx, dy = rows["x1"], rows["y1"], rows["x2"] - rows["x1"], rows["y2"] - rows["y1"]
        with np.errstate(invalid="ignore"):
            steps = np.nan_to_num(np.minimum(np.ceil(np.sqrt(dx * dx + dy * dy) / apart), 1e9)).astype(np.int64)
        for k in range(int(steps.max()) + 1 if len(steps) else 0):
            some = np.flatnonzero(steps >= k)
            t = k / np.maximum(steps[some], 1)
            px, py = x[some] + t * dx[some], y[some] + t * dy[some]
            yield px - half, py - half, px + half, py + half

    return run


def box_cover(boxes: DataFrame, cell: float) -> Cover | None:
    """The cover of boxes (minx to maxy); None without any."""
    if (ends := extent(boxes)) is None:
        return None
    grid = Grid(*ends, cell)
    return Cover(grid, marked(boxes, list(sj.BOX), _boxes, grid, True))


def buffer_cover(lines: DataFrame, radius: float, cell: float, free: bool = False) -> Cover | None:
    """The cover of what lies within a radius of segments (x1 to y2, minx to maxy): the squares in discs around places along them.
    With free also where nothing lies within it."""
    if (ends := extent(lines)) is None:
        return None
    grid = Grid(*(v + s * (radius * 1.5 + cell) for v, s in zip(ends, (-1, -1, 1, 1), strict=True)), cell)
    half = radius * np.sqrt(0.5)
    inside = marked(lines, ENDS, _whole(_squares(half * (1 - 1e-9), half)), grid, True)
    return Cover(grid, inside, marked(lines, ENDS, _whole(_squares(radius * 1.26, radius / 2)), grid, False) if free else None)


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    return [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]


def _known_ends(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> list[np.ndarray]:
    """An unknown end is where the other one is, as in the boxes, whose least and greatest pass over nulls."""
    return [np.where(np.isnan(a), b, a) for a, b in ((x1, x2), (y1, y2), (x2, x1), (y2, y1))]


def _whole(shapes: Callable[[dict], Iterator]) -> Callable[[dict], Iterator]:
    return lambda rows: shapes(dict(zip(ENDS, _known_ends(*(rows[c] for c in ENDS)), strict=True)))


def _batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """df's Arrow batches through a function. Later filters are not pushed below it, where they'd repeat the columns' expressions."""
    return df.mapInArrow(lambda batches: (f(b) for b in batches), schema)


def with_shares(segs: DataFrame, cover: Cover | None, low: str, high: str) -> DataFrame:
    """segs (x1 to y2) with the least and the greatest share of each that can be covered."""
    if cover is None:
        return segs.withColumns({low: F.lit(0.0), high: F.lit(0.0)})
    shared = segs.sparkSession.sparkContext.broadcast(cover)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = shared.value.shares(*_known_ends(*_numbers(batch, ENDS)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b)], names=[*batch.schema.names, low, high])

    return _batches(segs, run, StructType([*segs.schema.fields, StructField(low, DoubleType()), StructField(high, DoubleType())]))


def uncovered(segs: DataFrame, cover: Cover | None) -> DataFrame:
    """The segments (x1 to y2) that are not wholly covered for sure."""
    if cover is None:
        return segs
    shared = segs.sparkSession.sparkContext.broadcast(cover)
    return _batches(segs, lambda batch: batch.filter(pa.array(shared.value.shares(*_known_ends(*_numbers(batch, ENDS)))[0] < 1)), segs.schema)


def covered_runs(segs: DataFrame, cover: Cover, key: str = "id") -> DataFrame:
    """key, lo, hi: the parts of each segment that are covered for sure, as runs of its pieces."""
    shared = segs.sparkSession.sparkContext.broadcast(cover)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        who, lo, hi = _runs(shared.value, *_known_ends(*_numbers(batch, ENDS)), True)
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(who)), pa.array(lo), pa.array(hi)], names=[key, "lo", "hi"])

    return _batches(segs.select(key, *ENDS), run, StructType([segs.schema[key], StructField("lo", DoubleType()), StructField("hi", DoubleType())]))


def _runs(cover: Cover, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of segments, from, to: the runs of pieces that are covered for sure, or of those that are not."""
    n, sure, _ = cover.pieces(x1, y1, x2, y2)
    who = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    some = sure == kind
    begin = np.flatnonzero(some & ~np.append(False, some[:-1] & (who[1:] == who[:-1])))
    end = np.flatnonzero(some & ~np.append(some[1:] & (who[1:] == who[:-1]), False))
    return who[begin], at[begin] / n[who[begin]], (at[end] + 1) / n[who[end]]


def near_uncovered(others: DataFrame, segs: DataFrame, cover: Cover, radius: float = 0.0, cell: float = 50.0) -> DataFrame:
    """The others (minx to maxy) whose box, widened by the radius, comes near a piece of a segment that is not covered for sure."""
    span = extent(sj.boxed_segments(segs))
    if span is None:
        return others.limit(0)
    grid, held = Grid(*span, cell), segs.sparkSession.sparkContext.broadcast(cover)

    def open_pieces(rows: dict) -> Iterator[tuple[np.ndarray, ...]]:
        for p in range(0, len(rows["x1"]), ROWS):
            x1, y1, x2, y2 = _known_ends(*(rows[c][p : p + ROWS] for c in ENDS))
            n, sure, _ = held.value.pieces(x1, y1, x2, y2)
            who = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            who, a, b = who[~sure], (at / n[who])[~sure], ((at + 1) / n[who])[~sure]
            x, y = [[v[who] + t * (w - v)[who] for t in (a, b)] for v, w in ((x1, x2), (y1, y2))]
            yield np.minimum(*x), np.minimum(*y), np.maximum(*x), np.maximum(*y)

    total = np.pad(np.cumsum(np.cumsum(marked(segs, ENDS, open_pieces, grid, False), axis=0, dtype=np.int64), axis=1), ((1, 0), (1, 0)))
    shared = segs.sparkSession.sparkContext.broadcast((grid, total))

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, t = shared.value
        box = _numbers(batch, list(sj.BOX))
        known = ~np.isnan(box).any(axis=0)
        m = radius * (1 + 1e-9) + 1e-6
        at = lambda v, o, n, d, k: np.clip(np.floor((np.where(known, v, o) + d - o) / g.cell) + k, 0, n).astype(np.int64)
        x0, y0, x1, y1 = at(box[0], g.x0, g.nx, -m, 0), at(box[1], g.y0, g.ny, -m, 0), at(box[2], g.x0, g.nx, m, 1), at(box[3], g.y0, g.ny, m, 1)
        return batch.filter(pa.array(known & (x1 > x0) & (y1 > y0) & (t[y1, x1] - t[y0, x1] - t[y1, x0] + t[y0, x0] > 0)))

    return _batches(others, near, others.schema)
