"""Mainshocks and their aftershocks by windows, found inside tiles of space and time without listing pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.tiles import TILE_POINTS, _numbers
from terrastrat.session import cut

#: Events of a tile that are looked at together for whether any is left to decide.
BLOCK = 2048
#: Fixed columns of a tile.
_TILE = ["_tx", "_ty", "_tt"]
_PLACE = ["x", "y", "t_days"]


def reach_km(mag):
    return 10.0 ** (0.1238 * mag + 0.983)


def reach_days(mag):
    return np.where(mag >= 6.5, 10.0 ** (0.032 * mag + 2.7389), 10.0 ** (0.5409 * mag - 0.547))


class Windows:
    """Events of a tile in order of magnitude, then id; an event's number is its rank. Buckets are by place, then time."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.order = np.lexsort((_numbers(pdf["id"]), -pdf["mag"].to_numpy()))
        self.x, self.y, self.t, mag = (pdf[c].to_numpy(np.float64)[self.order] for c in (*_PLACE, "mag"))
        self.reach, self.days = reach_km(mag), reach_days(mag)
        # the table of buckets holds a few for each event at most
        span = max(np.ptp(self.x), np.ptp(self.y))
        self.size = max(float(self.reach.min()), float(self.reach.max()) / 6, span / (4 * math.sqrt(len(mag)) + 8))
        self.x0, self.y0, self.t0 = self.x.min(), self.y.min(), self.t.min()
        self.bx, self.by = (np.floor((v - v0) / self.size).astype(np.int64) for v, v0 in ((self.x, self.x0), (self.y, self.y0)))
        self.wide, self.high = int(self.bx.max()) + 1, int(self.by.max()) + 1
        self.code = self.by * self.wide + self.bx
        self.long = max(float(np.ptp(self.t)), 1e-9)
        part = self._part(self.t)
        self.at = np.lexsort((part, self.code))
        self.key = self.code[self.at] + part[self.at]
        self.sx, self.sy, self.st = self.x[self.at], self.y[self.at], self.t[self.at]

    def _part(self, t):
        """Place of times in a bucket, from 0.1 to 0.9."""
        return 0.1 + 0.8 * np.clip((t - self.t0) / self.long, -0.05, 1.05)

    def of(self, i: int) -> np.ndarray:
        """Numbers of the later events inside the window of event *i*."""
        r, d, x, y, t = self.reach[i], self.days[i], self.x[i], self.y[i], self.t[i]
        bx = np.arange(max(math.floor((x - r - self.x0) / self.size), 0), min(math.floor((x + r - self.x0) / self.size), self.wide - 1) + 1)
        by = np.arange(max(math.floor((y - r - self.y0) / self.size), 0), min(math.floor((y + r - self.y0) / self.size), self.high - 1) + 1)
        codes = (by[:, None] * self.wide + bx).ravel()
        low = np.searchsorted(self.key, codes + (self._part(t - d) - 1e-6))
        many = np.searchsorted(self.key, codes + (self._part(t + d) + 1e-6), "right") - low
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(low - ends + many, many)
        dx, dy = self.sx[at] - x, self.sy[at] - y
        who = self.at[at[(np.sqrt(dx * dx + dy * dy) <= r) & (np.abs(self.st[at] - t) <= d)]]
        return who[who > i]

    def near_any(self, marked: np.ndarray, reach: float) -> np.ndarray:
        """For each bucket, whether an event of *marked* may lie within *reach* of one of its events."""
        k = min(math.ceil(reach / self.size), max(self.wide, self.high))
        grid = np.bincount(self.code[marked], minlength=self.wide * self.high).reshape(self.high, self.wide)
        for axis in (0, 1):
            sums = np.insert(np.cumsum(grid, axis), 0, 0, axis)
            n = grid.shape[axis]
            grid = np.take(sums, np.minimum(np.arange(n) + k + 1, n), axis) - np.take(sums, np.maximum(np.arange(n) - k, 0), axis)
        return grid.ravel() > 0


def decided(w: Windows, known: np.ndarray, complete: np.ndarray) -> np.ndarray:
    """1 for mainshocks, 2 for events that one reaches, 0 where what lies outside of the tile may decide.

    known: mainshocks from before. complete: whether all that may reach the event is in the tile. Events are taken in
    order. Windows of undecided ones leave later events undecided, unless a mainshock reaches them. A window is only
    looked at if an event near it is neither reached nor left undecided yet.
    """
    n = len(known)
    state, reached, doubtful = np.zeros(n, np.int8), np.zeros(n, bool), ~complete & ~known
    for start in range(0, n, BLOCK):
        block = np.arange(start, min(start + BLOCK, n))
        block = block[~reached[block] | known[block]]
        if not len(block):
            continue
        clear = ~doubtful & ~reached
        clear[:start] = False
        idle = doubtful[block] & ~w.near_any(clear, float(w.reach[block].max()))[w.code[block]]
        for i in block[~idle].tolist():
            if known[i] or not (reached[i] or doubtful[i]):
                state[i] = 1
                reached[w.of(i)] = True
            elif not reached[i]:
                doubtful[w.of(i)] = True
    state[reached & (state == 0)] = 2
    return state


def _by_tiles(events: DataFrame, sizes: list[float], halos: list[float] | None = None) -> DataFrame:
    """Rows with the tile that they lie in, or once for every tile that they lie in or at most *halos* from."""
    for tile, c, size, halo in zip(_TILE, _PLACE, sizes, halos or [0.0] * 3, strict=True):
        of = lambda v: F.floor(v / F.lit(size)).cast("long")  # noqa: B023, E731
        events = events.withColumn(tile, F.explode(F.sequence(of(F.col(c) - halo), of(F.col(c) + halo))) if halos else of(F.col(c)))
    return events


def mainshocks(events: DataFrame, max_rounds: int = 500) -> tuple[DataFrame, list[float], list[float]]:
    """(mainshocks, sides of tiles, largest reaches) of written *events* ``(id, x, y, t_days, mag)`` without nulls.

    The largest event first, an event is a mainshock if no mainshock before it reaches it. A tile takes the events in order, with
    twice the largest reach around it. An event's state is known for certain unless events outside could change it;
    undecided ones go on with the mainshocks around them to the next round, in tiles that still hold any. The first undecided
    event of all is decided in its own tile, so rounds end. Mainshocks keep apart, so few windows hold an event, and no pair is
    listed or shuffled. Raises if *max_rounds* do not suffice.
    """
    ends = events.agg(F.count("*"), F.max("mag"), *[f(c) for c in _PLACE for f in (F.min, F.max)]).first()
    n, most, ends = ends[0], float(ends[1]), [float(v) for v in ends[2:]]
    reaches = [float(reach_km(most))] * 2 + [float(reach_days(np.float64(most)))]
    # sides are reaches times a factor, no longer than all there is, until a tile holds enough
    spans = [max(b - a, 1e-9) for a, b in zip(ends[::2], ends[1::2], strict=True)]
    held, factor = lambda f: n * math.prod(min(f * r / s, 1.0) for r, s in zip(reaches, spans, strict=True)), 8.0
    while held(factor) < min(max(n / 64, 2000), TILE_POINTS, n):
        factor *= 1.25
    sizes, halos = [factor * r for r in reaches], [2 * r for r in reaches]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w = Windows(pdf)
        own, complete = np.ones(len(pdf), bool), np.ones(len(pdf), bool)
        for v, k, size, halo, reach, low, high in zip((w.x, w.y, w.t), key, sizes, halos, reaches, ends[::2], ends[1::2], strict=True):
            own &= np.floor(v / size) == k
            a, b = k * size - halo, (k + 1) * size + halo
            complete &= ((v - a >= reach) | (a <= low)) & ((b - v > reach) | (b > high))
        known = pdf["main"].to_numpy()[w.order]
        state = decided(w, known, complete)
        new = own & ~known & (state < 2)
        return pdf.iloc[w.order[new]].drop(columns=_TILE).assign(main=state[new] == 1)

    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", main boolean"
    rows, found, main = events.withColumn("main", F.lit(False)), [], None
    tiles = _by_tiles(rows, sizes, halos)
    for _ in range(max_rounds):
        got = cut(tiles.groupBy(*_TILE).applyInPandas(solve, schema))
        found.append(got.filter("main"))
        main = found[0] if len(found) == 1 else main.unionByName(found[-1])
        left = got.filter("NOT main")
        if left.isEmpty():
            return main.drop("main"), sizes, reaches
        open_ = _by_tiles(left, sizes).select(*_TILE).distinct()
        tiles = _by_tiles(main.unionByName(left), sizes, halos).join(F.broadcast(open_), _TILE, "left_semi")
    raise RuntimeError(f"events are left undecided after {max_rounds} rounds")


def first_windows(events: DataFrame, main: DataFrame, sizes: list[float], reaches: list[float]) -> DataFrame:
    """``(id, parent)`` of *events*: the first of the mainshocks *main* that reaches each; null for these themselves."""
    kind = dict(events.dtypes)["id"]

    def solve(e: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        w = Windows(pd.concat([e, m], ignore_index=True))
        heads = np.flatnonzero(w.order >= len(e))
        parent = np.full(len(w.order), -1)
        for i in heads.tolist():
            who = w.of(i)
            parent[who[parent[who] < 0]] = w.order[i] - len(e)
        own = w.order < len(e)
        rows, parent = w.order[own], parent[own]
        ids = m["id"].to_numpy()
        same = np.isin(e["id"].to_numpy()[rows], ids)
        name = pd.Series(ids).reindex(np.where(same, -1, parent)).array if len(m) else [None] * len(rows)
        out = pd.DataFrame({"id": e["id"].to_numpy()[rows], "parent": name})
        return out.astype({"parent": "Int64"}) if pd.api.types.is_integer_dtype(e["id"]) else out.astype(object).where(out.notna(), None)

    own, around = _by_tiles(events, sizes).groupBy(*_TILE), _by_tiles(main, sizes, reaches).groupBy(*_TILE)
    return own.cogroup(around).applyInPandas(solve, f"id {kind}, parent {kind}")
