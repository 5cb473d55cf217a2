"""The most likely earlier event of each event, by the least of straight lines over time in the nodes of a tree of places."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.tiles import HELD, haloed
from terrastrat.session import cut

#: Events of a leaf (a power of two), events asked for at a time, nodes to begin with, and pieces of lines merged at a time.
LEAF, ASKED, FIRST, MERGED = 8, 4096, 64, 1 << 16
#: How near to the least eta a pair is kept, so that ties are decided outside, and how near a node must come to be opened.
SLACK, OPENED = 1 + 2.4e-8, 1 + 1e-7
#: Events of a tile aimed at, and magnitudes of one search, whose powers of ten are told apart in doubles.
TILE_EVENTS, BAND = 300_000, 20_000.0
_SECOND, _DAY = 1e6, 86400e6


def eta(days: Column, distance: Column, magnitude: Column) -> Column:
    """log10 of time x distance^1.6 x 10^(-m / 100), time at least a second and distance at least 0.1."""
    most = lambda c, v: F.greatest(c, F.lit(v))
    return F.log10(most(days, 1.0 / 86400)) + 1.6 * F.log10(most(distance, 0.1)) - magnitude / 100


def tree(columns: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(order, boxes): rows in leaves of LEAF, halved in turn along the columns, and (low, high) of every level's nodes."""
    n = len(columns[0])
    depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    order = np.arange(LEAF << depth)
    held = [np.concatenate([c, np.full(len(order) - n, np.inf)]) for c in columns]
    for level in range(depth):
        rows = order.reshape(1 << level, -1)
        half = rows.shape[1] // 2
        order = np.take_along_axis(rows, np.argpartition(held[level % len(held)][rows], half - 1, axis=1), 1).ravel()
    real = order < n
    low, high = (np.stack([np.where(real, c[order], v).reshape(-1, LEAF) for c in held]) for v in (np.inf, -np.inf))
    boxes = [(low.min(2), high.max(2))]
    while boxes[-1][0].shape[1] > 1:
        low, high = boxes[-1]
        boxes.append((np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])))
    return order, boxes[::-1]


def least_lines(node: np.ndarray, start: np.ndarray, line: np.ndarray, lines: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, line) pieces of the parents of *node*: from the time numbered start on, *line* is the least in the node.

    A line is at + slope x (time - origin), by the rows of *lines* (at, slope, origin); the last one stands for none.
    Pieces come and go by node, then start; those of a node last until its next one.
    """
    at, slope, origin = lines
    parent = node >> 1
    order = np.argsort(parent.astype(np.int64) * (len(times) + 1) + start, kind="stable")
    left = (node[order] & 1) == 0
    parent, start, line = parent[order], start[order], line[order]
    row = np.arange(len(order))
    new = np.diff(parent, prepend=-1) != 0
    first = np.maximum.accumulate(np.where(new, row, 0))
    end = np.append(np.where(new[1:], len(times), start[1:]), len(times))
    keep = end > start
    both = []
    for side in (left, ~left):
        last = np.maximum.accumulate(np.where(side, row, -1))
        both.append(np.where(last >= first, line[last], len(at) - 1)[keep])
    parent, start, end = parent[keep], start[keep], end[keep]
    (a, b), t0, t1 = both, times[start], times[end - 1]
    value = lambda i, t: at[i] + slope[i] * (t - origin[i])
    before, after = value(a, t0) <= value(b, t0), value(a, t1) <= value(b, t1)
    cross = np.flatnonzero(before != after)
    ca, cb = a[cross], b[cross]
    with np.errstate(divide="ignore", invalid="ignore"):
        when = origin[ca] + (at[cb] - at[ca] + slope[cb] * (origin[ca] - origin[cb])) / (slope[ca] - slope[cb])
    where = np.clip(np.searchsorted(times, when), start[cross] + 1, end[cross] - 1)
    place = cross + 1 + np.arange(len(cross))
    out = []
    for whole, part in ((parent, parent[cross]), (start, where), (np.where(before, a, b), np.where(after[cross], ca, cb))):
        column = np.empty(len(whole) + len(part), np.int32)
        rest = np.ones(len(column), bool)
        rest[place] = False
        column[rest], column[place] = whole, part
        out.append(column)
    keep = (np.diff(out[0], prepend=-1) != 0) | (np.diff(out[2], prepend=-1) != 0)
    return tuple(c[keep] for c in out)


def parents_of(node: np.ndarray, start: np.ndarray, line: np.ndarray, lines: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, ...]:
    """:func:`least_lines`, some nodes at a time."""
    many = (int(node[-1]) >> 1) + 1
    step = max(1, MERGED * many // len(node))
    edges = np.searchsorted(node, np.arange(0, 2 * many + 2 * step, 2 * step))
    parts = [least_lines(node[i:j], start[i:j], line[i:j], lines, times) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def search(asked: list[np.ndarray], known: list[np.ndarray], slope: np.ndarray, flat: np.ndarray, power: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(asked, known) pairs of rows of nearly the least max(slope x time, flat) x distance^(2 x power); columns are x, y and t.

    Of several pairs of the same time, distance and line only the first known row is given. Over time an event is a level
    for a second and a rising line from then on, so the least of a node's events is a row of pieces; it is found once for
    each node and time, and with the distance to the node's box bounds all that is in it. Nodes whose bound is above the
    least found are not opened.
    """
    n, times = len(known[0]), np.unique(np.concatenate([known[2], asked[2]]))
    order, boxes = tree(known[:2])
    rows = order[order < n]
    x, y, t, slope, flat = (c[rows] for c in (*known, slope, flat))  # what is near in places is near in memory
    lines = [np.concatenate(c) for c in ((flat, np.zeros(n), [np.inf]), (np.zeros(n), slope, [0.0]), (t, t, [0.0]))]
    begin, rise = np.searchsorted(times, t, "right"), np.where(slope > 0, np.searchsorted(times, t + _SECOND), len(times))
    valid = np.stack([begin < rise, rise < len(times)], 1).ravel()
    pieces = np.repeat(np.flatnonzero(order < n), 2), np.stack([begin, rise], 1).ravel(), np.stack([np.arange(n), np.arange(n) + n], 1).ravel()
    pieces = tuple(c[valid].astype(np.int32) for c in pieces)
    none = np.zeros((2, 0), np.int64)
    if not len(pieces[0]) or not len(asked[0]):
        return tuple(none)
    for _ in range(LEAF.bit_length() - 1):
        pieces = parents_of(*pieces, lines, times)
    key = lambda node: node.astype(np.int64) * (len(times) + 1)
    depth = len(boxes) - 1
    levels = [(depth, key(pieces[0]) + pieces[1], pieces[2])]
    while levels[0][0] >= 2 and (1 << levels[0][0] - 2) >= FIRST:
        for _ in range(2):
            pieces = parents_of(*pieces, lines, times)
        levels.insert(0, (levels[0][0] - 2, key(pieces[0]) + pieces[1], pieces[2]))
    ends = [np.full(len(order), np.inf) for _ in range(5)]
    for c, v in zip(ends, (x, y, t, slope, flat), strict=True):
        c[order < n] = v
    ends = [c.reshape(-1, LEAF) for c in ends]
    far = radius * radius * (1 + 1e-12)
    scaled = lambda d2: np.maximum(d2, 0.01) ** power
    number = np.searchsorted(times, asked[2])
    found = [none]
    turn = tree(asked[:2])[0]
    turn = turn[turn < len(asked[0])]

    def lowered(best, a, value):
        if len(a):
            at = np.flatnonzero(np.diff(a, prepend=-1))
            best[a[at]] = np.minimum(best[a[at]], np.minimum.reduceat(value, at))

    def once(best, who, got, value, d2, line):
        near = np.flatnonzero(value <= best[who] * SLACK)
        sort = near[np.lexsort((got[near], line[near], d2[near], who[near]))]
        new = np.any([np.diff(c[sort], prepend=np.nan) != 0 for c in (who, d2, line)], axis=0)
        return tuple(c[sort[new]] for c in (who, got, value, d2, line))

    for begin in range(0, len(turn), ASKED):
        mine = turn[begin : begin + ASKED]
        u, v, s, when = (c[mine] for c in (*asked, number))
        best, kept = np.full(len(mine), np.inf), []
        low, high = boxes[levels[0][0]]
        gap = [np.maximum(np.maximum(low[i] - c.max(), c.min() - high[i]), 0.0) for i, c in enumerate((u, v))]
        near = np.flatnonzero(gap[0] ** 2 + gap[1] ** 2 <= far)
        each = max(1, HELD // max(len(near), 1))
        open_ = [(0, np.repeat(np.arange(i, min(i + each, len(mine))), len(near)), np.tile(near, min(each, len(mine) - i))) for i in range(0, len(mine), each)][::-1]
        while open_:
            level, a, node = open_.pop()
            if level == len(levels):
                p, q, r, rate, least = (c[node] for c in ends)
                time = s[a][:, None] - r
                with np.errstate(invalid="ignore"):
                    d2, line = (p - u[a][:, None]) ** 2 + (q - v[a][:, None]) ** 2, np.maximum(rate * time, least)
                    value = np.where((time > 0) & (np.sqrt(d2) <= radius), line * scaled(d2), np.inf)
                lowered(best, a, value.min(1))
                i, j = np.nonzero(np.isfinite(value))
                kept.append(once(best, a[i], order[node[i] * LEAF + j], value[i, j], d2[i, j], line[i, j]))
                continue
            depth, keys, line = levels[level]
            low, high = boxes[depth]
            gap = [np.maximum(np.maximum(low[i][node] - c[a], c[a] - high[i][node]), 0.0) for i, c in enumerate((u, v))]
            d2 = gap[0] ** 2 + gap[1] ** 2
            keep = np.flatnonzero(d2 <= far)
            a, node, d2 = a[keep], node[keep], d2[keep]
            piece = np.searchsorted(keys, key(node) + when[a], "right") - 1
            keep = np.flatnonzero((piece >= 0) & (keys[piece] >= key(node)))
            a, node, d2, event = a[keep], node[keep], d2[keep], line[piece[keep]]
            value = lines[0][event] + lines[1][event] * (s[a] - lines[2][event])
            bound = value * scaled(d2)
            keep = np.flatnonzero(bound <= best[a] * OPENED)
            a, node, bound, value, event = a[keep], node[keep], bound[keep], value[keep], event[keep] % n
            d2 = (x[event] - u[a]) ** 2 + (y[event] - v[a]) ** 2
            lowered(best, a, np.where(np.sqrt(d2) <= radius, value * scaled(d2), np.inf))
            keep = np.flatnonzero(bound <= best[a] * OPENED)
            a, node = a[keep], node[keep]
            if level + 1 < len(levels):
                a, node = np.repeat(a, 4), (4 * node[:, None] + np.arange(4)).ravel()
            step = HELD if level + 1 < len(levels) else HELD // LEAF
            open_ += [(level + 1, a[i : i + step], node[i : i + step]) for i in range(0, len(a), step)][::-1]
        if kept:
            who, got = once(best, *(np.concatenate(c) for c in zip(*kept, strict=True)))[:2]
            found.append(np.stack([mine[who], got]))
    return tuple(np.concatenate(found, 1))


def likely(asked: list[np.ndarray], known: list[np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(asked, known) pairs of rows with nearly the least eta of the asked one; columns are x, y, t and, of known rows, magnitude.

    Known rows come by their ids. Magnitudes are searched in bands; where an eta isn't finite the first row is the one,
    and rows of unknown magnitude are asked only for what has no other.
    """
    magnitude = known[3]
    with np.errstate(invalid="ignore"):
        band = np.floor(magnitude / BAND)
    found, open_ = [np.zeros((2, 0), np.int64)], np.ones(len(asked[0]), bool)
    if not len(open_):
        return tuple(found[0])
    for b in np.unique(band):  # unknown ones come last
        rows = np.flatnonzero(np.isnan(band) if np.isnan(b) else band == b)
        wanted = np.flatnonzero(open_) if np.isnan(b) else np.arange(len(open_))
        if np.isfinite(b):
            weight = 10.0 ** (((b + 1) * BAND - magnitude[rows]) / 100)
            lines = weight, weight * _SECOND, 0.8
        else:
            lines = np.zeros(len(rows)), rows + 1.0, 0.0
        i, j = search([c[wanted] for c in asked], [c[rows] for c in known[:3]], *lines, radius)
        found.append(np.stack([wanted[i], rows[j]]))
        open_[wanted[i]] = False
    return tuple(np.concatenate(found, 1))


def parents(events: DataFrame, radius: float) -> DataFrame:
    """``(id, log_eta, parent)`` of events ``(id, x, y, t_us, mag)``: the earlier event within *radius* of the least eta.

    Events without an earlier one in reach are left out. Etas equal to nine places go by the lesser id, and an
    unknown magnitude is taken only where there is no other. A tile's events meet those around it in a tree; nodes whose
    bound is above the least found are not opened, so pairs are neither shuffled nor listed. Events of one place, time and
    magnitude are one in a tile, with their least id.
    """
    e = cut(events.select("id", "x", "y", "t_us", "mag").dropna(subset=["x", "y", "t_us"]))
    n, x0, x1, y0, y1 = e.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wide, high = (x1 - x0 + 1, y1 - y0 + 1) if n else (1, 1)
    side = max(2 * radius, math.sqrt(wide * high * min(max(n / 64, 2000), TILE_EVENTS) / max(n, 1)))
    tiles = (wide // side + 2) * (high // side + 2)
    kinds = {c: t for c, t in e.dtypes}

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
        x, y, t, magnitude = columns = [pdf[c].to_numpy(np.float64) for c in ("x", "y", "t_us", "mag")]
        own = np.flatnonzero((np.floor(x / side) == key[0]) & (np.floor(y / side) == key[1]))
        same = [x, y, t, np.nan_to_num(magnitude), np.isnan(magnitude).astype(np.int8)]
        order = np.lexsort(same)
        with np.errstate(invalid="ignore"):
            new = np.any([np.diff(c[order], prepend=-1) != 0 for c in same], axis=0)
        new[:1] = True
        known, group = np.sort(order[new]), np.empty(len(pdf), np.int64)
        group[order] = np.searchsorted(known, order[new])[np.cumsum(new) - 1]
        asked, of = np.unique(group[own], return_inverse=True)
        a, b = likely([c[known[asked]] for c in columns[:3]], [c[known] for c in columns], radius)
        sort = np.argsort(a, kind="stable")
        a, b = a[sort], b[sort]
        low, many = np.searchsorted(a, of), np.searchsorted(a, of, "right") - np.searchsorted(a, of)
        at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
        a, b = np.repeat(own, many), known[b[at]]
        near = {c: pdf[c].to_numpy() for c in ("id", "x", "y", "t_us")}
        out = pd.DataFrame({c: v[a] for c, v in near.items()} | {f"n_{c}": v[b] for c, v in near.items()})
        return out.assign(n_mag=magnitude[b])

    schema = ", ".join(f"{p}{c} {kinds[c]}" for p in ("", "n_") for c in ("id", "x", "y", "t_us")) + ", n_mag double"
    # more parts than tiles, which are dear and small in bytes: parts joined by their bytes would leave cores idle
    around = haloed(e, side, radius).repartition(int(min(2 * tiles, 4096)), "_tx", "_ty")
    pairs = around.groupBy("_tx", "_ty").applyInPandas(solve, schema)
    dx, dy = F.col("x") - F.col("n_x"), F.col("y") - F.col("n_y")
    days = (F.col("t_us") - F.col("n_t_us")) / _DAY
    value = eta(days, F.sqrt((dx * dx + dy * dy).cast("double")), F.nullif(F.col("n_mag"), F.lit(float("nan"))))
    first = F.struct(F.coalesce(F.round("eta", 9), F.lit(float("inf"))), "n_id")
    return pairs.withColumn("eta", value).groupBy("id").agg(F.min("eta").alias("log_eta"), F.min_by("n_id", first).alias("parent"))
