"""Neighbours, sums over discs and density clusters of points by square tiles, each with what lies around it, in vector steps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.graph import connected_components
from terrastrat.session import cut

#: Points of a tile aimed at, pairs that one step of a task holds, and places of a lookup table.
TILE_POINTS, HELD, TABLE = 40_000, 1 << 21, 1 << 23


def _tile(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def owned(points: DataFrame, size: float) -> DataFrame:
    """Rows with the tile ``_tx, _ty`` that they lie in."""
    return points.withColumns({"_tx": _tile(F.col("x"), size), "_ty": _tile(F.col("y"), size)})


def haloed(points: DataFrame, size: float, halo: float) -> DataFrame:
    """Rows once for every tile ``_tx, _ty`` that they lie in or at most *halo* from."""
    reach = lambda c: F.explode(F.sequence(_tile(F.col(c) - float(halo), size), _tile(F.col(c) + float(halo), size)))
    return points.withColumn("_tx", reach("x")).withColumn("_ty", reach("y"))


def _numbers(v: pd.Series) -> np.ndarray:
    """Keys as whole numbers of the same order."""
    return v.to_numpy(np.int64) if pd.api.types.is_integer_dtype(v) else np.unique(v.to_numpy(), return_inverse=True)[1]


def nearest_rows(queries: DataFrame, base: DataFrame, k: int, key: str, base_key: str, z: str | None = None, size: float | None = None, cap: float | None = None, ranks: list[int] | None = None) -> DataFrame:
    """``(key, x, y, n_key, n_x, n_y, d, rank)`` of the *k* nearest rows of *base* to each query, ties to the lesser key.

    Rows of a query's own key are left out if both keys have one name. ranks: only these are kept. cap: the largest
    distance. Both tables should be written and have no nulls. A tile's queries meet the rows of the 3 x 3 buckets
    around them; those with k rows within a bucket's size, which these buckets cover for certain, are settled, and the
    others go on with buckets twice as large. At one place only the least k + 1 keys can be among the nearest.
    """
    stats = base.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    own = queries.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    names = ["x", "y", *([z] if z else [])]
    kinds = [queries.schema[c].dataType.simpleString() for c in (key, *names)], [base.schema[c].dataType.simpleString() for c in (base_key, *names)]
    columns = [key, *names, f"n_{base_key}", *[f"n_{c}" for c in names]]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(columns, kinds[0] + kinds[1], strict=True)) + ", d double, rank int"
    n, same = stats[0], key == base_key
    if not n or not own[0]:
        return queries.sparkSession.createDataFrame([], schema)
    low, high = (min(stats[1], own[1]), min(stats[3], own[3])), (max(stats[2], own[2]), max(stats[4], own[4]))
    span = float(max(high[0] - low[0], high[1] - low[1], 1e-9))
    size = size or max(float(max(stats[2] - stats[1], stats[4] - stats[3], 1e-9)) * math.sqrt((k + 2) / n), 1e-9)
    side = max(2, math.isqrt(int(min(max(n / 64, 2000), TILE_POINTS) / (k + 2))))
    left, done = queries, None
    while True:
        size = min(size, cap) if cap else size
        last = size > 2 * span or size == cap
        solve = _solver(k, key, base_key, z, size, cap, last, same, set(ranks or range(1, k + 1)), columns)
        around = haloed(base, size * side, size)
        if done is not None:
            around = around.join(F.broadcast(owned(left, size * side).select("_tx", "_ty").distinct()), ["_tx", "_ty"], "left_semi")
        found = owned(left, size * side).groupBy("_tx", "_ty").cogroup(around.groupBy("_tx", "_ty")).applyInPandas(solve, schema)
        if last:
            return found if done is None else done.unionByName(found)
        found = cut(found)
        settled = found.filter("rank > 0")
        done = settled if done is None else done.unionByName(settled)
        left = found.filter("rank = 0").select(key, *names)
        if left.isEmpty():
            return done
        size *= 2


def _solver(k, key, base_key, z, size, cap, last, same, ranks, columns):
    """Solves a tile of :func:`nearest_rows`; queries that are not settled come back with rank 0."""
    names = ["x", "y", *([z] if z else [])]
    # in the plane all within the size is complete; with a third coordinate the last round takes any
    most = math.inf if z and last and not cap else cap if last and cap else size

    def solve(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q):
            place = [b[c].to_numpy() for c in names]
            number = _numbers(pd.concat([q[key], b[base_key]], ignore_index=True))
            own, others = number[: len(q)], number[len(q) :]
            bucket = lambda v: np.floor(v / size).astype(np.int64)
            r0, c0 = (min([bucket(t[c]).min() for t in (q, b) if len(t)]) - 1 for c in ("y", "x"))
            wide = max([int(bucket(t["x"]).max()) for t in (q, b) if len(t)]) - c0 + 2
            code = (bucket(b["y"].to_numpy()) - r0) * wide + bucket(b["x"].to_numpy()) - c0
            order = np.lexsort((others, *place, code))
            same_place = np.zeros(len(b), bool)
            same_place[1:] = code[order][1:] == code[order][:-1]
            for p in place:
                same_place[1:] &= p[order][1:] == p[order][:-1]
            at = np.arange(len(b))
            order = order[at - np.maximum.accumulate(np.where(same_place, 0, at)) <= k]
            code, others, place = code[order], others[order], [p[order] for p in place]
            home = (bucket(q["y"].to_numpy()) - r0) * wide + bucket(q["x"].to_numpy()) - c0
            lows = np.stack([np.searchsorted(code, home + i * wide - 1) for i in (-1, 0, 1)], 1)
            sizes = np.stack([np.searchsorted(code, home + i * wide + 1, "right") for i in (-1, 0, 1)], 1) - lows
            ends = np.cumsum(sizes.sum(1))
            start = 0
            while start < len(q):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + HELD, "right")))
                parts.append(_chunk(q, b, order, own, others, place, lows, sizes, start, stop))
                start = stop
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in [*columns, "d", "rank"]})

    def _chunk(q, b, order, own, others, place, lows, sizes, start, stop):
        low, many = lows[start:stop].ravel(), sizes[start:stop].ravel()
        asks = np.repeat(np.arange(stop - start), sizes[start:stop].sum(1))
        got = np.arange(len(asks)) + np.repeat(low - np.cumsum(many) + many, many)
        mine = [q[c].to_numpy()[start:stop] for c in names]
        step = [mine[i][asks] - place[i][got] for i in range(len(names))]
        d = np.sqrt((step[0] * step[0] + step[1] * step[1]).astype(np.float64))
        if z:
            d = np.sqrt(d * d + step[2].astype(np.float64) ** 2)
        keep = d <= most
        if same:
            keep &= own[start:stop][asks] != others[got]
        asks, got, d = asks[keep], got[keep], d[keep]
        sort = np.lexsort((others[got], d, asks))
        asks, got, d = asks[sort], got[sort], d[sort]
        count = np.bincount(asks, minlength=stop - start)
        rank = np.arange(len(asks)) - np.repeat(np.cumsum(count) - count, count) + 1
        full = np.ones(stop - start, bool) if last else count >= k
        keep = full[asks] & np.isin(rank, list(ranks)) & (rank <= k)
        rows, near = start + asks[keep], order[got[keep]]
        out = {c: q[c].to_numpy()[rows] for c in (key, *names)} | {f"n_{c}": b[c].to_numpy()[near] for c in (base_key, *names)}
        found = pd.DataFrame(out | {"d": d[keep], "rank": rank[keep].astype(np.int32)})
        if full.all():
            return found
        rest = q.iloc[start:stop][~full]
        # places of open queries stand in for the neighbours that they don't have yet
        b_key = pd.Series(b[base_key].iloc[:1].to_numpy().repeat(len(rest)) if len(b) else [None] * len(rest), dtype=b[base_key].dtype if len(b) else object)
        open_ = {c: rest[c].to_numpy() for c in (key, *names)} | {f"n_{base_key}": b_key} | {f"n_{c}": rest[c].to_numpy() for c in names}
        return pd.concat([found, pd.DataFrame(open_ | {"d": 0.0, "rank": np.zeros(len(rest), np.int32)})], ignore_index=True)

    return solve


def whole(points: DataFrame, *columns: str) -> bool:
    """Whether all places, and *columns*, are whole numbers (nulls aside), small enough to be told apart in doubles."""
    kinds, odd = dict(points.dtypes), []
    for c in ("x", "y", *columns):
        if kinds[c] in ("double", "float"):
            odd.append((F.col(c) != F.floor(c)) | (F.abs(c) >= float(1 << 52)) | F.isnan(c))
        elif kinds[c] not in ("tinyint", "smallint", "int", "bigint"):
            return False
    return all(points.filter(rule).isEmpty() for rule in odd)


def _side(places: DataFrame, radius: float) -> int:
    """Tiles of about TILE_POINTS places, no narrower than twice the radius and no more than 1024 wide beyond that."""
    n, x0, x1, y0, y1 = places.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    area = (x1 - x0 + 1) * (y1 - y0 + 1) if n else 1
    return int(max(2 * radius, 16, min(math.sqrt(area * min(max(n / 64, 2000), TILE_POINTS) / max(n, 1)), 1024)))


def half_widths(radius: float) -> list[tuple[int, int]]:
    """(dy, w): rows of a disc and the largest whole w with (w, dy) in it."""
    out = []
    for dy in range(-math.floor(radius), math.floor(radius) + 1):
        w = math.isqrt(max(int(radius * radius - dy * dy), 0)) + 1
        while w and math.sqrt(w * w + dy * dy) > radius:
            w -= 1
        out.append((dy, w))
    return out


class Rows:
    """Places of a tile in order of rows, then columns, each by one number in which places of one row are consecutive."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float) -> None:
        self.pad = math.floor(radius) + 1
        self.x0, self.y0 = int(x.min()), int(y.min())
        self.wide = int(x.max()) - self.x0 + 1 + 2 * self.pad
        self.top = (int(y.max()) - self.y0 + 1 + 2 * self.pad) * self.wide

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (y - self.y0 + self.pad) * self.wide + x - self.x0 + self.pad

    def first(self, codes: np.ndarray):
        """Gives how many of the ascending *codes* are less than a number, by a table where one is small."""
        if self.top > TABLE:
            return lambda v: np.searchsorted(codes, v)
        table = np.searchsorted(codes, np.arange(self.top + 1))
        return lambda v: table[v]


def exact_and_rest(weights: np.ndarray, most: float) -> list[np.ndarray]:
    """*weights* in two parts: one whose sums, times whole numbers up to *most*, are exact in extended digits, and the little that is left, if any."""
    total = float(np.abs(weights).sum()) * most
    if not 0 < total < math.inf:
        return [weights]
    grain = np.ldexp(np.longdouble(1), math.frexp(total)[1] - np.finfo(np.longdouble).nmant + 2)
    exact = np.rint(weights / grain) * grain
    return [exact, (weights - exact).astype(np.float64)] if (exact != weights).any() else [weights]


def disc_sums(places: DataFrame, radius: float, sums: list[str]) -> DataFrame:
    """``(x, y, sums, sx, sy, sxx, syy, sxy)`` of places ``(x, y, *sums)`` of whole numbers, one row a place: *sums* over the disc around each.

    sx to sxy are moments of the places in the disc about its centre, weighted by the last of *sums*. A row of a disc is
    a difference of two running sums over the tile's row, so work is one step a place and row of the disc, however many
    points there are.
    """
    p = cut(places.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *sums).dropna(subset=["x", "y"]))
    side, rows_of = _side(p, radius), half_widths(radius)
    moments = ["sx", "sy", "sxx", "syy", "sxy"]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        rows = Rows(x, y, radius)
        code = rows.code(x, y)
        first = rows.first(code)
        own = (x // side == key[0]) & (y // side == key[1])
        # extended digits keep what differences of sums and the move to the disc's centre would lose
        lx, ly, values = (x - rows.x0).astype(np.longdouble), (y - rows.y0).astype(np.longdouble), [pdf[c].to_numpy().astype(np.longdouble) for c in sums]
        parts = exact_and_rest(values[-1], float(max(lx.max(), ly.max(), 1)) ** 2)
        columns = []
        for w in parts:
            u, v = lx.astype(w.dtype), ly.astype(w.dtype)
            columns += [w, w * u, w * v, w * u * u, w * v * v, w * u * v]
        fields = [np.concatenate([np.zeros(1, v.dtype), np.cumsum(v, dtype=v.dtype)]) for v in (np.ones(len(x), np.int32), *values[:-1], *columns)]
        here, total = code[own], [np.zeros(int(own.sum()), f.dtype) for f in fields]
        for dy, half in rows_of:
            a, b = first(here + dy * rows.wide - half), first(here + dy * rows.wide + half + 1)
            for t, f in zip(total, fields, strict=True):
                t += f[b] - f[a]
        ox, oy = lx[own], ly[own]
        alone, plain, total = total[0] == 1, total[1 : len(sums)], total[len(sums) :]
        moved = 0
        for i in range(0, len(total), 6):  # each part is moved by itself, so that the first stays exact
            n, sx, sy, sxx, syy, sxy = total[i : i + 6]
            moved = moved + np.stack([n, sx - n * ox, sy - n * oy, sxx - 2 * ox * sx + n * ox * ox, syy - 2 * oy * sy + n * oy * oy, sxy - ox * sy - oy * sx + n * ox * oy])
        # a place alone in its disc has its own weight and no moments, without what rounding leaves
        moved[0], moved[1:] = np.where(alone, values[-1][own], moved[0]), np.where(alone, 0, moved[1:])
        return pd.DataFrame({"x": x[own], "y": y[own]} | {c: v.astype(np.float64) for c, v in zip([*sums, *moments], [*plain, *moved], strict=True)})

    schema = "x long, y long, " + ", ".join(f"{c} double" for c in [*sums, *moments])
    return haloed(p, side, radius).groupBy("_tx", "_ty").applyInPandas(solve, schema)


def joined_runs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of *n* nodes' components under edges (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def clusters(points: DataFrame, radius: float, least: int) -> DataFrame:
    """``(id, core, cluster)`` of points ``(id, x, y)`` with whole numbers, as :func:`terrastrat.operators.cluster.dbscan`.

    Equal places are one with their number and least id. A tile sees two radii around it: it counts within the disc by
    running sums and links runs of core places. A core place is linked to the nearest core places to its left and right
    in every row of its disc; any others there lie in the same runs, so no pair is listed. A run's first place in each
    other tile tells that tile's name of it, and components of these names join clusters over tiles.
    """
    p = cut(points.select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))
    places = cut(p.dropna().groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    side, rows_of = _side(places, radius), half_widths(radius)
    reach = math.floor(radius)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        x, y, ids = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["least"].to_numpy()
        tx, ty = x // side, y // side
        own = (tx == key[0]) & (ty == key[1])
        x0, y0 = key[0] * side, key[1] * side
        inner = (x >= x0 - reach) & (x < x0 + side + reach) & (y >= y0 - reach) & (y < y0 + side + reach)
        rows = Rows(x, y, radius)
        code = rows.code(x, y)
        first, running = rows.first(code), np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
        count = np.zeros(int(inner.sum()), np.int64)
        for dy, half in rows_of if least > 1 else ():
            at = code[inner] + dy * rows.wide
            count += running[first(at + half + 1)] - running[first(at - half)]
        core = inner.copy()
        core[inner] = count >= least if least > 1 else True
        c, cid = code[core], ids[core]
        new = np.ones(len(c), bool)
        new[1:] = np.diff(c) > reach  # the padding of rows is wider than the reach
        run = np.cumsum(new) - 1
        first, links = rows.first(c), []
        for dy, half in rows_of:
            if dy > 0 and len(c):
                at = c + dy * rows.wide
                after = first(np.minimum(at + 1, rows.top))
                for other, near in ((after - 1, (after > 0) & (at - c[after - 1] <= half)), (np.minimum(after, len(c) - 1), (after < len(c)) & (c[np.minimum(after, len(c) - 1)] - at <= half))):
                    pair = run[near] * len(c) + run[other[near]]
                    links.append(np.unique(pair[np.diff(pair, prepend=-1) != 0]))
        links = np.unique(np.concatenate(links)) if links else np.zeros(0, np.int64)
        runs = int(run[-1]) + 1 if len(c) else 0
        group = joined_runs(runs, links // max(len(c), 1), links % max(len(c), 1))[run]
        name = np.full(runs, np.iinfo(np.int64).max)
        np.minimum.at(name, group, cid)
        label = name[group]
        mine = own[core]
        tile = tx[core] * (1 << 31) + ty[core]
        head = ~mine & (new | (np.diff(tile, prepend=0) != 0))
        cx, cy = x[core], y[core]
        parts = [pd.DataFrame({"x": cx[s], "y": cy[s], "label": label[s], "core": True, "own": o}) for s, o in ((mine, True), (head, False))]
        rest = own & ~core
        if rest.any():
            here = code[rest]
            best, who = np.full(len(here), np.iinfo(np.int64).max), np.full(len(here), -1)
            for dy, half in rows_of if len(c) else ():
                at = here + dy * rows.wide
                after = first(np.clip(at + 1, 0, rows.top))
                for other, ok in ((np.maximum(after - 1, 0), after > 0), (np.minimum(after, len(c) - 1), after < len(c))):
                    gap = np.abs(c[other] - at)
                    d = gap * gap + dy * dy
                    nearer = ok & (gap <= half) & ((d < best) | ((d == best) & (cid[other] < cid[who])))
                    best, who = np.where(nearer, d, best), np.where(nearer, other, who)
            named = pd.array(label[who] if len(c) else who, dtype="Int64")
            named[who < 0] = pd.NA
            parts.append(pd.DataFrame({"x": x[rest], "y": y[rest], "label": named, "core": False, "own": True}))
        out = pd.concat([t for t in parts if len(t)] or parts[:1], ignore_index=True)
        return out.astype({"label": "Int64"})

    found = cut(haloed(places, side, 2 * reach).groupBy("_tx", "_ty").applyInPandas(solve, "x long, y long, label long, core boolean, own boolean"))
    mine = found.filter("own")
    names = found.filter("NOT own").select("x", "y", F.col("label").alias("other")).join(mine.filter("core").select("x", "y", "label"), ["x", "y"])
    united = connected_components(names.filter("label <> other").select("label", "other").distinct(), "label", "other")
    mine = mine.join(united.withColumnRenamed("node", "label"), "label", "left").select("x", "y", "core", F.coalesce("component", "label").alias("cluster"))
    return p.join(mine, ["x", "y"], "left").select("id", F.coalesce("core", F.lit(False)).alias("core"), "cluster")
