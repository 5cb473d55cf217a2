"""Steps that are sequential by nature, run apart on bounded groups: paths, drainage, thinning, planes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.operators.kernels import gather, square
from terrastrat.session import cut


def best_path(reward: np.ndarray, penalty: float, reach: int = 2) -> np.ndarray:
    """Lanes of the path through all stations (rows) with most reward less *penalty* a lane changed, up to *reach* at a step."""
    n, k = reward.shape
    score, back = reward[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        options = np.full((2 * reach + 1, k), -np.inf)
        for d in range(-reach, reach + 1):
            lo, hi = max(0, d), min(k, k + d)
            options[d + reach, lo:hi] = score[lo - d : hi - d] - penalty * abs(d)
        pick = options.argmax(axis=0)
        back[i] = np.arange(k) - (pick - reach)
        score = options[pick, np.arange(k)] + reward[i]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def best_paths(cells: DataFrame, key: str, lanes: int, penalty: float) -> DataFrame:
    """``(key, station, lane, reward)``: the best path of each key's ``(station, lane, reward)``; absent cells reward 0."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["station"].min())
        reward = np.zeros((int(pdf["station"].max()) - first + 1, lanes))
        reward[pdf["station"] - first, pdf["lane"]] = pdf["reward"]
        path = best_path(reward, penalty)
        return pd.DataFrame({key: pdf[key].iloc[0], "station": np.arange(len(path)) + first, "lane": path, "reward": reward[np.arange(len(path)), path]})

    return cells.select(key, "station", "lane", "reward").groupBy(key).applyInPandas(solve, f"{key} long, station long, lane long, reward double")


#: Fixed value: the eight neighbours in the order of preference among equal slopes.
NEIGHBOURS = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]


def settle(z: np.ndarray, level: np.ndarray, hops: np.ndarray) -> None:
    """Lowers (level, hops) in place until no cell can be reached better: the least highest ground on a way out, then cells crossed at that level.

    NaN ground is outside; cells of finite level are where ways begin.
    """
    rows, cols = z.shape
    heap = [(level[r, c], hops[r, c], r, c) for r, c in zip(*np.nonzero(np.isfinite(level)), strict=True)]
    heapq.heapify(heap)
    while heap:
        f, h, r, c = heapq.heappop(heap)
        if (f, h) > (level[r, c], hops[r, c]):
            continue
        for i, j in NEIGHBOURS:
            a, b = r + i, c + j
            if 0 <= a < rows and 0 <= b < cols and not np.isnan(z[a, b]):
                nf = max(z[a, b], f)
                new = (nf, h + 1 if nf == f else 0)
                if new < (level[a, b], hops[a, b]):
                    level[a, b], hops[a, b] = new
                    heapq.heappush(heap, (*new, a, b))


def downstream(level: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """Neighbour index that each cell drains to: the steepest, on flats the one fewest cells from their end; -1 for none."""
    wide, near = np.pad(level, 1, constant_values=np.nan), np.pad(hops, 1)
    rows, cols = level.shape
    drop, flat = np.full((8, rows, cols), -np.inf), np.full((8, rows, cols), np.inf)
    for n, (i, j) in enumerate(NEIGHBOURS):
        f, h = wide[1 + i : 1 + i + rows, 1 + j : 1 + j + cols], near[1 + i : 1 + i + rows, 1 + j : 1 + j + cols]
        known = np.isfinite(f) & np.isfinite(level)
        drop[n][known] = (level[known] - f[known]) / np.hypot(i, j)
        same = known & (f == level) & (h < hops)
        flat[n][same] = h[same]
    out = np.where(drop.max(axis=0) > 0, drop.argmax(axis=0), np.where(np.isfinite(flat.min(axis=0)), flat.argmin(axis=0), -1))
    return np.where(np.isfinite(level), out, -1)


def gathered(amount: np.ndarray, out: np.ndarray, level: np.ndarray, hops: np.ndarray, own: np.ndarray) -> None:
    """Adds every own cell's amount to the cell that it drains to, upstream cells first, in place."""
    r, c = np.nonzero(own & (out >= 0))
    order = np.lexsort((-hops[r, c], -level[r, c]))
    for a, b in zip(r[order], c[order], strict=True):
        if amount[a, b]:
            i, j = NEIGHBOURS[out[a, b]]
            amount[a + i, b + j] += amount[a, b]


def _grid(pdf: pd.DataFrame, tile: int, names: list[str], fill: dict) -> tuple[int, int, dict]:
    """Arrays of a tile with one cell around it; the tile's key is in columns _r and _c."""
    r0, c0 = int(pdf["_r"].iloc[0]) * tile - 1, int(pdf["_c"].iloc[0]) * tile - 1
    grids = {}
    for n in names:
        grids[n] = np.full((tile + 2, tile + 2), fill.get(n, np.nan))
        grids[n][pdf["row"] - r0, pdf["col"] - c0] = pdf[n]
    return r0, c0, grids


def _own(tile: int) -> np.ndarray:
    own = np.zeros((tile + 2, tile + 2), bool)
    own[1:-1, 1:-1] = True
    return own


def drainage(cells: DataFrame, tile: int = 256) -> DataFrame:
    """``(row, col, filled, direction, area)`` of the ground ``(row, col, z)``: filled surface, downstream neighbour (-1: out), cells upstream with the cell itself.

    Cells beside a missing one are ways out. Work runs on tiles with one cell around them. Levels are lowered
    within tiles and handed over their borders until none changes, which gives the one fixed point of
    the whole grid whatever the tiles. Then water is gathered inside tiles, and what leaves a tile is
    sent on to the next until nothing does. So results don't depend on *tile*. Null ground is missing.
    """
    ground = cells.filter("z is not null AND NOT isnan(z)").select("row", "col", F.col("z").cast("double").alias("z"))
    around = gather(ground, square(1), [F.count("*").alias("n")], [], within=ground)
    state = ground.join(around, ["row", "col"])
    state = cut(state.select("row", "col", "z", F.when(F.col("n") < 9, F.col("z")).otherwise(F.lit(float("inf"))).alias("level"), F.when(F.col("n") < 9, 0).otherwise(1 << 40).cast("double").alias("hops")))
    keys = F.array_distinct(F.array(*[F.struct(F.expr(f"floor((row + {i}) / {tile})").alias("r"), F.expr(f"floor((col + {j}) / {tile})").alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    haloed = lambda t: t.withColumn("_k", F.explode(keys)).select("*", F.col("_k.r").alias("_r"), F.col("_k.c").alias("_c")).drop("_k").groupBy("_r", "_c")
    own = _own(tile)

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, g = _grid(pdf, tile, ["z", "level", "hops"], {"level": np.inf, "hops": 1 << 40})
        before = g["level"].copy(), g["hops"].copy()
        settle(g["z"], g["level"], g["hops"])
        r, c = np.nonzero(own & ~np.isnan(g["z"]))
        changed = (g["level"] != before[0]) | (g["hops"] != before[1])
        return pd.DataFrame({"row": r + r0, "col": c + c0, "z": g["z"][r, c], "level": g["level"][r, c], "hops": g["hops"][r, c], "changed": changed[r, c]})

    while True:
        state = cut(haloed(state).applyInPandas(lower, "row long, col long, z double, level double, hops double, changed boolean"))
        moved = not state.filter("changed").isEmpty()
        state = state.drop("changed")
        if not moved:
            break

    def flow(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, g = _grid(pdf, tile, ["level", "hops"], {"level": np.nan, "hops": 0})
        out = downstream(g["level"], g["hops"])
        known = own & np.isfinite(g["level"])
        amount = known.astype(np.float64)
        gathered(amount, out, g["level"], g["hops"], known)
        return _result(r0, c0, g, out, amount, known)

    def _result(r0, c0, g, out, amount, known):
        """The tile's cells, and (direction null) what reached the cells around it."""
        r, c = np.nonzero(known)
        p, q = np.nonzero(~own & (amount > 0))
        mine = pd.DataFrame({"row": r + r0, "col": c + c0, "level": g["level"][r, c], "hops": g["hops"][r, c], "direction": out[r, c], "amount": amount[r, c]})
        sent = pd.DataFrame({"row": p + r0, "col": q + c0, "level": np.nan, "hops": np.nan, "direction": pd.NA, "amount": amount[p, q]})
        both = pd.concat([mine, sent], ignore_index=True) if len(sent) else mine
        both["direction"] = both["direction"].astype("Int64")
        return both

    schema = "row long, col long, level double, hops double, direction long, amount double"
    found = cut(haloed(state.select("row", "col", "level", "hops")).applyInPandas(flow, schema))
    net = cut(found.filter("direction is not null"))
    areas = net.select("row", "col", "amount")
    key = [F.expr(f"floor(row / {tile})").alias("_r"), F.expr(f"floor(col / {tile})").alias("_c")]
    tiles = net.select("row", "col", "level", "hops", "direction", *key)

    def carry(pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        r0, c0, g = _grid(pdf, tile, ["level", "hops", "direction"], {"hops": 0, "direction": -1})
        known = own & np.isfinite(g["level"])
        amount = np.zeros(known.shape)
        amount[sent["row"] - r0, sent["col"] - c0] = sent["amount"]
        out = g["direction"].astype(np.int64)
        gathered(amount, out, g["level"], g["hops"], known)
        return _result(r0, c0, g, out, amount, known & (amount > 0))

    while True:
        sent = cut(found.filter("direction is null").groupBy("row", "col").agg(F.sum("amount").alias("amount")).select("*", *key))
        if sent.isEmpty():
            break
        part = tiles.join(sent.select("_r", "_c").distinct(), ["_r", "_c"], "left_semi")
        found = cut(part.groupBy("_r", "_c").cogroup(sent.groupBy("_r", "_c")).applyInPandas(carry, schema))
        areas = areas.unionByName(found.filter("direction is not null").select("row", "col", "amount"))
    total = areas.groupBy("row", "col").agg(F.sum("amount").cast("long").alias("area"))
    return net.select("row", "col", F.col("level").alias("filled"), "direction").join(total, ["row", "col"])


def deflection(flow: DataFrame, least_area: int, window: int = 7, least: int = 5) -> DataFrame:
    """``(row, col, deflection)`` of channel cells of ``(row, col, direction, area)``: one minus the length of the mean direction of channels around.

    Channels are cells of at least *least_area*; with fewer than *least* of them in the window it is 0.
    """
    # fixed value: angles of the eight neighbours from east, against the clock, in the order of NEIGHBOURS
    angles = [float(np.arctan2(-i, j)) for i, j in NEIGHBOURS]
    angle = F.when(F.col("direction") >= 0, F.element_at(F.array(*map(F.lit, angles)), (F.col("direction") + 1).cast("int"))).otherwise(0.0)
    rows = flow.filter(F.col("area") >= least_area).select("row", "col", F.cos(angle).alias("u"), F.sin(angle).alias("v"))
    sums = gather(rows, square(window // 2), [F.sum("u").alias("u"), F.sum("v").alias("v"), F.count("*").alias("n")], ["u", "v"], within=rows)
    return sums.select("row", "col", F.when(F.col("n") >= least, 1 - F.hypot("u", "v") / F.col("n")).otherwise(0.0).alias("deflection"))


def tiled(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """Rows once for every tile ``_r, _c`` that they lie in or at most *halo* from."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    return cells.withColumn("_r", reach("row")).withColumn("_c", reach("col"))


#: Cells a side of a tile, and rounds of thinning that a task runs before tiles hear of each other again.
THIN_TILE, THIN_ROUNDS = 256, 32


def thin(mask: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Cells of the mask thinned to lines by the two alternating passes of the classical parallel rule.

    A pass looks one cell far, so a tile with two cells around it for every round runs THIN_ROUNDS of them alone and has its own
    cells right. Rounds end when no cell goes. Raises if *max_rounds* do not suffice.
    """
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]

    def goes(bits: int, step: int) -> bool:
        p = [bits >> n & 1 for n in range(8)]
        turns = sum(a == 0 and b == 1 for a, b in zip(p, p[1:] + p[:1], strict=True))
        if not 2 <= sum(p) <= 6 or turns != 1:
            return False
        n, e, s, w = p[0], p[2], p[4], p[6]
        return not (n * e * s or e * s * w) if step == 0 else not (n * e * w or n * s * w)

    lookup = [np.array([goes(b, step) for b in range(256)]) for step in (0, 1)]
    tile = THIN_TILE

    def run(rounds: int):
        halo = 2 * rounds

        def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            r, c = (pdf[n].to_numpy() - k * tile + halo + 1 for n, k in zip(("row", "col"), key, strict=True))
            grid = np.zeros((tile + 2 * halo + 2,) * 2, bool)
            grid[r, c] = True
            gone = np.zeros(grid.shape, np.int64)
            for n in range(1, rounds + 1):
                before = grid.copy()
                for table in lookup:
                    bits = np.zeros((grid.shape[0] - 2,) * 2, np.int64)
                    for at, (i, j) in enumerate(ring):
                        bits |= grid[1 + i : grid.shape[0] - 1 + i, 1 + j : grid.shape[1] - 1 + j].astype(np.int64) << at
                    grid[1:-1, 1:-1] &= ~table[bits]
                gone[before & ~grid] = n
                if (before == grid).all():
                    break
            own = (r > halo) & (r <= halo + tile) & (c > halo) & (c <= halo + tile)
            return pd.DataFrame({"row": pdf["row"].to_numpy()[own], "col": pdf["col"].to_numpy()[own], "gone": gone[r[own], c[own]]})

        return lambda left: cut(tiled(left, tile, halo).groupBy("_r", "_c").applyInPandas(solve, "row long, col long, gone long"))

    left, used = cut(mask.select("row", "col")), 0
    while used < max_rounds:
        rounds = min(THIN_ROUNDS, max_rounds - used)
        found = run(rounds)(left)
        left, last = found.filter("gone = 0").select("row", "col"), found.agg(F.max("gone")).first()[0] or 0
        if last < rounds:
            return left
        used += rounds
    raise RuntimeError(f"cells still go after {max_rounds} rounds")


def plane(xyz: np.ndarray, rounds: int = 3, spread: float = 3.0, least: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit normal, inliers, thickness) of a plane trimmed in up to *rounds* by its residuals.

    A point goes if its residual exceeds their median by *spread* times the scaled median deviation
    (at least 1), and doesn't come back. With fewer than *least* points left there is no plane: no inliers.
    """
    keep = np.ones(len(xyz), bool)
    for _ in range(rounds):
        centre = xyz[keep].mean(axis=0)
        normal = np.linalg.eigh(np.cov((xyz[keep] - centre).T))[1][:, 0]
        residual = np.abs((xyz - centre) @ normal)
        middle = np.median(residual[keep])
        scale = max(1.4826 * float(np.median(np.abs(residual[keep] - middle))), 1.0)
        new = keep & (residual <= middle + spread * scale)
        if new.sum() < least:
            return normal, np.zeros(len(xyz), bool), float("nan")
        if (new == keep).all():
            break
        keep = new
    normal = normal * (1 if normal[2] > 0 or (normal[2] == 0 and normal[0] >= 0) else -1)
    return normal, keep, float(np.sqrt(np.mean(residual[keep] ** 2)))


def planes(points: DataFrame) -> DataFrame:
    """One robust plane a bucket of ``(bucket, id, x, y, z)``; buckets of fewer than four points have none."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "nx", "ny", "nz", "thickness", "n", "inliers"]
        if len(pdf) < 4:
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values("id")
        normal, keep, thickness = plane(pdf[["x", "y", "z"]].to_numpy())
        if not keep.any():
            return pd.DataFrame(columns=columns)
        return pd.DataFrame([[pdf["bucket"].iloc[0], *map(float, normal), thickness, len(pdf), int(keep.sum())]], columns=columns)

    return points.groupBy("bucket").applyInPandas(solve, "bucket long, nx double, ny double, nz double, thickness double, n long, inliers long")
