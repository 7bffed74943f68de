"""Pairs of vectors whose product reaches a threshold, without comparing all rows with all.

A bounded number of rows serve as pivots; every row lives in the cell of its nearest one. A product of at least t is a distance of at
most d, d^2 = |x|^2 + M^2 - 2 t, where M is the largest length. A row of cell c can have a partner in cell e only if it lies within d of the
plane between the two pivots and within d of the ball that holds e, so it visits just the cells where both hold. No pair is lost:
the bounds are the triangle inequality. Of two cells one direction is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import cut

#: Most rows of a block, of which a task compares two at once; blocks of a table, where they hold so few; rows that are compared in one product.
BLOCK, GRID, TILE = 32_768, 16, 2048
#: Rows that a cell has on average, and the most pivots (each is 8 bytes a dimension in every task).
CELL, MOST_PIVOTS = 1024, 4096
#: What rounding can add to a distance.
SLACK = 1e-7


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


class Cells:
    """Pivots, the ball and the size of each one's cell, and which cells rows have to visit; what tasks need of it is small."""

    def __init__(self, rows: DataFrame, threshold: float, pivots: int | None = None) -> None:
        n, self.longest = rows.agg(F.count("*"), F.max(V.norm(F.col("v")))).first()
        self.n, self.threshold = n, threshold
        wanted = pivots or min(MOST_PIVOTS, -(-n // CELL))
        centres = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("id")).limit(max(1, wanted)).collect()], dtype=float)
        self.centres = centres = np.unique(centres, axis=0) if n else centres
        self.kind = dict(rows.dtypes)["id"]
        if not n:
            return

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    d = squared(matrix(pdf["v"]), centres)
                    yield pdf.assign(home=d.argmin(1).astype(np.int32), away=np.sqrt(d.min(1)))

        self.placed = cut(rows.mapInPandas(home, f"id {self.kind}, v array<double>, home int, away double"), "homes")
        self.radius, self.size = np.full(len(centres), -np.inf), np.zeros(len(centres), dtype=np.int64)
        for r in self.placed.groupBy("home").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():
            self.radius[r["home"]], self.size[r["home"]] = r["r"], r["n"]

    def visits(self):
        """A function (vectors, their homes, cells) -> which rows visit which of the cells; of two cells one direction is enough, and a row is in its own."""
        centres, radius, longest, threshold = self.centres, self.radius, self.longest, self.threshold

        def near(x: np.ndarray, own: np.ndarray, among: np.ndarray) -> np.ndarray:
            d = squared(x, centres[among])
            mine = np.maximum(((x - centres[own]) ** 2).sum(1), 0)
            reach = np.sqrt(np.maximum((x * x).sum(1) + longest**2 - 2 * threshold, 0))[:, None] + SLACK
            between = np.sqrt(squared(centres[own], centres[among]))
            gap = np.where(between > 0, between, np.inf)
            found = (d - mine[:, None] <= 2 * gap * reach) & (np.sqrt(d) - radius[among][None] <= reach)
            found &= (own[:, None] < among[None]) ^ ((own[:, None] + among[None]) % 2 == 1)
            return found | (own[:, None] == among[None])

        return near


def cells(rows: DataFrame, threshold: float, pivots: int | None = None) -> DataFrame:
    """(id, v, home, cell): rows(id, v), a table, in their own cell and in those that they visit."""
    held = Cells(rows, threshold, pivots)
    if not held.n:
        return rows.select("id", "v", F.lit(0).alias("home"), F.lit(0).alias("cell"))
    near, index = held.visits(), np.arange(len(held.centres))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = near(matrix(pdf["v"]), pdf["home"].to_numpy(), index)
                yield pdf[["id", "v", "home"]].assign(cell=[np.flatnonzero(row).astype(np.int32) for row in found])

    met = held.placed.mapInPandas(visits, f"id {held.kind}, v array<double>, home int, cell array<int>")
    return met.select("id", "v", "home", F.explode("cell").alias("cell"))


def work(visited: DataFrame) -> DataFrame:
    """(cell, own, guests): residents and visitors of each cell; own * (own - 1) / 2 + own * guests pairs are compared."""
    return visited.groupBy("cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("own"), F.count_if(F.col("home") != F.col("cell")).alias("guests"))


def block_rows(n: int) -> int:
    """Rows of a block where n are to be compared in blocks: a GRID-th of them, so a row travels GRID times whatever n is, until blocks would outgrow a task."""
    return min(BLOCK, max(TILE, -(-n // GRID)))


def best_of(who: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each of who, with what is as good as the k-th."""
    order = np.lexsort((-sim, who))
    w, s = who[order], sim[order]
    start = np.searchsorted(w, w)
    last = np.minimum(start + k - 1, np.searchsorted(w, w, side="right") - 1)
    return order[s >= s[last]]


def threshold_pairs(rows: DataFrame, threshold: float, k: int | None = None, strict: bool = False, pivots: int | None = None) -> DataFrame:
    """(i, j, sim) in both directions, i and j different rows or the same, of rows(id, v) with a product of at least `threshold` (above it if strict).

    Cells, or parts of large ones, are put together to blocks. A row travels once to each block where it has to meet any, however many cells of it that are, and every two blocks
    that meet are compared in one go, cell by cell. With k that puts out no more than the k best of a row (and ties), which hold the k best of all.
    """
    held = Cells(rows, threshold, pivots)
    kind = held.kind
    if not held.n:
        return rows.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("sim"))
    near, index, size = held.visits(), np.arange(len(held.centres)), block_rows(held.n)
    first, parts, last, full = np.zeros(len(index), dtype=np.int64), np.ones(len(index), dtype=np.int64), 0, 0
    for c, n in enumerate(held.size.tolist()):
        if full and full + n > size:
            last, full = last + 1, 0
        first[c], parts[c] = last, max(1, -(-n // size))
        last, full = (last + parts[c], 0) if n > size else (last, full + n)
    blocks = np.arange(int((first + parts).max()))
    holds = (first[None] <= blocks[:, None]) & (blocks[:, None] < (first + parts)[None])  # block, cell

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                home = pdf["home"].to_numpy()
                yield pdf[["id", "v", "home"]].assign(own=(first[home] + pdf["h"].to_numpy() % parts[home]).astype(np.int32))

    at = cut(held.placed.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInPandas(settled, f"id {kind}, v array<double>, home int, own int"), "settled")

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own, cells_ = pdf["own"].to_numpy(), near(matrix(pdf["v"]), pdf["home"].to_numpy(), index)
                for b in np.unique(own):
                    yield pd.DataFrame({"own": b, "cell": np.flatnonzero(cells_[own == b].any(0)).astype(np.int32)})

    asked = np.zeros(holds.shape, dtype=bool)  # block, cell that a row of it visits
    for r in at.mapInPandas(asks, "own int, cell int").groupBy("own").agg(F.collect_set("cell").alias("cells")).collect():
        asked[r["own"], r["cells"]] = True

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                home, own = pdf["home"].to_numpy(), pdf["own"].to_numpy()
                to = (near(matrix(pdf["v"]), home, index).astype(np.float32) @ holds.T.astype(np.float32) > 0) | asked[:, home].T
                to[np.arange(len(own)), own] = True
                yield pdf.assign(other=[np.flatnonzero(row).astype(np.int32) for row in to])

    dealt = at.mapInPandas(deal, f"id {kind}, v array<double>, home int, own int, other array<int>").withColumn("other", F.explode("other"))
    dealt = dealt.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "home", "id", "v")

    def met(one: tuple, two: tuple, guests_only: bool, alone: bool) -> Iterator[tuple]:
        """(rows of one, rows of two, products) of what of one visits the cells of two; alone: both are the same rows."""
        (x, home), (y, there) = one, two
        among = np.unique(there)
        visiting = near(x, home, among)
        for n, c in enumerate(among.tolist()):
            come, live = np.flatnonzero(visiting[:, n] & ((home != c) if guests_only else True)), np.flatnonzero(there == c)
            for a in range(0, len(come), TILE):
                for b in range(0, len(live), TILE):
                    r, l = come[a : a + TILE], live[b : b + TILE]  # noqa: E741
                    s = x[r] @ y[l].T
                    for mine, turned in ((s, False), (np.ascontiguousarray(s.T), True)):
                        ok = mine > threshold - 1e-9
                        if k is not None and k < mine.shape[1]:
                            ok &= mine >= np.partition(mine, -k, axis=1)[:, -k, None] - 1e-9
                        p, q = np.divmod(np.flatnonzero(ok), ok.shape[1])
                        p, q = (l[p], r[q]) if turned else (r[p], l[q])
                        if turned and alone:  # residents of one cell met both ways already
                            other = home[q] != c
                            p, q = p[other], q[other]
                        for cut_ in range(0, len(p), 1 << 17):
                            i, j = p[cut_ : cut_ + (1 << 17)], q[cut_ : cut_ + (1 << 17)]
                            sim = ((y[i] * x[j]) if turned else (x[i] * y[j])).sum(1)  # equal rows are equally alike
                            fine = sim > threshold if strict else sim >= threshold
                            yield turned, i[fine], j[fine], sim[fine]

    def compare(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        one, two = pdf[pdf["own"] == x], pdf[pdf["own"] == y]
        if not len(one) or not len(two):
            return
        n, ids = len(one), np.concatenate([one["id"].to_numpy(), two["id"].to_numpy()])
        left, right = ((matrix(t["v"]), t["home"].to_numpy()) for t in (one, two))
        turns = [(left, left, False, True, 0, 0)] if x == y else [(left, right, False, False, 0, n), (right, left, True, False, n, 0)]
        out, many = [], 0
        for a, b, guests_only, alone, at_a, at_b in turns:
            for turned, i, j, sim in met(a, b, guests_only, alone):
                out.append((i + (at_b if turned else at_a), j + (at_a if turned else at_b), sim))
                many += len(i)
                if many > 1 << 19:
                    i, j, sim = (np.concatenate(t) for t in zip(*out, strict=True))
                    if k is None:
                        yield pd.DataFrame({"i": ids[i], "j": ids[j], "sim": sim})
                        out, many = [], 0
                    else:
                        kept = best_of(i, sim, k)
                        out, many = [(i[kept], j[kept], sim[kept])], 0
        if out:
            i, j, sim = (np.concatenate(t) for t in zip(*out, strict=True))
            kept = slice(None) if k is None else best_of(i, sim, k)
            yield pd.DataFrame({"i": ids[i[kept]], "j": ids[j[kept]], "sim": sim[kept]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_, key = [], None
        for pdf in batches:
            for now, part in pdf.groupby(["x", "y"], sort=True):
                if key is not None and now != key:
                    yield from compare(pd.concat(held_))
                    held_ = []
                key = now
                held_.append(part)
        if held_:
            yield from compare(pd.concat(held_))

    return dealt.repartition("x", "y").sortWithinPartitions("x", "y").mapInPandas(run, f"i {kind}, j {kind}, sim double")
