"""All pairs of a table in blocks: points are packed into blocks, and each pair of blocks is one row and one numpy step.

For scores that are defined over all pairs. The work is quadratic by definition; what moves is each block once per other
block, and what leaves a step is what the caller's function makes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import order_key
from ..sources.scratch import drop as scratch_drop
from ..sources.scratch import keep

ROWS = 512
#: Times that a range is cut into bins until what lies in one differs by no more than rounding.
DEEPEST = 5


def _euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((y - x) ** 2).sum(1))


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(y - x).sum(1)


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 - y @ x / (max(np.linalg.norm(x), 1e-10) * np.maximum(np.linalg.norm(y, axis=1), 1e-10))


#: Distances of one vector to the rows of a matrix.
MEASURES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"euclidean": _euclidean, "manhattan": _manhattan, "cosine": _cosine}


def packed(points: DataFrame, label: str | None = None, rows: int = ROWS) -> DataFrame:
    """(block, ids, labels, data, dim): up to rows points (id, v, label) with vectors of one length."""

    def pack(batches):
        waiting: list[tuple] = []

        def out():
            ids, labels, data = zip(*waiting, strict=True)
            ids = np.array(ids, np.int64)
            waiting.clear()
            return pd.DataFrame({"block": [int(ids[0])], "ids": [ids.tobytes()], "labels": [np.array(labels, np.int64).tobytes()], "data": [np.array(data, np.float64).tobytes()], "dim": [len(data[0])]})

        for batch in batches:
            for row in zip(batch["id"], batch["label"], batch["v"], strict=True):
                waiting.append(row)
                if len(waiting) == rows:
                    yield out()
        if waiting:
            yield out()

    own = F.col(label).cast("long") if label else F.lit(0).cast("long")
    made = points.select("id", own.alias("label"), "v").mapInPandas(pack, "block long, ids binary, labels binary, data binary, dim int")
    # Dealt out, as the tasks of what follows are those of the files; blocks are few beside their points.
    return keep(made.repartition(points.sparkSession.sparkContext.defaultParallelism), "blocks")


def both(blocks: DataFrame, ordered: bool = False) -> DataFrame:
    """Every two blocks in one row, a block with itself too; in both orders if ordered."""
    other = blocks.select(*[F.col(c).alias(f"o_{c}") for c in blocks.columns])
    return blocks.crossJoin(other) if ordered else blocks.join(other, F.col("block") <= F.col("o_block"))


def unpack(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of one side of a row of two blocks."""
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}labels"], np.int64), np.frombuffer(row[f"{prefix}data"], np.float64).reshape(len(ids), row[f"{prefix}dim"])


def pairs(blocks: DataFrame, step: Callable, schema: str, ordered: bool = False) -> DataFrame:
    """step(ids, labels, x, other ids, other labels, other x) gives a frame for each pair of blocks; ordered pairs come in
    both orders, others once. A block is paired with itself too."""

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                yield step(*unpack(row, ""), *unpack(row, "o_"))

    return both(blocks, ordered).mapInPandas(run, schema)


def matrix(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of x to those of y."""
    measure = MEASURES[metric]
    return np.stack([measure(v, y) for v in x]) if len(x) else np.zeros((0, len(y)))


def _upper(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, metric: str):
    """Distances of each pair of points once, row by row."""
    measure = MEASURES[metric]
    for k, v in enumerate(x):
        yield measure(v, y[k + 1 :] if ids[0] == others[0] else y)


def quantiles(points: DataFrame, parts: list[float], metric: str = "euclidean", bins: int = 4096, few: int = 100_000) -> tuple[list[float | None], float | None]:
    """Exact quantiles, linear between ranks, and the mean of the distances of all pairs. Tasks count distances by bin, so a
    task sends a row a bin; the bins that hold wanted ranks are cut again until few distances lie in one, or they are all
    the same. No distance becomes a row but those last few."""
    blocks = packed(points)
    first = blocks.select("data", "dim").first()
    if first is None:
        return [None] * len(parts), None
    origin = np.frombuffer(first["data"], np.float64)[: first["dim"]]

    def reach(batches):
        for batch in batches:
            far = [MEASURES[metric](origin, np.frombuffer(d, np.float64).reshape(-1, len(origin))).max() for d in batch["data"]]
            yield pd.DataFrame({"far": far})

    # No two points are farther apart than both are from a third; cosine distances are at most 2.
    top = 2.0 if metric == "cosine" else 2 * blocks.select("data").mapInPandas(reach, "far double").agg(F.max("far")).first()[0]

    def inside(d: np.ndarray, path: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Of the distances those in the bin of a bin ... of the range that path says, and their places in bins of that one."""
        at = d * (bins / top)
        for i in path:
            own = np.floor(at) == i
            d, at = d[own], (at[own] - i) * bins
        return d, at

    def rows(batches):
        for row in (row for batch in batches for row in batch.to_dict("records")):
            yield np.concatenate(list(_upper(*unpack(row, "")[::2], *unpack(row, "o_")[::2], metric)))

    def counts(paths: list[tuple[int, ...]]) -> tuple[list[np.ndarray], float]:
        """By path, how many distances lie in each bin of it; the sum of all."""

        def count(batches):
            n, total = np.zeros((len(paths), bins), np.int64), 0.0
            for d in rows(batches):
                total += float(d.sum())
                for k, path in enumerate(paths):
                    n[k] += np.bincount(np.clip(np.floor(inside(d, path)[1]).astype(np.int64), 0, bins - 1), minlength=bins)
            k, i = np.nonzero(n)
            yield pd.DataFrame({"k": [*k, -1], "i": [*i, 0], "n": [*n[k, i], 0], "total": [*np.zeros(len(k)), total]})

        found = both(blocks).mapInPandas(count, "k int, i int, n long, total double").groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # bins a path
        out, whole = [np.zeros(bins, np.int64) for _ in paths], 0.0
        for x in found:
            if x.k < 0:
                whole = x.total
            else:
                out[x.k][x.i] = x.n
        return out, whole

    def values(paths: list[tuple[int, ...]], least: bool) -> list[np.ndarray]:
        """By path, its distances in order, or the least alone."""

        def some(batches):
            for d in rows(batches):
                for k, path in enumerate(paths):
                    if (own := inside(d, path)[0]).size:
                        yield pd.DataFrame({"k": np.int32(k), "d": [own.min()] if least else own})

        got = both(blocks).mapInPandas(some, "k int, d double")
        got = (got.groupBy("k").agg(F.min("d").alias("d")) if least else got).toPandas()  # few a path, a path a rank
        return [np.sort(got.d[got.k == k].to_numpy()) for k in range(len(paths))]

    top = top * (1 + 1e-9) or 1.0  # so that the largest lies in the last bin
    (first_count,), total = counts([()])
    pairs_ = int(first_count.sum())
    if not pairs_:
        return [None] * len(parts), None
    place, known = [p * (pairs_ - 1) for p in parts], {}
    open_ = {r: ((), r) for r in {int(f(h)) for h in place for f in (np.floor, np.ceil)}}  # of each rank: its path, and its rank there
    by_path = {(): first_count}
    while open_:
        stepped = {}
        for r, (path, rank) in open_.items():
            i = int(np.searchsorted(np.cumsum(by_path[path]), rank, "right"))
            stepped[r] = ((*path, i), rank - int(by_path[path][:i].sum()), int(by_path[path][i]))
        done = {r: x for r, x in stepped.items() if x[2] <= few or len(x[0]) >= DEEPEST}
        for least in (False, True):
            if paths := sorted({x[0] for x in done.values() if (x[2] > few) == least}):
                got = dict(zip(paths, values(paths, least), strict=True))
                known |= {r: got[x[0]][0 if least else x[1]] for r, x in done.items() if x[0] in got}
        open_ = {r: x[:2] for r, x in stepped.items() if r not in done}
        if paths := sorted({x[0] for x in open_.values()}):
            by_path = dict(zip(paths, counts(paths)[0], strict=True))
    scratch_drop(blocks)
    between = lambda h: known[int(np.floor(h))] + (h - np.floor(h)) * (known[int(np.ceil(h))] - known[int(np.floor(h))])
    return [float(between(h)) for h in place], total / pairs_


def distances(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(dist) of every pair of points, once; for small tables."""
    return pairs(packed(points), lambda ids, _, x, others, __, y: pd.DataFrame({"dist": np.concatenate(list(_upper(ids, x, others, y, metric)))}), "dist double")


def label_distances(points: DataFrame, label: str, metric: str = "euclidean") -> DataFrame:
    """(id, label, other, dist): each point's mean distance to the points of each label, itself left out."""

    def step(ids, labels, x, others, other_labels, y):
        found, place = np.unique(other_labels, return_inverse=True)
        member = np.zeros((len(y), len(found)))
        member[np.arange(len(y)), place] = 1
        total, rest = matrix(x, y, metric) @ member, member.sum(0)[None] - (ids[:, None] == others[None]).astype(float) @ member
        n = len(found)
        return pd.DataFrame({"id": np.repeat(ids, n), "label": np.repeat(labels, n), "other": np.tile(found, len(ids)), "total": total.ravel(), "n": rest.ravel().astype(np.int64)})

    sums = pairs(packed(points, label), step, "id long, label long, other long, total double, n long", ordered=True)
    return sums.groupBy("id", "label", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).where("n > 0").select("id", "label", "other", (F.col("t") / F.col("n")).alias("dist"))


# -- nearest neighbours ---------------------------------------------------------------------------------------------

#: Points of a block that queries are searched in; of each block, only the nearest of every query leave.
SEARCHED = 4096


def searched(queries: DataFrame, points: DataFrame, far: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]], k: int, exclude_self: bool) -> DataFrame:
    """(q_id, id, dist): for each block of points, the k nearest to every query, ties to smaller ids. far gives the distances
    of a block's points from each query in turn; queries (id, v), points (id, v)."""
    asked = packed(queries, rows=ROWS).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    pairs_ = packed(points, rows=SEARCHED).select("ids", "data").crossJoin(asked)  # of blocks

    def run(batches):
        for row in (row for batch in batches for row in batch.to_dict("records")):
            ids, q_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "q_ids"))
            x, q = (np.frombuffer(row[c], np.float64).reshape(n, -1) for c, n in (("data", len(ids)), ("q_data", len(q_ids))))
            out = []
            for own, d in zip(q_ids, far(q, x), strict=True):
                places = np.flatnonzero(ids != own) if exclude_self else np.arange(len(ids))
                d = d[places]
                if len(d) > k:
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    places, d = places[near], d[near]
                best = np.lexsort((ids[places], d))[:k]
                out.append((np.full(len(best), own), ids[places[best]], d[best]))
            a, b, d = (np.concatenate(part) for part in zip(*out, strict=True))
            yield pd.DataFrame({"q_id": a, "id": b, "dist": d})

    return pairs_.mapInPandas(run, "q_id long, id long, dist double")


# -- pairs within a radius ------------------------------------------------------------------------------------------

#: Points of a cell on average, and cells at most: their centres and radii are on the driver.
CELL_ROWS, CELLS = 2048, 1024


def near_pairs(points: DataFrame, eps: float, metric: str = "euclidean", cells: int | None = None, seed: int = 42) -> DataFrame:
    """(a, b, dist) for a < b at most eps apart. Points go to the nearest of some points chosen by hash, and each cell's
    points into blocks with a centre and a radius of their own. By the triangle inequality two cells, and then two blocks,
    can hold near points only if their centres are at most both radii and eps apart; the blocks that are left meet, each two
    in one row, and only pairs within eps leave it. A cell of any size is as many blocks as it needs. Cosine distances
    are half the square of Euclidean ones of vectors of length one, which say which blocks meet."""
    own = "euclidean" if metric == "cosine" else metric
    bound = float(np.sqrt(2 * eps)) * (1 + 1e-9) if metric == "cosine" else eps * (1 + 1e-9)
    unit = (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)) if metric == "cosine" else (lambda x: x)
    base = points.select(F.col("id").cast("long").alias("id"), "v")
    wanted = cells or max(1, min(base.count() // CELL_ROWS, CELLS))
    start = base.orderBy(order_key(seed, F.col("id")), "id").limit(wanted).select("v").collect()  # CELLS at most
    if not start:
        return points.sparkSession.createDataFrame([], "a long, b long, dist double")
    centres = unit(np.array([r.v for r in start], np.float64))

    def pack(batches):
        waiting: dict[int, list] = {}
        held = 0

        def out(c):
            nonlocal held
            ids, data = (np.concatenate(part) for part in zip(*waiting.pop(c), strict=True))
            held -= len(ids)
            for at in range(0, len(ids), ROWS):
                x = data[at : at + ROWS]
                u = unit(x)
                middle = u.mean(0)
                yield pd.DataFrame({
                    "cell": [c], "block": [int(ids[at])], "ids": [ids[at : at + ROWS].tobytes()], "data": [x.tobytes()], "middle": [middle],
                    "radius": [MEASURES[own](middle, u).max()], "reach": [MEASURES[own](centres[c], u).max()],
                })

        for batch in batches:
            if not len(batch):
                continue
            ids, x = batch["id"].to_numpy(), np.stack(batch["v"].to_numpy()).astype(np.float64)
            cell = np.argmin(matrix(unit(x), centres, own), axis=1)
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                waiting.setdefault(int(c), []).append((ids[rows], x[rows]))
                held += len(rows)
                if sum(len(i) for i, _ in waiting[int(c)]) >= ROWS:
                    yield from out(int(c))
            while held > 100_000:
                yield from out(max(waiting, key=lambda c: sum(len(i) for i, _ in waiting[c])))
        for c in list(waiting):
            yield from out(c)

    blocks = keep(base.mapInPandas(pack, "cell int, block long, ids binary, data binary, middle array<double>, radius double, reach double"), "blocks")
    reach = {r.cell: r.reach for r in blocks.groupBy("cell").agg(F.max("reach").alias("reach")).collect()}  # a row a cell
    between = matrix(centres, centres, own)
    meets = {a: [b for b in reach if between[a, b] <= reach[a] + reach[b] + bound] for a in reach}
    listed = F.lit([[int(b) for b in meets.get(a, [])] for a in range(len(centres))]).cast("array<array<int>>")
    one = blocks.select(*[F.col(c).alias(f"o_{c}") for c in ("block", "ids", "data", "middle", "radius")], F.explode(F.get(listed, F.col("cell"))).alias("cell"))
    apart = vectors.distance(own)(F.col("middle"), F.col("o_middle"))
    both_ = blocks.join(one, "cell").where((F.col("block") <= F.col("o_block")) & (apart <= F.col("radius") + F.col("o_radius") + bound))

    def measure(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                ids, others = (np.frombuffer(row[c], np.int64) for c in ("ids", "o_ids"))
                x, y = np.frombuffer(row["data"], np.float64).reshape(len(ids), -1), np.frombuffer(row["o_data"], np.float64).reshape(len(others), -1)
                found = []
                for k, d in enumerate(_upper(ids, x, others, y, metric)):
                    near = np.flatnonzero(d <= eps)
                    away = near + (k + 1 if ids[0] == others[0] else 0)
                    found.append((np.full(len(near), ids[k]), others[away], d[near]))
                i, j, d = (np.concatenate(part) for part in zip(*found, strict=True))
                yield pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j), "dist": d})

    return both_.select("ids", "data", "o_ids", "o_data").mapInPandas(measure, "a long, b long, dist double").where("a < b")
