"""Operator 4: embedding near-duplicates by spherical k-means cells and blocked cosine products.

Equal vectors form one class; classes are compared.  Spherical k-means, fitted on a bounded
sample (`sample` classes of smallest hash), assigns every class to its nearest cell, and a
class also visits each cell whose border with its own is within `margin`.  A pair at the
threshold's angle differs by sin(angle), spread over the dimensions, so a border is crossed
by about sin(angle) / sqrt(dimensions); the margin is `spread` times that.  A pair is found if
either of its vectors visits the other's cell, so it is missed only if the border is crossed
by more than two margins.  The share of linked pairs found is tested against brute force.  Cells grow in number as the
square root of the classes.

Within a cell blocks are compared by matrix products in double precision; a pair of blocks is
a task, so a hot cell is spread, and a task yields one row a member: its links and one edge
to its root in the task, never a row for each pair.  A pair that meets in two cells counts in
one.  Products within 1e-9 of the threshold are computed again in extended precision.

Edge cases: null, empty, zero and non-finite vectors and null components link with nothing
(component_id = vec_id, kept); a null vec_id has component_id null and is kept; vectors of
different lengths are never compared; repeated rows are members of one class; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, rows, with_least, written

BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k unit centres of unit vectors x; an empty cell restarts at the vector worst served."""
    rng = np.random.default_rng(seed)
    centre = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near, best = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1))
        empty = np.flatnonzero(norm < 1e-12)
        total[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        centre = unit(total)
    return np.unique(centre, axis=0)


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), 4096):
        c = x[a : a + 4096] @ centre.T
        near[a : a + 4096], best[a : a + 4096] = c.argmax(1), c.max(1)
    return near, best


def visits(x: np.ndarray, home: np.ndarray, centre: np.ndarray, margin: float, cells: np.ndarray | None = None) -> np.ndarray:
    """Which (of these) cells each unit vector is compared in: its own, and those with a border within the margin."""
    own = centre[home]
    some = centre if cells is None else centre[cells]
    gap = np.sqrt(np.maximum(0, 2 - 2 * (own @ some.T)))  # distance of each centre from the home's
    cell = np.arange(len(centre)) if cells is None else cells
    return ((x * own).sum(1)[:, None] - x @ some.T <= margin * gap) | (cell[None, :] == home[:, None])


LINKS = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
CELLS = pa.schema([("cid", pa.int64()), ("copies", pa.int64()), ("home", pa.int64()), ("cell", pa.int64()), ("vector", pa.list_(pa.float64()))])


def cells(classes: DataFrame, centre: np.ndarray, margin: float) -> DataFrame:
    """Each class once for each cell that it is compared in."""
    sent = classes.sparkSession.sparkContext.broadcast(centre)  # cells * dimensions; at most max_cells

    def run(batches):
        for batch in batches:
            step = max(64, min(2048, (1 << 22) // len(sent.value)))  # rows times cells are bounded
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                raw = matrix(part.column("vector"))
                x = unit(raw)
                home, _ = nearest(x, sent.value)
                row, cell = np.nonzero(visits(x, home, sent.value, margin))
                for s in range(0, len(row), 4096):
                    r = row[s : s + 4096]
                    vector = pa.ListArray.from_arrays(pa.array(np.arange(0, raw.shape[1] * len(r) + 1, raw.shape[1]), pa.int32()), pa.array(raw[r].ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("cid").take(pa.array(r)), part.column("copies").take(pa.array(r)), pa.array(home[r]), pa.array(cell[s : s + 4096]), vector], schema=CELLS)

    return classes.select("cid", "copies", "vector").mapInArrow(run, "cid long, copies long, home long, cell long, vector array<double>")


def linked(raw: np.ndarray, threshold: float) -> np.ndarray:
    x = unit(raw)
    c = x @ x.T
    out = c >= threshold
    # scaled by powers of two, which is exact: components of any size neither overflow nor vanish
    _, power = np.frexp(np.abs(raw).max(1))
    for i, j in zip(*np.nonzero(np.abs(c - threshold) < 1e-9)):
        a, b = (np.ldexp(raw[k], -power[k]).astype(np.longdouble) for k in (i, j))
        out[i, j] = np.double(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))) >= threshold
    return out


def compared(placed: DataFrame, centre: np.ndarray, margin: float, threshold: float) -> DataFrame:
    """cid, root, links over every block pair of every cell."""
    sent = placed.sparkSession.sparkContext.broadcast(centre)
    sizes = placed.groupBy("cell").count().where("count > 1")
    spread = placed.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("count") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("count", "blocks")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("cid")
        cid, copies, home, block = (group.column(c).to_numpy() for c in ("cid", "copies", "home", "block"))
        cell, low, high = (group.column(c)[0].as_py() for c in ("cell", "low", "high"))
        raw = matrix(group.column("vector"))
        link = linked(raw, threshold)
        np.fill_diagonal(link, False)
        own = home == cell
        link &= own[:, None] | own[None, :]
        if low != high:
            link &= block[:, None] != block[None, :]
        # a pair with two homes counts here unless it also meets in the other home, of smaller number
        here = np.flatnonzero(own)
        cells, which = np.unique(home, return_inverse=True)
        meets = visits(unit(raw[here]), home[here], sent.value, margin, cells)[:, which]
        counted = link.copy()
        counted[here] &= ~(meets & (home < cell)[None, :])
        counted[:, here] = counted[here].T | (counted[:, here] & own[:, None])
        root, old = cid.copy(), None
        while old is None or (old != root).any():
            old = root
            root = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(1))
        return pa.table([pa.array(cid), pa.array(root), pa.array((counted * copies[None, :]).sum(1))], schema=LINKS)

    return spread.groupBy("cell", "low", "high").applyInArrow(compare, "cid long, root long, links long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, sample: int = 20_000, max_cells: int = 4096, spread: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    ok = F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keyed = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("cid", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("embedding")))
    classes = written(keyed.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("vector")), "vectors")
    links = None
    for r in classes.groupBy(F.size("vector").alias("dim")).count().orderBy("dim").collect():  # one row a vector length
        mine = classes.where(F.size("vector") == r["dim"])
        if r["count"] < 2:
            continue
        some = mine.select("vector", "cid").orderBy("cid").limit(sample).toArrow()  # the bounded sample
        k = int(min(max_cells, np.ceil(np.sqrt(r["count"]))))
        centre = spherical_kmeans(unit(matrix(some.column("vector"))), k)
        angle = np.sqrt(1 - threshold**2)
        margin = min(angle, spread * angle / np.sqrt(r["dim"]))
        got = compared(cells(mine, centre, margin), centre, margin, threshold)
        links = got if links is None else links.unionByName(got)
    if links is None:
        links = classes.select("cid", F.col("cid").alias("root"), F.lit(0).cast("long").alias("links")).limit(0)
    links = written(links, "links")
    found = components(links, "cid", "root").select(F.col("node").alias("cid"), "component").join(classes.select("cid", "rep"), "cid")
    low = with_least(found, "component", F.col("rep"), "component_id").select("cid", "component_id")
    per_class = classes.select("cid", "rep", "copies").join(low, "cid", "left").join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    per_class = written(per_class.select("cid", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    dropped(classes, links)
    out = keyed.select("vec_id", "cid").join(per_class, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
