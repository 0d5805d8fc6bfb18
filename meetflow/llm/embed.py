"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .graph import components, groups

#: Numbers of blocks to choose from; the one with the least to compare is taken.
BLOCKS = (4, 1)
#: Vectors of a cell compared in one task at once; a larger cell is split, and pairs of its parts meet.  Beyond 8 parts they grow,
#: as each part is sent once for each other, to 4 times as many vectors, if these have 16 MB at most as doubles.
PART_ROWS = 8192
#: Rows dealt at once: they are as many as the input's rows times the parts these meet.
DEALT_ROWS = 8192
TILE = (512, 4096)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column, dim: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(column) else np.float64).reshape(-1, dim)


def pack(batches, dim: int):
    """Vectors as bytes, floats as floats; those without a direction or with a part that isn't a finite number go."""
    for batch in batches:
        a = batch.column("v")
        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        flat = a.flatten().cast(pa.float64())
        x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
        ok = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
        x = x[ok]
        if pa.types.is_float32(a.type.value_type):
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]).astype(np.float32)  # by a power of two, so exact
        else:
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no square of a part overflows or vanishes
        rows = [r.tobytes() for r in x]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(batch.column(k).filter(pa.array(ok)) for k in ("c", "mult"))], ["vec", "c", "mult"])


def moments(batches, dim: int):
    """Sums of the vectors and of their products: one packed row a task, for one of 64 groups."""
    total = np.zeros(dim + dim * dim + 1)
    for batch in batches:
        if batch.num_rows:
            u = unit(matrix(batch.column("vec"), dim))
            total += np.concatenate([u.sum(axis=0), (u.T @ u).ravel(), [len(u)]])
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "x"])


def add_moments(batches):
    """The sums of each task's groups in one row."""
    total = None
    for batch in batches:
        for x in batch.column("x").to_pylist():
            total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])


class Plan:
    """The rotation, its blocks, and the share of the squared distance each may use."""

    def __init__(self, m: np.ndarray, dim: int, budget: float, blocks: int) -> None:
        n = max(m[-1], 1)
        mean = m[:dim] / n
        cov = m[dim:-1].reshape(dim, dim) / n - np.outer(mean, mean)
        value, vector = np.linalg.eigh((cov + cov.T) / 2)
        self.rotation = vector[:, ::-1]
        self.begin = np.unique(np.linspace(0, dim, min(blocks, dim) + 1).astype(int))
        energy = np.maximum(np.add.reduceat(value[::-1], self.begin[:-1]), 0) + 1e-9
        # a floor keeps cells of blocks without spread from being needlessly thin
        share = 0.9 * energy / energy.sum() + 0.1 / len(energy)
        self.budget = budget * share * (1 + 1e-9)
        self.width = np.sqrt(self.budget) * (1 + 1e-6) + 1e-9
        self.dim, self.parts = dim, {}

    def divide(self, rows: dict[tuple[int, int], int]) -> None:
        """Parts of cells (block, cell) with so many vectors."""
        grown = max(1, min(4, (16 << 20) // (8 * self.dim * PART_ROWS)))
        self.parts = {k: max(min(8, -(-n // PART_ROWS)), -(-n // (grown * PART_ROWS))) for k, n in rows.items()}

    def cost(self, rows: dict[tuple[int, int], int]) -> float:
        """Pairs in a cell or two next to each other, by their coordinates and some 20 more for looking at a pair."""
        size = np.diff(np.append(self.begin, self.dim)) + 20
        return sum((n / 2 + rows.get((j, cell + 1), 0)) * n * float(size[j]) for (j, cell), n in rows.items())

    def cells(self, rotated: np.ndarray) -> np.ndarray:
        return np.floor(rotated[:, self.begin[:-1]] / self.width).astype(np.int64)


def count_cells(batches, plans: list[Plan], dim: int):
    found: dict = {}
    for batch in batches:
        if batch.num_rows:
            rotated = unit(matrix(batch.column("vec"), dim)) @ plans[0].rotation
            for k, plan in enumerate(plans):
                cells = plan.cells(rotated)
                for j in range(cells.shape[1]):
                    for cell, n in zip(*np.unique(cells[:, j], return_counts=True)):
                        found[k, j, int(cell)] = found.get((k, j, int(cell)), 0) + int(n)
    keys = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
    yield pa.RecordBatch.from_arrays([*keys, pa.array(list(found.values()), pa.int64())], ["k", "j", "cell", "n"])


def deal(batches, plan: Plan, dim: int):
    """Each vector to every group of its cells: parts (p, q) of one cell, or part p of a cell and q of the next.  Given out some thousand rows at a time."""
    names = ["j", "cell", "p", "q", "side"]
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("c").to_numpy()
        cells = plan.cells(unit(matrix(batch.column("vec"), dim)) @ plan.rotation)
        spread = (c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

        def piece(todo, batch=batch):
            row, *key = (np.concatenate(x) for x in zip(*todo))
            return pa.RecordBatch.from_arrays([*map(pa.array, key), *(batch.column(k).take(pa.array(row)) for k in ("c", "mult", "vec"))], [*names, "c", "mult", "vec"])

        todo, n_todo = [], 0
        for at, *key in dealt_groups(cells, spread, plan):
            for x in range(0, len(at), DEALT_ROWS):
                part = slice(x, x + DEALT_ROWS)
                if n_todo + len(at[part]) > DEALT_ROWS:
                    yield piece(todo)
                    todo, n_todo = [], 0
                todo.append((at[part], *(k[part] for k in key)))
                n_todo += len(at[part])
        if todo:
            yield piece(todo)


def dealt_groups(cells: np.ndarray, spread: np.ndarray, plan: Plan):
    """(rows, j, cell, p, q, side) of the rows of one cell, for one part of it or of a cell next to it at a time."""
    for j in range(cells.shape[1]):
        for cell in np.unique(cells[:, j]).tolist():
            at = np.flatnonzero(cells[:, j] == cell)
            full = lambda x, n=len(at): np.full(n, x, np.int64)
            n = plan.parts[j, cell]
            part = (spread[at] % np.uint64(n)).astype(np.int64)
            for q in range(n):
                p, r = np.minimum(part, q), np.maximum(part, q)
                yield at, full(j), full(cell), p, r, np.where((p < r) & (part == r), 1, 0)
            for q in range(plan.parts.get((j, cell + 1), 0)):
                yield at, full(j), full(cell), part, full(-1 - q), full(0)
            for p in range(plan.parts.get((j, cell - 1), 0)):
                yield at, full(j), full(cell - 1), full(p), -1 - part, full(1)


def links(batches, plan: Plan, dim: int, least: float):
    """For each group: links counted for each vector (kind 0: a, weight) and spanning links (kind 1: a, b)."""
    for t, begin in groups(batches, ["j", "cell", "p", "q"]):
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for lo, hi in zip(begin[:-1], begin[1:]):
            part = t.slice(lo, hi - lo)
            j, q, p = (part.column(k)[0].as_py() for k in ("j", "q", "p"))
            side, c, mult = (part.column(k).to_numpy() for k in ("side", "c", "mult"))
            u = unit(matrix(part.column("vec"), dim))
            r = u @ plan.rotation if len(plan.begin) > 1 else u  # distances are the same without a rotation
            f = r[:, plan.begin[j] : np.append(plan.begin, dim)[j + 1]].astype(np.float32)
            square, one = (f * f).sum(axis=1)[:, None], np.ones((len(f), 1), np.float32)
            left, right = np.hstack([-2 * f, square, one]), np.hstack([f, one, square])  # their product is the squared distance
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same = q >= 0 and p == q
            b = a if same else b
            count = np.zeros(len(c), np.int64)
            for x in range(0, len(a), TILE[0]):
                for y in range(0, len(b), TILE[1]):
                    ta, tb = a[x : x + TILE[0]], b[y : y + TILE[1]]
                    if same and tb[-1] <= ta[0]:
                        continue
                    i, k = tile(left[ta] @ right[tb].T, r[ta], r[tb], u[ta], u[tb], plan, j, least)
                    if same:
                        keep = ta[i] < tb[k]
                        i, k = i[keep], k[keep]
                    if not len(i):
                        continue
                    i, k = ta[i], tb[k]
                    count += np.bincount(i, mult[k], len(c)).astype(np.int64) + np.bincount(k, mult[i], len(c)).astype(np.int64)
                    node, root = forest(i, k)
                    for o, v in zip(out, (np.ones(len(node), np.int64), c[node], c[root])):
                        o.append(v)
            full = np.flatnonzero(count)
            for o, v in zip(out, (np.zeros(len(full), np.int64), c[full], count[full])):
                o.append(v)
        kind, x, y = (np.concatenate(o) for o in out)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], ["kind", "a", "b"])


def tile(d, ra, rb, ua, ub, plan: Plan, j: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs whose first block within its budget is block j; ``d``: squared distances in it, in single precision."""
    near = d <= np.float32(plan.budget[j] + 1e-5)
    n = np.count_nonzero(near)
    if n * 20 < near.size:
        i, k = np.nonzero(near)
        d = np.add.reduceat((ra[i] - rb[k]) ** 2, plan.begin[:-1], axis=1) <= plan.budget
        ok = d[:, j] & ~d[:, :j].any(axis=1)
        i, k = i[ok], k[ok]
        ok = np.einsum("ij,ij->i", ua[i], ub[k]) >= least
        return i[ok], k[ok]
    for x in range(j + 1):
        s = slice(plan.begin[x], plan.begin[x + 1])
        d = (ra[:, s] ** 2).sum(axis=1)[:, None] + (rb[:, s] ** 2).sum(axis=1)[None, :] - 2 * (ra[:, s] @ rb[:, s].T)
        near &= (d <= plan.budget[x]) == (x == j)
    return np.nonzero(near & (ua @ ub.T >= least))


def forest(i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the smallest of their component, and the smallest."""
    node, code = np.unique(np.concatenate([i, k]), return_inverse=True)
    a, b = code[: len(i)], code[len(i) :]
    both = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(both[0], kind="stable")
    to = both[1][order]
    begin = np.searchsorted(both[0][order], np.arange(len(node)))
    label = np.arange(len(node))
    while True:
        new = np.minimum(label, np.minimum.reduceat(label[to], begin))
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(node)))
    return node[far], node[label[far]]


def near_vectors(vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links of vectors with a cosine of at least ``least``, counted, and their components.

    Equal arrays are one class that counts for all its rows.  Unit vectors are
    rotated to the principal axes of all rows and split into 4 blocks, or kept as one where that
    leaves less to compare; each block gets a share of the squared distance 2 - 2*least, proportional to its variance, and
    vectors at most that far apart overall are within the share in some block.
    Each block is range-joined on cells of its first coordinate, as wide as the
    block's radius, so partners are in the same cell or the next; pairs within the
    block's budget are candidates, and the first block that has a pair verifies its
    cosine in double precision.  Cells are split into parts of about 8,000 rows (32,000, if there are many).
    Tasks give out sums for each vector and spanning links, never all pairs.
    The driver holds the rotation and the counts of cells (at most a few hundred).
    Without structure in the data the cells rule out few pairs and work grows
    with the square of the rows.

    Returns id, n_links, component_id (smallest id reachable) and kept.  Null,
    zero and non-finite vectors, and those with a null inside, link with nothing;
    only vectors of equal length are compared; repeated ids are rows of their own;
    null ids name no component; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("v"))
    key = [F.xxhash64("v").alias("c"), F.xxhash64(F.lit(11), F.col("v"), F.size("v")).alias("c2")]
    some = src.where("v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    classes = cut(some.groupBy(*key).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("mult"), F.min("_id").alias("rep")))
    found = None
    for dim in sorted(r["d"] for r in classes.groupBy(F.size("v").alias("d")).count().collect()):
        rows = cut(classes.where(F.size("v") == dim).select("v", "c", "mult").mapInArrow(lambda it, dim=dim: pack(it, dim), "vec binary, c long, mult long"))
        m = rows.mapInArrow(lambda it, dim=dim: moments(it, dim), "g int, x binary").repartition(64, "g").mapInArrow(add_moments, "x binary").collect()
        total = np.sum([np.zeros(dim + dim * dim + 1), *(np.frombuffer(r["x"]) for r in m)], axis=0)  # at most 64 rows
        plans = [Plan(total, dim, 2 - 2 * least, k) for k in BLOCKS]
        counts = rows.mapInArrow(lambda it, plans=plans, dim=dim: count_cells(it, plans, dim), "k long, j long, cell long, n long")
        counted = [{} for _ in plans]
        for r in counts.groupBy("k", "j", "cell").agg(F.sum("n").alias("n")).collect():
            counted[r["k"]][r["j"], r["cell"]] = r["n"]
        plan, counted = min(zip(plans, counted), key=lambda x: x[0].cost(x[1]))
        plan.divide(counted)
        dealt = rows.mapInArrow(lambda it, plan=plan, dim=dim: deal(it, plan, dim), "j long, cell long, p long, q long, side long, c long, mult long, vec binary")
        dealt = dealt.repartition("j", "cell", "p", "q").sortWithinPartitions("j", "cell", "p", "q")
        part = dealt.mapInArrow(lambda it, plan=plan, dim=dim: links(it, plan, dim, least), "kind long, a long, b long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "kind long, a long, b long")
    found = cut(found)
    sums = found.where("kind = 0").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("n"))
    comp = components(found.where("kind = 1").select("a", "b")).select(F.col("v").alias("c"), "comp")
    comp = comp.join(classes.select("c", "rep"), "c")
    least = cut(comp.groupBy("comp").agg(F.min("rep").alias("least")))  # joined by a key that a large component shares
    comp = comp.join(least, "comp").select("c", "least")
    named = classes.select("c", "c2", "mult", "rep", _usable("v").alias("ok")).join(sums, "c", "left").join(comp, "c", "left").select(
        "c", "c2", F.when(F.col("ok"), F.coalesce("n", F.lit(0)) + F.col("mult") - 1).otherwise(0).alias("n_links"),
        F.when(F.col("ok"), F.coalesce("least", "rep")).alias("component_id"))
    out = src.select("_id", *key).join(named, ["c", "c2"], "left")
    comp_id = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("_id") == comp_id, comp_id.isNull()).alias("kept"))


def _usable(v: str):
    return F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
