"""All pairs of vectors above a cosine, by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c.  A rotation spreads
that distance over low-dimensional blocks; if a pair is near enough in the whole
space, then in at least one block it uses no more than that block's share.
Blocks are range-joined one by one, and the union of what they find is verified
on the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import keep
from accordant.llm.components import components
from accordant.llm.topk import usable

FOUND = "rep long, links long, root long"
TILE = 1024
AT_ONCE = 32_768
SLACK = 1e-6  # relative; covers rounding of squared distances
SINGLE = 1e-5  # absolute; covers single precision in the first comparison


class Subspaces(NamedTuple):
    """A rotation whose columns are dealt into blocks, and each block's share."""

    rotation: np.ndarray
    starts: tuple[int, ...]  # where each block begins; the last one is the end
    shares: tuple[float, ...]  # squared distance a pair may use up there
    widths: tuple[float, ...]  # of the cells that the range join works on

    @classmethod
    def fit(cls, sample: np.ndarray, blocks: int, total: float, cell_factor: float) -> "Subspaces":
        """Main axes of a sample, dealt out in turn so that all blocks spread alike.

        Any rotation gives the same result; a fitted one makes cells sparser.
        """
        dim = sample.shape[1]
        _, axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim) if len(sample) > 1 else np.eye(dim))
        axes = axes[:, ::-1]
        order = [list(range(b, dim, blocks)) for b in range(min(blocks, dim))]
        starts = np.cumsum([0, *map(len, order)])
        shares = [total * len(o) / dim for o in order]
        return cls(axes[:, sum(order, [])], tuple(starts.tolist()), tuple(shares), tuple(cell_factor * math.sqrt(s) for s in shares))

    @property
    def count(self) -> int:
        return len(self.shares)

    def cells(self, turned: np.ndarray, block: int, axes: int) -> np.ndarray:
        part = turned[:, self.starts[block] : self.starts[block + 1]][:, :axes]
        return np.floor(part / self.widths[block]).astype(np.int64)

    def used(self, difference: np.ndarray) -> np.ndarray:
        """Squared distance in each block, one row per pair."""
        return np.stack([np.square(difference[:, a:b]).sum(1) for a, b in zip(self.starts, self.starts[1:])], 1)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    largest = np.abs(vectors).max(1, initial=0)
    scaled = vectors / largest[:, None]  # so that squares neither overflow nor vanish
    return scaled, scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _neighbours(turned: np.ndarray, space: Subspaces, block: int, axes: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, at home): each row's own cell, and earlier cells within reach."""
    home = space.cells(turned, block, axes)
    yield np.arange(len(home)), home, True
    part = turned[:, space.starts[block] : space.starts[block + 1]][:, :axes]
    inside = part - home * space.widths[block]
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * home.shape[1], indexing="ij"), -1).reshape(-1, home.shape[1])
    reach = space.shares[block] * (1 + SLACK)
    for step in steps:
        if tuple(step) >= (0,) * len(step):
            continue  # the later cell of a pair visits the earlier one
        gap = np.where(step < 0, inside, np.where(step > 0, space.widths[block] - inside, 0))
        rows = np.flatnonzero(np.square(gap).sum(1) <= reach + 1e-12)
        if len(rows):
            yield rows, home[rows] + step, False


def _cell_names(block: int, cells: np.ndarray) -> list[str]:
    return [f"{block}:" + ",".join(map(str, c)) for c in cells.tolist()]


class Forest:
    """Union by smallest index over arrays of pairs."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _link(space: Subspaces, block: int, threshold: float, vectors: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, Forest]:
    """Verified links between two sets of rows: weights linked to each row, and a forest.

    A pair that an earlier block finds as well is left to that block.
    """
    scaled, unit = _units(vectors)
    turned = unit @ space.rotation
    a, b = space.starts[block], space.starts[block + 1]
    part = turned[:, a:b]
    # One product of these gives minus half the squared distance in the block.
    half, ones = np.square(part).sum(1, keepdims=True) / -2, np.ones((len(part), 1))
    ahead = np.concatenate([part, ones, half], 1).astype(np.float32)
    behind = np.concatenate([part, half, ones], 1).astype(np.float32)
    norm = np.linalg.norm(scaled, axis=1)
    share = np.array(space.shares) * (1 + SLACK)
    links, forest = np.zeros(len(vectors), np.int64), Forest(len(vectors))
    same = left is right
    for i in range(0, len(left), TILE):
        rows = left[i : i + TILE]
        for j in range(i if same else 0, len(right), TILE):
            cols = right[j : j + TILE]
            x, y = np.divmod(np.flatnonzero(ahead[rows] @ behind[cols].T >= share[block] / -2 - SINGLE), len(cols))
            x, y = rows[x], cols[y]
            if same and i == j:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), AT_ONCE):
                p, q = x[at : at + AT_ONCE], y[at : at + AT_ONCE]
                used = space.used(turned[p] - turned[q]) <= share
                first = used[:, block] & ~used[:, :block].any(1)
                p, q = p[first], q[first]
                cosine = np.einsum("ij,ij->i", scaled[p], scaled[q]) / (norm[p] * norm[q])
                p, q = p[cosine >= threshold], q[cosine >= threshold]
                links += np.bincount(p, weight[q], len(links)).astype(np.int64) + np.bincount(q, weight[p], len(links)).astype(np.int64)
                forest.join(p, q)
    return links, forest


def _class_links(reps: DataFrame, threshold: float, blocks: int, axes: int, cell_factor: float, sample_rows: int, chunk: int) -> DataFrame:
    """Rows ``rep, links, root`` over classes of one length; a class may have several."""
    dim = reps.first()["dim"]
    sample = reps.orderBy(F.xxhash64("rep")).limit(sample_rows).select("vector").toArrow()["vector"]
    space = Subspaces.fit(_units(_matrix(sample, dim))[1], blocks, 2 - 2 * threshold, cell_factor)

    def own_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _units(_matrix(batch["vector"], dim))[1] @ space.rotation
            for block in range(space.count):
                yield pa.RecordBatch.from_arrays([pa.array(_cell_names(block, space.cells(turned, block, axes)))], names=["cell"])

    # Unit vectors lie in [-1, 1], so the cells are few: (2 / width + 2) ** axes per block.
    counted = reps.select("vector").mapInArrow(own_cells, "cell string").groupBy("cell").count().collect()
    parts = {r["cell"]: math.ceil(r["count"] / chunk) for r in counted}

    def to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deal rows to units: a part of a cell with a part of it or of its visitors."""
        for batch in batches:
            turned = _units(_matrix(batch["vector"], dim))[1] @ space.rotation
            mixed = batch["mixed"].to_numpy()
            for block in range(space.count):
                home_names = _cell_names(block, space.cells(turned, block, axes))
                for rows, cells, at_home in _neighbours(turned, space, block, axes):
                    picked, units, sides = [], [], []
                    for row, cell in zip(rows.tolist(), _cell_names(block, cells)):
                        n = parts.get(cell, 0)
                        if at_home:
                            own = int(mixed[row] % n)
                            # Part i meets part j >= i of its cell, and every visiting part.
                            for other in range(n):
                                low, high = min(own, other), max(own, other)
                                picked.append(row), units.append(f"{cell}|{low}|{cell}|{high}"), sides.append(own > low)
                            for visitor, m in visitors.get(cell, ()):
                                for other in range(m):
                                    picked.append(row), units.append(f"{cell}|{own}|{visitor}|{other}"), sides.append(False)
                        elif n:
                            home = home_names[row]
                            own = int(mixed[row] % parts[home])
                            for other in range(n):
                                picked.append(row), units.append(f"{cell}|{other}|{home}|{own}"), sides.append(True)
                    if picked:
                        part = batch.take(pa.array(picked))
                        yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(sides), part["rep"], part["m"], part["vector"]], names=["unit", "visits", "rep", "m", "vector"])

    visitors: dict[str, list[tuple[str, int]]] = {}
    for cell, m in parts.items():
        block, place = cell.split(":")
        place = np.array(place.split(","), np.int64)
        for step in np.stack(np.meshgrid(*[[-1, 0, 1]] * len(place), indexing="ij"), -1).reshape(-1, len(place)):
            if tuple(step) < (0,) * len(step):
                earlier = _cell_names(int(block), (place + step)[None])[0]
                if earlier in parts:
                    visitors.setdefault(earlier, []).append((cell, m))

    def join_unit(unit: pa.Table) -> pa.Table:
        vectors = _matrix(unit["vector"], dim)
        reps_, weight = unit["rep"].to_numpy(), unit["m"].to_numpy()
        visits = unit["visits"].to_numpy(zero_copy_only=False)
        name = unit["unit"][0].as_py()
        cell, low, other, high = name.split("|")
        order = np.argsort(reps_, kind="stable")  # roots are then smallest ids
        vectors, reps_, weight, visits = vectors[order], reps_[order], weight[order], visits[order]
        every = np.arange(len(vectors))
        within = cell == other and low == high
        left, right = (every, every) if within else (every[~visits], every[visits])
        links, forest = _link(space, int(cell.split(":")[0]), threshold, vectors, weight, left, right)
        has = links > 0
        return pa.table({"rep": reps_[has], "links": links[has], "root": reps_[forest.root[has]]})

    schema = "unit string, visits boolean, rep long, m long, vector " + dict(reps.dtypes)["vector"]
    dealt = reps.select("rep", "m", "mixed", "vector").mapInArrow(to_units, schema)
    return dealt.groupBy("unit").applyInArrow(join_unit, FOUND)


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    blocks: int = 4,
    axes: int = 2,
    cell_factor: float = 2.0,
    sample_rows: int = 4096,
    chunk: int = 8192,
) -> DataFrame:
    """Each vector's number of links, component and whether it is kept.

    Links are pairs of rows with cosine >= ``threshold`` in double precision,
    all of them.  Equal vectors form one class before anything is joined; links
    of a class count its copies.  A row without a usable vector (null, zero, or
    holding a null or non-finite number) has no link and is its own component;
    vectors of different lengths have none with each other.  A row with a null
    id stays, with a null component, and takes no part.  Extra columns are left
    out.

    Each block range-joins on cells over its first ``axes`` axes; a cell is
    ``cell_factor`` times the reach wide, and a row visits those earlier cells it
    can reach into.  Cells beyond ``chunk`` rows are split, and every part meets
    every part, so no task holds more than two of them.  ``sample_rows`` bounds
    the sample that the rotation is fitted on; results don't depend on it.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    can = usable(F.col("vector")) & F.col("vec_id").isNotNull() & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    good = clean.where(can)
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    # The mix decides parts of a cell; it is no id, so ids in sequence don't matter.
    classes = keep(classes.withColumn("dim", F.size("vector")).withColumn("mixed", F.pmod(F.xxhash64("rep"), F.lit(1 << 31))), "classes")
    linked = None
    for row in classes.select("dim").distinct().collect():
        part = _class_links(classes.where(F.col("dim") == row["dim"]), threshold, blocks, axes, cell_factor, sample_rows, chunk)
        linked = part if linked is None else linked.union(part)
    if linked is None:
        own = F.col("vec_id")
        return clean.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), own.isNotNull().alias("kept"))
    linked = keep(linked, "links")
    roots = components(linked, "rep", "root").withColumnRenamed("id", "rep")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("vector", "rep", "m").join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    found = good.join(known, "vector").select("vec_id", "n_links", "component_id")
    rest = clean.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
