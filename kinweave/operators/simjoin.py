"""Exact joins of vectors by Euclidean distance, and reductions over all pairs of groups.

Vectors are dealt to cells around pivots; a cell has a centre and a radius. Two cells can hold a pair
within a distance only if their centres are no farther apart than that plus both radii; only such
pairs of cells are computed, each as blocks in numpy. Cells beyond a size are cut. There are at most CELLS cells, whose centres all tasks
hold; beyond, blocks grow with the data and are compared in pieces. The vectors are written once to the shared folder, in chunks of whole blocks (as rough ones, of
half the size, where only links are asked for); a task
reads the two chunks that it compares, so no vector is sent once for each block that it meets. Clustered data skip most of the work; data
without structure keep all blocks, which no exact method avoids: their time grows with the square, the disk with the vectors.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, read_folder, shuffles_dropped, write_table

BLOCK = 1024
#: Vectors of a chunk at most, unless a block alone has more.
CHUNK = 16_384
#: Vectors of the right side that a block is compared with at once.
WIDTH = 2048
#: Cells at most; their centres take CELLS times the vectors' length times 8 bytes.
CELLS = 16_384
#: Vectors that are counted at least to estimate the sizes of cells, and files up to which tasks write chunks without a shuffle.
COUNTED, FILES = 1 << 16, 1 << 14


class Cells:
    """Centres, radii and numbers of blocks of the cells that hold vectors, and the vectors with their cell and block.

    rough: what is written of a vector are the differences from its centre, as four-byte multiples of a step of its own, which is
    half of the disk. Each side then tells how far its vectors may be from the true ones. Vectors that aren't finite, which no distance is within, are left out.
    """

    def __init__(self, vectors: DataFrame, block: int, rough: bool = False):
        with shuffles_dropped(vectors.sparkSession):
            self._deal(vectors, block, rough)

    def _deal(self, vectors: DataFrame, block: int, rough: bool) -> None:
        spark, n = vectors.sparkSession, vectors.count()
        self.rough = rough
        self.block = max(block, -(-n // CELLS))
        share = min(1.0, -(-n // self.block) / max(n, 1))
        bar = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
        rows = vectors.where(F.xxhash64("idx") <= bar).orderBy("idx").select("v").collect() if n else []  # about one vector for each block
        pivots = np.array([r["v"] for r in rows or vectors.limit(1).select("v").collect()], dtype=float)
        if len(pivots):  # one that isn't finite would draw all vectors to it
            finite = pivots[np.isfinite(pivots).all(1)]
            pivots = finite if len(finite) else np.zeros((1, pivots.shape[1]))
        # a vector's pivot is looked for among those of its nearest head, which needs not be exact
        heads = pivots[: int(np.ceil(np.sqrt(len(pivots))))] if len(pivots) else pivots
        under = _nearest(pivots, heads) if len(pivots) else np.empty(0, dtype=int)
        held = spark.sparkContext.broadcast((pivots, heads, [np.flatnonzero(under == h) for h in range(len(heads))]))

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
            """Rows, their cells, how far they are from its centre, and in which direction."""
            own, first, below = held.value
            for pdf in frames:
                x = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), -1)
                if rough and not (finite := np.isfinite(x).all(1)).all():
                    pdf, x = pdf[finite], x[finite]
                if not len(x):
                    continue
                cell = np.empty(len(x), dtype=np.int32)
                head = _nearest(x, first)
                for h in np.unique(head):
                    rows = np.flatnonzero(head == h)
                    cell[rows] = below[h][_nearest(x[rows], own[below[h]])]
                apart = x - own[cell]
                yield pdf, cell, np.sqrt((apart**2).sum(1)), apart

        kinds = ", ".join(f"`{f.name}` {'array<int>' if rough and f.name == 'v' else f.dataType.simpleString()}" for f in vectors.schema)
        kinds += ", step double" if rough else ""
        # how many vectors a cell has is only estimated, from those of a second hash; it decides where cells are cut, not what is compared
        part = min(1.0, max(1 / 16, COUNTED / max(n, 1)))
        counted = vectors.where(F.xxhash64("idx", F.lit(1)) <= min((1 << 63) - 1, -(1 << 63) + int(part * (1 << 64)))).select("v")
        seen = dict(counted.mapInPandas(lambda frames: (pd.DataFrame({"cell": cell}) for _, cell, _, _ in near(frames)), "cell int").groupBy("cell").count().collect()) if n else {}  # CELLS rows at most
        self.names = np.lexsort((np.arange(len(pivots)), under)) if len(pivots) else np.empty(0, dtype=np.int64)  # cells under one head are near each other
        self.centres = pivots[self.names] if len(pivots) else pivots
        likely = np.array([max(1, round(seen.get(c, 0) / part)) for c in self.names.tolist()], dtype=np.int64)
        cuts = -(-likely // self.block)
        # units are the cuts of cells, in order; chunks hold whole units
        self.cell = np.repeat(np.arange(len(cuts)), cuts)
        sizes = np.repeat(likely / cuts, cuts) if len(cuts) else np.empty(0)
        size = max(self.block, min(CHUNK, n // 32))
        self.chunk = np.unique((np.cumsum(sizes) - sizes).astype(np.int64) // size, return_inverse=True)[1]
        firsts = np.cumsum(cuts) - cuts
        place = np.argsort(self.names)  # where a pivot's cell stands
        deal = spark.sparkContext.broadcast((firsts[place], cuts[place], self.chunk))

        def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first, many, chunk = deal.value
            for pdf, cell, gap, apart in near(frames):
                unit = first[cell] + pdf["__turn"].to_numpy() % many[cell]
                if rough:
                    steps, step = _stepped(apart)
                    pdf = pdf.assign(v=list(steps), step=step)
                yield pdf.drop(columns="__turn").assign(cell=cell, gap=gap, unit=unit.astype(np.int32), chunk=chunk[unit].astype(np.int32))

        self.path = fresh_path(spark, "chunks")
        self.radii, self.held = np.zeros(len(cuts)), np.zeros(len(self.cell), dtype=bool)
        self.vectors = vectors.select("idx", F.lit(0).alias("cell")).limit(0)
        if n:
            rows = vectors.withColumn("__turn", F.xxhash64("idx")).mapInPandas(dealt, f"{kinds}, cell int, gap double, unit int, chunk int")
            chunks, parts = int(self.chunk[-1]) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
            if chunks * parts > FILES:  # else each task writes its part of each chunk, so that the disk holds the vectors once
                rows = rows.repartition(min(chunks, parts), "chunk")
            rows.write.partitionBy("chunk").parquet(self.path)
            self.vectors = spark.read.schema("idx long, cell int, gap double, unit int").parquet(self.path)
            for r in self.vectors.groupBy("unit").agg(F.max("gap").alias("radius")).collect():  # of each unit that holds vectors
                c = self.cell[r["unit"]]
                self.held[r["unit"]], self.radii[c] = True, np.maximum(self.radii[c], r["radius"])
        self.told = spark.sparkContext.broadcast((self.cell, self.centres, self.radii))

    def meeting(self, within: float | np.ndarray | None, alone: bool) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function that tells, for arrays of units, which of their pairs can hold pairs of vectors that matter. alone: only within a cell.

        within: how near they must be, for all or for each cell, of which the greater of both counts; None: always.
        """
        held = self.told

        def meet(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            cell, centres, radii = held.value
            a, b = cell[left], cell[right]
            if alone:
                return a[:, None] == b
            if within is None:
                return np.ones((len(a), len(b)), dtype=bool)
            bound = np.maximum(within[a][:, None], within[b]) if isinstance(within, np.ndarray) else within
            x, y = centres[a], centres[b]
            far = np.stack([np.sqrt(((y - c) ** 2).sum(1)) for c in x]) if len(x) else np.empty((0, len(y)))
            return ~(far > radii[a][:, None] + radii[b] + bound + 1e-9)  # a cell with a vector of no number meets all

        return meet


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points**2).sum(1) - 2 * x @ points.T).argmin(1)


def _stepped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as whole multiples of its step, which is infinite where the row overflowed."""
    step = np.abs(x).max(1, initial=0.0) / (2**31 - 1)
    some = (step > 0) & np.isfinite(step)
    return np.rint(np.where(some[:, None], x, 0.0) / np.where(some, step, 1.0)[:, None]).astype(np.int32), step


@dataclasses.dataclass
class Side:
    """Vectors of one side of a block: their idx, v and, where given, group; of rough ones, how far they may be from the true ones."""

    idx: np.ndarray
    v: np.ndarray
    g: np.ndarray | None
    off: np.ndarray | None = None

    def at(self, rows) -> Side:
        return Side(self.idx[rows], self.v[rows], None if self.g is None else self.g[rows], None if self.off is None else self.off[rows])


Reduce = Callable[[Side, Side, bool], pd.DataFrame]


def pair_blocks(cells: Cells, reduce: Reduce, schema: str, within: float | np.ndarray | None = None, alone: bool = False, fold: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Apply reduce to each pair of blocks that can hold pairs within a distance (None: all pairs).

    reduce gets both sides and whether they are one block, of which it uses the upper triangle. within may be an array of a
    bound for each cell, of which the greater of both counts. Vectors have idx (integer), v (array of double) and g, a group, if reduce needs one.
    fold makes fewer rows of those that were found so far in two chunks.
    """
    told, rough = cells.told, cells.rough
    spark, path, meet, block = cells.vectors.sparkSession, cells.path, cells.meeting(within, alone), cells.block
    filled = cells.held
    chunks, bounds = (int(cells.chunk[-1]) + 1 if len(cells.chunk) else 0), np.searchsorted(cells.chunk, np.arange(len(cells.chunk) + 1))

    def load(chunk: int) -> tuple[Side, np.ndarray, np.ndarray]:
        """The chunk's vectors by unit and idx; its units and where each begins."""
        rows = read_folder(f"{path}/chunk={chunk}")
        unit, idx = (rows[c].to_numpy() for c in ("unit", "idx"))
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(idx), -1)
        off = None
        if rough:
            cell, centres, _ = told.value
            step = rows["step"].to_numpy()
            v = v * np.where(np.isfinite(step), step, 0.0)[:, None] + centres[cell[unit]]
            off = np.sqrt(v.shape[1]) * (0.6 * step + 2.0**-50 * (np.abs(v).max(1, initial=0.0) + step * 2**31))
        order = np.lexsort((idx, unit))
        units, starts = np.unique(unit[order], return_index=True)
        side = Side(idx, v, rows["g"].to_pandas().to_numpy() if "g" in rows.column_names else None, off).at(order)
        return side, units, np.append(starts, len(idx))

    def compare(p: tuple, q: tuple, one: bool) -> Iterator[pd.DataFrame]:
        (left, units, starts), (right, others, begins) = p, q
        near = meet(units, others)
        for k in range(len(units)):
            ahead = np.flatnonzero(near[k] & (others > units[k])) if one else np.flatnonzero(near[k])
            rows = np.concatenate([np.arange(begins[j], begins[j + 1]) for j in ahead]) if len(ahead) else np.empty(0, dtype=int)
            for lo in range(starts[k], starts[k + 1], BLOCK):
                hi = min(lo + BLOCK, starts[k + 1])
                own = left.at(slice(lo, hi))
                if one and near[k, k]:
                    yield reduce(own, own, True)
                    for at in range(hi, starts[k + 1], WIDTH):
                        yield reduce(own, left.at(slice(at, min(at + WIDTH, starts[k + 1]))), False)
                for at in range(0, len(rows), WIDTH):
                    yield reduce(own, right.at(rows[at : at + WIDTH]), False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple] = {}
        for pdf in frames:
            for task in pdf["id"].tolist():
                # pairs of chunks row by row of the upper triangle
                i = int((2 * chunks + 1 - np.sqrt((2 * chunks + 1) ** 2 - 8 * task)) // 2)
                while i * (2 * chunks - i + 1) // 2 > task:
                    i -= 1
                while (i + 1) * (2 * chunks - i) // 2 <= task:
                    i += 1
                j = i + task - i * (2 * chunks - i + 1) // 2
                if not meet(*(bounds[c] + np.flatnonzero(filled[bounds[c] : bounds[c + 1]]) for c in (i, j))).any():
                    continue
                kept = {c: kept[c] if c in kept else load(c) for c in (i, j)}
                out, held = [], 0
                for found in compare(kept[i], kept[j], i == j):
                    if len(found):
                        out.append(found)
                        held += len(found)
                    if held > 100_000 and fold:
                        out = [fold(pd.concat(out))]
                        held = len(out[0])
                    if held > 100_000:
                        yield pd.concat(out)
                        out, held = [], 0
                if out:
                    yield fold(pd.concat(out)) if fold else pd.concat(out)

    tasks = chunks * (chunks + 1) // 2
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, tasks, 1, max(1, min(tasks, max(4 * few, tasks // 8)))).mapInPandas(run, schema)


def exact_distance(left: Side, right: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.sqrt(((left.v[i] - right.v[j]) ** 2).sum(1))


def close(left: Side, right: Side, alone: bool, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the distance, and of some that are farther by no more than rounding.

    Squares come from one product, in four-byte numbers where their rounding is small against the bound; the bar is raised by what rounding can make of them.
    """
    x, y = left.v, right.v
    most = max(np.abs(x).max(), np.abs(y).max(), 0.0)
    centre = x.mean(0)
    x, y = x - centre, y - centre
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    reach, n = np.sqrt(xx.max()) + np.sqrt(yy.max()), x.shape[1]
    kind, unit = np.float32, 2.0**-24
    if not 8 * (n + 8) * unit * reach**2 <= 0.05 * within**2 or reach > 1e15:
        kind, unit = np.float64, 2.0**-53
    bar = within**2 + 8 * (n + 8) * unit * reach**2 + 16 * np.sqrt(n) * 2.0**-53 * most * reach
    a, b = np.empty((len(x), n + 2), dtype=kind), np.empty((len(y), n + 2), dtype=kind)
    a[:, :n], a[:, n], a[:, n + 1] = -2 * x, xx, 1
    b[:, :n], b[:, n], b[:, n + 1] = y, 1, yy
    squares = a @ b.T
    hits = np.flatnonzero(~(squares > kind(bar)))
    i, j = np.divmod(hits, len(y))
    if alone:
        i, j = i[i < j], j[i < j]
    return i, j


def similarity_join(vectors: DataFrame, within: float, block: int = BLOCK, links: bool = False) -> DataFrame:
    """a, b, d: all pairs with distance `within` or less, a < b. vectors: idx, v. links: only a, b of some of the pairs, which join all that the pairs join."""
    if links:
        return _links(vectors.select(F.col("idx").cast("long"), "v"), within, block)

    def reduce(left, right, alone):
        i, j = close(left, right, alone, within)
        d = np.concatenate([exact_distance(left, right, i[lo : lo + 65536], j[lo : lo + 65536]) for lo in range(0, len(i), 65536)]) if len(i) else np.empty(0)
        keep = d <= within
        a, b = left.idx[i[keep]], right.idx[j[keep]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d[keep]})

    return pair_blocks(Cells(vectors.select(F.col("idx").cast("long"), "v"), block), reduce, "a long, b long, d double", within)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links a-b that join all that the links join, without a circle."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root, kept, left = np.arange(len(names)), [], np.arange(len(a))
    while len(left):
        p, q = root[i[left]], root[j[left]]
        left, p, q = left[p != q], p[p != q], q[p != q]
        high, low = np.maximum(p, q), np.minimum(p, q)
        order = np.lexsort((low, high))
        heads, first = np.unique(high[order], return_index=True)
        first = order[first]  # each root hangs under the least that it meets
        root[heads] = low[first]
        kept.append(left[first])
        while not np.array_equal(up := root[root], root):
            root = up
    return np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)


def _links(vectors: DataFrame, within: float, block: int) -> DataFrame:
    """a, b: of the pairs that are found in two chunks, no more than join what they join.

    Vectors are compared as rough ones; pairs so near the bound that these can't tell are looked at once more with the true ones.
    """

    def reduce(left, right, alone):
        grain = (left.v.shape[1] + 4) * 2.0**-52 * within
        i, j = close(left, right, alone, within + left.off.max() + right.off.max() + grain)
        d = np.concatenate([exact_distance(left, right, i[lo : lo + 65536], j[lo : lo + 65536]) for lo in range(0, len(i), 65536)]) if len(i) else np.empty(0)
        off = left.off[i] + right.off[j] + grain
        sure = d + off <= within
        keep = sure | ~(np.minimum(d, 1e154) - off > within)  # beyond, squares overflow
        found = pd.DataFrame({"a": left.idx[i[keep]], "b": right.idx[j[keep]], "sure": sure[keep]})
        return fold(found) if len(found) > len(left.idx) + len(right.idx) else found

    def fold(found):
        a, b, sure = (found[c].to_numpy() for c in ("a", "b", "sure"))
        tree = np.flatnonzero(sure)[spanning(a[sure], b[sure])]
        return found.iloc[np.concatenate([tree, np.flatnonzero(~sure)])]

    cells = Cells(vectors, block, rough=True)
    found = write_table(pair_blocks(cells, reduce, "a long, b long, sure boolean", within, fold=fold), "near-links")
    links, doubtful = found.where("sure").select("a", "b"), found.where("not sure").select("a", "b")
    if doubtful.isEmpty():
        return links

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x, y = (np.array(pdf[c].tolist(), dtype=float).reshape(len(pdf), -1) for c in ("va", "vb"))
                yield pdf.loc[np.sqrt(((x - y) ** 2).sum(1)) <= within, ["a", "b"]]

    ends = doubtful.select(F.col("a").alias("idx")).unionByName(doubtful.select(F.col("b").alias("idx"))).distinct()
    with shuffles_dropped(vectors.sparkSession):
        true = write_table(vectors.join(ends, "idx"), "true-vectors")
    both = doubtful.join(true.select(F.col("idx").alias("a"), F.col("v").alias("va")), "a").join(true.select(F.col("idx").alias("b"), F.col("v").alias("vb")), "b")
    return links.unionByName(both.mapInPandas(look, "a long, b long"))


def group_pair_stats(vectors: DataFrame, group_col: str, block: int = BLOCK) -> DataFrame:
    """ga, gb, n, total, least, most: over the distances of all pairs between and within groups, ga <= gb.

    Blocks are summed where they are computed, so no pair leaves its task.
    """
    kind = dict(vectors.dtypes)[group_col]

    def reduce(left, right, alone):
        ga, gb = left.g, right.g
        names = np.unique(np.concatenate([ga, gb]))
        out = []
        upper = np.ones((len(ga), len(gb)), dtype=bool)
        if alone:
            upper = np.triu(upper, 1)
        for p in names:
            for q in names:
                rows, cols = np.flatnonzero(ga == p), np.flatnonzero(gb == q)
                if not len(rows) or not len(cols):
                    continue
                i, j = np.nonzero(upper[np.ix_(rows, cols)])
                if not len(i):
                    continue
                # from differences, since the products that give `gaps` cancel
                d = np.concatenate([exact_distance(left, right, rows[i[lo : lo + 65536]], cols[j[lo : lo + 65536]]) for lo in range(0, len(i), 65536)])
                out.append((min(p, q), max(p, q), len(d), d.sum(), d.min(), d.max()))
        return pd.DataFrame(out, columns=["ga", "gb", "n", "total", "least", "most"])

    cells = Cells(vectors.select(F.col("idx").cast("long"), "v", F.col(group_col).alias("g")), block)
    parts = pair_blocks(cells, reduce, f"ga {kind}, gb {kind}, n long, total double, least double, most double")
    return parts.groupBy("ga", "gb").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def nearest_other_group(vectors: DataFrame, group_col: str, block: int = BLOCK) -> DataFrame:
    """idx, nearest, d: for each vector the nearest one of another group; ties go to the smaller idx.

    Cells are first joined with themselves. What a cell's vectors found there bounds how far it has to look; a cell with a vector that found nothing looks everywhere.
    """
    kind = dict(vectors.dtypes)[group_col]

    def reduce(left, right, alone):
        out = []
        x, y = left.v, right.v
        gaps = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))
        for a, b, g in ((left, right, gaps), (right, left, gaps.T)):
            ga, gb, ib = a.g, b.g, b.idx
            masked = np.where(ga[:, None] == gb[None, :], np.inf, g)
            for i in np.flatnonzero(np.isfinite(masked.min(1))):
                near = np.flatnonzero(masked[i] <= masked[i].min() + 1e-6)
                d = exact_distance(a, b, np.full(len(near), i), near)
                best = np.lexsort((ib[near], d))[0]
                out.append((int(a.idx[i]), int(ib[near[best]]), float(d[best])))
            if alone:
                break
        return pd.DataFrame(out, columns=["idx", "nearest", "d"])

    cells = Cells(vectors.select(F.col("idx").cast("long"), "v", F.col(group_col).cast(kind).alias("g")), block)
    found = "idx long, nearest long, d double"
    own = write_table(pair_blocks(cells, reduce, found, alone=True), "nearest-within")
    far = cells.vectors.select("idx", "cell").join(own.groupBy("idx").agg(F.min("d").alias("d")), "idx", "left")
    bounds = dict(far.groupBy("cell").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("far")).collect())  # CELLS rows at most
    parts = pair_blocks(cells, reduce, found, np.array([bounds.get(c, 0.0) for c in cells.names.tolist()], dtype=float))
    best = parts.groupBy("idx").agg(F.min(F.struct("d", "nearest")).alias("best"))
    return best.select("idx", "best.nearest", "best.d")


def centroids(vectors: DataFrame, group_col: str) -> DataFrame:
    """group, n, centre: element-wise mean vectors. Partial sums are combined before the shuffle."""
    flat = vectors.select(F.col(group_col).alias("g"), F.posexplode("v").alias("pos", "x"))
    means = flat.groupBy("g", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return means.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre")).withColumnRenamed("g", group_col)
