"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Rows are dealt to shards around pivots, so that a shard holds neighbours; shards of a bounded size. Over each shard a ball tree is built, once, and
written. A ball with centre c and radius r holds no larger inner product with q than q.c + |q| r. By this bound of the shards' roots a
query first goes to its best shard, then to the next few, then to all others whose bound isn't below its current kth score. In a
shard it visits nodes in the order of their bounds and stops at the first below the kth score that it has reached.
Queries travel in packed blocks; trees are replicated only where the queries are more than one task should answer.

Defined results: vectors that are null or hold a null or non-finite component take no part. Components are
floor(scale * x) as whole numbers of any size: products are exact in 53 or 63 bits where these hold all sums, else in unbounded integers. A result that
doesn't fit a long raises, as does a component that scaling takes out of a double's range. Vectors of different lengths are never compared. A candidate with the query's own id is left out, also where rows
repeat; rows that repeat an id and vector are one candidate. Ties go to the smaller id. Null ids take no part. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_parts, write_table

LEAF = 128
#: Numbers in a shard's points at most, shards whose roots all tasks hold at once (less for long vectors), and queries for which a tree is replicated.
NUMBERS, ROOTS, LANE = 1 << 20, 4096, 1 << 16
#: How many of its best shards a query has seen after each wave but the last.
WAVES = (1, 8)


class BallTree:
    """Nodes in arrays: centre, radius, left and right child (or -1) and the range of the points, which are put in the order of the leaves."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        nodes, centres, radii = [], [], []
        stack = [(0, len(points), -1, 0)]
        with np.errstate(over="ignore", invalid="ignore"):
            while stack:
                lo, hi, parent, side = stack.pop()
                own = points[order[lo:hi]]
                centre = own.mean(axis=0)
                gaps = np.sqrt(((own - centre) ** 2).sum(axis=1))
                me = len(nodes)
                nodes.append([lo, hi, -1, -1])
                centres.append(centre)
                radii.append(float(np.nan_to_num(gaps.max(), nan=np.inf, posinf=np.inf)))
                if parent >= 0:
                    nodes[parent][2 + side] = me
                if hi - lo > leaf and gaps.max() != 0:
                    far = own[int(gaps.argmax())]
                    other = own[int(((own - far) ** 2).sum(axis=1).argmax())]
                    middle = (hi - lo) // 2
                    order[lo:hi] = order[lo:hi][np.argpartition(own @ (other - far), middle)]
                    stack += [(lo, lo + middle, me, 0), (lo + middle, hi, me, 1)]
        self.points, self.ids = points[order], ids[order]
        self.nodes, self.centres, self.radii = np.array(nodes, dtype=np.int32), np.array(centres), np.array(radii)

    def pack(self) -> bytes:
        arrays = (self.points.astype("<f8"), self.ids.astype("<i8"), self.nodes.astype("<i4"), self.centres.astype("<f8"), self.radii.astype("<f8"))
        return struct.pack("<III", *self.points.shape, len(self.nodes)) + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def unpack(cls, raw: bytes) -> BallTree:
        n, dim, m = struct.unpack_from("<III", raw)
        made, at = cls.__new__(cls), 12
        for name, kind, shape in (("points", "<f8", (n, dim)), ("ids", "<i8", (n,)), ("nodes", "<i4", (m, 4)), ("centres", "<f8", (m, dim)), ("radii", "<f8", (m,))):
            size = math.prod(shape)
            setattr(made, name, np.frombuffer(raw, kind, size, at).reshape(shape))
            at += size * np.dtype(kind).itemsize
        return made


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """At least the largest inner product of each query with a point of each ball; infinite where doubles can't tell."""
    with np.errstate(over="ignore", invalid="ignore"):
        sizes = np.sqrt((queries**2).sum(axis=1))[:, None]
        spread = sizes * radii
        slack = 1e-9 * (sizes * np.sqrt((centres**2).sum(axis=1)) + spread) + 0.5  # above any rounding; scores are whole numbers
        out = queries @ centres.T + spread + slack
    return np.where(np.isnan(out), np.inf, out)


def exact_type(queries: np.ndarray, points: np.ndarray) -> type:
    """The type in which all inner products are exact."""
    top = float(np.abs(points).max(initial=1.0)), float(np.abs(queries).max(initial=1.0))
    room = math.log2(max(1.0, top[0])) + math.log2(max(1.0, top[1])) + math.log2(max(1, queries.shape[1])) + 1e-6
    return np.float64 if room < 53 else np.int64 if room < 63 else object


def whole(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return x.astype(kind)
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, floors: list[int | None], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's best rows, at most k and none under its floor."""
    kind = exact_type(queries, tree.points)
    points, asked = whole(tree.points, kind), whole(queries, kind)
    own, nodes = tree.ids, tree.nodes.tolist()
    bounds = upper_bounds(queries, tree.centres, tree.radii)
    out = []
    for i, q in enumerate(asked):
        floor, mine, bound = -math.inf if floors[i] is None else floors[i], int(query_ids[i]), bounds[i]
        best_s, best_i = np.empty(0, dtype=object if kind is object else np.int64), np.empty(0, dtype=np.int64)
        heap, low = [(-bound[0], 0)], _near(floor)
        while heap:
            least, node = heapq.heappop(heap)
            if -least < low:
                break
            lo, hi, left, right = nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= low:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = points[lo:hi] @ q
            keep = np.flatnonzero((scores >= floor) & (own[lo:hi] != mine))
            if len(keep):
                best_s = np.concatenate([best_s, scores[keep].astype(best_s.dtype)])
                best_i = np.concatenate([best_i, own[lo:hi][keep]])
                if len(best_s) > k:
                    order = _best(best_s, best_i)[:k]
                    best_s, best_i = best_s[order], best_i[order]
                if len(best_s) == k:
                    floor = max(floor, int(best_s.min()))
                    low = _near(floor)
        order = _best(best_s, best_i)
        out.append((mine, best_i[order], best_s[order]))
    return out


def _near(floor: float) -> float:
    """A double for a whole number of any size; the bounds' slack is wider than its rounding."""
    try:
        return float(floor)
    except OverflowError:
        return math.inf if floor > 0 else -math.inf


def _best(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j])), dtype=np.int64)
    return np.lexsort((ids, -scores))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _placed(base: DataFrame, shard_rows: int) -> DataFrame:
    """base (id, v, dim) with its shard: the nearest pivot, and a part of its cell where it has more than one shard's rows."""
    spark, total = base.sparkSession, base.count()
    bar = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, 1 / shard_rows) * (1 << 64)))
    pivots: dict[int, list] = {}
    for r in base.where(F.xxhash64("id", F.lit(2)) <= bar).select("dim", "v").limit(ROOTS).collect() if total > shard_rows else []:  # any pivots do: they decide speed, not results
        pivots.setdefault(r["dim"], []).append(r["v"])
    held = spark.sparkContext.broadcast({d: np.array(v) for d, v in pivots.items()})

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cell = np.zeros(len(pdf), dtype=np.int32)
            dims = pdf["dim"].to_numpy()
            for d in np.unique(dims):
                if d in held.value:
                    own, rows = held.value[d], np.flatnonzero(dims == d)
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell[rows] = ((own**2).sum(1) - 2 * np.array(pdf["v"].iloc[rows].tolist()) @ own.T).argmin(1)
            yield pdf.assign(cell=cell)

    dealt = write_table(base.mapInPandas(near, "id long, v array<double>, dim int, cell int"), "placed")
    most = F.greatest(F.lit(64), F.least(F.lit(shard_rows), F.floor(F.lit(NUMBERS) / F.greatest("dim", F.lit(1)))))
    cuts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).alias("cuts"))
    dealt = dealt.join(cuts, ["dim", "cell"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")))
    return dealt.withColumn("shard", F.xxhash64("dim", "cell", "cut"))


def _grown(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree(np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1), pdf["id"].to_numpy(dtype=np.int64))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [int(pdf["dim"].iloc[0])], "centre": [tree.centres[0].astype("<f8").tobytes()], "radius": [float(tree.radii[0])], "blob": [tree.pack()]})


_SENT, _SENT_ARROW = "shard long, lane int, kind int, blob binary", pa.schema([("shard", pa.int64()), ("lane", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _sent(roots, seen: int, most: int | None, query_rows: int):
    """Queries (id, dim, v, floor), each in blocks for the shards that come after its `seen` best up to its `most` best, if their bound isn't under the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, query_rows):
                batch = whole_batch.slice(start, query_rows)
                ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                known = np.asarray(batch.column(3).is_valid())
                floors = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
                lanes = batch.column(4).to_numpy()
                for (d, lane), rows in pd.Series(range(len(ids))).groupby([dims, lanes]).groups.items():
                    if d not in roots.value:
                        continue
                    rows = np.array(rows)
                    shards, centres, radii = roots.value[d]
                    queries = _vectors(batch.column(2).take(pa.array(rows)), d)
                    bounds = upper_bounds(queries, centres, radii)
                    place = np.empty(bounds.shape, dtype=np.int64)
                    np.put_along_axis(place, np.argsort(-bounds, axis=1, kind="stable"), np.arange(len(shards))[None, :], axis=1)
                    go = (place >= seen) & (place < (len(shards) if most is None else most)) & (~known[rows][:, None] | (bounds >= floors[rows].astype(np.float64)[:, None]))
                    out = []
                    for s in np.flatnonzero(go.any(axis=0)):
                        x = np.flatnonzero(go[:, s])
                        body = ids[rows[x]].astype("<i8").tobytes() + known[rows[x]].astype("u1").tobytes() + floors[rows[x]].astype("<i8").tobytes() + queries[x].astype("<f8").tobytes()
                        out.append((int(shards[s]), int(lane), 1, struct.pack("<II", len(x), d) + body))
                    for i in range(0, len(out), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 64], strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW)

    return run


def _answers(k: int):
    """Streams one shard after another: its tree comes first, then the queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for shard, lane, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    tree, at = BallTree.unpack(blob), (shard, lane)
                    continue
                if at != (shard, lane):
                    raise RuntimeError(f"queries of shard {shard} came without its tree")
                n, dim = struct.unpack_from("<II", blob)
                ids, known = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "u1", n, 8 + 8 * n)
                floors, queries = np.frombuffer(blob, "<i8", n, 8 + 9 * n), np.frombuffer(blob, "<f8", n * dim, 8 + 17 * n).reshape(n, dim)
                found = [x for x in search(tree, queries, ids, [int(f) if has else None for f, has in zip(floors, known, strict=True)], k) if len(x[1])]
                if found:
                    scores = list(itertools.chain.from_iterable(s.tolist() for _, _, s in found))
                    if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
                        raise ValueError("a score doesn't fit a long")
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(i), q, dtype=np.int64) for q, i, _ in found])), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(scores, pa.int64())], schema=schema)

    return run


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row that `queries` selects.

    queries: a condition on the id, as F.col("id") % 20 == 0.
    """
    spark = vectors.sparkSession
    parts = shuffle_parts(spark)
    fine = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.col(id_col).isNotNull()

    def scaled(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        inside = F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # beyond, a double is whole
        return F.when(F.abs(y) == math.inf, F.raise_error(F.lit("a scaled component is beyond a double's range")).cast("double")).otherwise(inside)

    kept = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, scaled).alias("v")).withColumn("dim", F.size("v"))
    base = write_table(kept.distinct(), "vectors")
    asked = base.where(queries)
    lanes = max(1, -(-asked.count() // LANE))
    asked = asked.withColumn("lane", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(lanes)).cast("int"))
    trees = write_table(_placed(base, shard_rows).groupBy("shard").applyInPandas(_grown, "shard long, dim int, centre binary, radius double, blob binary"), "trees")
    size = trees.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shares = max(1, -(-size[0] // max(1, min(ROOTS, (4 * NUMBERS) // max(1, size[1])))))
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for share in range(shares):
        own = trees.where(F.pmod(F.xxhash64("shard"), F.lit(shares)) == share)
        roots: dict[int, list] = {}
        for r in own.select("shard", "dim", "centre", "radius").orderBy("shard").collect():  # about ROOTS rows
            roots.setdefault(r["dim"], []).append(r)
        held = spark.sparkContext.broadcast({d: (np.array([r["shard"] for r in rs]), np.array([np.frombuffer(r["centre"], "<f8") for r in rs]).reshape(len(rs), d), np.array([r["radius"] for r in rs])) for d, rs in roots.items()})
        widest = max(map(len, roots.values()), default=0)
        steps = [w for w in WAVES if w < widest]
        sent_trees = own.select("shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), "blob")
        for seen, most in itertools.pairwise([0, *steps, None]):
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            ready = asked.join(kth, "id", "left").select("id", "dim", "v", "floor", "lane")
            blocks = ready.mapInArrow(_sent(held, seen, most, query_rows), _SENT)
            met = sent_trees.unionByName(blocks).repartition(parts, "shard", "lane").sortWithinPartitions("shard", "lane", "kind")
            got = met.mapInArrow(_answers(k), "query_id long, vec_id long, score long")
            best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            every = got.unionByName(found.select("query_id", "vec_id", "score")).distinct()
            found = write_table(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "top-k")
    return found.select("query_id", "rank", "vec_id", "score")
