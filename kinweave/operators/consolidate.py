"""Tier 2: merging clusters by centroids and raw evidence, under human vetoes."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import l2_distance
from ..storage import write_table
from .components import label_all
from .simjoin import centroids, similarity_join


@dataclasses.dataclass
class Node:
    """A cluster: positions of its members, its near-duplicate groups and the ids of its faces."""

    members: list[int]
    groups: set
    faces: set


def raw_distances(x: np.ndarray, a: list[int], b: list[int]) -> np.ndarray:
    return np.sqrt(((x[a][:, None, :] - x[b][None, :, :]) ** 2).sum(2))


def evidence(x: np.ndarray, group: list, a: list[int], b: list[int], most: float) -> tuple[int, int, int]:
    """Distinct unordered pairs of groups with a raw distance of `most` or less, and the groups covered on either side."""
    pairs, left, right = set(), set(), set()
    for i, j in zip(*np.nonzero(raw_distances(x, a, b) <= most), strict=True):
        p, q = group[a[i]], group[b[j]]
        pairs.add((min(p, q), max(p, q)))
        left.add(p)
        right.add(q)
    return len(pairs), len(left), len(right)


def vetoed(a: Node, b: Node, vetoes: list[tuple[set, set]]) -> bool:
    return any(p and q and ((a.faces & p and b.faces & q) or (a.faces & q and b.faces & p)) for p, q in vetoes)


def consolidate(x: np.ndarray, group: list, face: list, clusters: list[list[int]], vetoes: list[tuple[set, set]], cfg: EngineConfig = DEFAULT) -> list[list[int]]:
    """Member positions of each identity.

    Each round merges the closest pair by centroid that passes the strict rule; only when there is none, the
    closest that passes the strong-pair rule. Pairs that fail the strong rule are never tried again.
    """
    return _merged(x, group, face, clusters, vetoes, cfg, blocking=True)[0]


def _merged(x: np.ndarray, group: list, face: list, clusters: list[list[int]], vetoes: list[tuple[set, set]], cfg: EngineConfig, blocking: bool) -> tuple[list[list[int]], bool]:
    """The identities, and without blocking whether a pair that failed the strong rule passed it later.

    Where none did, blocking makes no difference: the blocked pairs, whichever they are, would have failed again.
    """
    nodes: list[Node | None] = [Node(list(c), {group[i] for i in c}, {face[i] for i in c}) for c in clusters]
    sums = np.array([x[c].sum(0) for c in clusters])
    sizes = np.array([len(c) for c in clusters], dtype=float)
    means = sums / sizes[:, None]
    gaps = np.full((len(nodes), len(nodes)), np.inf)
    for i in range(len(nodes) - 1):
        gaps[i, i + 1 :] = np.sqrt(((means[i + 1 :] - means[i]) ** 2).sum(1))
    refused = np.zeros_like(gaps, dtype=bool)  # by the strict rule, until one side grows
    blocked: set[tuple[int, int]] = set()
    recovered = False
    while True:
        found = None
        open_ = np.where((gaps <= cfg.consolidate) & ~refused, gaps, np.inf)
        while found is None and open_.size and np.isfinite(open_.min()):
            i, j = map(int, np.unravel_index(open_.argmin(), open_.shape))
            a, b = nodes[i], nodes[j]
            if not vetoed(a, b, vetoes) and raw_distances(x, a.members, b.members).min() <= cfg.min_raw_pair:
                found = (i, j)
            else:
                refused[i, j] = True
                open_[i, j] = np.inf
        if found is None:
            best = np.inf
            for i, j in np.argwhere(gaps <= cfg.consolidate_review).tolist():
                if blocking and ((i, j) in blocked or gaps[i, j] >= best):
                    continue
                a, b = nodes[i], nodes[j]
                ok = not vetoed(a, b, vetoes)
                if ok:
                    pairs, left, right = evidence(x, group, a.members, b.members, cfg.strong_pair)
                    cover = left / len(a.groups) if len(a.groups) <= len(b.groups) else right / len(b.groups)
                    ok = pairs >= cfg.min_strong_pairs and cover >= cfg.min_strong_coverage
                if not ok:
                    blocked.add((i, j))
                    continue
                recovered |= (i, j) in blocked
                if gaps[i, j] < best:
                    found, best = (i, j), gaps[i, j]
        if found is None:
            return [sorted(n.members) for n in nodes if n is not None], recovered
        i, j = found
        a, b = nodes[i], nodes[j]
        nodes[i], nodes[j] = Node(a.members + b.members, a.groups | b.groups, a.faces | b.faces), None
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        means[i] = sums[i] / sizes[i]
        gaps[j, :] = gaps[:, j] = np.inf
        for k in (k for k, n in enumerate(nodes) if n is not None and k != i):
            lo, hi = min(i, k), max(i, k)
            gaps[lo, hi] = np.sqrt(((means[i] - means[k]) ** 2).sum())
        refused[i, :] = refused[:, i] = False


def reach_groups(means: DataFrame, bound: float) -> DataFrame:
    """node, root: clusters (idx, v) that merges can ever bring within the bound of each other.

    The centroid of merged clusters lies in the ball around their centroids. So chains of centroids within the bound are joined, then
    groups whose balls come within it, until no two do.
    """
    means = write_table(means.select(F.col("idx").cast("long").alias("idx"), "v"), "means")
    groups = write_table(label_all(means, similarity_join(means, bound), "idx"), "reach")
    while True:
        placed = means.join(groups, F.col("idx") == F.col("node")).select("idx", "v", "root")
        centres = centroids(placed, "root").select("root", "centre")
        balls = placed.join(centres, "root").groupBy("root").agg(F.first("centre").alias("v"), F.max(l2_distance("v", "centre")).alias("r"))
        balls = write_table(balls.select(F.col("root").alias("idx"), "v", "r"), "balls")
        widest = balls.agg(F.max("r")).first()[0] or 0.0
        near = similarity_join(balls.select("idx", "v"), bound + 2 * widest + 1e-9)
        radius = balls.select(F.col("idx").alias("n"), "r")
        near = near.join(radius.select(F.col("n").alias("a"), F.col("r").alias("ra")), "a").join(radius.select(F.col("n").alias("b"), F.col("r").alias("rb")), "b")
        near = write_table(near.where(F.col("d") <= F.col("ra") + F.col("rb") + F.lit(bound + 1e-9)).select("a", "b"), "near-balls")
        if near.isEmpty():
            return groups
        joined = label_all(balls, near, "idx").select(F.col("node").alias("old"), F.col("root").alias("new"))
        groups = write_table(groups.join(joined, F.col("root") == F.col("old")).select("node", F.col("new").alias("root")), "reach")


def consolidate_identities(faces: DataFrame, clusters: DataFrame, groups: DataFrame, vetoes: list[tuple[set, set]] = (), cfg: EngineConfig = DEFAULT) -> DataFrame:
    """face_idx, identity_id (the smallest face index). faces: face_idx, face_id, photo_id, descriptor; groups: photo_id, group_id.

    Groups of clusters that can never come within reach of each other are merged apart, a task for each. Only which failing pairs are never tried
    again depends on the order of all merges; this matters only if such a pair would pass later. If that occurs in any
    group, all clusters that have another within reach are merged in the order of the whole, in one task.
    """
    rows = faces.select(F.col("face_idx").cast("long").alias("face_idx"), "face_id", "photo_id", "descriptor").join(clusters, "face_idx")
    rows = rows.join(groups.select("photo_id", F.col("group_id").cast("string").alias("g")), "photo_id", "left").withColumn("g", F.coalesce("g", "photo_id"))
    rows = write_table(rows, "clustered")
    means = centroids(rows.select("cluster_id", F.col("descriptor").alias("v")), "cluster_id").select(F.col("cluster_id").alias("idx"), F.col("centre").alias("v"))
    reach = write_table(reach_groups(means, cfg.consolidate_review), "reach")
    sizes = reach.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
    close = reach.join(sizes, "root").select(F.col("node").alias("cluster_id"), "root")
    held = list(vetoes)

    def run(blocking: bool):
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("face_idx").reset_index(drop=True)
            own = [list(i) for _, i in sorted(pdf.groupby("cluster_id").indices.items())]
            found, recovered = _merged(np.array(pdf["descriptor"].tolist(), dtype=float), pdf["g"].tolist(), pdf["face_id"].tolist(), own, held, cfg, blocking)
            idx = pdf["face_idx"].to_numpy()
            return pd.DataFrame([(int(idx[i]), int(idx[min(c)]), recovered) for c in found for i in c], columns=["face_idx", "identity_id", "recovered"])

        return merge

    schema = "face_idx long, identity_id long, recovered boolean"
    worked = write_table(rows.join(close, "cluster_id").groupBy("root").applyInPandas(run(False), schema), "merged")
    if not worked.where("recovered").isEmpty():
        worked = rows.join(close.select("cluster_id"), "cluster_id").groupBy(F.lit(1)).applyInPandas(run(True), schema)
    return worked.select("face_idx", "identity_id").unionByName(rows.join(close, "cluster_id", "left_anti").select("face_idx", F.col("cluster_id").alias("identity_id")))


def identity_pairs(rows: DataFrame, cfg: EngineConfig = DEFAULT, most: float | None = None, key: str = "cluster_id") -> DataFrame:
    """a, b, d: pairs of clusters whose centroids are within the review bound."""
    means = centroids(rows.select(key, F.col("descriptor").alias("v")), key)
    return similarity_join(means.select(F.col(key).alias("idx"), F.col("centre").alias("v")), cfg.consolidate_review if most is None else most)


def review_candidates(rows: DataFrame, cfg: EngineConfig = DEFAULT, key: str = "identity_id") -> DataFrame:
    """a, b, d, reason: pairs of identities that a human should see. rows: key, g (near-duplicate group), descriptor.

    Pairs within the review bound; and for two small identities the nearest small neighbour within a wider bound.
    """
    sizes = rows.groupBy(F.col(key).alias("id")).agg(F.count_distinct("g").alias("k"))
    wide = identity_pairs(rows, cfg, cfg.review_small, key)
    wide = wide.join(sizes.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(sizes.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    small = (F.col("ka") <= cfg.small_groups) & (F.col("kb") <= cfg.small_groups)
    plain = wide.where(~small & (F.col("d") <= cfg.consolidate_review)).select("a", "b", "d", F.lit("no-corroborating-evidence").alias("reason"))
    both = wide.where(small)
    ways = both.select(F.col("a").alias("x"), F.col("b").alias("y"), "d").unionByName(both.select(F.col("b").alias("x"), F.col("a").alias("y"), "d"))
    nearest = ways.groupBy("x").agg(F.min(F.struct("d", "y")).alias("m"))
    nearest = nearest.select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b"), "m.d").distinct()
    return plain.unionByName(nearest.select("a", "b", "d", F.lit("small-cluster").alias("reason")))


def impure(rows: DataFrame, cfg: EngineConfig = DEFAULT, key: str = "identity_id") -> DataFrame:
    """id, n, a, b, d: small identities whose farthest pair is farther than allowed."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= cfg.impure_max_members))
    own = rows.select(key, F.col("face_idx").cast("long").alias("face_idx"), "descriptor").join(sizes, key)
    pair = own.select(key, "n", F.col("face_idx").alias("a"), F.col("descriptor").alias("va")).join(own.select(F.col(key).alias("k2"), F.col("face_idx").alias("b"), F.col("descriptor").alias("vb")), (F.col(key) == F.col("k2")) & (F.col("a") < F.col("b")))
    pair = pair.withColumn("d", l2_distance("va", "vb"))
    first = W.partitionBy(key).orderBy(F.desc("d"), "a", "b")
    return pair.withColumn("rn", F.row_number().over(first)).where((F.col("rn") == 1) & (F.col("d") > cfg.impure_distance)).select(F.col(key).alias("id"), "n", "a", "b", "d")
