"""Tier 1: constrained average-linkage clustering, exact per connected component."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import l2_distance
from ..storage import write_table
from .components import label_all
from .simjoin import BLOCK, similarity_join


def average_linkage(vectors: np.ndarray, photos: list[set], start: np.ndarray | None = None, cfg: EngineConfig = DEFAULT) -> list[list[int]]:
    """Member positions of each cluster; positions are in face order. start: a label per face, equal for faces that begin in one cluster.

    The closest pair of clusters by average distance is merged as long as it lies within the limit, which is
    lower for clusters that share a photo. Ties go to the lowest positions.
    """
    n = len(vectors)
    gaps = np.sqrt(np.maximum(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(2), 0)) if n <= 400 else np.stack([np.sqrt(((vectors - v) ** 2).sum(1)) for v in vectors])
    _, heads, of = np.unique(np.arange(n) if start is None else start, return_index=True, return_inverse=True)
    members = [np.flatnonzero(of == k).tolist() for k in np.argsort(heads)]
    m = len(members)
    sums = gaps
    if m < n:
        onto = np.zeros((m, n))
        for k, own in enumerate(members):
            onto[k, own] = 1
        sums = onto @ gaps @ onto.T
    size = np.array([len(x) for x in members], dtype=float)
    names = {p: k for k, p in enumerate(sorted(set().union(*photos)))}
    held = np.zeros((m, len(names)), dtype=np.float32)  # which photos each cluster is in
    for k, own in enumerate(members):
        held[k, [names[p] for i in own for p in photos[i]]] = 1
    shared = held @ held.T > 0
    alive = np.ones(m, dtype=bool)
    upper = np.triu(np.ones((m, m), dtype=bool), 1)
    mean = sums / np.outer(size, size)
    mean = np.where((mean <= np.where(shared, cfg.same_photo, cfg.similarity)) & upper, mean, np.inf)  # of pairs that may merge, lower cluster first
    to = mean.argmin(1)  # each row's first least
    least = mean[np.arange(m), to]
    while True:
        a = int(least.argmin())
        if least[a] == np.inf:
            break
        b = int(to[a])
        sums[a] += sums[b]
        sums[:, a] = sums[a]
        sums[a, a] = 0
        size[a] += size[b]
        members[a] += members[b]
        held[a] = np.maximum(held[a], held[b])
        alive[b] = False
        own = sums[a] / (size[a] * size)
        own = np.where((own <= np.where(held @ held[a] > 0, cfg.same_photo, cfg.similarity)) & alive, own, np.inf)
        mean[a, a + 1 :], mean[:a, a] = own[a + 1 :], own[:a]
        mean[b], mean[:, b] = np.inf, np.inf
        stale = (to == a) | (to == b)
        stale[[a, b]] = True
        better = ~stale[:a] & ((own[:a] < least[:a]) | ((own[:a] == least[:a]) & (a < to[:a]) & (own[:a] < np.inf)))
        to[:a][better], least[:a][better] = a, own[:a][better]
        rows = np.flatnonzero(stale)
        to[rows] = mean[rows].argmin(1)
        least[rows] = mean[rows, to[rows]]
    return [sorted(members[i]) for i in np.flatnonzero(alive)]


def micro_pairs(faces: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """a, b, d: pairs of faces nearer than the micro bound."""
    vectors = faces.select(F.col("face_idx").alias("idx"), F.col("descriptor").alias("v"))
    return similarity_join(vectors, cfg.micro).where(F.col("d") < cfg.micro)


def micro_clusters(faces: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """face_idx, start: single linkage below the micro bound, whoever is in the same photo."""
    every = faces.select(F.col("face_idx").cast("long").alias("face_idx"))
    vectors = faces.select(F.col("face_idx").alias("idx"), F.col("descriptor").alias("v"))
    links = similarity_join(vectors, math.nextafter(cfg.micro, 0.0), BLOCK, True)  # not all pairs, of which a group of copies has the square of its size
    return label_all(every, links, "face_idx").select(F.col("node").alias("face_idx"), F.col("root").alias("start"))


def cluster_faces(faces: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """face_idx, cluster_id: the cluster's smallest face index. faces: face_idx, photo_id, descriptor.

    A merge needs a raw pair within the larger limit, so clusters never leave a connected component of that
    graph; each component is clustered by itself, with the same result as all at once. Of more faces than
    exact_max_faces, those that micro_clusters joins begin together.
    """
    total = faces.count()
    cut = max(cfg.similarity, cfg.same_photo, cfg.micro)
    pairs = write_table(similarity_join(faces.select(F.col("face_idx").alias("idx"), F.col("descriptor").alias("v")), cut), "near")
    every = faces.select(F.col("face_idx").cast("long").alias("face_idx"))
    roots = label_all(every, pairs, "face_idx")
    begun = roots.select(F.col("node").alias("face_idx"), F.col("node").alias("start"))
    if total > cfg.exact_max_faces:  # the pairs below the micro bound are among those found
        begun = label_all(every, pairs.where(F.col("d") < cfg.micro), "face_idx").select(F.col("node").alias("face_idx"), F.col("root").alias("start"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("root"):
            own = own.sort_values("face_idx")
            idx = own["face_idx"].to_numpy()
            if len(own) == 1:
                out.append((int(idx[0]), int(idx[0])))
                continue
            found = average_linkage(np.array(own["descriptor"].tolist(), dtype=float), [{p} for p in own["photo_id"]], own["start"].to_numpy(), cfg)
            out += [(int(idx[i]), int(idx[min(c)])) for c in found for i in c]
        return pd.DataFrame(out, columns=["face_idx", "cluster_id"])

    rows = faces.select(F.col("face_idx").cast("long").alias("face_idx"), "photo_id", "descriptor").join(roots.withColumnRenamed("node", "face_idx"), "face_idx").join(begun, "face_idx")
    # small components share a task, about a thousand faces each
    lots = max(1, -(-total // 1024))
    return rows.withColumn("lot", F.pmod(F.xxhash64("root"), F.lit(lots))).groupBy("lot").applyInPandas(run, "face_idx long, cluster_id long")


def review_pairs(faces: DataFrame, clusters: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """a, b, average: pairs of clusters whose average distance lies just above the limit.

    A candidate has a raw pair within the upper bound; only candidates' sums are computed.
    """
    clusters = write_table(clusters, "clusters")
    rows = faces.select(F.col("face_idx").cast("long").alias("face_idx"), F.col("descriptor").alias("v")).join(clusters, "face_idx").select(F.col("face_idx").alias("idx"), "v", "cluster_id")
    top = cfg.similarity + cfg.review_margin
    near = similarity_join(rows.select("idx", "v"), top).select("a", "b")
    own = clusters.select(F.col("face_idx"), "cluster_id")
    near = near.join(own.withColumnRenamed("face_idx", "a").withColumnRenamed("cluster_id", "ca"), "a").join(own.withColumnRenamed("face_idx", "b").withColumnRenamed("cluster_id", "cb"), "b")
    near = near.where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()
    left = rows.select(F.col("cluster_id").alias("ca"), F.col("v").alias("va"))
    right = rows.select(F.col("cluster_id").alias("cb"), F.col("v").alias("vb"))
    means = near.join(left, "ca").join(right, "cb").groupBy("ca", "cb").agg(F.avg(l2_distance("va", "vb")).alias("average"))
    return means.where((F.col("average") > cfg.similarity) & (F.col("average") <= top)).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "average")
