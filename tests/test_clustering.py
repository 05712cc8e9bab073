"""Clustering against naive versions written from the rules alone."""

import itertools
import random
import time
from pathlib import Path

import numpy as np
import pytest

from kinweave.config import DEFAULT, EngineConfig
from kinweave.operators import components, consolidate, dupes, linkage, simjoin
from kinweave.storage import storage_root


def naive_linkage(x, photos, cfg):
    clusters = [[i] for i in range(len(x))]
    while True:
        best = None
        for i, j in itertools.combinations(range(len(clusters)), 2):
            a, b = clusters[i], clusters[j]
            d = np.mean([np.linalg.norm(x[p] - x[q]) for p in a for q in b])
            limit = cfg.same_photo if {photos[p] for p in a} & {photos[q] for q in b} else cfg.similarity
            if d <= limit and (best is None or d < best[0] - 1e-12):
                best = (d, i, j)
        if best is None:
            return {frozenset(c) for c in clusters}
        _, i, j = best
        clusters[i] = clusters[i] + clusters[j]
        del clusters[j]


@pytest.mark.parametrize("seed", range(6))
def test_linkage_is_the_naive_one(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.35, (24, 3))
    photos = [f"t-{rng.integers(9)}" for _ in x]
    got = {frozenset(map(int, c)) for c in linkage.average_linkage(x, [{p} for p in photos])}
    assert got == naive_linkage(x, photos, DEFAULT)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_by_component_are_the_global_ones(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.6, (60, 3))
    photos = [f"t-{rng.integers(20)}" for _ in x]
    rows = spark.createDataFrame([(i, photos[i], [float(v) for v in x[i]]) for i in range(len(x))], "face_idx int, photo_id string, descriptor array<double>")
    got = {}
    for r in linkage.cluster_faces(rows).collect():
        got.setdefault(r["cluster_id"], set()).add(r["face_idx"])
    assert {frozenset(c) for c in got.values()} == naive_linkage(x, photos, DEFAULT)
    assert all(min(c) == k for k, c in got.items())


def test_micro_step_joins_below_its_cut(spark):
    rows = spark.createDataFrame([(i, f"t-{i}", [x]) for i, x in enumerate((0.0, 0.39, 0.78, 1.17, 9.0, 9.4))], "face_idx int, photo_id string, descriptor array<double>")
    got = {r["face_idx"]: r["cluster_id"] for r in linkage.cluster_faces(rows, EngineConfig(exact_max_faces=2)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}  # the last two by their average, below the other limit
    assert len({r["cluster_id"] for r in linkage.cluster_faces(rows).collect()}) > 2
    assert {r["start"] for r in linkage.micro_clusters(rows).collect()} == {0, 4, 5}


def naive_consolidate(x, group, clusters, cfg):
    nodes = {i: list(c) for i, c in enumerate(clusters)}
    blocked = set()

    def raw(a, b):
        return [np.linalg.norm(x[p] - x[q]) for p in a for q in b]

    while True:
        centre = {i: x[c].mean(0) for i, c in nodes.items()}
        gap = {(i, j): float(np.linalg.norm(centre[i] - centre[j])) for i, j in itertools.combinations(nodes, 2)}
        strict = [(d, k) for k, d in gap.items() if d <= cfg.consolidate and min(raw(nodes[k[0]], nodes[k[1]])) <= cfg.min_raw_pair]
        pick = min(strict, key=lambda s: s[0])[1] if strict else None
        if pick is None:
            best = np.inf
            for k, d in gap.items():
                if d > cfg.consolidate_review or k in blocked or d >= best:
                    continue
                a, b = nodes[k[0]], nodes[k[1]]
                near = [(group[p], group[q]) for p in a for q in b if np.linalg.norm(x[p] - x[q]) <= cfg.strong_pair]
                ga, gb = {group[p] for p in a}, {group[q] for q in b}
                cover = len({p for p, _ in near}) / len(ga) if len(ga) <= len(gb) else len({q for _, q in near}) / len(gb)
                if len({tuple(sorted(n)) for n in near}) >= cfg.min_strong_pairs and cover >= cfg.min_strong_coverage:
                    pick, best = k, d
                else:
                    blocked.add(k)
        if pick is None:
            return {frozenset(c) for c in nodes.values()}
        nodes[pick[0]] = nodes[pick[0]] + nodes.pop(pick[1])


@pytest.mark.parametrize("seed", range(8))
def test_consolidation_is_the_naive_one(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (30, 3))
    group = [str(rng.integers(12)) for _ in x]
    clusters = [list(range(i, i + 2)) for i in range(0, 30, 2)]
    got = {frozenset(map(int, c)) for c in consolidate.consolidate(x, group, list(map(str, range(30))), clusters, [])}
    assert got == naive_consolidate(x, group, clusters, DEFAULT)


@pytest.mark.parametrize("seed", range(3))
def test_groups_consolidate_apart_as_all_at_once(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.22, (20, 3)) for c in (0, 4, 8)])
    clusters = [list(range(i, i + 2)) for i in range(0, 60, 2)]
    faces = spark.createDataFrame([(i, f"f{i}", f"t-{i % 17}", [float(v) for v in p]) for i, p in enumerate(x)], "face_idx int, face_id string, photo_id string, descriptor array<double>")
    placed = spark.createDataFrame([(i, c[0]) for c in clusters for i in c], "face_idx long, cluster_id long")
    groups = spark.createDataFrame([(f"t-{i}", i // 2) for i in range(17)], "photo_id string, group_id int")
    vetoes = [({"f0", "f2"}, {"f5"}), ({"f41"}, {"f44", "f47"})]
    got = {}
    for r in consolidate.consolidate_identities(faces, placed, groups, vetoes).collect():
        got.setdefault(r["identity_id"], set()).add(r["face_idx"])
    want = consolidate.consolidate(x, [str(i % 17 // 2) for i in range(60)], [f"f{i}" for i in range(60)], clusters, vetoes)
    assert {frozenset(c) for c in got.values()} == {frozenset(c) for c in want} and all(min(c) == k for k, c in got.items())
    assert 3 < len(got) < 30


def test_veto_keeps_clusters_apart():
    x = np.array([[0.0], [0.1], [0.2], [0.3]])
    args = (x, list("abcd"), list("abcd"), [[0, 1], [2, 3]])
    assert len(consolidate.consolidate(*args, [])) == 1
    assert len(consolidate.consolidate(*args, [({"d"}, {"a"})])) == 2
    assert len(consolidate.consolidate(*args, [(set(), {"a"})])) == 1


def test_similarity_join_finds_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (40, 4)) for c in (0, 3, 6)])
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "idx long, v array<double>")
    got = {(r["a"], r["b"]) for r in simjoin.similarity_join(rows, 0.4, block=16).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if np.linalg.norm(x[i] - x[j]) <= 0.4}


def test_similarity_join_sends_no_vector_twice(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "idx long, v array<double>")
    cells = simjoin.Cells(rows, 16)
    assert len(cells.chunk) > 10 and spark.read.parquet(cells.path).count() == 300
    found = simjoin.similarity_join(rows, 2.0, block=16)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]) for r in found.collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(300), 2) if np.linalg.norm(x[i] - x[j]) <= 2.0} and len(got) > 100


def test_similarity_join_far_from_the_origin(spark):
    x = [6e6 + 100.0 * (i // 2) + i % 2 * 0.435 for i in range(400)]
    rows = spark.createDataFrame([(i, [v, 1.0, 2.0]) for i, v in enumerate(x)], "idx long, v array<double>")
    assert {(r["a"], r["b"]) for r in simjoin.similarity_join(rows, 0.44).collect()} == {(i, i + 1) for i in range(0, 400, 2)}


def folders(spark) -> set:
    """What lies in the shared folder."""
    root = Path(storage_root(spark).removeprefix("file://")) / "kinweave"
    return set(root.iterdir()) if root.is_dir() else set()


def test_join_writes_its_vectors_once(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 3000)] + rng.normal(scale=0.05, size=(3000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, v array<double>")
    before = folders(spark)
    found = {(r["a"], r["b"]) for r in simjoin.similarity_join(rows, 0.1, block=64).collect()}
    made = folders(spark) - before
    tables = [spark.read.parquet(str(m)) for m in made]
    assert sum(t.count() for t in tables if "v" in t.columns) == len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert found == set(zip(*(k.tolist() for k in np.nonzero(np.triu(d <= 0.1, 1))), strict=True))


def test_linkage_finds_its_pairs_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(linkage, "similarity_join", lambda *args: calls.append(1) or simjoin.similarity_join(*args))
    rows = spark.createDataFrame([(i, f"t-{i}", [x]) for i, x in enumerate((0.0, 0.39, 0.78, 1.17, 9.0, 9.4))], "face_idx int, photo_id string, descriptor array<double>")
    assert linkage.cluster_faces(rows, EngineConfig(exact_max_faces=2)).count() == 6
    assert len(calls) == 1


def test_micro_pairs_shuffle_no_vectors(spark):
    rows = spark.createDataFrame([(i, f"t-{i}", [x]) for i, x in enumerate((0.0, 0.25, 1.0, 1.375, 1.75, 9.0))], "face_idx int, photo_id string, descriptor array<double>")
    found = linkage.micro_pairs(rows, EngineConfig(micro=0.375))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0, 1, 0.25)]


def counted(spark, df):
    """df, and an accumulator of the rows that its tasks give."""
    seen = spark.sparkContext.accumulator(0)

    def note(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(note, df.schema), seen


def test_components_read_their_links_once(spark):
    links, seen = counted(spark, spark.createDataFrame([(0, 1), (1, 2), (5, 5), (7, 8)], "a long, b long"))
    nodes = spark.range(10)
    assert dict(map(tuple, components.label_all(nodes, links, "id").collect())) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    assert seen.value == 4


def test_micro_clusters_find_their_pairs_once(spark, monkeypatch):
    found = []

    def join(*args):
        pairs, seen = counted(spark, simjoin.similarity_join(*args))
        found.append(seen)
        return pairs

    monkeypatch.setattr(linkage, "similarity_join", join)
    rows = spark.createDataFrame([(i, f"t-{i}", [x]) for i, x in enumerate((0.0, 0.39, 0.78, 1.17, 9.0, 9.4))], "face_idx int, photo_id string, descriptor array<double>")
    assert {r["start"] for r in linkage.micro_clusters(rows).collect()} == {0, 4, 5}
    assert [s.value for s in found] in ([3], [4])  # the last pair is at the bound


def test_micro_clusters_keep_few_links_of_copies(spark, monkeypatch):
    found = []

    def join(*args):
        pairs, seen = counted(spark, simjoin.similarity_join(*args))
        found.append(seen)
        return pairs

    monkeypatch.setattr(linkage, "similarity_join", join)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(0, 5, (3, 8)), 100, axis=0)
    rows = spark.createDataFrame([(i, f"t-{i}", v.tolist()) for i, v in enumerate(x)], "face_idx int, photo_id string, descriptor array<double>")
    before = folders(spark)
    assert {tuple(r) for r in linkage.micro_clusters(rows).collect()} == {(i, i // 100 * 100) for i in range(300)}
    assert [s.value for s in found] == [297]  # of 14,850 pairs
    chunks = [spark.read.parquet(str(m)) for m in folders(spark) - before]
    assert [dict(c.dtypes)["v"] for c in chunks if "v" in c.columns] == ["array<int>"]  # four bytes for each number


def joined(a, b, n) -> list[int]:
    """The least name that each of n reaches."""
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for i, j in zip(a, b, strict=True):
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return root


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_links_join_what_all_pairs_join(spark, far):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.16, (60, 4)) for c in (0, 3, 6)]) + far
    x = np.concatenate([x, np.full((40, 4), np.nan), np.full((3, 4), np.inf), np.full((2, 4), 1e200), np.full((2, 4), -1.7e308), np.full((2, 4), 1.7e308)])
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "idx long, v array<double>")
    with np.errstate(all="ignore"):
        pairs = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= 0.2]
    before = folders(spark)
    links = [tuple(r) for r in simjoin.similarity_join(rows, 0.2, 16, True).collect()]
    again = {r["idx"] for m in folders(spark) - before if m.name.startswith("true-") for r in spark.read.parquet(str(m)).collect()}
    assert again and np.isfinite(x[sorted(again)]).all()  # what isn't finite is never looked at again
    assert {tuple(sorted(k)) for k in links} <= set(pairs) and 20 < len(set(joined(*zip(*pairs, strict=True), len(x)))) < len(x) - 20
    assert joined(*zip(*links, strict=True), len(x)) == joined(*zip(*pairs, strict=True), len(x))


def test_links_at_the_bound_are_told_by_the_true_vectors(spark):
    x = [(0.0, 0.0), (0.1, 0.0), (0.3, 0.0), (0.7, 0.0), (0.7, 0.4), (5.0, 0.1), (5.0, 0.5), (5.0, 0.9)]
    rows = spark.createDataFrame([(i, list(p)) for i, p in enumerate(x)], "idx long, v array<double>")
    for within in (0.4, np.nextafter(0.4, 0), np.nextafter(0.4, 1), np.sqrt(0.4 * 0.4)):
        pairs = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if np.sqrt(((np.array(x[i]) - np.array(x[j])) ** 2).sum()) <= within]
        links = [tuple(r) for r in simjoin.similarity_join(rows, float(within), 4, True).collect()]
        assert joined(*zip(*links, strict=True), len(x)) == joined(*zip(*pairs, strict=True), len(x))


def test_cells_leave_no_shuffles(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_") and n.endswith(".data")}

    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "idx long, v array<double>")
    rows = rows.repartition(4, "idx")
    before = shuffled()
    assert len(simjoin.Cells(rows, 16).chunk) > 10
    for _ in range(50):  # they are deleted in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before


def test_empty_and_single_vectors(spark):
    none = spark.createDataFrame([], "idx long, v array<double>")
    assert simjoin.similarity_join(none, 0.4).count() == 0
    one = spark.createDataFrame([(7, "t-1", [0.0, 1.0])], "face_idx int, photo_id string, descriptor array<double>")
    assert [tuple(r) for r in linkage.cluster_faces(one).collect()] == [(7, 7)]
    assert linkage.cluster_faces(one.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(30)) and got[200] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_aliases_with_a_cycle(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s")]
    got = dict(map(tuple, components.resolve_aliases(spark.createDataFrame(rows, "from_id string, to_id string")).collect()))
    assert got["a"] == got["b"] == got["c"] == got["d"] == "d"
    assert got["x"] == "y" and got["y"] == "x"


def test_long_chains_of_aliases(spark):
    n = 10_000
    rows = spark.range(n).selectExpr("id as from_id", "id + 1 as to_id").unionByName(spark.createDataFrame([(-1, -2), (-2, -3), (-3, -4), (-4, -2), (-9, -3)], "from_id long, to_id long"))
    got = dict(map(tuple, components.resolve_aliases(rows).collect()))
    assert {got[i] for i in range(n + 1)} == {n}
    # into the circle -2, -3, -4: the id before the one where the chain entered
    assert {i: got[i] for i in (-1, -2, -3, -4, -9)} == {-1: -4, -2: -4, -3: -2, -4: -3, -9: -2}


def test_leader_groups(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(6)]
    hashes = []
    for i in range(80):
        h = base[i % 6]
        for _ in range(rnd.randrange(0, 6)):
            h ^= 1 << rnd.randrange(64)
        hashes.append(None if i % 17 == 0 else f"{h:016x}")
    want, leaders = [], []
    for i, h in enumerate(hashes):
        g = None if h is None else next((k for k, (lead, _) in enumerate(leaders) if lead is not None and (lead ^ int(h, 16)).bit_count() <= 6), None)
        if g is None:
            leaders.append((None if h is None else int(h, 16), i))
            g = len(leaders) - 1
        want.append(g)
    rows = spark.createDataFrame([(f"t-{i}", i, h) for i, h in enumerate(hashes)], "photo_id string, seq int, phash string")
    got = dict(map(tuple, dupes.near_duplicate_groups(rows).collect()))
    assert [got[f"t-{i}"] for i in range(80)] == want


def test_settings_change_the_fingerprint():
    assert EngineConfig().detection_fingerprint() != EngineConfig(refine_min_confidence=0.3).detection_fingerprint()
    assert EngineConfig().detection_fingerprint() == EngineConfig(similarity=0.5).detection_fingerprint()


def test_faces_are_joined_with_the_numbers_as_stored(spark, tmp_path):
    from kinweave.plans.fixtures import LOOSE, faces

    x = np.random.default_rng(2).normal(size=(40, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = faces(spark, str(tmp_path), LOOSE)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("cast(") < plan.index("Join") and "transform(" not in plan[plan.index("Join") :]
    wide = x.astype(float)
    for r in rows.collect():
        assert np.array_equal(r["descriptor"], wide[r["seed"]] + LOOSE * wide[(r["seed"] * 7 + r["face_idx"] % 4 * 13 + 1) % 40])
