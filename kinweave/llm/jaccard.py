"""Exact join of documents by the Jaccard similarity of their word n-grams, in the metric space of 1 - similarity.

1. Documents with the same set are one class; only classes go on.
2. Every class offers the shingles of its prefix as meeting points: the |x| - ceil(t |x|) + 1 first in an
   order that puts shingles from crowded hash buckets last. Two sets of similarity t or more share a shingle
   of their prefixes. Similar sets differ in size by a factor of t at most: classes meet within bands of sizes, and
   those near a border are replicated to the next band. The smallest class at a meeting point is its pivot. So the
   regions are those of the pivots in a band, and a class lies in the regions of all pivots that it meets.
3. Only outlines go to the regions: shingles counted by hash place, whose L1 distance is a metric and never exceeds the size of the sets'
   difference. Within a region a set is compared with those whose distances to its pivots fall in the window that the triangle inequality leaves.
   Chains of outlines in reach form the groups that go on.
4. Each group's texts are joined exactly. Pivots divide it into Voronoi cells by the distance d = 1 - similarity. A set x is replicated to the cell of p
   when d(x, p) <= d(x, its own pivot) + 1 - t; sets that are far from all pivots are one more cell. Cells are joined recursively, without the
   pivots, which have been compared with all. Sets within 1 - t of a pivot are linked to it at once, and a cell whose sets
   are in one component is done, so a group of copies gives about as many comparisons and links as it has members.
   A region or group with more shingles than one task should hold is cut into blocks, and each pair of blocks is a task.
5. The links' connected components, and the classes, give the result. No pairs within a class or region are listed.

Every pair of sets with similarity t or more has a meeting point and lies in a common band and cell, where its
sizes of intersection and union are computed from 64-bit shingle hashes; so no link between components is lost.

Why not cells over the whole corpus: unrelated texts all have distance about 1 from every pivot, so
the window of step 4 would replicate each of them to all cells. Meeting points find the few pivots that matter to a set.

Defined results: null or empty texts and texts without words have n_shingles 0 and are linked with nothing; a text with fewer words
than n has one shingle. Rows that repeat an id are judged each by its own text. Rows with a null id get a null
component and link nothing. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ._common import U64, hash_words, mix64, shuffle_parts, slices, tidied, write_table

#: Hash buckets in which shingles are counted to tell common from rare ones, and buckets in a row of counts.
BUCKETS, ROW = 1 << 21, 1 << 12
#: Shingles of a region that one task holds; a set counts as SMALL of them at least.
HELD, SMALL = 4_000_000, 64
#: Bytes of texts that are cut into shingles at once, which takes about 40 times as much.
PIECE = 1 << 20
#: Pivots that are taken at a time, and how many times its sets the cells of a region may hold.
PIVOTS, SPREAD = 8, 1.5


class Shingler:
    """Sorted distinct 64-bit hashes of texts' word n-grams."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        words, counts = hash_words(texts)
        if not len(words):
            return [words] * len(texts)
        n = self.n
        size = max(0, len(words) - n + 1)
        grams = np.full(size, n, dtype=U64)
        for j in range(n):
            grams = mix64(grams * U64(0x9E3779B97F4A7C15) + words[j : j + size])
        out, at = [], 0
        for k in counts.tolist():
            if k >= n:
                out.append(np.unique(grams[at : at + k - n + 1]))
            else:  # the whole text is one shingle
                h = np.full(min(k, 1), k, dtype=U64)
                for j in range(k):
                    h = mix64(h * U64(0x9E3779B97F4A7C15) + words[at + j])
                out.append(h)
            at += k
        return out


def signature(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(shingles.tobytes(), seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(43)).astype(np.int64)


def similar(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, t: Fraction):
    """Whether the share of the intersection in the union is t or more, in whole numbers."""
    return inter * t.denominator >= (a + b - inter) * t.numerator


def _ceil(t: Fraction, n: int) -> int:
    return -(-n * t.numerator // t.denominator)


def prefix(shingles: np.ndarray, crowd: np.ndarray, t: Fraction) -> np.ndarray:
    n = len(shingles)
    take = n - _ceil(t, n) + 1
    if take >= n:
        return shingles
    key = crowd[_bucket(shingles)]
    return shingles[np.lexsort((shingles, key))[:take]]


class Region:
    """Sets of one region and the links found among them."""

    def __init__(self, sets: list[np.ndarray], t: Fraction):
        self.t, self.size = t, np.array([len(s) for s in sets], dtype=np.int64)
        _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        spread = np.bincount(inverse)
        owner = np.repeat(np.arange(len(sets)), self.size)
        shared = spread[inverse] > 1
        inverse, owner = inverse[shared], owner[shared]
        order = np.argsort(inverse, kind="stable")
        self.holders = owner[order]  # of each shingle, one after another
        self.starts = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(spread)))]
        cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.rows = [inverse[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.load = np.array([int((self.starts[r + 1] - self.starts[r]).sum()) for r in self.rows])
        self.label = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def overlap(self, i: int) -> np.ndarray:
        """Sizes of the intersections of set i with all sets."""
        row = self.rows[i]
        n = self.starts[row + 1] - self.starts[row]
        at = np.repeat(self.starts[row] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(row) else np.empty(0, dtype=np.int64)
        out = np.bincount(self.holders[at], minlength=len(self.size))
        out[i] = self.size[i]
        return out

    def link(self, i: int, others: np.ndarray) -> None:
        """One link to each other component among the sets that are similar to set i."""
        for j in others:
            if self.label[j] != self.label[i]:
                self.links.append((i, int(j)))
                self.label[self.label == self.label[j]] = self.label[i]

    def compare(self, i: int, members: np.ndarray) -> np.ndarray:
        """Link set i within members, and return the distances."""
        inter = self.overlap(i)[members]
        union = self.size[members] + self.size[i] - inter
        self.link(i, members[inter * self.t.denominator >= union * self.t.numerator])
        return 1 - inter / union

    def join(self) -> list[tuple[int, int]]:
        """Voronoi cells of pivots, joined recursively until what is left of a cell lies in one component."""
        waiting, reach = [np.arange(len(self.size))], 1 - float(self.t) + 1e-9
        while waiting:
            members = waiting.pop()  # two or more
            pivots, far, gaps = [], np.full(len(members), np.inf), []
            while len(pivots) < min(PIVOTS, math.isqrt(len(members) - 1) + 1) and (free := self.unsettled(members, pivots)).any():
                # the most central set first, then the farthest from all pivots; sets of the largest component are settled among themselves
                p = int(members[np.where(free, self.load[members] if not pivots else far, -1).argmax()])
                pivots.append(p)
                gaps.append(self.compare(p, members))
                far = np.minimum(far, gaps[-1])
            rest = ~np.isin(members, pivots)
            if self.unsettled(members, pivots).any():
                cells = self.cells(members, far, gaps, rest, reach)
                # windows that divide nothing: all go on together, without the pivots
                waiting += cells if sum(map(len, cells)) <= SPREAD * rest.sum() else [members[rest]] * int(rest.sum() > 1)
        return self.links

    def unsettled(self, members: np.ndarray, pivots: list[int]) -> np.ndarray:
        """Which members aren't pivots and not in the members' largest component. Before the first pivot, all."""
        labels, at, counts = np.unique(self.label[members], return_inverse=True, return_counts=True)
        if len(labels) == 1:
            return np.zeros(len(members), dtype=bool)
        return ~np.isin(members, pivots) & ((at != counts.argmax()) if pivots else True)

    @staticmethod
    def cells(members: np.ndarray, far: np.ndarray, gaps: list[np.ndarray], rest: np.ndarray, reach: float) -> list[np.ndarray]:
        """The cell of each pivot with the sets near its border, and the sets that are far from all pivots.

        Let x be the one of two similar sets that is nearer to its pivot p. The other is no farther from p than x and 1 - t,
        so than its own nearest pivot and 1 - t. Where x is farther than t from all pivots, so is the other.
        """
        found = [members[rest & (g < 1) & (g <= far + reach)] for g in gaps] + [members[rest & (far >= 1 - reach)]]
        return [c for c in found if len(c) > 1]


def region_links(sets: list[np.ndarray], t: Fraction) -> list[tuple[int, int]]:
    """Links that join all similar sets into components; each is a similar pair."""
    if len(sets) == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if similar(inter, len(sets[0]), len(sets[1]), t) else []
    return Region(sets, t).join()


#: Mean count that a place of a class's outline is to have.
CROWD = 8


def outline_width(band: int, step: float) -> int:
    """Places of the outlines of a band: a power of two."""
    top = math.exp((band + 1) * step) / CROWD
    return 1 << max(4, min(16, math.ceil(math.log2(max(top, 1.0)))))


def outline(shingles: np.ndarray, width: int) -> np.ndarray:
    """Shingles counted by hash place, up to 255. The L1 distance of two outlines is at most the size of the sets' difference."""
    return np.minimum(np.bincount((shingles & U64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8)


def bands(n: int, t: Fraction, step: float) -> list[tuple[int, int]]:
    """(band, 1) of a size, and (next band, 0) where a similar set may be in the next band."""
    own = math.floor(math.log(n) / step + 1e-12)
    near = math.log(n) - math.log(float(t)) + 1e-9 >= (own + 1) * step
    return [(own, 1)] + ([(own + 1, 0)] if near else [])


class Outlines:
    """Chains of sets that may be similar, by their sizes and outlines: no similar pair is in two chains.

    The outlines' L1 distance obeys the triangle inequality and is never above the size of the sets' difference. A set is compared with
    those in its window only: whose distance to each pivot differs from its own by no more than similar sets can differ. Sets of the
    largest chain aren't compared with each other.
    """

    def __init__(self, sizes: np.ndarray, outlines: np.ndarray, t: Fraction):
        self.sizes, self.flat = sizes, outlines.astype(np.int16)
        self.less, self.more = t.denominator - t.numerator, t.denominator + t.numerator
        self.label, self.main = np.arange(len(sizes)), -1

    def allowed(self, i: int, others: np.ndarray) -> np.ndarray:
        """How much the outlines of similar sets of these sizes can differ."""
        return self.less * (self.sizes[others] + self.sizes[i]) // self.more

    def compare(self, i: int, others: np.ndarray) -> np.ndarray:
        """Chain set i with those of the others that are in reach, and return the distances."""
        gap = np.abs(self.flat[others] - self.flat[i]).sum(axis=1, dtype=np.int64)
        old = np.unique(self.label[np.append(others[gap <= self.allowed(i, others)], i)])
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = self.main if self.main in old else self.label[i]
        return gap

    def chains(self) -> np.ndarray:
        every, n = np.arange(len(self.sizes)), len(self.sizes)
        done, pivots = np.zeros(n, dtype=bool), []
        p = int(np.abs(self.flat - np.median(self.flat, axis=0)).sum(axis=1).argmin())  # the most central set
        while True:
            pivots.append(self.compare(p, every))
            done[p] = True
            if len(pivots) == PIVOTS or n <= 4 * PIVOTS:
                break
            p = int(np.where(done, -1, np.min(pivots, axis=0)).argmax())
        gaps = np.array(pivots)
        order = np.argsort(gaps[0], kind="stable")
        first = gaps[0][order]
        widest = int(2 * self.less * self.sizes.max() // self.more)
        labels, counts = np.unique(self.label, return_counts=True)
        self.main = int(labels[counts.argmax()])
        for i in np.flatnonzero(~done).tolist():
            if self.label[i] != self.main:
                window = order[np.searchsorted(first, gaps[0][i] - widest) : np.searchsorted(first, gaps[0][i] + widest, side="right")]
                self.compare(i, window[(np.abs(gaps[:, window] - gaps[:, i : i + 1]) <= self.allowed(i, window)).all(axis=0)])
        return self.label


_FIRST = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])


def _profile(n: int, seed: int):
    """Kind 0: a document with its set's signature and size; kind 1: a row of buckets with their numbers of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = Shingler(n), np.zeros(BUCKETS, dtype=np.int32)
        for whole in batches:
            for batch in slices(whole, 1, PIECE):
                sets = cut(batch.column(1).to_pylist())
                names = [signature(s, seed) if len(s) else (None, None) for s in sets]
                at, more = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
                counts[at] += more.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.binary())], schema=_FIRST)
        packed = np.minimum(counts, 65535).astype("<u2").reshape(-1, ROW)
        some = np.flatnonzero(packed.any(axis=1))
        none = pa.nulls(len(some), pa.int64())
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), dtype=np.int32)), pa.array(some), none, none, none, pa.array([packed[i].tobytes() for i in some], pa.binary())], schema=_FIRST)

    return run


def _crowding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of counts, as a byte a bucket: twice the logarithm. Rows are added as they come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(raw, dtype="<u2").astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([(2 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], names=["id", "crowd"])


def _offers(n: int, seed: int, t: Fraction, step: float, crowd):
    """Meeting points (shingle s, band) of classes; and with s null a class's outline in a band."""
    schema = pa.schema([("s", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("band", pa.int32()), ("home", pa.int32()), ("outline", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(n)
        for whole in batches:
            for batch in slices(whole, 0, PIECE):
                sets = [s for s in cut(batch.column(0).to_pylist()) if len(s)]
                if not sets:
                    continue
                rows = [(signature(s, seed)[0], len(s), band, home, outline(s, outline_width(band, step)).tobytes(), i) for i, s in enumerate(sets) for band, home in bands(len(s), t, step)]
                points = [prefix(s, crowd.value, t).view(np.int64) for s in sets]
                times = [len(points[r[5]]) for r in rows]
                place = pa.array(np.repeat(np.arange(len(rows)), times))
                cols = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:5], [schema.field(i).type for i in range(1, 6)], strict=True)]
                total = sum(times)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([points[r[5]] for r in rows])), cols[0].take(place), pa.nulls(total, pa.int32()), cols[2].take(place), cols[3].take(place), pa.nulls(total, pa.binary())], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), *cols], schema=schema)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], keys: int, bytes_col: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come sorted by their first columns, gathered by these."""
    at, rows = None, []
    for whole in batches:
        for batch in slices(whole, bytes_col, 8 << 20):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != at:
                    if rows:
                        yield at, rows
                    at, rows = row[:keys], []
                rows.append(row[keys:])
    if rows:
        yield at, rows


def _candidates(t: Fraction):
    """Regions (p, band, i, j | node, n, home, outline) to groups of sets that chains of possible similarity join.

    A group's key is a digest of its members, so the same group found in several regions is one.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for _, rows in _gathered(batches, 4, 7):
            rows = list({r[0]: r for r in rows}.values())
            if len(rows) < 2:
                continue
            nodes, sizes = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64)
            label = Outlines(sizes, np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(len(rows), -1), t).chains()
            for x in np.flatnonzero(np.bincount(label) > 1):
                own = np.flatnonzero(label == x)
                key = xxhash.xxh3_64_intdigest(np.sort(np.array([nodes[i] for i in own], dtype=np.int64)).tobytes()) - (1 << 63)
                out += [(key, nodes[i], int(sizes[i])) for i in own]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def _joined(n: int, seed: int, t: Fraction):
    """Groups (key, i, j | node, text), sorted, are gathered and joined exactly."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(n)
        for _, rows in _gathered(batches, 3, 4):
            known: dict[int, np.ndarray] = {}
            for lo in range(0, len(rows), 256):
                part = rows[lo : lo + 256]
                for (node, _), s in zip(part, cut([text for _, text in part]), strict=True):
                    if len(s) and signature(s, seed)[0] == node:  # else a row that repeats the id with another text
                        known[node] = s
            if len(known) > 1:
                ids = list(known)
                found = [(ids[i], ids[j]) for i, j in region_links(list(known.values()), t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    return run


def _cut(rows: DataFrame, keys: list[str], held: int) -> DataFrame:
    """rows (keys, node, n, ...) with i and j: where a group's n sum to more than one task holds, pairs of blocks of it."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("__k"), F.sum(F.greatest("n", F.lit(SMALL))).alias("__load")).where("__k > 1")
    blocks = F.when(F.col("__load") > held, F.ceil(2 * F.col("__load") / F.lit(held))).otherwise(F.lit(1)).cast("int")
    total = total.select(*(F.col(k).alias(f"__{k}") for k in keys), blocks.alias("__blocks"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    own = F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int")
    out = rows.join(total, cond).withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return out.withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: Fraction | str | float = "0.8", id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """A row per row of docs: the id, n_shingles and component_id, the smallest id reachable by links.

    similarity is taken as an exact decimal. Pass it as a string or Fraction.
    """
    t = Fraction(str(similarity)) if not isinstance(similarity, Fraction) else similarity
    if not 0 < t <= 1 or words < 1:
        raise ValueError("similarity must be above 0 and at most 1, and words 1 or more")
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    for seed in range(8):
        first = write_table(source.mapInArrow(tidied(_profile(words, seed)), "kind int, id long, h1 long, h2 long, n long, counts binary"), "profile")
        rows = first.where("kind = 0").select("id", "h1", "h2", "n")
        classes = rows.where("h1 is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"))
        classes = write_table(classes, "classes")
        if classes.count() == classes.select("h1").distinct().count():
            break  # h1 alone names a class; else another seed is tried
    else:
        raise RuntimeError("64-bit names of sets collide under every seed")
    crowd = np.zeros((BUCKETS // ROW, ROW), dtype=np.uint8)
    for r in first.where("kind = 1").select("id", "counts").repartition(parts, "id").mapInArrow(tidied(_crowding), "id long, crowd binary").collect():  # a byte a bucket
        crowd[r["id"]] = np.frombuffer(bytes(r["crowd"]), dtype=np.uint8)
    crowd = spark.sparkContext.broadcast(crowd.ravel())

    # bands are wider than 1 / t, so sizes in reach lie in one band or the next
    step = -3 * math.log(float(t)) if t < 1 else 1.0
    offers = write_table(source.where("id is not null").select("text").mapInArrow(tidied(_offers(words, seed, t, step, crowd)), "s long, node long, n int, band int, home int, outline binary"), "offers")
    meet = offers.where("s is not null").select("s", "band", "home", "node")
    points = meet.groupBy("s", "band").agg(F.min("node").alias("p"), F.max("node").alias("q"), F.max("home").alias("homes")).where("p != q and homes > 0").select(F.col("s").alias("ps"), F.col("band").alias("pb"), "p")
    met = meet.join(points, (F.col("s") == F.col("ps")) & (F.col("band") == F.col("pb"))).select("p", "band", "node").distinct()
    outlines = offers.where("s is null").groupBy("node", "band").agg(F.first("home").alias("home"), F.first("n").cast("long").alias("n"), F.first("outline").alias("outline"))
    met = write_table(met.join(outlines.select("node", "band", "n"), ["node", "band"]).select("p", "band", "node", "n"), "met")
    members = _cut(met, ["p", "band"], held).select("p", "band", "i", "j", "node")
    members = members.join(outlines, ["node", "band"]).select("p", "band", "i", "j", "node", "n", "home", "outline")
    keys = ["p", "band", "i", "j"]
    groups = members.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tidied(_candidates(t)), "key long, node long, n long")
    groups = write_table(groups.distinct(), "groups")
    placed = _cut(groups, ["key"], held).select("key", "i", "j", "node")
    placed = placed.join(classes.select(F.col("h1").alias("node"), "rep"), "node")
    texts = placed.join(source.where("id is not null"), F.col("rep") == F.col("id")).select("key", "i", "j", "node", "text")
    found = texts.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidied(_joined(words, seed, t)), "a long, b long")
    roots = connected_components(found)

    named = roots.join(classes.select(F.col("h1").alias("node"), "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = classes.join(named.join(least, "root").select(F.col("node").alias("h1"), "component"), "h1", "left")
    of_class = of_class.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
