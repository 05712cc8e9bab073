"""Line deduplication over sharded minimal perfect hashes.

1. Every distinct line key of the corpus is counted (one aggregation of 128-bit hashes; each
   document adds at most one to a key, and tasks add up before the shuffle).
2. The distinct hashes are dealt to shards. Each shard builds a minimal perfect hash (levels of
   bit arrays, each holding the keys that are alone in their slot) which numbers its keys 0..n-1 and
   so indexes two compact arrays: 16-bit fingerprints and 8-bit saturated counts.
3. Documents send their hashes, packed by shard, to the shards' arrays and probe them. No line
   text moves, and lines are not joined with lines.

Keys that make up a ten-thousandth of all lines or more (at most 10,000 keys, whatever the corpus)
form one further shard. Its arrays are replicated to all tasks, so that a very common line is never sent. Most keys that
probe it are foreign, so it holds the 128-bit hashes instead of fingerprints; a key that isn't equal goes to its shard as usual.

Defined results: a null or empty text is one empty line. Lines whose key is shorter than
`min_chars` code points always stay. Rows are documents: a row that repeats another counts again. Null ids are allowed.
A text whose every line goes becomes the empty text. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLANKS, U64, digest128, mix64, shuffle_parts, slices, tidied, unused, write_table

#: A key with a larger share of all counted lines than 1 in so many is replicated; so at most this many are.
HOT_KEYS = 10_000
KEYS_PER_SHARD = 32_768
LEAST_SHARDS = 512
SATURATED = 255
#: Bytes of text that are cut into lines at once.
PIECE = 8 << 20


def line_key(line: bytes) -> bytes:
    """The key under which lines count as the same."""
    return line.strip(BLANKS).lower()


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys with fingerprints and counts.

    Level i maps the keys that earlier levels left over to 2n slots; a key alone in its slot
    gets it. The number of a key is the rank of its bit over all levels.
    """

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        self.ranks, total = [], 0
        for bits in levels:
            c = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(c - bits + total)
            total += int(c[-1]) if len(c) else 0

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(a + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ b) % U64(size)).astype(np.int64)

    @staticmethod
    def _print(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix64(b ^ (a << U64(1))) >> U64(48)).astype(np.uint16)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> PerfectHash:
        a, b = h1.astype(np.int64).view(U64), h2.astype(np.int64).view(U64)
        n, left, levels = len(a), np.arange(len(a)), []
        order = np.empty(n, dtype=np.int64)
        done = 0
        while len(left):
            size = 2 * len(left)
            slot = cls._slot(a[left], b[left], len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            placed = alone[slot]
            number = np.cumsum(alone, dtype=np.int64) - 1
            order[left[placed]] = done + number[slot[placed]]
            done += int(placed.sum())
            left = left[~placed]
        prints, held = np.empty(n, dtype=np.uint16), np.empty(n, dtype=np.uint8)
        prints[order] = cls._print(a, b)
        held[order] = np.minimum(counts, SATURATED).astype(np.uint8)
        return cls(levels, prints, held)

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key; a foreign key has that of some other key, or -1."""
        a, b = h1.astype(np.int64).view(U64), h2.astype(np.int64).view(U64)
        number = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for i, bits in enumerate(self.levels):
            if not len(left):
                break
            slot = self._slot(a[left], b[left], i, len(bits))
            hit = bits[slot] == 1
            number[left[hit]] = self.ranks[i][slot[hit]]
            left = left[~hit]
        return number

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The saturated count of each key; 0 for keys that the fingerprints show to be foreign."""
        a, b = h1.astype(np.int64).view(U64), h2.astype(np.int64).view(U64)
        number = self.numbers(h1, h2)
        out = np.zeros(len(a), dtype=np.uint8)
        ok = np.flatnonzero(number >= 0)
        ok = ok[self.prints[number[ok]] == self._print(a[ok], b[ok])]
        out[ok] = self.counts[number[ok]]
        return out

    def pack(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.prints)) + b"".join(struct.pack("<I", len(x)) for x in self.levels)
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.prints.tobytes() + self.counts.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        k, n = struct.unpack_from("<II", raw)
        sizes = struct.unpack_from(f"<{k}I", raw, 8)
        at, levels = 8 + 4 * k, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size))
            at += width
        return cls(levels, np.frombuffer(raw, "<u2", n, at), np.frombuffer(raw, np.uint8, n, at + 2 * n))


class HotLines:
    """The replicated shard: a perfect hash whose slots hold the whole keys, so that no foreign key passes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.blob = PerfectHash.build(h1, h2, np.ones(len(h1))).pack()
        order = np.argsort(PerfectHash.unpack(self.blob).numbers(h1, h2))
        self.h1, self.h2 = h1[order], h2[order]

    def reader(self):
        """A function that says which keys are of these."""
        arrays = PerfectHash.unpack(self.blob)

        def holds(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
            number = arrays.numbers(h1, h2)
            return (number >= 0) & (self.h1[number] == h1) & (self.h2[number] == h2)

        return holds


def _keys_of(texts: list[bytes | None], min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Keys that count, with the row and the line number of each."""
    keys, rows, lines = [], [], []
    for r, text in enumerate(texts):
        for n, line in enumerate((text or b"").split(b"\n")):
            key = line_key(line)
            if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                keys.append(key)
                rows.append(r)
                lines.append(n)
    return keys, np.array(rows, dtype=np.int64), np.array(lines, dtype=np.int32)


def _count_batches(min_chars: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, PIECE):
                keys, rows, _ = _keys_of(batch.column(0).to_pylist(), min_chars)
                if not keys:
                    continue
                h1, h2 = digest128(keys)
                order = np.lexsort((rows, h2, h1))
                h1, h2, rows = h1[order], h2[order], rows[order]
                new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
                in_doc = new_key | np.r_[True, rows[1:] != rows[:-1]]
                starts = np.flatnonzero(new_key)
                n = np.add.reduceat(in_doc.astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(h1[starts]), pa.array(h2[starts]), pa.array(n)], schema=schema)

    return run


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """h1, h2 (the 128-bit hash of a line key) and n, the number of documents that hold it."""
    found = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(tidied(_count_batches(min_chars)), "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    made = PerfectHash.build(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), pdf["n"].to_numpy())
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "kind": [0], "blob": [made.pack()]})


_PROBE = np.dtype([("doc", "<i8"), ("null", "u1"), ("text", "<i8"), ("line", "<i4"), ("h1", "<i8"), ("h2", "<i8")])
_BLOB = "shard long, kind int, blob binary"
_BLOB_ARROW = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
#: Rows in one packed probe at most, which bounds a blob at 300 kB.
PACKED = 8192


def _probe_batches(hot: HotLines | None, shards: int, min_chars: int):
    """Packed probes (kind 1) of the shards, and packed hits (kind 2) of the replicated arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replicated = hot.reader() if hot else None
        for whole in batches:
            for batch in slices(whole, 2, PIECE):
                keys, rows, lines = _keys_of(batch.column(2).to_pylist(), min_chars)
                if not keys:
                    continue
                ids, texts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
                null = np.asarray(ids.is_null())
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
                out = np.empty(len(keys), dtype=_PROBE)
                out["h1"], out["h2"] = digest128(keys)
                out["doc"], out["null"], out["text"], out["line"] = doc[rows], null[rows], texts[rows], lines
                got = []
                if replicated:
                    common = replicated(out["h1"], out["h2"])
                    hits, out = out[common], out[~common]
                    got += [(int(x["h1"][0]) & (shards - 1), 2, x.tobytes()) for i in range(0, len(hits), PACKED) if len(x := hits[i : i + PACKED])]
                shard = out["h1"] & (shards - 1)
                order = np.argsort(shard, kind="stable")
                out, shard = out[order], shard[order]
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
                for start, end in itertools.pairwise([*cuts, len(shard)]):
                    got += [(int(shard[start]), 1, out[i : min(end, i + PACKED)].tobytes()) for i in range(start, end, PACKED)]
                for i in range(0, len(got), 256):
                    part = got[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in part], pa.int64()), pa.array([g[1] for g in part], pa.int32()), pa.array([g[2] for g in part], pa.binary())], schema=_BLOB_ARROW)

    return run


def _answer(min_docs: int):
    """Streams one shard after another: its arrays come first, then the probes."""
    schema = pa.schema([("doc", pa.int64()), ("text", pa.int64()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, None
        for batch in batches:
            for shard, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = blob.as_buffer()
                if kind == 0:
                    at, arrays = shard, PerfectHash.unpack(raw.to_pybytes())
                    continue
                rows = np.frombuffer(raw, dtype=_PROBE)
                if kind == 1:
                    if at != shard:
                        raise RuntimeError(f"probes of shard {shard} came without its arrays")
                    rows = rows[arrays.probe(rows["h1"], rows["h2"]) >= min_docs]
                if len(rows):
                    doc = pa.array(np.ascontiguousarray(rows["doc"]), mask=rows["null"].astype(bool))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(np.ascontiguousarray(rows["text"])), pa.array(np.ascontiguousarray(rows["line"]))], schema=schema)

    return run


@F.pandas_udf(T.BinaryType())
def _without(text: pd.Series, drops: pd.Series) -> pd.Series:
    out = []
    for t, d in zip(text, drops, strict=True):
        t = bytes(t) if t is not None else b""
        if d is not None and len(d):
            gone = set(d.tolist() if hasattr(d, "tolist") else d)
            t = b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in gone)
        out.append(t)
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines gone whose key is in min_docs documents or more.

    The text column holds the remaining lines; n_lines and n_dropped (long) are added, replacing columns of these names.
    """
    if not 1 <= min_docs <= SATURATED:
        raise ValueError(f"min_docs must be from 1 to {SATURATED}, where the counts saturate")
    spark = docs.sparkSession
    counts = write_table(line_counts(docs, text_col, min_chars), "line-counts")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = LEAST_SHARDS
    while shards * KEYS_PER_SHARD < distinct:
        shards *= 2
    common = F.col("n") >= max(min_docs, total // HOT_KEYS + 1)
    hot = counts.where(common).toPandas()  # under HOT_KEYS rows, since each has over total / HOT_KEYS of the lines
    replicated = HotLines(hot["h1"].to_numpy(dtype=np.int64), hot["h2"].to_numpy(dtype=np.int64)) if len(hot) else None
    arrays = counts.where(~common).withColumn("shard", F.col("h1").bitwiseAND(F.lit(shards - 1))).groupBy("shard").applyInPandas(_build_shard, _BLOB)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).cast("binary").alias("t"))
    probes = source.mapInArrow(tidied(_probe_batches(replicated, shards, min_chars)), _BLOB)
    hits = arrays.union(probes).repartition(shuffle_parts(spark), "shard").sortWithinPartitions("shard", "kind").mapInArrow(tidied(_answer(min_docs)), "doc long, text long, line int")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, own, of, gone = unused(docs, "__doc", "__h", "__th", "__drops")
    drops = hits.groupBy(F.col("doc").alias(doc), F.col("text").alias(own)).agg(F.collect_set("line").alias(gone))
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(*names).withColumn(of, F.xxhash64(text))
    joined = plain.join(drops, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(of) == F.col(own)), "left")
    joined = joined.withColumn("n_lines", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    joined = joined.withColumn("n_dropped", F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"))
    kept = _without(text.cast("binary"), F.col(gone)).cast("string")
    return joined.withColumn(text_col, kept).select(*names, "n_lines", "n_dropped")
