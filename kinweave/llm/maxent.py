"""Language-model scoring with a hashed maximum-entropy model.

The chance of a token is a product of softmaxes over classes, from the whole vocabulary down to the token (tree.py).
Each softmax has weights for hashed features: the previous token (n-gram), the token before it (skip) and both. The COMMON
most frequent training tokens are leaves of their own. All others share classes by their hash, at most FAN ** DEEPEST; within
its class a token has the chance (count + 0.1) / mass, where the mass leaves room for one unknown token. So the chances of all tokens sum to 1.

1. Tokens are counted over all training documents. The counts of frequent tokens and the masses of the classes go to all tasks; both are bounded.
2. Each document is coded once: three bytes a token, and the hashes of its other tokens. The coded documents are a table.
3. Events (previous, token before it, token) are dealt to shards by the previous token. A token that precedes more events than a shard is to
   hold is dealt on by the token before it, and a pair of two such by the document, so no context is hot. A shard holds all
   weights of its features: gradient steps are made where their events are, and the shard then scores its events.
4. Other tokens find their counts in shards of sorted hashes. All sums per document meet as packed arrays.

Defined results: a null or empty text is the end token alone. Equal texts get equal scores, also where ids repeat or are null. With no training
document all counts are 0 and every token has the chance 1 (base and model). A null id is hashed as the empty string. An empty table gives an empty one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree as T
from ._common import U64, fresh_path, hash_words, mix64, shuffle_parts, slices, tidied, write_table

#: Tokens whose counts and places in the tree all tasks hold: about 30 bytes each.
COMMON = 1 << 19
ROUNDS = 4
#: Events of a shard on average, and shards at least.
EVENTS, SHARDS = 200_000, 32
#: Events or lookups that a task gathers before it deals them out, and counts in a shard of lookups.
HELD, LOOKUPS = 2_000_000, 1 << 17
#: Bits of a hash that lead to its place among those of the frequent tokens.
TOP_BITS = 20
#: What packed sums are of.
TREE, LOOKED_UP = 0, 1
#: The hash of the end token.
END = U64(0x5851F42D4C957F2D)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def code(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts as 64-bit hashes, laid end to end with the end token behind each, and where each text starts."""
    words, counts = hash_words(texts)
    tokens = np.insert(words, np.cumsum(counts), END)
    return tokens, np.r_[0, np.cumsum(counts + 1)[:-1]].astype(np.int64)


class Vocabulary:
    """What all tasks hold: frequent tokens by falling count, the classes of the others, and their tree."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, masses: np.ndarray, total: int, distinct: int, events: int):
        order = np.lexsort((hashes, -counts))
        self.counts, self.masses, self.total = counts[order], masses, total
        self.base_mass = total + 0.1 * (distinct + 1) if total else 0.1
        self.depth = len(masses).bit_length() // 3
        by_hash = np.argsort(hashes[order], kind="stable")
        self.hashes, self.ranks = hashes[order][by_hash], by_hash.astype(np.int32)
        self.first = np.searchsorted(self.hashes >> U64(64 - TOP_BITS), np.arange((1 << TOP_BITS) + 1, dtype=U64)).astype(np.int32)
        self.tree = T.Tree(self.counts, masses)
        self.edge = len(self.tree.leaf)  # the context before a text
        end = self.codes(np.array([END]))[0][0]
        seen = np.concatenate([self.counts, masses])
        self.spread = np.ceil(np.r_[seen, seen[end]] / events).astype(np.int64)  # shards that the events behind a token are to fill
        self.shards = max(SHARDS, -(-(total + total // 9) // events))

    def codes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each token, and whether it is a frequent one."""
        known, leaf = np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens), dtype=np.int64)
        left, top = np.arange(len(tokens)), (tokens >> U64(64 - TOP_BITS)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        while len(left := left[at[left] < end[left]]):  # one after another of the few hashes with the same first bits
            place = at[left]
            hit = self.hashes[place] == tokens[left]
            known[left[hit]], leaf[left[hit]] = True, self.ranks[place[hit]]
            left = left[~hit]
            at[left] += 1
        away = np.flatnonzero(~known)
        leaf[away] = len(self.counts) + T.rare_class(tokens[away], self.depth)
        return leaf, known

    def shard(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where an event is trained; doc: a hash of the event's document."""
        lane = np.where(self.spread[one] > 1, mix64(two.astype(U64)) % (4 * self.spread[one]).astype(U64), U64(0))
        both = np.minimum(self.spread[one], self.spread[two])
        lane = mix64(lane + (one.astype(U64) << U64(32))) + np.where(both > 1, doc % both.astype(U64), U64(0))
        return (mix64(lane) % U64(self.shards)).astype(np.int64)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "c"])

    for whole in batches:
        for batch in slices(whole, 0, 8 << 20):
            held.append(code(batch.column(0).to_pylist())[0])
            size += len(held[-1])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 as three bytes each, all low bytes first."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _unplanes(raw: np.ndarray) -> np.ndarray:
    low, mid, high = raw.reshape(3, -1).astype(np.int64)
    return low | mid << 8 | high << 16


_CODED = "id long, out boolean, n_tokens long, n_known long, base double, score double, codes binary, others binary"


def _coded(held):
    """A document's sums over frequent tokens, its codes, and the hashes of its other tokens."""
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = held.value
        logs, masses = np.log10((own.counts + 0.1) / own.base_mass), -np.log10(own.masses)
        for whole in batches:
            for batch in slices(whole, 2, 2 << 20):
                tokens, starts = code(batch.column(2).to_pylist())
                leaf, known = own.codes(tokens)
                ends, n = np.r_[starts[1:], len(tokens)], len(starts)
                doc = np.repeat(np.arange(n), ends - starts)
                frequent = np.flatnonzero(known)
                base = np.bincount(doc[frequent], logs[leaf[frequent]], n).astype(float)  # of no rows, the sums are whole numbers
                away = np.flatnonzero(~known)
                score = np.bincount(doc[away], masses[leaf[away] - len(own.counts)], n).astype(float)
                others, cuts = tokens[away], np.searchsorted(doc[away], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(ends - starts), pa.array(np.bincount(doc, known, n).astype(np.int64)), pa.array(base), pa.array(score),
                    pa.array([_planes(leaf[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([others[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                ], names=names)

    return run


_PACKED, _PACKED_ARROW = "shard long, kind int, first long, blob binary", pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("first", pa.int64()), ("blob", pa.binary())])


def _dealt(shard: np.ndarray, kind: int, first: int, pack: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
    """A blob per shard; pack gets the places of the shard's rows."""
    order = np.argsort(shard, kind="stable")
    names, cuts = np.unique(shard[order], return_index=True)
    ends = np.r_[cuts[1:], len(order)]
    for lo in range(0, len(names), 256):
        blobs = [pack(order[a:b]) for a, b in zip(cuts[lo : lo + 256], ends[lo : lo + 256], strict=True)]
        k = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 256]), pa.array([kind] * k, pa.int32()), pa.array([first] * k, pa.int64()), pa.array(blobs, pa.binary())], schema=_PACKED_ARROW)


def _gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches whose byte column sums to about `most`."""
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, column, most):
            held.append(batch)
            size += batch.column(column).nbytes
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs(refs: np.ndarray) -> bytes:
    """References as runs of consecutive numbers: how many runs, where each begins and its first number."""
    at = np.flatnonzero(np.r_[True, np.diff(refs) != 1])
    return struct.pack("<I", len(at)) + at.astype("<u4").tobytes() + refs[at].astype("<i8").tobytes()


def _unruns(raw: bytes, places: np.ndarray) -> np.ndarray:
    k = struct.unpack_from("<I", raw)[0]
    at, first = np.frombuffer(raw, "<u4", k, 4).astype(np.int64), np.frombuffer(raw, "<i8", k, 4 + 4 * k)
    run = np.searchsorted(at, places, side="right") - 1
    return first[run] + places - at[run]


def _events(held):
    """Coded documents (ref, out, codes) to packed events by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = held.value
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for group in _gathered(batches, 2, 3 * HELD):
            refs = np.concatenate([b.column(0).to_numpy() for b in group])
            out = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in group])
            parts = [_unplanes(np.frombuffer(raw, np.uint8)) for b in group for raw in b.column(2).to_pylist()]
            sizes = np.array([len(p) for p in parts])
            leaf = np.concatenate(parts)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            del parts
            one = np.r_[own.edge, leaf[:-1]]
            one[starts] = own.edge
            two = np.r_[own.edge, one[:-1]]
            two[starts] = own.edge
            doc = np.repeat(np.arange(len(refs)), sizes)
            named = mix64(np.add.reduceat(mix64(leaf.astype(U64)), starts))  # equal texts, equal shards
            shard = own.shard(one, two, named[doc])
            marked, head = leaf | np.where(out[doc], 1 << 23, 0), _runs(refs)

            def pack(x: np.ndarray, one=one, two=two, marked=marked, doc=doc, head=head) -> bytes:
                body = _planes(one[x]) + _planes(two[x]) + _planes(marked[x]) + _planes(np.diff(doc[x], prepend=0))  # documents rise
                return struct.pack("<I", len(x)) + squeeze(head + body)

            yield from _dealt(shard, 0, int(refs[0]), pack)

    return run


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """one, two, leaf with its mark, and the document's reference, of packed events."""
    n = struct.unpack_from("<I", blob)[0]
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    one, two, leaf, doc = (_unplanes(np.frombuffer(raw, np.uint8, 3 * n, len(raw) - 3 * n * (4 - i))) for i in range(4))
    return one, two, leaf, _unruns(raw, np.cumsum(doc))


class _Sums:
    """Sums per document, sent on as packed arrays by the document's part."""

    def __init__(self, parts: int, kind: int, value: str):
        """kind: what the blobs are marked with; value: the type of the sums."""
        self.parts, self.kind, self.value, self.refs, self.values, self.size = parts, kind, value, [], [], 0

    def add(self, refs: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """values: a row for each column."""
        ref, back = np.unique(refs, return_inverse=True)
        self.refs.append(ref)
        self.values.append(np.stack([np.bincount(back, v, len(ref)).astype(float) for v in values]))
        self.size += len(ref)
        if self.size > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ref, values = add_up(self.refs, self.values)
        self.refs, self.values, self.size = [], [], 0
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def pack(x: np.ndarray) -> bytes:
            return struct.pack("<I", len(x)) + squeeze(_runs(ref[x]) + values[:, x].astype(self.value).tobytes())

        yield from _dealt((mix64((ref >> 10).astype(U64)) % U64(self.parts)).astype(np.int64), self.kind, 0, pack)


def _open_sums(kind: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """References, and the score by the tree and of looked-up tokens the number known, the base and the score."""
    n = struct.unpack_from("<I", blob)[0]
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    values = np.zeros((4, n))
    if kind == TREE:
        values[0] = np.frombuffer(raw, "<f4", n, len(raw) - 4 * n)
    else:
        values[1:] = np.frombuffer(raw, "<f8", 3 * n, len(raw) - 24 * n).reshape(3, n)
    return _unruns(raw, np.arange(n)), values


def add_up(refs: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, columns = np.concatenate(refs), np.concatenate(values, axis=1)
    ref, back = np.unique(every, return_inverse=True)
    return ref, np.stack([np.bincount(back, c, len(ref)) for c in columns])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Blobs that come sorted by shard, gathered by it."""
    at, blobs = None, []
    for batch in batches:
        for shard, kind, first, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != at and blobs:
                yield at, blobs
                blobs = []
            at = shard
            blobs.append((kind, first, blob))
    if blobs:
        yield at, blobs


def _trained(held, rounds: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = held.value
        sums = _Sums(parts, TREE, "<f4")
        for _, blobs in _by_shard(batches):
            blobs.sort(key=lambda b: b[1])
            one, two, leaf, ref = (np.concatenate(x) for x in zip(*(_open(b) for _, _, b in blobs), strict=True))
            fits = leaf < 1 << 23
            got = T.train_and_score(own.tree, one, two, leaf & ((1 << 23) - 1), fits, rounds) / np.log(10)
            yield from sums.add(ref, got[None, :])
        yield from sums.flush()

    return run


def _packed_counts(shards: int):
    """Counts (h, c) of tokens that aren't frequent, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from _dealt((mix64(h) % U64(shards)).astype(np.int64), 0, 0, lambda x: h[x].tobytes() + c[x].tobytes())

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()))
            size += len(held[-1][0])
            if size > HELD // 2:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _asked(shards: int):
    """Coded documents (ref, others) to packed lookups by shard: distinct tokens of each document with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, 1, 4 * HELD):
            refs = np.concatenate([b.column(0).to_numpy() for b in group])
            parts = [np.frombuffer(raw, U64) for b in group for raw in b.column(1).to_pylist()]
            h, doc = np.concatenate(parts), np.repeat(np.arange(len(refs)), [len(p) for p in parts])
            if not len(h):
                continue
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            h, ref, k = h[first], refs[doc[first]], np.diff(np.r_[first, len(h)])
            yield from _dealt((mix64(h) % U64(shards)).astype(np.int64), 1, 0, lambda x, h=h, ref=ref, k=k: h[x].tobytes() + ref[x].tobytes() + k[x].tobytes())

    return run


def _looked_up(held, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, sums = held.value.base_mass, _Sums(parts, LOOKED_UP, "<f8")
        at, known, hashes, counts = None, [], np.empty(0, U64), np.empty(0, np.int64)
        for batch in batches:
            for shard, kind, _, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    at, known, hashes, counts = shard, [], np.empty(0, U64), np.empty(0, np.int64)
                if kind == 0:
                    known.append(np.frombuffer(blob, "<i8").reshape(2, -1))
                    continue
                if known:
                    pairs = np.concatenate(known, axis=1)
                    order = np.argsort(pairs[0].view(U64))
                    known, hashes, counts = [], pairs[0].view(U64)[order], pairs[1][order]
                h, ref, k = np.frombuffer(blob, "<i8").reshape(3, -1)
                c = np.zeros(len(h), dtype=np.int64)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, h.view(U64)), len(hashes) - 1)
                    c = np.where(hashes[place] == h.view(U64), counts[place], 0)
                score = k * np.log10(c + 0.1)
                yield from sums.add(ref, np.stack([k * (c > 0), score - k * np.log10(mass), score]))
        yield from sums.flush()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed sums of one part after another to a row per document."""
    for _, blobs in _by_shard(batches):
        refs, values, size = [], [], 0
        for kind, _, blob in blobs:
            ref, own = _open_sums(kind, blob)
            refs.append(ref)
            values.append(own)
            size += len(ref)
            if size > HELD:
                refs, values = ([x] for x in add_up(refs, values))
                size = len(refs[0])
        ref, sums = add_up(refs, values)
        yield pa.RecordBatch.from_arrays([pa.array(ref), *(pa.array(s) for s in sums)], names=["sums_of", "tail", "more_known", "more_base", "more_score"])


def vocabulary(counts: DataFrame, common_tokens: int, events: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of counts (h, c), and the counts of tokens that aren't frequent."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the smallest bar above which common_tokens at most lie, from the numbers of tokens by magnitude
    sizes = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 8).alias("m")).agg(F.count("*").alias("k"), F.min("c").alias("least")).orderBy(F.desc("m")).collect()
    bar, room = (1 << 63) - 1, common_tokens
    for row in sizes:
        room -= row["k"]
        if room < 0:
            break
        bar = row["least"]
    frequent = counts.where(F.col("c") >= bar).toPandas()
    others = counts.where(F.col("c") < bar)
    depth = T.depth_for(v - len(frequent))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(T.rare_class(batch.column(0).to_numpy().view(U64), depth)), pa.array(batch.column(1).to_numpy() + 0.1)], names=["k", "m"])

    sums = others.select("h", "c").mapInArrow(classed, "k long, m double").groupBy("k").agg(F.sum("m").alias("m")).toPandas()  # FAN ** DEEPEST rows at most
    masses = np.full(T.FAN**depth, 0.1)
    masses[sums["k"].to_numpy(dtype=np.int64)] += sums["m"].to_numpy(dtype=float)
    return Vocabulary(frequent["h"].to_numpy(dtype=np.int64).view(U64), frequent["c"].to_numpy(dtype=np.int64), masses, n, v, events), others


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, common_tokens: int = COMMON, events: int = EVENTS) -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents whose crc32(id as text) mod 10 is 0 are held out of training; all are scored.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("out"), F.col(text_col).cast("binary").alias("t"))
    counted = source.where(~F.col("out")).select("t").mapInArrow(tidied(_token_counts), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = write_table(counted, "token-counts")
    words, others = vocabulary(counts, common_tokens, events)
    held = spark.sparkContext.broadcast(words)
    path = fresh_path(spark, "coded")
    # the references are fixed by being written
    source.mapInArrow(tidied(_coded(held)), _CODED).withColumn("ref", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    coded = spark.read.schema(f"{_CODED}, ref long").parquet(path)

    def met(packed: DataFrame, *then: str) -> DataFrame:
        return packed.repartition(parts, "shard").sortWithinPartitions("shard", *then)

    lookups = max(1, -(-others.count() // LOOKUPS))
    asked = others.select("h", "c").mapInArrow(_packed_counts(lookups), _PACKED).unionByName(coded.select("ref", "others").mapInArrow(tidied(_asked(lookups)), _PACKED))
    sums = met(asked, "kind").mapInArrow(tidied(_looked_up(held, parts)), _PACKED)
    if words.total:
        trained = met(coded.select("ref", "out", "codes").mapInArrow(tidied(_events(held)), _PACKED)).mapInArrow(tidied(_trained(held, rounds, parts)), _PACKED)
        sums = sums.unionByName(trained)
    sums = met(sums).mapInArrow(tidied(_added), "sums_of long, tail double, more_known double, more_base double, more_score double")
    out = coded.drop("codes", "others").join(sums, F.col("ref") == F.col("sums_of"), "left")

    def plus(own: str, *rest: str) -> F.Column:
        return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in rest), F.col(own))

    base = plus("base", "more_base") if words.total else F.lit(0.0)
    score = plus("score", "tail", "more_score") if words.total else F.lit(0.0)
    return out.select(F.col("id").alias(id_col), F.col("out").alias("held_out"), "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
