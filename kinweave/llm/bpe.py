"""Byte-level BPE encoding and decoding.

A piece (one match of the split pattern) is a linked list of parts. Each neighbouring pair that
some merge joins waits in the bucket of its merge rank, under the pair's left position. A
hierarchical bitmap over the ranks (64 ways a level) tells by find-first-set which bucket is next, so a
merge costs constant time however long the piece is. An entry whose pair has changed since is stale and skipped.

Defined results: a null or empty text has no tokens. Rows that repeat are encoded each. Special
tokens are never recognised: their strings are ordinary text. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, tidied

#: Pieces up to so many characters are remembered; the memory has two halves that hold about so many.
MEMO_CHARS, MEMO_PIECES = 40, 300_000
#: Pieces that share one queue, and bytes of text that are encoded at once.
MERGED, PIECE = 1_000, 2 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of positions by rank below a bitmap of three levels: ranks under 64**3."""

    def __init__(self) -> None:
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        i, j = rank >> 6, rank >> 12
        self.low[i] = self.low.get(i, 0) | 1 << (rank & 63)
        self.mid[j] = self.mid.get(j, 0) | 1 << (i & 63)
        self.top |= 1 << j

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that waits, and its positions in the order of pushing."""
        if not self.top:
            return None
        j = (self.top & -self.top).bit_length() - 1
        word = self.mid[j]
        i = j << 6 | (word & -word).bit_length() - 1
        bits = self.low[i]
        rank = i << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[i] = bits
        if not bits:
            word &= word - 1
            self.mid[j] = word
            if not word:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes and decodes by a table of ranks; `pattern` splits a text before the merges.

    parted: the pattern never matches across the place before a blank (0x20) that no white space follows. Texts are
    then cut there first and the cuts remembered, which spares most of the pattern's work.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, parted: bool = False):
        if any(r >= 1 << 18 for r in ranks.values()):
            raise ValueError("the bitmap holds ranks below 2**18")
        # the library's \s is Unicode's White_Space; so the class is named outright
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.wide = regex.compile(r" \s").search
        self.ranks, self.parted = ranks, parted
        self.tokens = {r: t for t, r in ranks.items()}
        self.names = {r: str(r) for r in ranks.values()}
        self.pairs = np.full(1 << 16, -1, dtype=np.int64)  # ranks by two bytes
        for t, r in ranks.items():
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = r
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.queue = RankQueue()

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each piece. One queue serves them all: merges in different pieces don't touch."""
        ranks, text = self.ranks, b"".join(pieces)
        n = len(text)
        get, push, pop, bucket = ranks.get, self.queue.push, self.queue.pop, self.queue.buckets.get
        sizes = np.array([len(x) for x in pieces])
        whole = np.array([x in ranks for x in pieces])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        link = np.arange(1, n + 1)
        link[starts[whole]] = ends[whole]
        ahead = link.tolist()  # where the part at a position ends
        link = np.arange(-1, n)
        link[starts] = -1
        before = link.tolist()  # where the part before it starts; -1 at a piece's start
        wall = np.zeros(n + 1, dtype=np.uint8)
        wall[ends] = 1
        wall = wall.tobytes()  # 1 where a piece ends
        raw = np.frombuffer(text, np.uint8).astype(np.int64)
        first = np.append(self.pairs[raw[:-1] << 8 | raw[1:]], -1)
        first[ends - 1] = -1
        first[np.repeat(whole, sizes)] = -1
        waits = first.tolist()  # the rank of the pair that starts at a position; -1: none, or no part starts there
        for q in np.flatnonzero(first >= 0).tolist():
            if (waiting := bucket(waits[q])) is None:
                push(waits[q], q)
            else:  # the bitmap knows the bucket
                waiting.append(q)
        while (found := pop()) is not None:
            rank, positions = found
            if len(positions) > 1:
                positions.sort()
            for k, p in enumerate(positions):
                if waits[p] != rank:
                    continue  # stale
                middle = ahead[p]
                end = ahead[middle]
                ahead[p] = end
                waits[middle] = -1
                least = rank + 1
                if wall[end]:
                    waits[p] = -1
                else:
                    before[end] = p
                    r = get(text[p : ahead[end]])
                    if r is None:
                        waits[p] = -1
                    else:
                        waits[p] = least = r
                        if (waiting := bucket(r)) is None:
                            push(r, p)
                        else:
                            waiting.append(p)
                q = before[p]
                if q >= 0:
                    r = get(text[q:end])
                    if r is None:
                        waits[q] = -1
                    elif r != waits[q]:
                        waits[q] = r
                        if (waiting := bucket(r)) is None:
                            push(r, q)
                        else:
                            waiting.append(q)
                        if r < least:
                            least = r
                if least <= rank and k + 1 < len(positions):  # possible only with ranks that no training gives
                    for x in positions[k + 1 :]:
                        push(rank, x)
                    break
        out, p = [], 0
        for end in ends.tolist():
            ids = []
            while p < end:
                q = ahead[p]
                ids.append(ranks[text[p:q]])
                p = q
            out.append(tuple(ids))
        return out

    def cuts(self, text: str) -> list[str]:
        if not self.parted or self.wide(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cuts = [self.cuts(t) for t in texts]
        fresh = self.unknown(chain.from_iterable(cuts))
        split = [self.split(x) if self.parted else (x,) for x in fresh]
        pieces = self.unknown(chain.from_iterable(split))
        memo = self.memo
        for i in range(0, len(pieces), MERGED):
            part = pieces[i : i + MERGED]
            memo.update(zip(part, self.merge([x.encode() for x in part]), strict=True))
        find = memo.__getitem__
        for x, xs in zip(fresh, split, strict=True):
            if len(xs) > 1:
                memo[x] = tuple(chain.from_iterable(map(find, xs)))
        out = [list(chain.from_iterable(map(find, xs))) for xs in cuts]
        if max(map(len, fresh), default=0) > MEMO_CHARS:
            for x in [x for x in chain(fresh, pieces) if len(x) > MEMO_CHARS]:
                memo.pop(x, None)
        if len(memo) > MEMO_PIECES:
            self.old, self.memo = memo, {}
        return out

    def unknown(self, found: Iterable[str]) -> list[str]:
        """What isn't remembered, each once. What only the older memory holds is taken over into the newer one."""
        memo, out = self.memo, []
        recall = self.old.get
        for x in set(found).difference(memo):
            ids = recall(x)
            if ids is None:
                out.append(x)
            else:
                memo[x] = ids
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_held: dict[str, Encoder] = {}


def _encoder(digest: str, ranks: dict[bytes, int], pattern: str, parted: bool) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    if digest not in _held:
        _held.clear()
        _held[digest] = Encoder(ranks, pattern, parted)
    return _held[digest]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, parted: bool = False) -> DataFrame:
    """A row per document: its id, n_tokens and, as asked, ids (array of int) and digests.

    digests adds ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes that decoding gives).
    The rank table has a fixed size, about one megabyte, and is broadcast. The key column keeps its type.
    parted: see Encoder.
    """
    ranks = load_ranks(ranks_path)
    digest = hashlib.sha256(repr((sorted(ranks.items()), pattern, parted)).encode()).hexdigest()
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [("n_tokens", pa.int64())] + ids * [("ids", pa.list_(pa.int32()))] + digests * [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(digest, held.value, pattern, parted)
        coder.memo, coder.old = {}, {}
        names = coder.names
        for whole in batches:
            for batch in slices(whole, 1, PIECE):
                cols: dict[str, list] = {name: [] for name, _ in fields}
                for got in coder.encode_all([(raw or b"").decode("utf-8", "replace") for raw in batch.column(1).to_pylist()]):
                    cols["n_tokens"].append(len(got))
                    if ids:
                        cols["ids"].append(pa.array(got, pa.int32()))
                    if digests:
                        cols["ids_sha256"].append(hashlib.sha256(" ".join(map(names.__getitem__, got)).encode()).hexdigest())
                        cols["decoded_sha256"].append(hashlib.sha256(coder.decode(got)).hexdigest())
                arrays = [batch.column(0)]
                for name, kind in fields:
                    if name == "ids":
                        sizes = [0]
                        for n in cols["n_tokens"]:
                            sizes.append(sizes[-1] + n)
                        arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(cols["ids"])))
                    else:
                        arrays.append(pa.array(cols[name], kind))
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *cols])
        coder.memo, coder.old = {}, {}  # the worker may go on to other work

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long" + ids * ", ids array<int>" + digests * ", ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text_col).cast("binary").alias("__text")).mapInArrow(tidied(run), schema)
