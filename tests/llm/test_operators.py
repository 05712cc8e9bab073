"""The corpus operators against brute force, round trips and held-out labels, and on odd inputs."""

import collections
import hashlib
import itertools
import math
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import bpe, jaccard, line_dedup, matroska, maxent, mixing, perspectives, quality, queries, topk, tree, warc
from kinweave.llm._common import hash_words, mix64

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, rows, schema=DOCS):
    """Documents from (id, text), with columns whose names clash with the operators' own."""
    made = spark.createDataFrame([(i, t, "en", None if i is None or i % 3 == 0 else "s", len(t or "")) for i, t in rows], schema)
    return made.withColumns({c: F.lit(-1) for c in ("n_dropped", "n_shingles", "copy", "node", "p", "band", "key", "h", "id", "__doc", "__h", "__th", "__drops", "__u", "__source", "__table", "__part", "ref", "score", "codes")})


LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\x0b "), (4, "a\n\n a \nA"), (5, LONG), (6, LONG), (None, "a b"), (7, "é" * 500), (7, "é" * 500), (8, "a b"), (9, "<|im_start|> 'll  \x1c")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


# words and lines


@given(st.lists(st.one_of(st.none(), st.binary(max_size=40), st.text(" aAbB\n\x0b\x1cé", max_size=40).map(str.encode)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_word_hashes(texts):
    hashes, counts = hash_words(texts)
    words = [w for t in texts for w in bytes(c + 32 if 65 <= c <= 90 else c for c in t or b"").split()]
    assert counts.tolist() == [len((t or b"").split()) for t in texts]
    names = dict(zip(words, hashes.tolist(), strict=True))
    assert [names[w] for w in words] == hashes.tolist() and len(set(names.values())) == len(names)


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        h1, h2 = rng.integers(-(2**63), 2**63 - 1, (2, n))
        counts = rng.integers(1, 400, n)
        made = line_dedup.PerfectHash.unpack(line_dedup.PerfectHash.build(h1, h2, counts).pack())
        assert (made.probe(h1, h2) == np.minimum(counts, 255)).all()
        assert len(made.counts) == n
        other = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
        assert (made.probe(*other) != 0).mean() < 0.001


def naive_lines(rows, least):
    keys = [[line.strip(" \t\n\x0b\x0c\r").encode().lower() for line in (t or "").split("\n")] for _, t in rows]
    seen = collections.Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        kept = [line for line, k in zip((t or "").split("\n"), ks, strict=True) if seen[k] < least]
        out.append((i, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(spark, least):
    rnd = random.Random(least)
    rows = ODD + [(100 + i, "\n".join(rnd.choice(["x", " X\t", "É", "é", "y y", "", f"own {i}", "z" * 70]) for _ in range(rnd.randrange(6)))) for i in range(60)]
    got = line_dedup.dedup_lines(docs(spark, rows), min_docs=least)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == naive_lines(rows, least)


def test_line_dedup_without_rows(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_counts_of_a_hot_line(spark):
    rows = [(i, f"common\nown {i}\nown {i}") for i in range(300)]
    got = line_dedup.dedup_lines(docs(spark, rows), min_docs=10)
    assert {r["text"] for r in got.collect()} == {f"own {i}\nown {i}" for i in range(300)}


def test_rare_lines_with_the_fingerprint_of_a_hot_one_stay(spark):
    hot, others = [f"hot {i}" for i in range(200)], [f"own {i}" for i in range(1_000_000)]
    made = line_dedup.PerfectHash.build(*line_dedup.digest128(x.encode() for x in hot), np.full(len(hot), 10))
    alike = [others[i] for i in np.flatnonzero(made.probe(*line_dedup.digest128(x.encode() for x in others)))]
    rows = [(i, "\n".join([*hot, f"only {i}"])) for i in range(10)] + [(100, "\n".join([*alike, *hot]))]
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs(spark, rows), min_docs=10).collect()}
    assert alike and got == {i: (200, f"only {i}") for i in range(10)} | {100: (200, "\n".join(alike))}


def test_documents_of_hot_lines_alone(spark):
    got = line_dedup.dedup_lines(docs(spark, [(i, "common\ncommon too") for i in range(30)]), min_docs=10).collect()
    assert [(r["n_dropped"], r["text"]) for r in got] == [(2, "")] * 30


# tokens


def coder(parted):
    return bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, parted)


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("parted", [False, True])
def test_bpe_is_the_library_one(parted):
    mine, theirs, rnd = coder(parted), reference(), random.Random(5)
    for alphabet in ("aaab  \n\t'sxé漢1٣\x1c .,ThE😀\xa0 ", "abcdeth '", " \n"):
        for n in (1, 2, 3, 7, 60, 900):
            texts = ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(150)]
            assert mine.encode_all(texts) == [theirs.encode_ordinary(t) for t in texts]
    for text in ("a" * 50_000, "abcab" * 9_000, LONG):
        assert mine.encode(text) == theirs.encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text.encode()


def test_rank_queue_gives_the_lowest_first():
    queue, rnd, held = bpe.RankQueue(), random.Random(2), collections.defaultdict(list)
    for i in range(3000):
        r = rnd.randrange(1 << 18)
        queue.push(r, i)
        held[r].append(i)
    for r in sorted(held):
        assert queue.pop() == (r, held[r])
    assert queue.pop() is None


def test_merge_order_with_untrained_ranks():
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 9, b"bc": 5, b"abc": 3, b"ca": 4, b"cab": 8, b"abca": 6}
    mine = bpe.Encoder(ranks, r".+")

    def naive(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if piece in ranks:
            return (ranks[piece],)
        while True:
            found = min(((ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks), default=None)
            if found is None:
                return tuple(ranks[p] for p in parts)
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 8):
        pieces = [bytes(p) for p in itertools.product(b"abc", repeat=n)]
        assert mine.merge(pieces) == [naive(p) for p in pieces]


def test_bpe_documents(spark):
    got = bpe.encode_documents(docs(spark, ODD), RANKS, public_tokenizers.PATTERN, digests=True, parted=True).collect()
    theirs = reference()
    want = sorted(((i, theirs.encode_ordinary(t or "")) for i, t in ODD), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
    texts = collections.Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert collections.Counter(r["decoded_sha256"] for r in got) == texts
    assert bpe.encode_documents(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# media


@given(st.binary(max_size=200).flatmap(lambda b: st.integers(0, 300).map(lambda n: b * n)))
@settings(max_examples=60, deadline=None)
def test_matroska_round_trip(raw):
    payload = matroska.payload_of(raw)
    stored = matroska.mux(payload)
    media = matroska.parse(stored)
    assert len(payload) % 192 == 0 and payload.startswith(raw) and matroska.samples(stored, media) == payload
    assert [p.timestamp for p in media.packets] == [24 * i for i in range(len(payload) // 192)]
    assert {(c.position, c.time) for c in media.cues} == set(media.clusters)


@given(st.lists(st.integers(0, 3000), min_size=1, max_size=40), st.sampled_from([matroska.XIPH, matroska.EBML_LACING, matroska.FIXED]))
@settings(max_examples=150, deadline=None)
def test_lacing_round_trip(sizes, kind):
    sizes = [sizes[0]] * len(sizes) if kind == matroska.FIXED else sizes
    frames = [bytes([i % 251]) * n for i, n in enumerate(sizes)]
    raw = matroska.lace(frames, kind)
    got, at = matroska.sizes_of_laces(raw, 0, len(raw), kind)
    assert got == sizes and raw[at:] == b"".join(frames)


def test_matroska_of_others():
    block = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x82\x00\x05\x00data"))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.uint(matroska.TIMESTAMP, 7) + matroska.element(matroska.VOID, b"..") + block
    raw = matroska.element(matroska.EBML, matroska.text(matroska.DOC_TYPE, "webm")) + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + cluster
    media = matroska.parse(raw)
    assert media.doc_type == "webm" and [(p.track, p.cluster, p.timestamp, raw[p.start : p.start + p.size], p.keyframe) for p in media.packets] == [(2, 0, 12, b"data", True), (2, 1, 12, b"data", True)]
    with pytest.raises(ValueError, match="longer|short|no variable"):
        matroska.parse(matroska.mux(matroska.payload_of(b"x" * 900))[:-30])


def test_matroska_documents(spark):
    stored = matroska.store_texts(docs(spark, ODD))
    rows = matroska.read_media(stored).collect()
    want = collections.Counter()
    for i, t in ODD:
        p = matroska.payload_of((t or "").encode())
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    packets = matroska.packet_table(stored.where("doc_id = 5")).collect()
    assert len(packets) == -(-len(LONG) // 192) and packets[1]["byte_start"] == packets[0]["byte_start"] + 192
    assert matroska.read_media(matroska.store_texts(docs(spark, []))).count() == 0


# archives


def test_warc(spark):
    rnd = random.Random(9)
    rows = [(i, f"http://x/{i}\r\nX: y" if i % 7 == 0 else None, None if i % 11 == 0 else "".join(rnd.choice("ab\x1f\x8b\x08é") for _ in range(rnd.choice([0, 3, 3000]))) if i % 5 else "same page") for i in range(400)] + [(None, None, "same page"), (None, "u", "only me")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    files = warc.write_warc(pages.repartition(3))
    got = warc.read_warc(files, split_bytes=1000).collect()
    groups = collections.defaultdict(list)
    for i, _, t in rows:
        groups[(t or "").encode()].append(i)
    want = collections.Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        head = max((x for x in groups[raw] if x is not None), default=None)
        refers = None if head is None or i == head else head
        want[i, len(raw), warc.base32_sha1(raw), "response" if refers is None else "revisit", refers, raw if refers is None else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0
    assert {r["record_type"] for r in warc.read_warc(warc.write_warc(pages, min_bytes=1 << 20)).collect()} == {"response"}


def test_members_that_hold_the_magic(tmp_path):
    import pyarrow as pa

    payload = b"".join(warc.record(i, "", os.urandom(50), "X", None, "d") for i in range(5))  # archives within a record
    raw = b"".join(warc.record(i, "u", payload + os.urandom(3000), "X", None, "d") for i in range(30))
    (tmp_path / "a.gz").write_bytes(raw)
    for size in (1, 97, 4096, len(raw)):
        if size == 1:
            continue
        found = []
        with pa.OSFile(str(tmp_path / "a.gz")) as f:
            for lo in range(0, len(raw), size):
                found += [at for at, _ in warc.members(f, lo, lo + size)]
        assert len(found) == 30 and found == sorted(set(found))


def test_stores_by_their_spark_names():
    assert warc.open_store("/a/b")[1] == "/a/b" and warc.open_store("file:/a/b")[1] == "/a/b" and warc.open_store("file:///a/b")[1] == "/a/b"
    assert warc.open_store("dbfs:/a/b")[1] == "/dbfs/a/b"


# search


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (300, 8)), np.repeat(rng.normal(0, 1, (1, 8)), 60, axis=0), 1e6 * rng.normal(0, 1, (5, 8))])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(900, None), (902, [float("nan")] * 8), (904, [None] * 8), (906, [1.0] * 3), (908, [2.0] * 3), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = {}
    for r in topk.exact_top_k(table, F.col("id") % 2 == 0, 7, shard_rows=50, query_rows=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(64 * v) for v in p] for i, p in rows if i is not None and p and all(v is not None and math.isfinite(v) for v in p)}
    for q, p in whole.items():
        if q % 2 == 0:
            best = sorted(((-sum(a * b for a, b in zip(p, o, strict=True)), i) for i, o in whole.items() if i != q and len(o) == len(p)))[:7]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.exact_top_k(table.limit(0), F.col("id") % 2 == 0).count() == 0


@pytest.mark.parametrize(("size", "dim", "n"), [(4e6, 16, 40), (3e6, 2000, 60), (1e7, 20, 30)])
def test_top_k_of_large_components(spark, size, dim, n):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(rng.normal(0, size, (n, dim)))]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 2 == 0, 5, shard_rows=16).collect()}
    whole = [[math.floor(64 * v) for v in p] for _, p in rows]
    for q in range(0, n, 2):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(n) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]


def test_top_k_beyond_63_bits(spark):
    def best(rows, k=2):
        return [tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k).orderBy("rank").collect()]

    assert best([(0, [1.0]), (1, [3e6]), (2, [2e6])]) == [(0, 1, 1, 12_288_000_000), (0, 2, 2, 8_192_000_000)]
    # sums that pass 2 ** 63 on their way, and products whose last bits decide
    big = 2.0**40
    assert best([(0, [big, big, 1.0]), (1, [big, -big, 3.0]), (2, [big, -big, 5.0]), (3, [-big, -big, 9.0])]) == [(0, 1, 2, 64 * 64 * 5), (0, 2, 1, 64 * 64 * 3)]
    with pytest.raises(Exception, match="fit a long"):
        best([(0, [1e200]), (1, [1e200])])
    assert best([(0, [1e200, 1.0]), (1, [0.0, 1.0]), (2, [-1e300, 0.0])], 1) == [(0, 1, 1, 4096)]


@given(st.integers(0, 5), st.integers(1, 60), st.sampled_from([1.0, 1e5, 1e12, 1e160]))
@settings(max_examples=40, deadline=None)
def test_ball_tree_search_is_exact(seed, n, size):
    rng = np.random.default_rng(seed)
    points = np.floor(size * rng.normal(0, 1, (n, 3)))
    tree_ = topk.BallTree.unpack(topk.BallTree(points, np.arange(n), leaf=4).pack())
    for q, ids, scores in topk.search(tree_, points[:5], np.arange(min(5, n)), [None] * 5, 3):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(points[q], p, strict=True)), i) for i, p in enumerate(points) if i != q)[:3]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == want


# similarity


def naive_components(rows, n, t):
    t, sets = Fraction(t), {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))) if words else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both * t.denominator >= (len(sets[a]) + len(sets[b]) - both) * t.numerator:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts(seed, n=90):
    rnd = random.Random(seed)
    base = [[f"v{rnd.randrange(400)}" for _ in range(rnd.choice([2, 5, 30, 80]))] for _ in range(6)]
    out = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(400)}"
        out.append((i, " ".join(words).upper() if i % 4 == 0 else "  ".join(words)))
    return out


@pytest.mark.parametrize(("n", "t", "held"), [(3, "0.9", jaccard.HELD), (2, "0.6", jaccard.HELD), (1, "0.5", 600), (5, "0.8", 300)])
def test_jaccard_components(spark, n, t, held):
    rows = [(i, x) for i, x in ODD if i not in (None, 7)] + [(1000 + i, x) for i, x in near_texts(n)]
    got = jaccard.near_duplicates(docs(spark, rows), n, t, held=held).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == naive_components(rows, n, t)


def test_jaccard_of_repeated_and_null_ids(spark):
    got = jaccard.near_duplicates(docs(spark, ODD), 3, "0.9").collect()
    assert sorted((r["component_id"] for r in got if r["doc_id"] == 7)) == [7, 7]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert len(got) == len(ODD) and jaccard.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_cells_lose_no_link(seed, monkeypatch):
    divided, cells = [], jaccard.Region.cells
    monkeypatch.setattr(jaccard.Region, "cells", staticmethod(lambda *a: divided.append(cells(*a)) or divided[-1]))
    rnd, t = random.Random(seed), Fraction(8, 10)
    sets = [np.unique(np.array([rnd.randrange(60 * (1 + i % 5), 60 * (2 + i % 5)) for _ in range(40)], dtype=np.uint64)) for i in range(150)]
    sets += [np.unique(np.r_[s[: len(s) - 1], np.uint64(9000 + i)]) for i, s in enumerate(sets[:60])]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in jaccard.region_links(sets, t):
        assert jaccard.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), t)
        root[find(a)] = find(b)
    for a, b in itertools.combinations(range(len(sets)), 2):
        if jaccard.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), t):
            assert find(a) == find(b)


def test_cells_run_on_groups_of_any_size(monkeypatch):
    calls, cells = [], jaccard.Region.cells
    monkeypatch.setattr(jaccard.Region, "cells", staticmethod(lambda *a: calls.append(len(a[0])) or cells(*a)))
    rng = np.random.default_rng(1)
    for n in (12, 40, 200):
        families = [rng.integers(0, 1 << 40, 60).astype(np.uint64) for _ in range(max(1, n // 5))]
        sets = [np.unique(np.r_[families[i % len(families)][rng.random(60) < 0.8], rng.integers(0, 1 << 40, 3).astype(np.uint64)]) for i in range(n)]
        calls.clear()
        jaccard.region_links(sets, Fraction(9, 10))
        assert calls


@pytest.mark.parametrize("seed", range(6))
def test_windows_lose_no_pair_in_reach(seed):
    rnd, t = random.Random(seed), Fraction(rnd_t := [9, 8, 6][seed % 3], 10)
    base = [[rnd.randrange(1 << 30) for _ in range(rnd.choice([20, 60]))] for _ in range(5)]
    sets = []
    for _ in range(120):
        s = list(rnd.choice(base))
        for _ in range(rnd.randrange(12)):
            s[rnd.randrange(len(s))] = rnd.randrange(1 << 30)
        sets.append(np.unique(np.array(s, dtype=np.uint64)))
    outlines = np.stack([jaccard.outline(s, 16) for s in sets])
    sizes = np.array([len(s) for s in sets])
    label = jaccard.Outlines(sizes, outlines, t).chains()
    assert len(set(label.tolist())) > 1
    for a, b in itertools.combinations(range(len(sets)), 2):
        gap = int(np.abs(outlines[a].astype(int) - outlines[b]).sum())
        if gap * (10 + rnd_t) <= (10 - rnd_t) * int(sizes[a] + sizes[b]):
            assert label[a] == label[b]
        if jaccard.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), t):
            assert label[a] == label[b]


def test_a_region_of_very_many_near_copies_ends():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 58).astype(np.uint64)
    sets = []
    for _ in range(20_000):  # three shingles of each are its own
        s = base.copy()
        s[rng.integers(0, 58)] = rng.integers(0, 1 << 40)
        sets.append(np.unique(s))
    outlines = np.stack([jaccard.outline(s, 16) for s in sets])
    assert len(set(jaccard.Outlines(np.array([len(s) for s in sets]), outlines, Fraction(9, 10)).chains().tolist())) == 1
    assert len(jaccard.region_links(sets, Fraction(9, 10))) == len(sets) - 1


# language model


def test_language_model(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["the cat sat", "a dog ran", "THE end", f"rare{rnd.randrange(2000)}"]) for _ in range(rnd.randrange(1, 40)))) for i in range(400)] + [(i, t) for i, t in ODD]
    got = maxent.score_documents(docs(spark, [(None if i is None else i + (1000 if (i, t) in ODD else 0), t) for i, t in rows]), common_tokens=50, events=2000).collect()
    rows = [(None if i is None else i + (1000 if (i, t) in ODD else 0), t) for i, t in rows]

    def out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0

    def tokens(t):
        return [*(t or "").encode().lower().split(), b" "]

    counts = collections.Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append((out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))))
    seen = collections.defaultdict(list)
    for r in got:
        assert r["train_tokens"] == n
        seen[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]))
    for i in want:
        for a, b in zip(sorted(want[i]), sorted(seen[i]), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_chances_of_all_tokens_sum_to_one():
    rng = np.random.default_rng(0)
    for k, masses, seen in ((300, 64, 900), (1, 8, 50), (0, 8, 30), (9, 8, 200)):
        made = tree.Tree(np.sort(rng.integers(1, 50, k))[::-1], rng.random(masses) + 0.1)
        leaves = np.arange(len(made.leaf))
        one, two = np.r_[rng.integers(0, 9, seen), np.full(len(leaves), 3)], np.r_[rng.integers(0, 9, seen), np.full(len(leaves), 5)]
        events, fits = np.r_[(one[:seen] * 7) % len(leaves), leaves], np.r_[np.full(seen, True), np.full(len(leaves), False)]
        got = np.exp(tree.train_and_score(made, one, two, events, fits, 4))[seen:]
        assert got.sum() == pytest.approx(1, abs=1e-4)
        untrained = np.exp(tree.train_and_score(made, one, two, events, fits & False, 4))[seen:]
        assert got[21 % len(leaves)] > untrained[21 % len(leaves)] or len(leaves) < 9
        assert untrained.sum() == pytest.approx(1, abs=1e-4)


def naive_training(made, events, rounds):
    """The chances of the events (one, two, leaf, fits) of a shard, event by event and feature by feature."""

    def path(leaf):
        out, node, child = [], int(made.leaf[leaf]), int(made.leaf_child[leaf])
        while node >= 0:
            out.append((node, child))
            node, child = int(made.up[node]), int(made.turn[node])
        return out

    def mixed(x):
        return int(mix64(np.array([x], dtype=np.uint64))[0])

    def slots(one, two, node):
        for x, salt in ((one, 0xA0761D6478BD642F), (two, 0xE7037ED1A0B428DB), (one << 32 | two, 0x8EBC6AF09C88C6E3)):
            yield ((mixed(x ^ salt) + (node + 1) * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 % (1 << 64)) >> (64 - tree.TABLE)

    weights, seen = collections.defaultdict(lambda: [0.0] * 8), collections.defaultdict(lambda: [1.0] * 8)

    def chances(one, two, node):
        z = [float(made.prior[node][j]) + sum(weights[s][j] for s in slots(one, two, node)) for j in range(8)]
        total = sum(math.exp(max(x, -700)) for x in z)
        return [math.exp(max(x, -700)) / total for x in z]

    for r in range(rounds):
        slope = collections.defaultdict(lambda: [0.0] * 8)
        for one, two, leaf, fits in events:
            if fits and mixed((mixed((one << 32 | two) ^ 0x8EBC6AF09C88C6E3) + leaf) % (1 << 64)) % rounds == r:
                for node, child in path(leaf):
                    for j, p in enumerate(chances(one, two, node)):
                        for s in slots(one, two, node):
                            slope[s][j] += (j == child) - p
        for s, g in slope.items():
            for j in range(8):
                seen[s][j] += g[j] ** 2
                weights[s][j] += tree.RATE * g[j] / math.sqrt(seen[s][j])
    return [sum(math.log10(chances(one, two, node)[child]) for node, child in path(leaf)) for one, two, leaf, _ in events]


def test_scores_are_the_naive_ones(spark):
    rnd = random.Random(16)
    rows = [(i, " ".join(rnd.choice(["the cat sat on", "a dog ran", "THE end", f"rare{rnd.randrange(60)}"]) for _ in range(rnd.randrange(1, 9)))) for i in range(70)] + [(200, None), (201, "new words only"), (202, "the the the the the")]
    got = {r["doc_id"]: r["score"] for r in maxent.score_documents(docs(spark, rows), common_tokens=20, events=60).collect()}
    tokens = {i: maxent.code([(t or "").encode()])[0] for i, t in rows}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = collections.Counter(int(h) for i, ts in tokens.items() if i not in held for h in ts)
    sizes = collections.Counter(math.floor(math.log2(c) * 8) for c in counts.values())
    some, bar = 0, None
    for m in sorted(sizes, reverse=True):
        some += sizes[m]
        if some > 20:
            break
        bar = m
    frequent = [h for h, c in counts.items() if math.floor(math.log2(c) * 8) >= bar]
    depth = tree.depth_for(len(counts) - len(frequent))
    masses = [0.1] * 8**depth

    def classed(h):
        return int(tree.rare_class(np.array([h], dtype=np.uint64), depth)[0])

    for h, c in counts.items():
        if h not in frequent:
            masses[classed(h)] += c + 0.1
    words = maxent.Vocabulary(np.array(frequent, dtype=np.uint64), np.array([counts[h] for h in frequent]), np.array(masses), sum(counts.values()), len(counts), 60)
    order = sorted(frequent, key=lambda h: (-counts[h], h))
    leaf = {h: order.index(h) if h in frequent else len(order) + classed(h) for ts in tokens.values() for h in map(int, ts)}
    shards, want = collections.defaultdict(list), collections.defaultdict(float)
    for i, ts in tokens.items():
        path = [words.edge, words.edge, *(leaf[int(h)] for h in ts)]
        named = sum(int(x) for x in mix64(np.array(path[2:], dtype=np.uint64))) % (1 << 64)
        for (two, one, own), h in zip(zip(path, path[1:], path[2:], strict=False), ts, strict=True):
            at = words.shard(np.array([one]), np.array([two]), mix64(np.array([named], dtype=np.uint64)))[0]
            shards[int(at)].append((i, (one, two, own, i not in held)))
            if int(h) not in frequent:
                want[i] += math.log10((counts[int(h)] + 0.1) / masses[classed(int(h))])
    assert len({s for s in shards}) > 5 and (words.spread > 1).any()
    for events in shards.values():
        for (i, _), x in zip(events, naive_training(words.tree, [e for _, e in events], maxent.ROUNDS), strict=True):
            want[i] += x
    assert got == pytest.approx(dict(want), abs=1e-3)


def test_rare_tokens_follow_their_context(spark):
    rnd = random.Random(8)
    pairs = [(f"first{i}", f"second{i}") for i in range(3000)]
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 10]
    rows = [(i, " ".join(f"{a} {b}" for a, b in rnd.sample(pairs, 20))) for i in ids[:3000]]
    held = [i for i in range(9000) if i not in set(ids)][:40]
    for k, i in enumerate(held):
        own = rnd.sample(pairs, 50) if k % 2 == 0 else own
        seconds = [own[j - 1][1] if k % 2 else own[j][1] for j in range(50)]
        rows.append((i, " ".join(f"{a} {b}" for (a, _), b in zip(own, seconds, strict=True))))
    got = {r["doc_id"]: r for r in maxent.score_documents(docs(spark, rows)).collect()}
    for right, wrong in zip(held[::2], held[1::2], strict=True):
        assert got[right]["base_score"] == pytest.approx(got[wrong]["base_score"])
        assert got[right]["score"] > got[wrong]["score"] + 25


def test_language_model_without_training(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert {(r["base_score"], r["score"]) for r in maxent.score_documents(docs(spark, [(i, "a b c") for i in held])).collect()} == {(0, 0)}


def test_language_model_without_rows(spark):
    assert maxent.score_documents(docs(spark, [])).count() == 0


# quality, mixing, perspectives


def test_quality_on_labelled_texts(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    got = quality.classify(spark.read.parquet(f"{path}/documents.parquet")).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in got}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.99
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) >= 0.9


def test_figures_of_very_long_words():
    for word, chars in [(b"a" * 70_000, 70_000), ("é".encode() * 70_000, 70_000), (b"aB" * 70_000, 140_000)]:
        figures = quality.measure([word, b"a b", word + b" x"])[0]
        assert figures["mean"].tolist() == [chars, 1, (chars + 1) / 2] and figures["letters"][0] == 1


def kinds_of_junk(seed, n=20_000):
    """Votes of five labellers on fine texts and three kinds of junk, each found by one to three of them.

    The last labeller is alone in finding its kind, so nobody can contradict it, and it rarely errs.
    """
    rng = np.random.default_rng(seed)
    finds = np.array([[0.01, 0.01, 0.02, 0.01, 0.001], [0.95, 0.9, 0.02, 0.01, 0.001], [0.01, 0.01, 0.9, 0.8, 0.001], [0.01, 0.01, 0.02, 0.01, 0.97]])
    truth = rng.choice(4, n, p=[0.8, 0.1, 0.06, 0.04])
    votes = (rng.random((n, 5)) < finds[truth]).astype(int)
    votes[rng.random(votes.shape) < 0.1] = quality.ABSTAIN
    return truth, votes


def test_weak_model_finds_kinds_of_junk_and_accuracies():
    truth, votes = kinds_of_junk(3)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.WeakModel(patterns, counts)
    assert model.prior == pytest.approx(0.2, abs=0.03)
    told = (votes != quality.ABSTAIN).any(axis=1)
    assert ((model.posterior(votes) >= 0.5) == (truth > 0))[told].mean() > 0.94  # a lone objection can be an error or junk
    for j, share in model.accuracy(patterns, counts).items():
        gave = votes[:, j] != quality.ABSTAIN
        assert share == pytest.approx(((votes[:, j] == 1) == (truth > 0))[gave].mean(), abs=0.05)


def test_weak_model_is_plain_em_and_its_density_rises():
    _, votes = kinds_of_junk(4, 300)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.WeakModel(patterns, counts)
    assert all(b >= a - 1e-9 * abs(a) for a, b in itertools.pairwise(model.densities))
    post = naive_em(votes.tolist(), model.rounds)
    assert model.posterior(votes) == pytest.approx([sum(p[1:]) for p in post], abs=1e-9)


def naive_em(votes, rounds):
    """The chances of all classes for each text, text by text."""
    k = len(votes[0])
    post = []
    for v in votes:
        own = [j for j in range(k) if v[j] == 1]
        start = [float(not own)] + [float(j in own) / max(1, len(own)) for j in range(k)]
        post.append([0.98 * x + 0.02 / (k + 1) for x in start])
    for _ in range(rounds):
        share = [sum(p[c] for p in post) / len(post) for c in range(k + 1)]
        bad = [[sum(p[c] for p, v in zip(post, votes, strict=True) if v[j] == 1) + 0.5 for j in range(k)] for c in range(k + 1)]
        good = [[sum(p[c] for p, v in zip(post, votes, strict=True) if v[j] == 0) + 0.5 for j in range(k)] for c in range(k + 1)]
        post = []
        for v in votes:
            chance = []
            for c in range(k + 1):
                x = share[c]
                for j in range(k):
                    p = bad[c][j] / (bad[c][j] + good[c][j])
                    x *= p if v[j] == 1 else 1 - p if v[j] == 0 else 1
                chance.append(x)
            post.append([x / sum(chance) for x in chance])
    return post


def naive_figures(text):
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    ends = {c for c in range(33, 127) if not chr(c).isalnum()}

    def chars(w):
        return sum(b & 0xC0 != 0x80 for b in w)

    def share(test):
        return sum(map(test, words)) / n

    bare = [tuple((i, b + 32 if 65 <= b <= 90 else b) for i, b in enumerate(w) if b not in quality.AROUND) for w in words]

    def run():
        return max((len(list(g)) for _, g in itertools.groupby(bare)), default=0)

    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for w in words for b in w)
    return {
        "words": len(words), "lines": len(lines), "mean": share(chars), "caps": share(lambda w: any(65 <= b <= 90 for b in w) and not any(97 <= b <= 122 for b in w) and chars(w) > 1),
        "bang": share(lambda w: len(w) > 1 and w[-1] in b"!?" and w[-2] in b"!?"), "odd": share(lambda w: chars(w) > 1 and any(b in quality.ODD for b in w[-3:])), "bars": share(lambda w: w in (b"|", b">")),
        "short": share(lambda w: chars(w) - (w[-1] in ends) <= 3), "repeat_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "distinct": len(set(bare)) / n,
        "top": max(collections.Counter(bare).values(), default=0) / n, "pair": max(collections.Counter(itertools.pairwise(bare)).values(), default=0) / n, "run": run(),
        "stops": share(lambda w: w[-1] in b".!?"), "letters": letters / max(1, chars(text)),
    }


def naive_features(text):
    figures, row = naive_figures(text), collections.Counter()
    for name, steps in quality._STEPS.items():
        row[zlib.crc32(f"{name}>{sum(figures[name] > s for s in steps)}".encode()) % quality.WIDTH] += 1
    for w in text.split():
        upper, small, letters = sum(65 <= b <= 90 for b in w), sum(97 <= b <= 122 for b in w), sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in w)
        case = (0 if upper == 0 else 2 if small == 0 and upper > 1 else 1) + 3 * ((letters == 0) + 2 * (48 <= w[0] <= 57))
        ends = [b if 33 <= b < 127 and not chr(b).isalnum() else 0 for b in w]
        tail = ends[-1] + 256 * (ends[-2] if len(w) > 1 and ends[-1] else 0)
        row[int(mix64(np.array([case * 65536 + tail], dtype=np.uint64))[0] % np.uint64(quality.WIDTH))] += 2 / len(text.split())
    return row


def test_quality_is_the_naive_one(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    table = table.unionByName(spark.createDataFrame([(None, "a b"), (None, "a b"), (-1, None), (-2, " \n")], "doc_id long, text string"))
    got = sorted(((r["text"] or "", r["quality_score"], r["keep"]) for r in quality.classify(table).collect()), key=repr)
    texts = [(r["text"] or "").encode() for r in table.collect()]
    voted = [t for t in texts if t.split()]
    votes = [[int(vote({k: np.array([v]) for k, v in naive_figures(t).items()})[0]) for _, vote in quality.LABELLERS] for t in voted]
    patterns, counts = np.unique(np.array(votes), axis=0, return_counts=True)
    post = [sum(p[1:]) for p in naive_em(votes, quality.WeakModel(patterns, counts).rounds)]
    every = {(r["doc_id"], (r["text"] or "").encode()) for r in table.collect()}  # both samples hold all rows here, and the rows that repeat once
    chance = dict(zip(voted, post, strict=True))
    rows = [(naive_features(t), 1 - chance[t]) for _, t in sorted(every, key=repr) if t.split()]
    fine, junk = sum(g for _, g in rows), sum(1 - g for _, g in rows)
    weights, seen, bias, seen_bias = collections.defaultdict(float), collections.defaultdict(lambda: 1e-8), 0.0, 1e-8
    slots = {s for f, _ in rows for s in f}
    for _ in range(300):
        slope, total = collections.defaultdict(float), 0.0
        for f, good in rows:
            x = (0.5 * good / fine + 0.5 * (1 - good) / junk) * (1 / (1 + math.exp(-max(-30, min(30, bias + sum(weights[s] * v for s, v in f.items()))))) - good)
            total += x
            for s, v in f.items():
                slope[s] += x * v
        for s in slots:
            g = slope[s] + 1e-4 * weights[s]
            seen[s] += g * g
            weights[s] -= 0.5 * g / math.sqrt(seen[s])
        seen_bias += total * total
        bias -= 0.5 * total / math.sqrt(seen_bias)
    want = []
    for t in texts:
        score = 1 / (1 + math.exp(-bias - sum(weights[s] * v for s, v in naive_features(t).items()))) if t.split() else 0.0
        want.append((t.decode(), score, bool(t.strip()) and score >= 0.4))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6) and a[2] == b[2]


def test_quality_of_odd_texts(spark):
    got = quality.classify(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(not r["keep"] for r in got if not (r["text"] or "").strip())
    assert quality.classify(docs(spark, [])).count() == 0
    assert all(quality.unpack(p) == v for v in [(1, 0, -1, 1, 0, -1, 1, 0, -1, 1)] for p in [sum((x + 1) * 3 ** (9 - i) for i, x in enumerate(v))])


def test_poisson_counts():
    for rate in (0.01, 0.7, 3.0, 900.0, 2e6):
        first, cdf = mixing.poisson_table(rate)
        assert cdf[-1] == pytest.approx(1, abs=1e-6)
        mean = sum((first + i) * (b - a) for i, (a, b) in enumerate(zip([0.0, *cdf], cdf, strict=False)))
        assert mean == pytest.approx(rate, rel=1e-3)
    assert mixing.poisson_table(0) == (0, [])


def test_mixing_to_weights(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 10 == 1, "small").otherwise("big").alias("source"))
    got = mixing.mix_sources(rows, {"small": 0.5, "big": 0.25, None: 0.25, "absent": 3}, total=9000)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert n["small"] == pytest.approx(4500, rel=0.1) and n["big"] == pytest.approx(2250, rel=0.1) and n[None] == pytest.approx(2250, rel=0.1)
    again = mixing.mix_sources(rows.repartition(5), {"small": 0.5, "big": 0.25, None: 0.25}, total=9000)
    assert got.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).count() == 0
    keys = [r["shuffle_key"] for r in got.collect()]
    assert keys == sorted(keys)
    assert {r["source"] for r in mixing.mix_sources(rows, {"small": 1.0}).select("source").distinct().collect()} == {"small"}
    assert mixing.mix_sources(docs(spark, [])).count() == 0 and mixing.mix_sources(docs(spark, ODD)).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


TURNS = "conv_id long, turn long, role string, text string"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "x"), (1, 3, "ann", "x"), (2, 0, "system", "alone"), (3, None, None, "n"), (None, 1, "", "y")]
    got = {(r["conv_id"], r["perspective"]): r for r in perspectives.rotate(spark.createDataFrame(rows, TURNS).withColumns({"part": F.lit(9), "mask": F.lit(1), "k": F.lit(0), "_conv_id": F.lit(0)})).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "unknown")}
    ann = got[1, "ann"]
    assert ann["n_messages"] == 5 and ann["n_trained"] == 3 and "user name=bob" in ann["rendered"] and "system\nbe kind" in ann["rendered"]
    assert [ann["rendered"][a:b] for a, b in ann["mask"]] == ["hi <​|im_end|><|im_end|>", "x<|im_end|>", "x<|im_end|>"]
    assert got[1, "bob"]["rendered"].count("<|im_start|>assistant") == 1
    assert perspectives.rotate(spark.createDataFrame([], TURNS)).count() == 0


def naive_dialogues(rows, most):
    """The whole rendering and mask of each (conversation, speaker)."""
    out = {}
    fixed = [(c, t, r or "unknown", x or "") for c, t, r, x in rows]
    for conv, speaker in {(c, r) for c, _, r, _ in fixed if r != "system"}:
        seen, said = collections.Counter(), []
        for c, t, r, x in fixed:
            if c == conv:
                said.append((t is not None, t or 0, seen[t, r, x] // most, hashlib.md5(f"{r}\n{x}".encode()).hexdigest(), r, x))
                seen[t, r, x] += 1
        text, spans = "", []
        for *_, r, x in sorted(said):
            r, own, x = r.replace("<|im_", "<​|im_"), r == speaker, x.replace("<|im_", "<​|im_")
            text += f"<|im_start|>{'assistant' if own else 'system' if r == 'system' else 'user name=' + r}\n"
            if own:
                spans.append([len(text), len(text) + len(x) + 10])
            text += f"{x}<|im_end|>\n"
        out[conv, speaker] = (text, spans, len(said))
    return out


@pytest.mark.parametrize(("block", "most"), [(256, 4096), (4, 6), (10, 3)])
def test_parts_are_the_whole_dialogue(spark, block, most):
    rnd = random.Random(block)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(30)]), rnd.choice(["ann", "bob", "<|im_x", "system", None, ""]), rnd.choice([None, "same", "é😀", "a <|im_start|> b", f"own {i}"])) for i in range(400)]
    rows += [(5, 3, "ann", "again")] * 25 + [(5, 3, "bob", "too")] * 2 + [(5, -7, "ann", "early")]
    parts = collections.defaultdict(list)
    for r in perspectives.rotate(spark.createDataFrame(rows, TURNS), block=block, most=most).collect():
        parts[r["conv_id"], r["perspective"]].append(r)
    want = naive_dialogues(rows, most)
    assert set(parts) == set(want)
    for key, (text, spans, n) in want.items():
        own = sorted(parts[key], key=lambda r: r["first_message"])
        assert [(r["block"] is not None, r["block"] or 0, r["part"]) for r in own] == sorted((r["block"] is not None, r["block"] or 0, r["part"]) for r in own)
        assert "".join(r["rendered"] for r in own) == text and [list(s) for r in own for s in r["mask"]] == spans and sum(r["n_messages"] for r in own) == n
        at = count = 0
        for r in own:
            assert (r["char_start"], r["first_message"]) == (at, count)
            at, count = at + len(r["rendered"]), count + r["n_messages"]
            assert r["n_trained"] == len(r["mask"]) and r["trained_chars"] == sum(b - a for a, b in r["mask"])
            assert r["mask_sha256"] == hashlib.sha256(",".join(f"{a}-{b}" for a, b in r["mask"]).encode()).hexdigest()


def test_a_very_long_conversation_is_cut(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    rows = rows.unionByName(spark.range(500).select(F.lit(2).cast("long").alias("conv_id"), F.lit(5).cast("long").alias("turn"), F.lit("a").alias("role"), F.col("id").cast("string").alias("text")))
    got = perspectives.rotate(rows, block=100, most=120)
    assert got.agg(F.max("n_messages")).first()[0] < 250
    per = {(r["conv_id"], r["perspective"]): r["n"] for r in got.groupBy("conv_id", "perspective").agg(F.sum("n_messages").alias("n")).collect()}
    assert per == {(1, "a"): 3000, (1, "b"): 3000, (2, "a"): 500}
