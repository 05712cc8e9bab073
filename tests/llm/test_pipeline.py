"""The pipeline's stages against brute force, each on what its predecessor kept."""

import collections

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from kinweave.llm import bpe, mixing, quality
from tests.llm.test_operators import naive_components, naive_lines


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).cache()  # a small fixture: the stages are compared with quadratic versions
    kept = P.keep_quality(spark, docs, sf)
    assert kept.columns == P.COLUMNS
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    scored = quality.classify(docs).collect()
    assert {r["doc_id"] for r in scored if r["keep"]} == {i for i, _ in rows}

    lines = P.drop_common_lines(spark, kept, sf)
    assert lines.columns == P.COLUMNS
    cut = [(r["doc_id"], r["text"]) for r in lines.collect()]
    assert sorted(cut, key=repr) == sorted(((i, t) for i, _, _, t in naive_lines(rows, 10)), key=repr)

    near = P.drop_near_duplicates(spark, lines, sf)
    assert near.columns == P.COLUMNS
    left = {r["doc_id"] for r in near.collect()}
    assert left == {i for i, (_, c) in naive_components(cut, 5, "0.8").items() if i == c}

    mixed = P.mix(spark, near, sf)
    assert mixed.columns == P.COLUMNS
    rates = {r["__source"]: r["rate"] for r in mixing.source_rates(near).collect()}
    want = collections.Counter()
    for r in near.collect():
        import hashlib

        u = int(hashlib.md5(f"{r['doc_id']}|17|copies".encode()).hexdigest()[:13], 16) / (1 << 52)
        first, cdf = mixing.poisson_table(rates[r["source"]])
        if n := first + sum(c <= u for c in cdf):
            want[r["doc_id"]] = n
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == want

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = dict(cut)
    for r in P.encode(spark, mixed, sf).collect():
        assert r["ids"] == theirs.encode_ordinary(texts[r["doc_id"]])


def test_near_duplicates_by_row(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, "only " + b[::-1]), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (5, b), (7, c), (None, "only " + b[::-1]), (8, ""), (9, None)], key=repr)


ODD_ROWS = [(1, None, None), (2, "", "s"), (3, " \t", "s"), (None, "a line\nof a text that is fine to read", None), (4, "a line\nof a text that is fine to read", "s"), (4, "a line\nof a text that is fine to read", "s"), (5, " ".join(f"w{i}" for i in range(5000)), "t")]


def test_stages_on_odd_rows(spark, sf):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, -1, -1) for i, t, s in ODD_ROWS], "doc_id long, text string, lang string, source string, n_chars long, __row long, __h long, keep int")
    kept = sorted((r["doc_id"], r["text"]) for r in P.keep_quality(spark, docs, sf).collect() if r["doc_id"])
    assert all((t or "").strip() for _, t in kept)
    lines = P.drop_common_lines(spark, docs, sf)
    assert lines.columns == P.COLUMNS and sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in lines.collect()) == sorted((str(i), t or "", len(t or "")) for i, t, _ in ODD_ROWS)
    near = [(r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(near, key=repr) == sorted([(i, t) for i, t, _ in ODD_ROWS if i in (1, 2, 3, 5)] + [(4, ODD_ROWS[4][1])], key=repr)
    mixed = P.mix(spark, docs, sf)
    assert mixed.columns == P.COLUMNS and {r["doc_id"] for r in mixed.collect()} <= {i for i, _, _ in ODD_ROWS}
    coded = P.encode(spark, docs, sf).collect()
    assert sorted(str(r["doc_id"]) for r in coded) == sorted(str(i) for i, _, _ in ODD_ROWS) and all(r["n_tokens"] == 0 for r in coded if r["doc_id"] in (1, 2))


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard", "poisson mixing", "byte bpe"] and P.ORACLE_SQL is None
