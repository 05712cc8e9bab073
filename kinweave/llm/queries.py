"""The subpackage's queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, line_dedup, matroska, maxent, mixing, perspectives, quality, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perspectives.rotate(_table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "block", "part", "perspective", "first_message", "char_start", "n_messages", "n_trained", "trained_chars", F.sha2("rendered", 256).alias("rendered_sha256"), "mask_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_media(matroska.store_texts(_table(spark, sf_dir, "documents")))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), temperature=0.5, seed=17)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True, parted=True)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), words=3, similarity="0.9")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "keep")


QUERIES = {f.__name__: f for f in (op1_perspectives, op2_line_dedup, op3_matroska, op4_poisson_mixing, op5_byte_bpe, op6_ngram_jaccard, op7_maxent_lm, op8_warc, op9_exact_top_k, op10_weak_quality)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op1_perspectives": """
        WITH s AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS raw FROM conversations),
        m AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn, role, raw) - 1) // 4096 AS lot, md5(role || chr(10) || raw) AS h, replace(raw, '<|im_', '<' || chr(8203) || '|im_') AS text FROM s),
        p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM m WHERE role <> 'system'),
        r AS (SELECT *, role = perspective AS own,
                '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || replace(role, '<|im_', '<' || chr(8203) || '|im_') END || chr(10) AS head,
                text || '<|im_end|>' AS body
              FROM m JOIN p ON conv_id IS NOT DISTINCT FROM c),
        o AS (SELECT *, row_number() OVER w AS n, sum(length(head) + length(body) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS ends FROM r
              WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, lot, h, role, raw))
        SELECT conv_id, CAST(floor(turn / 256.0) AS BIGINT) AS block, CAST(0 AS BIGINT) AS part, perspective, min(n) - 1 AS first_message,
          CAST(min(ends - length(head) - length(body) - 1) AS BIGINT) AS char_start, count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_trained,
          CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS trained_chars,
          sha256(string_agg(head || body || chr(10), '' ORDER BY n)) AS rendered_sha256,
          sha256(coalesce(string_agg((ends - 1 - length(body)) || '-' || (ends - 1), ',' ORDER BY n) FILTER (WHERE own), '')) AS mask_sha256
        FROM o GROUP BY conv_id, 2, perspective""",
    "op2_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
        k AS (SELECT doc_id, n, line, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
        c AS (SELECT key, count(DISTINCT doc_id) AS docs FROM k WHERE length(key) >= 1 GROUP BY key),
        j AS (SELECT k.*, coalesce(c.docs, 0) >= 10 AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op4_poisson_mixing": """
        WITH s AS (SELECT source AS src, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source),
        r AS (SELECT src, w / (SELECT sum(w) FROM s) * (SELECT CAST(sum(n) AS DOUBLE) FROM s) / n AS rate FROM s),
        p AS (SELECT src, k, sum(exp(-rate + k * ln(rate) - lgamma(CAST(k + 1 AS DOUBLE)))) OVER (PARTITION BY src ORDER BY k) AS cdf FROM r, range(0, 200) t(k)),
        d AS (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|17|copies'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
        c AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(count(*) AS INTEGER) AS n_copies FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.src AND p.cdf <= d.u GROUP BY ALL),
        e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n_copies)) AS copy, n_copies FROM c)
        SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, n_copies,
          CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy || '|17|order'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS shuffle_key
        FROM e""",
    "op6_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
        e AS MATERIALIZED (SELECT doc_id, unnest(g) AS x FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM i JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.g) + len(y.g) - n)),
        bw AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        walk(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT bw.b, walk.root FROM walk JOIN bw ON bw.a = walk.node)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT node, min(root) AS component_id FROM walk GROUP BY node) ON node = doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
        SELECT page_id, octet_length(encode(html)) AS payload_bytes,
          list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest,
          CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM m""",
    "op9_exact_top_k": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
}
