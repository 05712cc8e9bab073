"""Queries over what is read, cached, kept and published: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT as C
from ..functions import geometry as geo
from ..functions import scalars as sc
from ..operators import checks, emit, gates, ledger, overrides, people, ranking, review
from ..sources import ingest, sinks
from ..storage import fresh_path
from ..streaming import incremental
from .catalogue import _DECISIONS, _PEOPLE, ORACLES, _bridge, _decisions
from .fixtures import table
from .registry import query, r6

# published tables


@query("""SELECT 't-' || doc_id AS id, CAST(n_chars % 4000 + 1 AS INTEGER) AS w, 3000 AS h, printf('#%02x0000', CAST(doc_id % 256 AS INTEGER)) AS c, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 + 1 ELSE 0 END AS INTEGER) AS dg
    FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def saved_photos(spark: SparkSession, d: str) -> DataFrame:
    ident = F.concat(F.lit("t-"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents")
    analysis = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(ident.alias("id"), (F.col("n_chars") % 4000 + 1).cast("int").alias("width"), F.lit(3000).alias("height"), sc.colour((F.col("doc_id") % 256).cast("int"), F.lit(0), F.lit(0)).alias("colour"))
    groups = docs.where("doc_id % 2 = 0").select(ident.alias("photo_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("group_id"))
    path = fresh_path(spark, "photos-json")
    emit.write_json(emit.public_photos(docs.select(ident.alias("id"), F.col("doc_id").alias("seq")), analysis, groups), path)
    return ingest.read_table(spark, path, schemas.PHOTO, multiline=False)


@query(ORACLES["public_people"])
def saved_people(spark: SparkSession, d: str) -> DataFrame:
    made = emit.public_people(*_bridge(spark, d))
    nobody = spark.createDataFrame([("p-none", 0, None, None, 0, [])], schemas.PERSON).select(*made.columns)
    path = fresh_path(spark, "people-json")
    emit.write_json(made.unionByName(nobody), path)  # people without photos are left out by the reader
    return ingest.read_people(spark, path).withColumn("photos", F.array_join("photos", ","))


_OWNED = """o AS (SELECT 'f' || p_partkey AS f, 'p-' || p_partkey % 40 AS p FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT DISTINCT 'p-' || p_partkey % 40 AS id, CASE WHEN p_partkey % 40 % 2 = 0 THEN 'Name ' || p_partkey % 40 ELSE 'Guest ' || p_partkey % 40 END AS name FROM part WHERE p_partkey % 3 <> 0),
    q AS (SELECT l_extendedprice AS d, 'f' || l_partkey AS face_a, 'f' || l_suppkey AS face_b FROM lineitem)"""


@query(f"""WITH {_OWNED} SELECT x.p AS a, y.p AS b, face_a, face_b, d, u.name AS name_a, v.name AS name_b FROM q JOIN o x ON x.f = face_a JOIN o y ON y.f = face_b JOIN n u ON u.id = x.p JOIN n v ON v.id = y.p
    WHERE x.p <> y.p ORDER BY d, a, b, face_a, face_b LIMIT 300""")
def review_identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("face_id"), (F.col("p_partkey") % 40).alias("n"))
    owners = owned.select("face_id", F.concat(F.lit("p-"), F.col("n").cast("string")).alias("person_id"))
    persons = owned.select(F.concat(F.lit("p-"), F.col("n").cast("string")).alias("id"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("Name "), F.col("n").cast("string"))).alias("name"), F.col("n").alias("ordinal")).distinct()
    pairs = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("d"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("face_a"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("face_b"))
    return emit.review_pairs(pairs, owners, persons, 300)


@query(f"""{_PEOPLE}, k2 AS (SELECT cluster_id, photo_id, min(face_idx) AS first_at, count(*) AS n FROM q WHERE cluster_id IN (SELECT cluster_id FROM s) GROUP BY ALL)
    SELECT 'p-' || cluster_id AS id, CASE WHEN cluster_id % 3 = 0 THEN 'Name ' || cluster_id ELSE 'Guest ' || cluster_id END AS name, count(*) AS photo_count, CAST(sum(n) AS BIGINT) AS face_count, array_to_string(list_slice(list(photo_id ORDER BY first_at), 1, 12), ',') AS samples FROM k2 GROUP BY cluster_id""")
def review_people(spark: SparkSession, d: str) -> DataFrame:
    return emit.person_report(*_bridge(spark, d)).withColumn("samples", F.array_join("samples", ","))


@query("SELECT label AS id, CAST(count(*) AS BIGINT) AS n, max(vec_id) / 10.0::DOUBLE AS d FROM embeddings GROUP BY label ORDER BY d DESC, id LIMIT 200")
def review_impure(spark: SparkSession, d: str) -> DataFrame:
    return emit.review_impure(table(spark, d, "embeddings").groupBy(F.col("label").alias("id")).agg(F.count("*").alias("n"), (F.max("vec_id") / 10).alias("d")))


@query(f"""WITH {_DECISIONS}, c AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY ALL),
    p AS (SELECT DISTINCT pair_key, split_part(pair_key, '|', 1) AS a, split_part(pair_key, '|', 2) AS b FROM k)
    SELECT p.pair_key, a, b, coalesce(decision, 'undecided') AS decision, coalesce(x.name, 'Guest (' || a || ')') AS name_a, coalesce(x.n, 0) AS photos_a, coalesce(y.name, 'Guest (' || b || ')') AS name_b, coalesce(y.n, 0) AS photos_b
    FROM p LEFT JOIN last USING (pair_key) LEFT JOIN c x ON x.id = a LEFT JOIN c y ON y.id = b""")
def pair_cards(spark: SparkSession, d: str) -> DataFrame:
    log = _decisions(spark, d)
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    persons = table(spark, d, "customer").where("c_custkey % 2 = 0").join(counts, F.col("c_custkey") == F.col("k"), "left").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("photo_count"))
    pairs = log.select("pair_key").distinct().withColumns({"a": F.split_part("pair_key", F.lit("|"), F.lit(1)), "b": F.split_part("pair_key", F.lit("|"), F.lit(2))})
    return review.pair_cards(pairs, review.latest_decisions(log, seq="seq"), persons)


@query("SELECT * FROM (SELECT 'all' AS shown, 'people' AS view, (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM orders) AS photos UNION ALL SELECT 'nobody', 'photos', 0, (SELECT count(*) FROM orders))")
def first_page(spark: SparkSession, d: str) -> DataFrame:
    persons, photos = table(spark, d, "customer"), table(spark, d, "orders")
    return people.landing(persons, photos).withColumn("shown", F.lit("all")).unionByName(people.landing(persons.where("c_custkey < 0"), photos).withColumn("shown", F.lit("nobody")))


@query("""WITH a AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT c_custkey + 1000000 FROM customer), c AS (SELECT c_custkey AS cid, CASE WHEN c_acctbal >= 5000 THEN c_name ELSE 'Guest ' || c_custkey END AS display_name, c_nationkey AS photo_count FROM customer)
    SELECT id, cid IS NOT NULL AS found, display_name, photo_count FROM a LEFT JOIN c ON cid = id""")
def person_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    asked = rows.select(F.col("c_custkey").alias("id")).unionByName(rows.select((F.col("c_custkey") + 1000000).alias("id")))
    persons = rows.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ordinal"), F.when(F.col("c_acctbal") >= 5000, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("photo_count"))
    return people.person_card(persons, asked)


# caches and runs


@query("WITH c AS (SELECT sha1(text) AS s, min(doc_id) AS m FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, 'r' || m AS result FROM documents JOIN c ON s = sha1(text) WHERE m % 3 <> 0")
def cached_hits(spark: SparkSession, d: str) -> DataFrame:
    photos = table(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    own = photos.where("sha1 is not null").groupBy("sha1").agg(F.min("doc_id").alias("m"))
    fingerprint = F.when(F.col("m") % 3 == 0, F.lit("of other settings")).otherwise(F.lit(C.detection_fingerprint()))
    root = fresh_path(spark, "analysis-cache")
    kept = own.select("sha1", fingerprint.alias("fingerprint"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("r"), F.col("m").cast("string")).alias("result"))
    sinks.upsert(spark, root, kept, ["sha1"], schemas.ANALYSIS_CACHE)
    return ingest.cached_results(photos, sinks.read_version(spark, root, schemas.ANALYSIS_CACHE)).select("doc_id", "result")


@query("SELECT sha1(text) AS sha1, CASE WHEN length(text) % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS results, CASE WHEN length(text) % 10 = 0 THEN 1 ELSE 0 END::BIGINT AS failures FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def retried_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two drops of files, analysed as a stream; what failed in the first run succeeds in the second."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    source, cache, seen = (fresh_path(spark, x) for x in ("drops", "stream-cache", "stream-checkpoint"))

    def engine(cured: bool):
        bad = (F.length("content") % 10 == 0) & F.lit(not cured)
        return lambda rows: rows.select("sha1", F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, "no").alias("error"), F.lit("x").alias("result"))

    for k, cured in ((0, False), (1, False), (2, True)):
        if k < 2:
            docs.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(source)
        incremental.run_incremental(spark, source, "doc_id long, content string", engine(cured), cache, seen)
    got = spark.read.schema(schemas.ANALYSIS_CACHE).option("recursiveFileLookup", "true").parquet(cache)
    # a failure that a second drop or run offered again while it lasted counts once here
    return got.groupBy("sha1").agg(F.count_distinct("status").alias("results"), F.max((F.col("status") == "failed").cast("long")).alias("failures"))


@query(ORACLES["decision_log_latest"])
def decision_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    log = _decisions(spark, d)
    source, out, seen = (fresh_path(spark, x) for x in ("decision-events", "decision-log", "decision-checkpoint"))
    log.write.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    incremental.decision_stream(spark, source, schema, out, seen)
    return review.latest_decisions(spark.read.parquet(out), seq="seq")


@query("SELECT what, n FROM (SELECT 'first' AS what, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'second', (SELECT count(*) FROM region) + 5 UNION ALL SELECT 'snapshot', (SELECT count(*) FROM nation) UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'template', 1 UNION ALL SELECT 'cleared', 1)")
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    root, path, schema = fresh_path(spark, "versions"), fresh_path(spark, "template"), "id string, n long"
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").cast("long").alias("n"))
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_regionkey").cast("long").alias("n"))
    sinks.commit_version(nations, root)
    held = sinks.snapshot(spark, {"table": root, "missing": f"{root}-none"})
    first = sinks.read_version(spark, root, schema).count()
    sinks.commit_version(nations.where("id in ('n0', 'n1', 'n2', 'n3', 'n4')"), root)
    sinks.upsert(spark, root, regions, ["id"], schema)
    rows = [("first", first), ("second", sinks.read_version(spark, root, schema).count()), ("snapshot", sinks.read_version(spark, root, schema, held["table"]).count()), ("missing", int(held["missing"] is not None))]
    rows.append(("template", int(sinks.write_template(spark, path, "{}")) + int(sinks.write_template(spark, path, "[]"))))
    rows.append(("cleared", int(sinks.clear(spark, root)) + int(sinks.clear(spark, root, yes=True))))
    return spark.createDataFrame(rows, "what string, n long")


# the ledger over two runs


def _second_run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, ledger.Book]:
    """The clusters of a second run over those of a first, one for each embedding; its assignment and the ledger behind it.

    Of six numbers in a row the first cluster grows, the next two join, the fourth splits, and the last two join although a human keeps them
    apart. A cluster of faces that nobody knows comes with each six.
    """
    seeds = table(spark, d, "embeddings").select(F.col("vec_id").alias("s"))
    face = F.concat(F.lit("f"), F.col("s").cast("string"), F.lit("-"), F.col("r").cast("string"))
    first = seeds.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.col("s").alias("cluster_id"), face.alias("face_id"))
    _, book = ledger.assign(ledger.empty_book(spark), first)
    root = fresh_path(spark, "ledger")
    ledger.save(book, root)
    book = ledger.load(spark, root)
    m = F.pmod("s", F.lit(6))
    whole = seeds.withColumn("r", F.explode(F.when(m == 0, F.sequence(F.lit(0), F.lit(5))).otherwise(F.sequence(F.lit(0), F.lit(3)))))
    key = F.when(m.isin(2, 5), F.col("s") - 1).when((m == 3) & (F.col("r") == 3), F.col("s") + 10_000_000).otherwise(F.col("s"))
    known = whole.select(key.alias("cluster_id"), face.alias("face_id"))
    fresh = seeds.where(m == 0).withColumn("r", F.explode(F.sequence(F.lit(10), F.lit(12)))).select((F.col("s") + 20_000_000).alias("cluster_id"), face.alias("face_id"))
    numbers = ranking.number_rows(seeds, ["s"], "n").select("s", F.format_string("p-%04d", "n").alias("id"))
    right = numbers.select((F.col("s") - 1).alias("s"), F.col("id").alias("b"))
    apart = numbers.where(m == 4).join(right, "s").select(F.col("id").alias("a"), "b")
    clusters = known.unionByName(fresh)
    table_, after = ledger.assign(book, clusters, apart)
    return clusters, table_, after


_RUN = """e AS (SELECT vec_id AS s, vec_id % 6 AS m, row_number() OVER (ORDER BY vec_id) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY vec_id % 6 ORDER BY vec_id) AS g FROM embeddings),
    b AS (SELECT s, m, 'p-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS id, n, total + g AS fresh, s - 1 IN (SELECT s FROM e) AS paired FROM e), c AS (SELECT *, 'p-' || lpad(fresh::VARCHAR, greatest(4, length(fresh::VARCHAR))::INTEGER, '0') AS fresh_id FROM b)"""


@query(f"""WITH {_RUN} SELECT s AS cluster_id, id AS person_id, false AS folded FROM c WHERE NOT (m IN (2, 5) AND paired) UNION ALL SELECT s + 10000000, id, true FROM c WHERE m = 3 UNION ALL SELECT s + 20000000, fresh_id, false FROM c WHERE m = 0""")
def ledger_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _second_run(spark, d)[1]


@query(f"WITH {_RUN} SELECT x.id AS from_id, y.id AS to_id FROM c x JOIN c y ON y.s = x.s - 1 WHERE x.m = 2")
def ledger_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _second_run(spark, d)[2].aliases


@query(f"""WITH {_RUN} SELECT id, CAST(n AS INTEGER) AS ordinal, CASE m WHEN 0 THEN 6 WHEN 3 THEN 3 ELSE CASE WHEN m IN (1, 4) AND s + 1 IN (SELECT s FROM c) THEN 8 ELSE 4 END END::BIGINT AS anchors FROM c
    UNION ALL SELECT fresh_id, CAST(fresh AS INTEGER), 3 FROM c WHERE m = 0""")
def ledger_people(spark: SparkSession, d: str) -> DataFrame:
    book = _second_run(spark, d)[2]
    return book.people.join(book.anchors.groupBy("id").agg(F.count("*").alias("anchors")), "id").select("id", "ordinal", "anchors")


@query(f"""WITH {_RUN} SELECT id AS person_id, CASE WHEN m = 0 THEN 6 WHEN m IN (1, 4) AND s + 1 IN (SELECT s FROM c) THEN 8 ELSE 4 END::BIGINT AS faces FROM c WHERE NOT (m IN (2, 5) AND paired) UNION ALL SELECT fresh_id, 3 FROM c WHERE m = 0""")
def folded_faces(spark: SparkSession, d: str) -> DataFrame:
    clusters, assigned, _ = _second_run(spark, d)
    return ledger.apply_folds(clusters, assigned).groupBy("person_id").agg(F.count("*").alias("faces"))


@query("WITH z AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT k, row_number() OVER (ORDER BY n DESC, k) AS o FROM z) SELECT k AS l_suppkey, CAST(o AS INTEGER) AS ordinal, 'p-' || lpad(o::VARCHAR, greatest(4, length(o::VARCHAR))::INTEGER, '0') AS new_id FROM r")
def numbered_by_size(spark: SparkSession, d: str) -> DataFrame:
    return overrides.number_people(table(spark, d, "lineitem"), "l_suppkey")


# files and settings


_OVERRIDES = '{"people": {"p-0001": {"name": "A", "featured": true, "order": 2, "hidden": false}, "p-0002": {"hidden": true}}, "merge": [["p-0003", "p-0004"], ["p-0005", "p-0006"]], "split": {"p-0007": {"moveFaces": ["f1", "f2"], "to": "p-0008"}}, "include": {"p-0009": ["f3"]}, "ignoreFaces": ["f4"], "doNotMerge": [["p-0001", "p-0002"]]}'


@query("SELECT * FROM (VALUES ('people', 2), ('merge', 2), ('split', 1), ('include', 1), ('ignoreFaces', 1), ('ignorePhotos', 0), ('doNotMerge', 1), ('moved faces', 2), ('hidden', 1), ('of no file', 0)) t(part, n)")
def overrides_loaded(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "overrides-json")
    sinks.write_template(spark, path, _OVERRIDES)
    got = ingest.read_table(spark, path, schemas.OVERRIDES)
    parts = {c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>") if c.startswith("ignore") else F.col(c))) for c in ("people", "merge", "split", "include", "ignoreFaces", "ignorePhotos", "doNotMerge")}
    parts["moved faces"] = F.size(F.flatten(F.transform(F.map_values("split"), lambda s: s["moveFaces"])))
    parts["hidden"] = F.size(F.filter(F.map_values("people"), lambda a: F.coalesce(a["hidden"], F.lit(False))))
    rows = got.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), v.cast("int").alias("n")) for k, v in parts.items()))).alias("x")).select("x.part", "x.n")
    none = ingest.read_table(spark, f"{path}-none", schemas.OVERRIDES, optional=True).agg(F.count("*").cast("int").alias("n")).select(F.lit("of no file").alias("part"), "n")
    return rows.unionByName(none)


_FINGERPRINT = "v1|decode_long_edge=4096|detect_long_edge=1600|detect_min_confidence=0.3|detect_min_size=40|max_faces_per_photo=60|tile_target_px=1400|tile_overlap=0.18|tiling_min_long_edge=2200|merge_iou=0.35|refine_below_px=140|refine_padding=0.6|refine_size=384|refine_min_confidence={}"


@query(f"""SELECT * FROM (VALUES ('default', '{_FINGERPRINT.format('0.2')}', 0.46::DOUBLE, 'discover,analyze,identify,emit'), ('refined', '{_FINGERPRINT.format('0.3')}', 0.46, 'identify,emit'), ('threshold', '{_FINGERPRINT.format('0.2')}', 0.5, 'analyze')) t(settings, fingerprint, similarity, stages)""")
def run_settings(spark: SparkSession, d: str) -> DataFrame:
    stages = ["discover", "analyze", "identify", "emit"]
    rows = []
    for name, flags, run in (("default", {}, {}), ("refined", {"refine_min_confidence": 0.3}, {"first": "identify"}), ("threshold", {"threshold": 0.5}, {"only": "analyze"})):
        made = ingest.parse_options(**flags)
        rows.append((name, made.detection_fingerprint(), made.similarity, ",".join(s for s in stages if ingest.runs_stage(s, stages, **run))))
    return spark.createDataFrame(rows, "settings string, fingerprint string, similarity double, stages string")


@query("SELECT l_orderkey AS photo_id, l_linenumber AS n, l_quantity AS score FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def flattened_faces(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("score"))).alias("faces"))
    photos = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(nested, F.col("id") == F.col("l_orderkey"), "left")
    return gates.flatten(photos)


@query("SELECT count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS bytes, round(sum(length(html)) / count(*)::DOUBLE * 2000, 6) AS projected_bytes FROM pages")
def storage_use(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.length("html").cast("long").alias("bytes"))
    return checks.storage_use(files, files.count()).withColumn("projected_bytes", r6("projected_bytes"))


# scalars


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) + 1) * 128)) AS v FROM embeddings),
    l AS (SELECT vec_id, list_transform(range(0, 64), lambda i: v[CASE WHEN i >= 8 THEN i - 8 ELSE i END + 1] + v[CASE WHEN i < 56 THEN i + 8 ELSE i END + 1] + v[CASE WHEN i % 8 > 0 THEN i - 1 ELSE i END + 1] + v[CASE WHEN i % 8 < 7 THEN i + 1 ELSE i END + 1] - 4 * v[i + 1]) AS r FROM e)
    SELECT vec_id, round(list_stddev_samp(r), 6) AS sharpness FROM l""")
def sharpness(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 128))
    return table(spark, d, "embeddings").select("vec_id", r6(sc.sharpness(pixels, F.lit(8))).alias("sharpness"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN 1400 ELSE 1600 END * 1000 + l_quantity * 100 AS rank FROM lineitem")
def detection_ranks(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("l_linenumber") > 1, F.lit(1400)).otherwise(F.lit(1600))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geo.detection_rank(source, F.col("l_quantity")).alias("rank"))
