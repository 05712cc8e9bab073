"""Detections, boxes and bridges derived from the driver's tables, in Spark and in SQL.

Every row of `embeddings` is a seed with four faces: its vector plus a share of another row's. With the tight share
(0.15) faces of a seed are nearer to each other than any two seeds; with the loose one (0.32) they
straddle the thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import detection_rank

TIGHT, LOOSE = 0.15, 0.32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def faces(spark: SparkSession, sf_dir: str, share: float = TIGHT) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))  # the join sends the numbers as they are stored
    n = e.count()
    seeds = e.select(F.col("vec_id").alias("seed"), F.col("v").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    seeds = seeds.withColumn("other", F.pmod(F.col("seed") * 7 + F.col("r") * 13 + 1, F.lit(n)))
    rows = seeds.join(e.select(F.col("vec_id").alias("other"), F.col("v").alias("b")), "other")
    rows = rows.withColumn("face_idx", (F.col("seed") * 4 + F.col("r")).cast("int"))
    photo = F.concat(F.lit("t-"), (F.pmod(F.col("seed") * 3 + F.col("r") % 3, F.lit(max(1, n * 37 // 60))) + 1).cast("string"))
    cx, cy, w = F.col("face_idx") % 500 * 8, F.col("r") * 8, F.col("face_idx") * 17 % 400 + 60
    rows = rows.withColumn("photo_id", photo).withColumn("face_id", F.concat("photo_id", F.format_string("_%04dx%04d", cx, cy)))
    return rows.select(
        "face_idx", "seed", "photo_id", "face_id", F.struct(cx.cast("int").alias("x"), cy.cast("int").alias("y"), w.cast("int").alias("w"), w.cast("int").alias("h")).alias("box"),
        (F.lit(0.5) + F.col("face_idx") * 31 % 50 / 100).alias("score"), w.cast("int").alias("native_width"), (F.col("face_idx") * 11 % 100 / 100).alias("frontality"),
        F.when(F.col("face_idx") % 10 == 0, F.lit(-1.0)).otherwise((F.col("face_idx") * 3 % 60).cast("double")).alias("sharpness"),
        (w < 140).alias("refined"), F.zip_with("a", "b", lambda x, y: x.cast("double") + F.lit(share) * y.cast("double")).alias("descriptor"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, position, x, y, w, h, score, rank: detections made of lineitem."""
    rows = table(spark, sf_dir, "lineitem")
    side = 20 + F.col("l_quantity")
    score = F.lit(1.0) - F.col("l_discount")
    source = F.when(F.col("l_linenumber") > 1, F.lit(1400)).otherwise(F.lit(1600))
    return rows.select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("position"), (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"), side.cast("double").alias("w"), side.cast("double").alias("h"), score.alias("score"), detection_rank(source, score).cast("double").alias("rank"))


def faces_sql(share: float = TIGHT) -> str:
    """Common table expressions that end in faces."""
    return f"""
        e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        cnt AS (SELECT count(*) AS n FROM embeddings),
        f0 AS (SELECT s.vec_id AS seed, r, CAST(s.vec_id * 4 + r AS INTEGER) AS face_idx, s.v AS a, o.v AS b, greatest(1, cnt.n * 37 // 60) AS p
               FROM e s, range(0, 4) t(r), cnt, e o WHERE o.vec_id = (s.vec_id * 7 + r * 13 + 1) % cnt.n),
        f1 AS (SELECT *, 't-' || ((seed * 3 + r % 3) % p + 1) AS photo_id, face_idx % 500 * 8 AS cx, r * 8 AS cy, face_idx * 17 % 400 + 60 AS w FROM f0),
        faces AS (SELECT face_idx, seed, r, photo_id, photo_id || '_' || lpad(CAST(cx AS VARCHAR), 4, '0') || 'x' || lpad(CAST(cy AS VARCHAR), 4, '0') AS face_id, cx, cy, w,
                  0.5::DOUBLE + (face_idx * 31 % 50)::DOUBLE / 100 AS score, w AS native_width, (face_idx * 11 % 100)::DOUBLE / 100 AS frontality,
                  CASE WHEN face_idx % 10 = 0 THEN -1.0 ELSE face_idx * 3 % 60 END::DOUBLE AS sharpness,
                  list_transform(list_zip(a, b), lambda z: z[1] + {share}::DOUBLE * z[2]) AS descriptor FROM f1)"""


BOXES_SQL = """
        boxes AS (SELECT l_orderkey AS photo, l_linenumber AS position, (l_partkey % 1000)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y, (20 + l_quantity)::DOUBLE AS w, (20 + l_quantity)::DOUBLE AS h,
                  1.0::DOUBLE - l_discount AS score FROM lineitem)"""


#: Clusters of two faces around a supplier's place on a line, by the supplier's number modulo 7: the kind, number of the face, first face of its cluster, x, y, z, photo, first face of the identity that it is to end in.
FAMILIES = (
    # close centroids and a close pair
    (0, 0, 0, 0.0, 0.0, 0.0, "a", 0), (0, 1, 0, 0.02, 0.0, 0.0, "b", 0), (0, 2, 2, 0.3, 0.0, 0.0, "c", 0), (0, 3, 2, 0.32, 0.0, 0.0, "d", 0),
    # close centroids, no close pair
    (1, 0, 0, 0.0, 0.4, 0.0, "a", 0), (1, 1, 0, 0.0, -0.4, 0.0, "b", 0), (1, 2, 2, 0.3, 0.0, 0.4, "c", 2), (1, 3, 2, 0.3, 0.0, -0.4, "d", 2),
    # centroids in the review band, two strong pairs of photos
    (2, 0, 0, 0.0, 0.0, 0.0, "a", 0), (2, 1, 0, 0.1, 0.0, 0.0, "b", 0), (2, 2, 2, 0.44, 0.0, 0.0, "c", 0), (2, 3, 2, 0.48, 0.0, 0.0, "d", 0),
    # the same, but one strong pair of photos
    (3, 0, 0, 0.0, 0.0, 0.0, "a", 0), (3, 1, 0, 0.1, 0.0, 0.0, "b", 0), (3, 2, 2, 0.44, 0.0, 0.0, "c", 2), (3, 3, 2, 0.48, 0.0, 0.0, "c", 2),
    # as the first, under a veto
    (4, 0, 0, 0.0, 0.0, 0.0, "a", 0), (4, 1, 0, 0.02, 0.0, 0.0, "b", 0), (4, 2, 2, 0.3, 0.0, 0.0, "c", 2), (4, 3, 2, 0.32, 0.0, 0.0, "d", 2),
    # the closer pair merges first and moves out of the third's reach
    (5, 0, 0, 0.0, 0.0, 0.0, "a", 0), (5, 1, 0, 0.02, 0.0, 0.0, "b", 0), (5, 2, 2, 0.33, 0.0, 0.0, "c", 2), (5, 3, 2, 0.35, 0.0, 0.0, "d", 2), (5, 4, 4, 0.61, 0.0, 0.0, "e", 2), (5, 5, 4, 0.63, 0.0, 0.0, "f", 2),
    # the closer pair merges first and moves into the third's reach
    (6, 0, 0, 0.0, 0.0, 0.0, "a", 0), (6, 1, 0, 0.02, 0.0, 0.0, "b", 0), (6, 2, 2, 0.45, 0.0, 0.0, "c", 0), (6, 3, 2, 0.47, 0.0, 0.0, "d", 0), (6, 4, 4, 0.24, 0.0, 0.0, "e", 0), (6, 5, 4, 0.26, 0.0, 0.0, "f", 0),
)


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_idx, face_id, photo_id, descriptor, cluster_id: the clusters of FAMILIES, once for each supplier."""
    spec = spark.createDataFrame(FAMILIES, "kind int, n int, first int, x double, y double, z double, photo string, ends int")
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    rows = own.join(F.broadcast(spec), F.pmod("s", F.lit(7)) == F.col("kind"))
    return rows.select(
        (F.col("s") * 10 + F.col("n")).alias("face_idx"), F.concat(F.lit("f"), (F.col("s") * 10 + F.col("n")).cast("string")).alias("face_id"), F.concat_ws("-", F.lit("t"), F.col("s").cast("string"), "photo").alias("photo_id"),
        F.array(F.col("s") * 100 + F.col("x"), "y", "z").alias("descriptor"), (F.col("s") * 10 + F.col("first")).alias("cluster_id"),
    )
