"""Integrity and privacy checks: a row per check with its number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = ("descriptor", "embedding", "landmark")


def check(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def empty(name: str, df: DataFrame) -> DataFrame:
    """One violation if there is no row."""
    return df.agg((F.count("*") == 0).cast("long").alias("violations")).select(F.lit(name).alias("name"), "violations")


def dangling(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; null keys refer to nothing and count too."""
    return check(name, child.join(parent.select(F.col(parent_key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti"))


def failing(name: str, df: DataFrame, good: Column) -> DataFrame:
    return check(name, df.where(~F.coalesce(good, F.lit(False))))


def storage_use(files: DataFrame, photos: int, projected: int = 2000) -> DataFrame:
    """files, bytes and projected_bytes: what `projected` photos would take at the mean of these `photos`. files: bytes."""
    sums = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sums.withColumn("projected_bytes", F.when(F.lit(photos > 0), F.col("bytes") / F.lit(max(photos, 1)) * projected))


def gallery_checks(photos: DataFrame, people: DataFrame, photo_faces: DataFrame, most_bytes: int = 1024 << 20, sizes: DataFrame | None = None) -> DataFrame:
    """All checks of the published tables: photos (id, w, h, c), people (id, photoCount, photos), photo_faces (photo_id, faces)."""
    listed = people.select(F.col("id").alias("person"), F.explode("photos").alias("photo"))
    seen = photo_faces.select(F.col("photo_id").alias("photo"), F.explode("faces").alias("f")).select("photo", F.col("f.p").alias("person"))
    shared = seen.groupBy("photo").agg(F.count_distinct("person").alias("k"))
    total = photos.count()
    top = shared.agg(F.max_by("photo", F.struct("k", "photo")).alias("photo")).where("photo is not null")
    rows = [
        empty("photos exist", photos),
        empty("people exist", people),
        failing("photos have a size", photos, (F.col("w") > 0) & (F.col("h") > 0)),
        failing("colours are hexadecimal", photos, F.col("c").rlike("^#[0-9a-f]{6}$")),
        check("nobody owns every photo", people.where((F.col("photoCount") >= total) & F.lit(total > 1))),
        dangling("photos of people exist", listed, "photo", photos, "id"),
        failing("photoCount matches", people, F.col("photoCount") == F.size("photos")),
        check("people are in their photos", listed.join(seen, ["person", "photo"], "left_anti")),
        check("faces belong to listed photos", seen.distinct().join(listed, ["person", "photo"], "left_anti")),
        empty("somebody has several photos", people.where("photoCount > 1")),
        empty("some photo is shared", shared.where("k > 1")),
        check("the most shared photo is in all its lists", seen.join(top, "photo", "left_semi").distinct().join(listed, ["person", "photo"], "left_anti")),
    ]
    for df, name in ((photos, "photos"), (people, "people"), (photo_faces, "photo faces")):
        bad = [c for c in df.columns if any(t in c.lower() for t in FORBIDDEN)]
        rows.append(empty(f"{name} hold no vector", df.sparkSession.range(0 if bad else 1)))
    if sizes is not None:
        rows.append(failing("files fit the budget", sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")), F.col("total") < most_bytes))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
