"""From clusters of faces to ranked people with covers, and the questions a reader asks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import centrality, display_name, face_quality, l2_distance
from .ranking import number_rows
from .simjoin import centroids


def score_faces(faces: DataFrame, key: str = "cluster_id", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """faces with centre_distance and q, the quality, by the centroid of their cluster."""
    means = centroids(faces.select(key, F.col("descriptor").alias("v")), key).select(F.col(key).alias("__key"), "centre")
    near = faces.join(means, F.col(key) == F.col("__key")).withColumn("centre_distance", l2_distance("descriptor", "centre"))
    q = face_quality(F.col("native_width"), F.col("score"), F.col("frontality"), F.col("sharpness"), centrality(F.col("centre_distance"), cfg), cfg)
    return near.withColumn("q", q).drop("__key", "centre")


def distinct_group(groups: DataFrame | None = None) -> Column:
    """The near-duplicate group of a photo, or the photo itself."""
    return F.coalesce(F.col("group_id").cast("string"), F.col("photo_id")) if groups is not None else F.col("photo_id")


def cluster_summary(scored: DataFrame, key: str = "cluster_id", group_col: str = "photo_id") -> DataFrame:
    """key, n_faces, n_groups, mean_quality."""
    return scored.groupBy(key).agg(F.count("*").alias("n_faces"), F.count_distinct(group_col).alias("n_groups"), F.avg("q").alias("mean_quality"))


def park(summary: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """summary with status: thin (too few moments or faces) goes before low quality; the rest is shown."""
    thin = (F.col("n_groups") < cfg.min_photos) | (F.col("n_faces") < cfg.min_faces)
    return summary.withColumn("status", F.when(thin, F.lit("thin")).when(F.col("mean_quality") < cfg.min_quality, F.lit("low_quality")).otherwise(F.lit("shown")))


def covers(scored: DataFrame, key: str = "cluster_id", group_col: str = "photo_id", chosen: DataFrame | None = None) -> DataFrame:
    """key, cover: the face with the best quality, discounted where a burst of photos shows it; a chosen face wins."""
    rows = scored.withColumn("burst", F.count("*").over(W.partitionBy(key, group_col)))
    rows = rows.withColumn("value", F.col("q") / F.pow(F.col("burst").cast("double"), F.lit(0.25)))
    if chosen is not None:
        rows = rows.join(chosen.select(F.col(key), F.col("cover").alias("face_id"), F.lit(1).alias("own")), [key, "face_id"], "left")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("int"))
    best = F.min(F.struct(-F.coalesce("own", F.lit(0)).alias("o"), (-F.col("value")).alias("v"), F.col("face_idx").alias("i"), F.col("face_id").alias("f")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, F.col("b.f").alias("cover"))


def rank_order() -> list[Column]:
    """Featured people first; where an order is set it decides; else the number of moments, then the ordinal."""
    free = F.col("order").isNull()
    return [F.desc("featured"), F.col("order").asc_nulls_last(), F.when(free, F.col("n_groups")).desc_nulls_last(), F.when(free, F.col("ordinal")).asc_nulls_last(), F.col("ordinal")]


def ranked(people: DataFrame) -> DataFrame:
    """people (featured, order, n_groups, ordinal) with rank from 1."""
    return number_rows(people, rank_order(), "rank")


def reader_order() -> list[Column]:
    """How a reader's list is sorted: featured, number of photos, ordinal."""
    return [F.desc("featured"), F.desc("photo_count"), F.col("ordinal")]


def guest_numbers(people: DataFrame, tie: str = "ordinal", id_col: str = "id") -> DataFrame:
    """id, guest_number, display_name: people without a name are numbered by photos, then the tie column."""
    nameless = number_rows(people.where("name is null").select(*dict.fromkeys([id_col, "photo_count", tie])), [F.desc("photo_count"), F.col(tie)], "guest_number").select(id_col, "guest_number")
    joined = people.join(nameless, id_col, "left")
    return joined.select(id_col, "guest_number", display_name(F.col("name"), F.col("guest_number")).alias("display_name"))


def person_photos(people: DataFrame, photos: DataFrame, person: str | None = None) -> DataFrame:
    """person, pos, photo columns: a person's photos in order; ids without a photo are left out. An unknown person has no row."""
    rows = people if person is None else people.where(F.col("id") == person)
    listed = rows.select(F.col("id").alias("person"), F.posexplode("photos").alias("pos", "photo_id"))
    return listed.join(photos, "photo_id")


def clusters_sharing_photos(rows: DataFrame, key: str = "cluster_id") -> DataFrame:
    """a, b: pairs of clusters that are in one photo at least. A photo has a bounded number of faces."""
    own = rows.select("photo_id", key).distinct()
    return own.withColumnRenamed(key, "a").join(own.withColumnRenamed(key, "b"), "photo_id").where("a < b").select("a", "b").distinct()


def photo_sets(rows: DataFrame, key: str = "cluster_id", merged: DataFrame | None = None) -> DataFrame:
    """key, n_faces, photos (sorted, each once). merged: (key, into) puts clusters together first."""
    if merged is not None:
        rows = rows.join(merged.select(key, "into"), key, "left").withColumn(key, F.coalesce("into", key)).drop("into")
    photos = rows.groupBy(key, "photo_id").agg(F.count("*").alias("n"))
    return photos.groupBy(key).agg(F.sum("n").alias("n_faces"), F.sort_array(F.collect_list("photo_id")).alias("photos"))


def photo_people(bridge: DataFrame) -> DataFrame:
    """photo_id, people: each photo's people, once each, in the order of their first face. bridge: photo_id, person_id, face_idx."""
    first = bridge.groupBy("photo_id", "person_id").agg(F.min("face_idx").alias("at"))
    return first.groupBy("photo_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "person_id"))), lambda s: s["person_id"]).alias("people"))


def _positions(photos: DataFrame, by: str, key: str, within: str | None, name: str) -> DataFrame:
    """within, key and the position from 1, among all photos or those of the same `within`."""
    if within is None:
        return number_rows(photos.select(key, *([by] if by != key else [])), [by, key], name).select(key, name)
    return photos.select(within, key, F.row_number().over(W.partitionBy(within).orderBy(by, key)).alias(name))


def neighbours(photos: DataFrame, by: str = "seq", key: str = "id", within: str | None = None) -> DataFrame:
    """key, previous, next: around the circle of photos in order."""
    if within is None:
        placed = _positions(photos, by, key, None, "__pos")
        last = placed.agg(F.max("__pos")).first()[0] or 0
        ends = placed.where(F.col("__pos").isin(1, last)).select((F.col("__pos") == 1).alias("__first"), key).collect()  # two rows
        first_key, last_key = (next((r[key] for r in ends if r["__first"] == want or last == 1), None) for want in (True, False))
        left = placed.select((F.col("__pos") + 1).alias("__pos"), F.col(key).alias("previous"))
        right = placed.select((F.col("__pos") - 1).alias("__pos"), F.col(key).alias("next"))
        kind = photos.schema[key].dataType
        around = placed.join(left, "__pos", "left").join(right, "__pos", "left")
        return around.select(key, F.coalesce("previous", F.lit(last_key).cast(kind)).alias("previous"), F.coalesce("next", F.lit(first_key).cast(kind)).alias("next"))
    w = W.partitionBy(within).orderBy(by, key)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    previous = F.coalesce(F.lag(key).over(w), F.last(key).over(whole))
    following = F.coalesce(F.lead(key).over(w), F.first(key).over(whole))
    return photos.select(within, key, previous.alias("previous"), following.alias("next"))


def grid(photos: DataFrame, columns: int, chunk: int = 150, by: str = "seq", key: str = "id", within: str | None = None) -> DataFrame:
    """key, position (from 1), grid_column, chunk: where a gallery shows each photo and when it loads."""
    placed = _positions(photos, by, key, within, "position")
    return placed.withColumns({"grid_column": F.pmod(F.col("position") - 1, F.lit(columns)), "chunk": F.floor((F.col("position") - 1) / F.lit(chunk)).cast("int")})


def landing(people: DataFrame, photos: DataFrame) -> DataFrame:
    """view, people, photos in one row: what the first page shows. Without people it is the plain gallery of photos."""
    counts = [x.agg(F.count("*").alias(n)).withColumn("__one", F.lit(1)) for x, n in ((people, "people"), (photos, "photos"))]
    return counts[0].join(counts[1], "__one").select(F.when(F.col("people") > 0, F.lit("people")).otherwise(F.lit("photos")).alias("view"), "people", "photos")


def person_card(people: DataFrame, ids: DataFrame) -> DataFrame:
    """id, found, display_name, photo_count of each asked id: an unknown one is a row that says so, not an error."""
    known = people.select(F.col("id").alias("pid"), display_name(F.col("name"), F.col("ordinal")).alias("display_name"), "photo_count")
    return ids.select("id").join(known, F.col("id") == F.col("pid"), "left").select("id", F.col("pid").isNotNull().alias("found"), "display_name", "photo_count")


def busiest_photo(bridge: DataFrame) -> DataFrame:
    """photo_id, people: the photo with the most people; the greatest id on ties."""
    counts = bridge.groupBy("photo_id").agg(F.count_distinct("person_id").alias("people"))
    return counts.agg(F.max(F.struct("people", "photo_id")).alias("m")).where("m is not null").select("m.photo_id", "m.people")
