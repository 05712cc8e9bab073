"""What is published: photos, people, faces in photos and the review report. No vector leaves through here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalise_box
from ..functions.scalars import display_name
from ..sources.sinks import commit_version


def public_photos(photos: DataFrame, analysis: DataFrame, groups: DataFrame) -> DataFrame:
    """id, w, h, c, dg, in gallery order; photos without analysis are left out, dg is 0 without a group."""
    joined = photos.join(analysis.select("id", "width", "height", "colour"), "id").join(groups.select(F.col("photo_id").alias("id"), "group_id"), "id", "left")
    return joined.orderBy("seq", "id").select("id", F.col("width").alias("w"), F.col("height").alias("h"), F.col("colour").alias("c"), F.coalesce("group_id", F.lit(0)).alias("dg"))


def public_people(bridge: DataFrame, people: DataFrame) -> DataFrame:
    """id, ordinal, name, featured (only where true), photoCount, photos in gallery order. bridge: person_id, photo_id, seq."""
    listed = bridge.select("person_id", "seq", "photo_id").distinct().groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "photo_id"))), lambda s: s["photo_id"]).alias("photos"))
    joined = people.join(listed, people["id"] == listed["person_id"])
    return joined.select("id", "ordinal", "name", F.when(F.col("featured"), F.lit(True)).alias("featured"), F.size("photos").alias("photoCount"), "photos")


def public_photo_faces(bridge: DataFrame, sizes: DataFrame, even: bool = False) -> DataFrame:
    """photo_id, faces: struct(p, b) of the visible people's faces; photos without any are left out. bridge: person_id, photo_id, face_idx, box. even: see to_fixed."""
    joined = bridge.join(sizes.select(F.col("id").alias("photo_id"), "width", "height"), "photo_id")
    rows = joined.select("photo_id", F.struct("face_idx", F.struct(F.col("person_id").alias("p"), normalise_box(F.col("box"), F.col("width"), F.col("height"), even=even).alias("b")).alias("f")).alias("x"))
    return rows.groupBy("photo_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda s: s["f"]).alias("faces"))


def describe_pairs(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with names; people without one are called by their ordinal."""
    named = people.select(F.col("id").alias("pid"), display_name(F.col("name"), F.col("ordinal")).alias("shown"))
    for side in "ab":
        pairs = pairs.join(named.withColumnRenamed("pid", f"{side}_id").withColumnRenamed("shown", f"name_{side}"), F.col(side) == F.col(f"{side}_id"), "left").drop(f"{side}_id")
    return pairs


def resolved_pairs(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """pairs (face_a, face_b, ...) with the persons a and b of their faces (owners: face_id, person_id); pairs of unknown faces or of one person are left out."""
    for side in "ab":
        pairs = pairs.join(owners.select(F.col("face_id").alias(f"face_{side}"), F.col("person_id").alias(side)), f"face_{side}")
    return pairs.where("a <> b")


def review_pairs(pairs: DataFrame, owners: DataFrame, people: DataFrame, most: int, by: str = "d") -> DataFrame:
    """The report's first pairs by distance, with persons and names: 300 of identities, 200 of clusters."""
    return describe_pairs(resolved_pairs(pairs, owners), people).orderBy(by, "a", "b", "face_a", "face_b").limit(most)


def review_impure(impure: DataFrame, most: int = 200) -> DataFrame:
    """The report's first mixed identities, the farthest pair first."""
    return impure.orderBy(F.desc("d"), "id").limit(most)


def person_report(bridge: DataFrame, people: DataFrame, samples: int = 12) -> DataFrame:
    """id, name, photo_count, face_count and the first photos by face. bridge: person_id, photo_id, face_idx, one row a face."""
    first = bridge.groupBy("person_id", "photo_id").agg(F.min("face_idx").alias("at"), F.count("*").alias("n"))
    counts = first.groupBy("person_id").agg(F.count("*").alias("photo_count"), F.sum("n").alias("face_count"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "photo_id"))), lambda s: s["photo_id"]), 1, samples).alias("samples"))
    return people.join(counts, F.col("id") == F.col("person_id")).select("id", display_name(F.col("name"), F.col("ordinal")).alias("name"), "photo_count", "face_count", "samples")


def json_lines(df: DataFrame) -> DataFrame:
    """value: one JSON object a row. Null names are kept as null; a featured flag that is null is left out.

    Spark drops all nulls or none, so the objects are made as text.
    """
    parts = []
    for c in df.columns:
        inner = F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")
        pair = F.concat(F.lit(f'"{c}":'), inner)
        parts.append(F.when(F.col(c).isNotNull(), pair) if c == "featured" else pair)
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def write_json(df: DataFrame, path: str) -> str:
    """Commit a table of JSON lines as the current version below path: readers see the old table or the new one."""
    return commit_version(json_lines(df), path, "text")
