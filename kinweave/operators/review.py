"""The review loop: pairs to judge, decisions, merge groups and the checks after applying them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import pair_key
from .components import connected_components, resolve_aliases


def dedupe_pairs(pairs: DataFrame, order: str | None = None) -> DataFrame:
    """One row per unordered pair: the closest, then the first by `order`."""
    keyed = pairs.withColumn("pair_key", pair_key(F.col("a").cast("string"), F.col("b").cast("string")))
    best = W.partitionBy("pair_key").orderBy("distance", *([order] if order else ["a", "b"]))
    return keyed.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def latest_decisions(log: DataFrame, key: str = "pair_key", at: str = "decided_at", seq: str | None = None) -> DataFrame:
    """The last decision of each pair; pairs whose last decision is `unset` have none."""
    last = F.max_by(F.struct(*log.columns), F.struct(at, seq) if seq else F.struct(at))
    return log.groupBy(key).agg(last.alias("d")).select("d.*").where("decision <> 'unset'")


def undecided(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs without a decision, or put off."""
    known = decisions.select("pair_key", F.col("decision").alias("__d"))
    return pairs.join(known, "pair_key", "left").where("__d is null or __d = 'skip'").drop("__d")


def decision_summary(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """total, same, different, skipped, undecided in one row."""
    joined = pairs.join(decisions.select("pair_key", "decision"), "pair_key", "left")
    return joined.agg(F.count("*").alias("total"), *(F.count_if(F.col("decision") == d).alias(n) for d, n in (("same", "same"), ("different", "different"), ("skip", "skipped"))), F.count_if(F.col("decision").isNull()).alias("undecided"))


def pair_cards(pairs: DataFrame, decisions: DataFrame, people: DataFrame) -> DataFrame:
    """pairs (a, b, pair_key) with the decision, or undecided, and each side's name and photos; ids that aren't known are guests without photos."""
    out = pairs.join(decisions.select("pair_key", "decision"), "pair_key", "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))
    for side in "ab":
        card = people.select(F.col("id").alias(f"__{side}"), F.col("name").alias(f"name_{side}"), F.col("photo_count").alias(f"photos_{side}"))
        out = out.join(card, F.col(side) == F.col(f"__{side}"), "left").drop(f"__{side}")
        out = out.withColumns({f"name_{side}": F.coalesce(f"name_{side}", F.concat(F.lit("Guest ("), F.col(side), F.lit(")"))), f"photos_{side}": F.coalesce(f"photos_{side}", F.lit(0).cast("long"))})
    return out


def merge_groups(existing: DataFrame, same: DataFrame, photo_counts: DataFrame) -> DataFrame:
    """canonical, members: groups of two or more ids that old groups and `same` pairs join.

    existing: grp (order of the group), pos, id. The canonical id is the first that already heads a group, by the
    groups' order; else the one with the most photos, the first by id on ties.
    """
    heads = existing.where("pos = 0").select("grp", F.col("id").alias("head"))
    links = existing.join(heads, "grp").select(F.col("head").alias("a"), F.col("id").alias("b")).unionByName(same.select("a", "b"))
    roots = connected_components(links)
    ranked = roots.join(heads.groupBy(F.col("head").alias("node")).agg(F.min("grp").alias("heads")), "node", "left")
    ranked = ranked.join(photo_counts.select(F.col("id").alias("node"), "photo_count"), "node", "left")
    groups = ranked.groupBy("root").agg(
        F.min(F.struct(F.coalesce("heads", F.lit(2**62)).alias("h"), (-F.coalesce("photo_count", F.lit(0))).alias("p"), F.col("node").alias("n"))).alias("best"),
        F.sort_array(F.collect_set("node")).alias("members"),
    )
    return groups.where(F.size("members") > 1).select(F.col("best.n").alias("canonical"), F.concat(F.array("best.n"), F.array_remove("members", F.col("best.n"))).alias("members"))


def do_not_merge(existing: DataFrame, different: DataFrame) -> DataFrame:
    """Existing pairs and new ones that are not listed in either order; existing rows come first."""
    old = existing.select("a", "b", F.lit(0).alias("new"))
    both = old.unionByName(different.select("a", "b", F.lit(1).alias("new"))).withColumn("pair_key", pair_key(F.col("a").cast("string"), F.col("b").cast("string")))
    first = W.partitionBy("pair_key").orderBy("new", "a", "b")
    return both.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("a", "b", "pair_key")


def lost_photos(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, photo: photos (id, photo) that a person who still exists has lost."""
    alive = after.select("id").distinct()
    return before.select("id", "photo").distinct().join(alive, "id", "left_semi").join(after.select("id", "photo"), ["id", "photo"], "left_anti")


def validate(before: DataFrame, after: DataFrame, aliases: DataFrame, same: DataFrame, different: DataFrame) -> DataFrame:
    """kind, detail: conflicts after applying decisions. before, after: id, photo, face_id.

    Totals of faces and photos stay; nobody who is left loses photos; `same` pairs end in one person that has the
    photos of both, and `different` pairs in two.
    """
    spark = before.sparkSession
    out = []
    for kind, col in (("faces", "face_id"), ("photos", "photo")):
        sides = before.select(F.col(col).alias("x"), F.lit(None).cast(dict(after.dtypes)[col]).alias("y")).unionByName(after.select(F.lit(None).cast(dict(before.dtypes)[col]).alias("x"), F.col(col).alias("y")))
        out.append(sides.agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).where("x <> y").select(F.lit(f"{kind} changed").alias("kind"), F.concat_ws(" -> ", "x", "y").alias("detail")))
    out.append(lost_photos(before, after).groupBy("id").agg(F.count("*").alias("n")).select(F.lit("photos lost").alias("kind"), F.concat_ws(": ", "id", "n").alias("detail")))
    ids = same.select(F.col("a").alias("id")).unionByName(same.select(F.col("b").alias("id"))).unionByName(different.select(F.col("a").alias("id"))).unionByName(different.select(F.col("b").alias("id"))).distinct()
    ends = resolve_aliases(aliases, ids)

    def ended(pairs: DataFrame) -> DataFrame:
        return pairs.join(ends.select(F.col("id").alias("a"), F.col("resolved").alias("ra")), "a").join(ends.select(F.col("id").alias("b"), F.col("resolved").alias("rb")), "b")

    out.append(ended(same).where("ra <> rb").select(F.lit("same but apart").alias("kind"), pair_key(F.col("a"), F.col("b")).alias("detail")))
    out.append(ended(different).where("ra = rb").select(F.lit("different but joined").alias("kind"), pair_key(F.col("a"), F.col("b")).alias("detail")))
    union = ended(same).where("ra = rb").select(F.col("ra").alias("target"), F.explode(F.array("a", "b")).alias("id")).distinct().join(before.select("id", "photo").distinct(), "id")
    missing = union.select(F.col("target").alias("id"), "photo").distinct().join(after.select("id", "photo"), ["id", "photo"], "left_anti")
    out.append(missing.groupBy("id").agg(F.count("*").alias("n")).select(F.lit("union not whole").alias("kind"), F.concat_ws(": ", "id", "n").alias("detail")))
    found = spark.createDataFrame([], "kind string, detail string")
    for x in out:
        found = found.unionByName(x)
    return found


def photos_reassigned(same: DataFrame, photo_counts: DataFrame) -> DataFrame:
    """photos_reassigned: of each joined pair the smaller side moves."""
    counts = photo_counts.select("id", "photo_count")
    joined = same.join(counts.withColumnRenamed("id", "a").withColumnRenamed("photo_count", "ca"), "a", "left").join(counts.withColumnRenamed("id", "b").withColumnRenamed("photo_count", "cb"), "b", "left")
    return joined.agg(F.coalesce(F.sum(F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))), F.lit(0)).alias("photos_reassigned"))
