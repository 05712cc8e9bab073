"""Declarative corrections by humans, in a fixed order: split, merge, include, hidden, attributes.

Assignments are tables (person_id, face_id, photo_id, ...). References that match nothing are stale, never errors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import person_id
from .ranking import number_rows


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def split(assignment: DataFrame, moves: Mapping[str, Mapping], next_id: int = 1) -> DataFrame:
    """Move the named faces of a person to another one; without a target to new ids, numbered in the order of the persons."""
    spark = assignment.sparkSession
    rows, n = [], next_id
    for source in sorted(moves):
        target = moves[source].get("to")
        if not target:
            target, n = f"p-{n:04d}", n + 1
        rows += [(source, f, target) for f in moves[source].get("moveFaces", [])]
    table = _table(spark, rows, "person_id string, face_id string, target string").dropDuplicates(["person_id", "face_id"])
    moved = assignment.join(table, ["person_id", "face_id"], "left")
    return moved.withColumn("person_id", F.coalesce("target", "person_id")).drop("target").select(*assignment.columns)


def merge(assignment: DataFrame, groups: Sequence[Sequence[str]]) -> tuple[DataFrame, dict[str, str]]:
    """Give the faces of each group to its first id; returns the aliases too. Chains of groups are followed."""
    alias: dict[str, str] = {}

    def end(x: str) -> str:
        while x in alias:
            x = alias[x]
        return x

    for group in groups:
        head = end(group[0]) if group else None
        for other in group[1:]:
            if end(other) != head:
                alias[end(other)] = head
    table = _table(assignment.sparkSession, [(k, end(k)) for k in alias], "person_id string, target string")
    merged = assignment.join(table, "person_id", "left").withColumn("person_id", F.coalesce("target", "person_id")).drop("target")
    return merged.select(*assignment.columns).distinct(), {k: end(k) for k in alias}


def include(assignment: DataFrame, faces: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Attach faces (face_id, photo_id), gated or not, to persons. A face may then belong to two."""
    table = _table(assignment.sparkSession, [(p, f) for p, fs in wanted.items() for f in fs], "person_id string, face_id string")
    extra = table.join(faces, "face_id").join(assignment.select("person_id", "face_id"), ["person_id", "face_id"], "left_anti")
    return assignment.unionByName(extra.select(*[c if c in extra.columns else F.lit(None).alias(c) for c in assignment.columns]))


def hide(assignment: DataFrame, attributes: Mapping[str, Mapping]) -> DataFrame:
    gone = [p for p, a in attributes.items() if a.get("hidden")]
    return assignment.where(~F.col("person_id").isin(gone)) if gone else assignment


def attributes_table(spark: SparkSession, attributes: Mapping[str, Mapping]) -> DataFrame:
    rows = [(p, a.get("name"), bool(a.get("featured", False)), a.get("order"), a.get("cover")) for p, a in attributes.items()]
    return _table(spark, rows, "person_id string, name string, featured boolean, `order` int, cover string")


def stale_references(assignment: DataFrame, overrides: Mapping) -> DataFrame:
    """kind, reference: what the overrides name and the assignment doesn't hold."""
    rows = [("split", p) for p in overrides.get("split", {})] + [("merge", p) for g in overrides.get("merge", []) for p in g] + [("people", p) for p in overrides.get("people", {})]
    named = _table(assignment.sparkSession, rows, "kind string, reference string").distinct()
    people = assignment.select(F.col("person_id").alias("reference")).distinct()
    faces = [(f,) for s in overrides.get("split", {}).values() for f in s.get("moveFaces", [])] + [(f,) for fs in overrides.get("include", {}).values() for f in fs]
    lost = _table(assignment.sparkSession, faces, "reference string").distinct().join(assignment.select(F.col("face_id").alias("reference")), "reference", "left_anti")
    return named.join(people, "reference", "left_anti").select("kind", "reference").unionByName(lost.select(F.lit("face").alias("kind"), "reference"))


def shared_faces(assignment: DataFrame) -> DataFrame:
    """face_id, people: faces that belong to more than one person."""
    return assignment.groupBy("face_id").agg(F.sort_array(F.collect_set("person_id")).alias("people")).where(F.size("people") > 1)


def apply(assignment: DataFrame, faces: DataFrame, overrides: Mapping, next_id: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """All corrections but attributes; returns the assignment and the aliases."""
    out = split(assignment, overrides.get("split", {}), next_id)
    out, aliases = merge(out, overrides.get("merge", []))
    out = include(out, faces, overrides.get("include", {}))
    return hide(out, overrides.get("people", {})), aliases


def number_people(clusters: DataFrame, key: str = "cluster_id") -> DataFrame:
    """key, ordinal, new_id: fresh ids p-0001... in the order of size, then key: what a first run without a ledger gives."""
    sizes = clusters.groupBy(key).agg(F.count("*").alias("n"))
    numbered = number_rows(sizes, [F.desc("n"), F.col(key)], "ordinal")
    return numbered.select(key, "ordinal", person_id(F.col("ordinal")).alias("new_id"))
