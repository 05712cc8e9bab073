"""Stable identifiers across runs, kept as tables: people (id, ordinal), anchors (id, face_id) and aliases (from_id, to_id)."""

from __future__ import annotations

import dataclasses

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, EngineConfig
from ..functions.scalars import person_id
from ..sources import sinks
from ..storage import write_table
from .components import connected_components
from .ranking import number_rows


@dataclasses.dataclass(frozen=True)
class Book:
    """The ledger between two runs. Numbers only grow; an operation gives a new book."""

    people: DataFrame
    anchors: DataFrame
    aliases: DataFrame
    next_id: int = 1
    next_ordinal: int = 1


def empty_book(spark: SparkSession) -> Book:
    return Book(*(spark.createDataFrame([], s) for s in (schemas.LEDGER_PERSON, schemas.LEDGER_ANCHOR, schemas.LEDGER_ALIAS)))


def save(book: Book, root: str) -> None:
    """Commit the tables and the counters as new versions below root; the counters come last."""
    spark = book.people.sparkSession
    for name in ("people", "anchors", "aliases"):
        sinks.commit_version(getattr(book, name), f"{root}/{name}")
    sinks.commit_version(spark.createDataFrame([(book.next_id, book.next_ordinal)], schemas.LEDGER_COUNTER), f"{root}/counters")


def load(spark: SparkSession, root: str) -> Book:
    """The saved book; an empty one before the first run. Damaged tables raise."""
    tables = [sinks.read_version(spark, f"{root}/{n}", s) for n, s in (("people", schemas.LEDGER_PERSON), ("anchors", schemas.LEDGER_ANCHOR), ("aliases", schemas.LEDGER_ALIAS))]
    counters = sinks.read_version(spark, f"{root}/counters", schemas.LEDGER_COUNTER).first()
    return Book(*tables, *(counters or (1, 1)))


def register(book: Book, faces: DataFrame) -> Book:
    """Replace the anchors of the ids in faces (id, face_id); ids that aren't known get ordinals in the order of their ids."""
    ids = faces.select("id").distinct()
    fresh = number_rows(ids.join(book.people, "id", "left_anti"), ["id"], "rank")
    fresh = write_table(fresh.select("id", (F.col("rank") + (book.next_ordinal - 1)).cast("int").alias("ordinal")), "ledger-people")
    anchors = book.anchors.join(ids, "id", "left_anti").unionByName(faces.select("id", "face_id").distinct())
    return dataclasses.replace(book, people=book.people.unionByName(fresh), anchors=write_table(anchors, "ledger-anchors"), next_ordinal=book.next_ordinal + fresh.count())


def allocate(book: Book, groups: DataFrame, order: list, key: str) -> tuple[DataFrame, Book]:
    """(key, id) with a new id for each row of groups (key, ...), numbered in the given order; and the book with their ordinals."""
    numbered = number_rows(groups, order, "rank")
    made = numbered.select(key, person_id(F.col("rank") + (book.next_id - 1)).alias("id"), (F.col("rank") + (book.next_ordinal - 1)).cast("int").alias("ordinal"))
    made = write_table(made, "ledger-new")
    n = made.count()
    return made.select(key, "id"), dataclasses.replace(book, people=book.people.unionByName(made.select("id", "ordinal")), next_id=book.next_id + n, next_ordinal=book.next_ordinal + n)


def add_aliases(book: Book, pairs: DataFrame) -> Book:
    """Point from_id at to_id; a later alias of an id replaces the earlier one, and an id is no alias of itself."""
    fresh = pairs.where("from_id <> to_id").groupBy("from_id").agg(F.max("to_id").alias("to_id"))
    kept = book.aliases.join(fresh.select("from_id"), "from_id", "left_anti")
    return dataclasses.replace(book, aliases=write_table(kept.unionByName(fresh), "ledger-aliases"))


def ordinals(book: Book, ids: DataFrame) -> DataFrame:
    """id, ordinal: 0 for ids that the ledger doesn't know."""
    return ids.select("id").distinct().join(book.people, "id", "left").select("id", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))


def anchor_overlaps(assignment: DataFrame, anchors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """cluster, id, both, cluster_size, anchor_size, overlap: how far old anchors cover the clusters of (key, face_id)."""
    clusters, known = assignment.select(key, "face_id").distinct(), anchors.select("id", "face_id").distinct()
    both = clusters.join(known, "face_id").groupBy(key, "id").agg(F.count("*").alias("both"))
    sizes = clusters.groupBy(key).agg(F.count("*").alias("cluster_size"))
    held = known.groupBy("id").agg(F.count("*").alias("anchor_size"))
    joined = both.join(sizes, key).join(held, "id")
    return joined.withColumn("overlap", F.col("both") / F.least("cluster_size", "anchor_size"))


_MOVES = "kind string, cluster string, id string, target string"


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The decisions for the clusters of one component, the largest first: claim, fold, alias or new."""
    out, holder, gone = [], {}, set(pdf.loc[pdf["aliased"], "id"])
    for (_, _, cluster), rows in pdf.groupby(["order", "at", "cluster"], sort=True):
        near = [r for r in rows.sort_values("ordinal").itertuples() if r.id not in holder and r.id not in gone]
        if near:
            best = min(near, key=lambda r: (-r.both, -r.overlap, r.ordinal))
            holder[best.id] = cluster
            out.append(("claim", cluster, best.id, None))
            for r in near:
                if r.id != best.id and best.id not in r.foes:
                    gone.add(r.id)
                    out.append(("alias", None, r.id, best.id))
            continue
        rows = {r.id: r for r in rows.itertuples()}
        taken = [rows[p] for p in holder if p in rows and not rows[p].blocked]  # in the order of the claims
        if taken:
            best = max(taken, key=lambda r: r.overlap)
            out.append(("fold", cluster, best.id, holder[best.id]))
        else:
            out.append(("new", cluster, None, None))
    return pd.DataFrame(out, columns=["kind", "cluster", "id", "target"])


def assign(book: Book, assignment: DataFrame, apart: DataFrame | None = None, cfg: EngineConfig = DEFAULT, key: str = "cluster_id") -> tuple[DataFrame, Book]:
    """(key, person_id, folded) for each cluster of assignment (key, face_id), and the next book.

    Clusters choose in the order of their size, then their key. A cluster claims the id with which it shares most anchors; the other free ids that
    it covers become aliases of it, unless a human keeps the two apart (a, b). A cluster whose ids are all claimed folds into the claimer that
    its old anchors overlap most, unless it holds anchors of an id that is kept apart from it; else it gets a new id.

    A decision can only touch decisions on clusters that share an id, so each connected component of clusters and ids is walked by itself.
    """
    spark = assignment.sparkSession
    kind = dict(assignment.dtypes)[key]
    every = write_table(anchor_overlaps(assignment, book.anchors, key), "overlaps")
    apart = spark.createDataFrame([], "a string, b string") if apart is None else apart.select("a", "b")
    foes = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    blocked = every.select(key, F.col("id").alias("b")).join(foes, "b").select(key, F.col("a").alias("id")).distinct().withColumn("blocked", F.lit(True))
    listed = foes.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("foes"))
    near = every.where(F.col("overlap") >= cfg.ledger_overlap).join(book.people, "id")
    near = near.join(book.aliases.select(F.col("from_id").alias("id"), F.lit(True).alias("aliased")), "id", "left").join(listed, "id", "left").join(blocked, [key, "id"], "left")
    cluster, ident = F.concat(F.lit("c "), F.col(key).cast("string")), F.concat(F.lit("p "), F.col("id"))
    roots = connected_components(near.select(cluster.alias("a"), ident.alias("b")))
    rows = near.join(roots.select(F.col("node").alias("__node"), "root"), cluster == F.col("__node")).select(
        "root", F.col(key).cast("string").alias("cluster"), (-F.col("cluster_size")).alias("order"), F.col(key).alias("at"), "id", "ordinal", "both", "overlap",
        F.coalesce("aliased", F.lit(False)).alias("aliased"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("foes", F.array().cast("array<string>")).alias("foes"),
    )
    moves = write_table(rows.groupBy("root").applyInPandas(_walk, _MOVES), "ledger-moves")
    placed = moves.where("kind in ('claim', 'fold')").select(F.col("cluster").cast(kind).alias(key), F.col("id").alias("person_id"), (F.col("kind") == "fold").alias("folded"))
    sizes = assignment.select(key, "face_id").distinct().groupBy(key).agg(F.count("*").alias("n"))
    made, after = allocate(book, sizes.join(placed.select(key), key, "left_anti"), [F.desc("n"), F.col(key)], key)
    table = write_table(placed.unionByName(made.select(key, F.col("id").alias("person_id"), F.lit(False).alias("folded"))), "ledger-assignment")
    claimed = assignment.join(table.where("not folded"), key).select(F.col("person_id").alias("id"), "face_id")
    after = add_aliases(register(after, claimed), moves.where("kind = 'alias'").select(F.col("id").alias("from_id"), F.col("target").alias("to_id")))
    return table, after


def apply_folds(assignment: DataFrame, table: DataFrame, key: str = "cluster_id") -> DataFrame:
    """assignment with person_id: the faces of a folded cluster go to the identity that takes it in."""
    return assignment.join(table.select(key, "person_id"), key)
