"""Ledger, overrides, review, sources and sinks on small cases."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import scalars as sc
from kinweave.operators import gates, ledger, overrides, people, review
from kinweave.sources import ingest, sinks
from kinweave.streaming import incremental


def book(spark, *anchors):
    """A ledger whose ids p-0001, ... hold the given faces."""
    groups = spark.createDataFrame([(i, f) for i, a in enumerate(anchors) for f in a.split()] or [(0, "x")], "n int, face_id string")
    numbers, held = ledger.allocate(ledger.empty_book(spark), groups.select("n").distinct().limit(len(anchors)), ["n"], "n")
    return ledger.register(held, groups.join(numbers, "n")) if anchors else ledger.empty_book(spark)


def run(spark, held, clusters, apart=()):
    rows = spark.createDataFrame([(i, f) for i, c in enumerate(clusters) for f in c.split()], "cluster_id long, face_id string")
    table, after = ledger.assign(held, rows, spark.createDataFrame(list(apart), "a string, b string"))
    return {r["cluster_id"]: (r["person_id"], r["folded"]) for r in table.collect()}, after


def aliases(held):
    return dict(map(tuple, held.aliases.collect()))


def test_an_identity_that_grows_keeps_its_id(spark):
    got, after = run(spark, book(spark, "f1 f2"), ["f1 f2 f3 f4 f5 f6 f7 f8 f9 f10"])
    assert got == {0: ("p-0001", False)} and after.anchors.count() == 10


def test_two_ids_for_one_cluster_leave_an_alias_unless_kept_apart(spark):
    got, after = run(spark, book(spark, "f1 f2 f3", "f4 f5"), ["f1 f2 f3 f4 f5"])
    assert got == {0: ("p-0001", False)} and aliases(after) == {"p-0002": "p-0001"}
    _, after = run(spark, book(spark, "f1 f2 f3", "f4 f5"), ["f1 f2 f3 f4 f5"], [("p-0002", "p-0001")])
    assert aliases(after) == {}


def test_a_second_cluster_of_one_id_folds_into_it(spark):
    got, _ = run(spark, book(spark, "f1 f2 f3 f4"), ["f1 f2 f3", "f4 f9"])
    assert got == {0: ("p-0001", False), 1: ("p-0001", True)}


def test_a_fold_is_refused_where_a_human_keeps_apart(spark):
    got, _ = run(spark, book(spark, "f1 f2 f3 f4", "g1 g2 g3 g4 g5 g6 g7 g8"), ["f1 f2 f3", "f4 g1"], [("p-0001", "p-0002")])
    assert got[0] == ("p-0001", False) and got[1] == ("p-0002", False)
    got, _ = run(spark, book(spark, "f1 f2 f3 f4", "g1 g2 g3 g4 g5 g6 g7 g8 g9"), ["f1 f2 f3", "g2 g3 g4 g5", "f4 g1"], [("p-0001", "p-0002")])
    assert got[2] == ("p-0003", False)


def test_absorbed_ids_are_no_candidates(spark):
    held = ledger.add_aliases(book(spark, "f1 f2 f3", "f4 f5"), spark.createDataFrame([("p-0002", "p-0001"), ("p-0001", "p-0001")], "from_id string, to_id string"))
    got, after = run(spark, held, ["f4 f5", "f1 f2 f3"])
    assert got == {1: ("p-0001", False), 0: ("p-0003", False)} and aliases(after) == {"p-0002": "p-0001"}


def test_new_ids_are_never_used_again(spark):
    got, after = run(spark, book(spark, "f1"), ["y1", "x1 x2"])
    assert got == {0: ("p-0003", False), 1: ("p-0002", False)}
    asked = spark.createDataFrame([("p-0003",), ("nobody",)], "id string")
    assert dict(map(tuple, ledger.ordinals(after, asked).collect())) == {"p-0003": 3, "nobody": 0}


def naive_assign(anchors, clusters, apart):
    """The rules one after another: ids by cluster, folded clusters, and aliases."""
    ids, folded, alias, holder, n = {}, set(), {}, {}, len(anchors)
    foes = collections.defaultdict(set)
    for a, b in apart:
        foes[a].add(b)
        foes[b].add(a)
    for c in sorted(range(len(clusters)), key=lambda i: (-len(clusters[i]), i)):
        near = [(len(a & clusters[c]), len(a & clusters[c]) / min(len(a), len(clusters[c])), p) for p, a in anchors.items() if a]
        free = [x for x in near if x[1] >= 0.25 and x[2] not in holder and x[2] not in alias]
        if free:
            best = sorted(free, key=lambda x: (-x[0], -x[1], x[2]))[0][2]
            ids[c], holder[best] = best, c
            alias.update({p: best for _, _, p in free if p != best and best not in foes[p]})
            continue
        taken = [(share, p) for p in holder for both, share, q in near if q == p and share >= 0.25 and not any(anchors.get(f, set()) & clusters[c] for f in foes[p])]
        if taken:
            ids[c] = max(taken, key=lambda x: x[0])[1]
            folded.add(c)
        else:
            n += 1
            ids[c] = f"p-{n:04d}"
    return ids, folded, alias


@pytest.mark.parametrize("seed", range(3))
def test_assignment_is_the_naive_walk(spark, seed):
    rnd = random.Random(seed)
    faces = [f"f{i}" for i in range(60)]
    old = [" ".join(rnd.sample(faces, rnd.randrange(1, 9))) for _ in range(12)]
    rnd.shuffle(faces)
    cuts = sorted(rnd.sample(range(1, 60), 14))
    clusters = [" ".join(faces[a:b]) for a, b in zip([0, *cuts], [*cuts, 60], strict=True)]
    apart = [(f"p-{rnd.randrange(1, 13):04d}", f"p-{rnd.randrange(1, 13):04d}") for _ in range(8)]
    got, after = run(spark, book(spark, *old), clusters, apart)
    ids, folded, alias = naive_assign({f"p-{i + 1:04d}": set(o.split()) for i, o in enumerate(old)}, [set(c.split()) for c in clusters], apart)
    assert {c: p for c, (p, _) in got.items()} == ids and {c for c, (_, f) in got.items() if f} == folded and aliases(after) == alias


def test_a_ledger_is_saved_and_loaded(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    assert ledger.load(spark, root).next_id == 1
    ledger.save(book(spark, "f1 f2", "f3"), root)
    held = ledger.load(spark, root)
    assert (held.next_id, held.next_ordinal) == (3, 3) and held.anchors.count() == 3


ROWS = [("p1", "f1", "t-1"), ("p1", "f2", "t-2"), ("p2", "f3", "t-1"), ("p3", "f4", "t-3")]


def table(spark):
    return spark.createDataFrame(ROWS, "person_id string, face_id string, photo_id string")


def test_overrides_in_their_order(spark):
    spec = {"split": {"p1": {"moveFaces": ["f2", "gone"]}}, "merge": [["p2", "p3"], ["p3", "p4"]], "include": {"p2": ["f1"]}, "people": {"p-0001": {"hidden": True}}}
    out, aliases = overrides.apply(table(spark), table(spark).select("face_id", "photo_id"), spec)
    assert {(r["person_id"], r["face_id"]) for r in out.collect()} == {("p1", "f1"), ("p2", "f3"), ("p2", "f4"), ("p2", "f1")}
    assert aliases == {"p3": "p2", "p4": "p2"}
    assert {(r["kind"], r["reference"]) for r in overrides.stale_references(table(spark), spec).collect()} == {("merge", "p4"), ("people", "p-0001"), ("face", "gone")}
    assert [r["people"] for r in overrides.shared_faces(out).collect()] == [["p1", "p2"]]


def test_each_override_alone_and_none(spark):
    assert overrides.apply(table(spark), table(spark).select("face_id", "photo_id"), {})[0].count() == 4
    assert overrides.hide(table(spark), {"p1": {"hidden": True}}).count() == 2
    assert overrides.number_people(table(spark), "person_id").orderBy("ordinal").first()["new_id"] == "p-0001"


def test_conflicts_after_applying(spark):
    before = spark.createDataFrame([("a", "t-1", "f1"), ("a", "t-2", "f2"), ("b", "t-3", "f3"), ("c", "t-4", "f4")], "id string, photo string, face_id string")
    after = spark.createDataFrame([("a", "t-1", "f1"), ("a", "t-3", "f3"), ("c", "t-4", "f4")], "id string, photo string, face_id string")
    aliases = spark.createDataFrame([("b", "a")], "from_id string, to_id string")
    pairs = "a string, b string"
    found = review.validate(before, after, aliases, spark.createDataFrame([("a", "b"), ("a", "c")], pairs), spark.createDataFrame([("b", "a")], pairs))
    kinds = sorted(r["kind"] for r in found.collect())
    assert kinds == ["different but joined", "faces changed", "photos changed", "photos lost", "same but apart", "union not whole"]
    assert review.validate(before, before, aliases.limit(0), spark.createDataFrame([], pairs), spark.createDataFrame([], pairs)).count() == 0


def test_first_failing_gate_counts(spark):
    rows = spark.createDataFrame([("a", 0.5, 50, 0.0), ("b", 0.7, 50, 0.0), ("c", 0.7, 110, 0.0), ("d", 0.62, 110, 0.12), ("e", 0.9, 200, 0.9)], "face_id string, score double, native_width int, frontality double")
    ignored = spark.createDataFrame([("e",)], "face_id string")
    assert dict(map(tuple, gates.rejections(rows, ignored).collect())) == {"confidence": 1, "size": 1, "frontality": 1, "ignored": 1, "passed": 1}


@pytest.mark.parametrize(("a", "b", "d"), [("0" * 16, "f" * 16, 64), ("00000000000000ff", "00000000000000f0", 4), (None, "0" * 16, 64), ("00", "0" * 16, 64), ("8" + "0" * 15, "0" * 16, 1)])
def test_hamming(spark, a, b, d):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(sc.hamming(F.col("a"), F.col("b"))).first()[0] == d


def test_scalars(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert value(sc.round_half_up(F.lit(-2.5))) == -2
    assert value(sc.pad4(F.lit(12345))) == "12345" and value(sc.pad4(F.lit(7))) == "0007"
    assert value(sc.to_fixed(F.lit(0.07125), 4)) == 0.0712 and value(sc.to_fixed(F.lit(1.0), 4)) == 1.0
    assert value(sc.display_name(F.lit(None).cast("string"), F.lit(None).cast("int"))) == "Guest ?"
    assert value(sc.colour(F.lit(None).cast("int"), F.lit(1), F.lit(2))) == "#e5dcd1"
    assert value(sc.format_duration(F.lit(3_725_000))) == "1h 02m"
    assert value(sc.sequence_of(F.lit("T-12.JPG"))) == 12 and value(sc.sequence_of(F.lit("x.jpg"))) is None
    assert value(sc.face_quality(F.lit(1000), F.lit(1.0), F.lit(1.0), F.lit(-1.0), F.lit(1.0))) == pytest.approx(0.925)


def test_versions_and_templates(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    schema = "id string, n int"
    assert sinks.read_version(spark, root, schema).count() == 0
    first = sinks.commit_version(spark.createDataFrame([("a", 1), ("b", 2)], schema), root)
    sinks.upsert(spark, root, spark.createDataFrame([("b", 3), ("c", 4)], schema), ["id"], schema)
    assert dict(map(tuple, sinks.read_version(spark, root, schema).collect())) == {"a": 1, "b": 3, "c": 4}
    assert sinks.read_version(spark, root, schema, first).count() == 2
    assert sinks.snapshot(spark, {"t": root, "none": f"{root}-x"})["none"] is None
    path = f"file://{tmp_path}/o.json"
    assert sinks.write_template(spark, path, "{}") and not sinks.write_template(spark, path, "[]")
    (tmp_path / "t" / "CURRENT").unlink()
    with pytest.raises(ValueError, match="none is marked"):
        sinks.read_version(spark, root, schema)
    assert not sinks.clear(spark, root) and sinks.clear(spark, root, yes=True)


def test_json_tables(spark, tmp_path):
    from kinweave import schemas
    from kinweave.operators import emit

    assert ingest.read_people(spark, f"file://{tmp_path}/none").count() == 0
    rows = spark.createDataFrame([("p-1", 1, None, True, 1, ["t-1"]), ("p-2", 2, "N", None, 0, [])], schemas.PERSON)
    emit.write_json(rows, f"file://{tmp_path}/people")
    lines = sorted(r["value"] for r in spark.read.text(sinks.current_path(spark, f"file://{tmp_path}/people")).collect())
    assert lines == ['{"id":"p-1","ordinal":1,"name":null,"featured":true,"photoCount":1,"photos":["t-1"]}', '{"id":"p-2","ordinal":2,"name":"N","photoCount":0,"photos":[]}']
    assert [r["id"] for r in ingest.read_people(spark, f"file://{tmp_path}/people").collect()] == ["p-1"]
    with pytest.raises(ValueError, match="threshold"):
        ingest.parse_options(threshold=3)
    assert ingest.parse_options(threshold=0.5).similarity == 0.5
    assert ingest.runs_stage("b", ["a", "b"], first="b") and not ingest.runs_stage("a", ["a", "b"], only="b")


def test_discovery_reads_a_folder(spark, tmp_path):
    for name in ("t-2.jpg", "T-10.JPG", "t-3.jpg", "x.png"):
        (tmp_path / name).write_bytes(b"x")
    found = ingest.discover(spark, f"file://{tmp_path}", ignore=["T-3"], limit=5)
    assert [r["id"] for r in found.collect()] == ["t-2", "T-10"]


def test_incremental_runs_give_each_content_once(spark, tmp_path):
    schema = "id string, content string"
    source, cache, cured = f"file://{tmp_path}/in", f"file://{tmp_path}/cache", tmp_path / "cured"

    def engine(rows):
        bad = (F.col("content") == "bad") & F.lit(not cured.exists())
        return rows.select("sha1", F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, "no").alias("error"), F.upper("content").alias("result"))

    def results():
        rows = spark.read.option("recursiveFileLookup", "true").parquet(cache).collect()
        return sorted((r["result"], r["status"]) for r in rows)

    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "bad")], schema).write.parquet(source)
    incremental.run_incremental(spark, source, schema, engine, cache, f"file://{tmp_path}/cp")
    assert results() == [("BAD", "failed"), ("X", "ok")]
    spark.createDataFrame([("d", "x"), ("e", "y")], schema).write.mode("append").parquet(source)
    incremental.run_incremental(spark, source, schema, engine, cache, f"file://{tmp_path}/cp")
    assert results() == [("BAD", "failed"), ("BAD", "failed"), ("X", "ok"), ("Y", "ok")]
    cured.touch()  # no new file, and what failed is offered again
    incremental.run_incremental(spark, source, schema, engine, cache, f"file://{tmp_path}/cp")
    assert results() == [("BAD", "failed"), ("BAD", "failed"), ("BAD", "ok"), ("X", "ok"), ("Y", "ok")]
    incremental.run_incremental(spark, source, schema, engine, cache, f"file://{tmp_path}/cp")
    assert len(results()) == 5


def test_first_page_and_cards(spark):
    persons = spark.createDataFrame([("p-1", None, 4, 7)], "id string, name string, ordinal int, photo_count int")
    photos = spark.createDataFrame([(f"t-{i}", i) for i in range(5)], "id string, seq int")
    assert people.landing(persons, photos).first() == ("people", 1, 5) and people.landing(persons.limit(0), photos).first() == ("photos", 0, 5)
    cards = people.person_card(persons, spark.createDataFrame([("p-1",), ("p-9",)], "id string")).collect()
    assert sorted(map(tuple, cards)) == [("p-1", True, "Guest 4", 7), ("p-9", False, None, None)]
    around = {r["id"]: (r["previous"], r["next"]) for r in people.neighbours(photos).collect()}
    assert around == {f"t-{i}": (f"t-{(i - 1) % 5}", f"t-{(i + 1) % 5}") for i in range(5)}
    assert people.neighbours(photos.limit(1)).first() == ("t-0", "t-0", "t-0") and people.neighbours(photos.limit(0)).count() == 0
    assert [tuple(r) for r in people.grid(photos, 2, 3).orderBy("position").collect()] == [(f"t-{i}", i + 1, i % 2, i // 3) for i in range(5)]
