"""Near-duplicate photos by perceptual hash."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scalars import hamming
from ..storage import write_table
from .components import connected_components
from .ranking import number_rows

BITS = 64


#: Bands that hashes are cut into, by the number of hashes: more bands make finer keys and more rows.
BANDS = ((1 << 18, 8), (1 << 23, 9), (1 << 62, 10))


def hash_classes(hashes: DataFrame, key: str = "idx", hash_col: str = "phash") -> DataFrame:
    """hash, rep, n: each hash of 16 digits once, with the smallest key that has it and how many have it."""
    known = hashes.where(F.length(hash_col) == 16)
    return known.groupBy(F.col(hash_col).alias("hash")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def hamming_pairs(hashes: DataFrame, most: int = DEFAULT.hamming_dupe, key: str = "idx", hash_col: str = "phash") -> DataFrame:
    """a, b, d, na, nb: pairs of hashes that differ in `most` bits or fewer, by their smallest keys, a < b, and how many rows have each.

    Rows with equal hashes are one class; hash_classes gives the members. The bits are cut into bands; two such hashes agree in all bands but `most`, so
    every choice of that many bands is a key, and an equi-join on the choice and its bits finds them all; the exact count drops the rest.
    """
    classes = write_table(hash_classes(hashes, key, hash_col), "hash-classes")
    total = classes.count()
    bands = max(most + 1, next(b for n, b in BANDS if total <= n))
    bits = F.lpad(F.conv("hash", 16, 2), BITS, "0")
    edges = [round(i * BITS / bands) for i in range(bands + 1)]
    cut = [F.substring(bits, a + 1, b - a) for a, b in itertools.pairwise(edges)]
    keys = F.array(*(F.struct(F.lit(i).alias("pick"), F.concat(*(cut[j] for j in pick)).alias("part")) for i, pick in enumerate(itertools.combinations(range(bands), bands - most))))
    dealt = classes.select("hash", "rep", "n", F.explode(keys).alias("x")).select("hash", "rep", "n", "x.pick", "x.part")
    other = dealt.select(F.col("hash").alias("other"), F.col("rep").alias("orep"), F.col("n").alias("on"), F.col("pick").alias("opick"), F.col("part").alias("opart"))
    near = dealt.join(other, (F.col("pick") == F.col("opick")) & (F.col("part") == F.col("opart")) & (F.col("rep") < F.col("orep")))
    near = near.withColumn("d", hamming(F.col("hash"), F.col("other"))).where(F.col("d") <= most)
    return near.select(F.col("rep").alias("a"), F.col("orep").alias("b"), "d", F.col("n").alias("na"), F.col("on").alias("nb")).distinct()


def near_duplicate_groups(photos: DataFrame, most: int = DEFAULT.hamming_dupe, order: str = "seq", id_col: str = "photo_id", hash_col: str = "phash") -> DataFrame:
    """photo_id, group_id: photos in order join the first group whose first member is within `most` bits, or found one.

    Only hashes within reach can meet, so connected hashes are scanned together and apart from others. A null
    hash is its own group; groups are numbered from 0 by their first photo.
    """
    rows = photos.select(F.col(id_col).alias("id"), F.col(order).alias("pos"), F.col(hash_col).alias("hash"))
    first = rows.where("hash is not null").groupBy("hash").agg(F.min(F.struct("pos", "id")).alias("first")).select("hash", "first.pos", "first.id")
    pairs = hamming_pairs(first, most, "hash", "hash")
    every = first.join(connected_components(pairs.select("a", "b")), F.col("hash") == F.col("node"), "left").withColumn("root", F.coalesce("root", "hash"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "id"])
        leaders: dict[str, list[int]] = {}
        found = []
        for root, h in zip(pdf["root"], pdf["hash"], strict=True):
            value, own = int(h, 16), leaders.setdefault(root, [])
            lead = next((x for x in own if (x ^ value).bit_count() <= most), None)
            if lead is None:
                own.append(lead := value)
            found.append(f"{lead:016x}")
        return pd.DataFrame({"hash": pdf["hash"], "leader": found})

    every = write_table(every.select("hash", "pos", "id", "root"), "hashes")
    # components that share a lot are told apart in it; a lot has about 4,096 hashes
    lots = max(1, -(-every.count() // 4096))
    led = every.withColumn("lot", F.pmod(F.xxhash64("root"), F.lit(lots))).groupBy("lot").applyInPandas(scan, "hash string, leader string")
    placed = rows.join(led, "hash", "left")
    group = F.coalesce(F.col("leader"), F.concat(F.lit("alone "), F.col("id").cast("string")))
    firsts = placed.groupBy(group.alias("g")).agg(F.min(F.struct("pos", "id")).alias("first"))
    # the number of a group is the rank of its first photo
    numbers = number_rows(firsts, ["first"], "rank").select("g", (F.col("rank") - 1).alias("group_id"))
    return placed.withColumn("g", group).join(numbers, "g").select(F.col("id").alias(id_col), "group_id")
