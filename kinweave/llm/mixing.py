"""Mixing of sources to target weights by Poisson replication.

A source with n rows and target weight w gets the mean repetition rate L = w * total / n, where total is
the number of rows wanted over all. A row's copies are drawn by inverting the Poisson distribution at a
uniform number that a hash of its id and the seed gives: the same rows get the same copies in any run
and on any number of machines. Rows are exploded by their copies and shuffled globally by a second hash,
so that the output, read in the order of shuffle_key, is a uniform permutation.

Defined results: rows with a null source form a source of their own, whose weight is that of the key
None. Sources without a target weight get weight 0, which drops their rows; weights are scaled to sum
to 1 over the sources that occur. A null id is hashed as the empty string. Rows that repeat an id get equal
counts; the order among rows of equal shuffle_key, which needs equal ids and copy numbers, isn't defined. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import shuffle_parts, unused, write_table

#: The sources' tables of the distribution are broadcast up to so many numbers, 16 MB; beyond, they are joined by a shuffle.
BROADCAST_NUMBERS = 2_000_000


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """The first count that matters and the cumulative probabilities from there on.

    What lies below or beyond has under 1e-15 of the probability; the number of copies at a uniform u is the
    first count plus the number of entries that are u or less.
    """
    if not rate > 0:
        return 0, []
    wide = 12 * math.sqrt(rate) + 20
    first = max(0, math.floor(rate - wide))
    out, total = [], 0.0
    for k in range(first, math.ceil(rate + wide)):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out.append(total)
    return first, out


def uniform(key: F.Column, salt: str) -> F.Column:
    """A number in [0, 1) with 52 bits from the MD5 of key and salt."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{salt}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, total: int | None = None, source_col: str = "source") -> DataFrame:
    """source, n, rate: the mean repetition rate of each source.

    Without weights, the target weight of a source is proportional to n ** temperature.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        sized = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__name string, __w double")
        sized = sizes.join(F.broadcast(table), F.col("__source").cast("string").eqNullSafe(F.col("__name")), "left").withColumn("w", F.coalesce("__w", F.lit(0.0)))
    sized = write_table(sized.select("__source", "n", "w"), "sources")
    rows, weight = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    wanted = float(rows if total is None else total)
    rate = F.when(F.lit(weight) > 0, F.col("w") / F.lit(weight or 1.0) * F.lit(wanted) / F.col("n")).otherwise(F.lit(0.0))
    return sized.select("__source", "n", rate.alias("rate"))


_TABLE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("cdf", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_TABLE)
def _table(rates: pd.Series) -> pd.DataFrame:
    made = [poisson_table(r) for r in rates]
    return pd.DataFrame({"first": [m[0] for m in made], "cdf": [m[1] for m in made]})


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs replicated to the target weights and globally shuffled, with copy (from 0), n_copies and shuffle_key.

    The output is range-partitioned by shuffle_key and sorted within partitions, replacing columns of these names.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, temperature, total, source_col)
    u, source, table, part = unused(docs, "__u", "__source", "__table", "__part")
    tables = write_table(rates.select(F.col("__source").alias(source), _table("rate").alias(table)), "poisson")
    if (tables.agg(F.coalesce(F.sum(F.size(f"{table}.cdf") + 8), F.lit(0))).first()[0]) <= BROADCAST_NUMBERS:
        tables = F.broadcast(tables)
    names = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = docs.select(*names).withColumn(u, uniform(key, f"{seed}|copies"))
    drawn = drawn.join(tables, F.col(source_col).eqNullSafe(F.col(source)), "left")
    n = F.when(F.size(f"{table}.cdf") <= 0, F.lit(0)).otherwise(F.col(f"{table}.first") + F.size(F.filter(f"{table}.cdf", lambda c: c <= F.col(u))))
    drawn = drawn.withColumn("n_copies", n.cast("int")).where("n_copies > 0")
    spread = drawn.select(*names, "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    spread = spread.withColumn("shuffle_key", uniform(F.concat(key, F.lit("|"), F.col("copy").cast("string")), f"{seed}|order"))
    parts = shuffle_parts(spark)
    # the key is uniform, so equal ranges of it are equal shares: no sampling pass is needed
    ranged = spread.withColumn(part, F.floor(F.col("shuffle_key") * parts).cast("int")).repartitionById(parts, F.col(part))
    return ranged.drop(part).sortWithinPartitions("shuffle_key").select(*names, "copy", "n_copies", "shuffle_key")
