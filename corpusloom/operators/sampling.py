"""Seeded split, shuffle and length-grouped batches, the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import order_key
from corpusloom.plans.ranking import with_rank

# Share of held-out rows, seed, batch size, batches per length group.
TEST_SHARE = 0.05
SEED = 3
BATCH_ROWS = 4
MEGA_BATCHES = 50


def split_boundary(keys: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """One row ``cut``: the (hash, key) of the last test row.

    A histogram over the first four hex digits (at most 65,536 rows) finds the
    bucket that holds the boundary; only that bucket is ranked.
    """
    hashed = keys.select(F.col(key).alias("k"), order_key(seed, F.col(key)).alias("h"))
    hashed = hashed.withColumn("b", F.substring("h", 1, 4))
    hist = hashed.groupBy("b").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    upto = everything.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hist.select("b", "n", F.sum("n").over(upto).alias("end"), F.sum("n").over(everything).alias("total"))
    # Ceiling on the nearest 9 digits: 0.05 * 20 must not become 2 through a last-bit error.
    wanted = F.ceil(F.round(F.col("total") * F.lit(share), 9))
    edge = placed.withColumn("want", wanted).where("end >= want and end - n < want").select(
        "b", (F.col("want") - (F.col("end") - F.col("n"))).alias("take")
    )
    inside = hashed.join(F.broadcast(edge), "b")  # edge is one row
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", "k")))
    return ranked.where("r = take").select(F.struct("h", "k").alias("cut"))


def with_split(rows: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split``: exactly ``ceil(share * n)`` rows are ``test``.

    The rows themselves are only compared with one scalar; they never move.
    """
    cut = split_boundary(rows.select(key), key, share, seed).scalar()
    here = F.struct(order_key(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
    return rows.withColumn("split", F.when(here <= cut, F.lit("test")).otherwise(F.lit("train")))


def shuffled(rows: DataFrame, key: str, seed: int = SEED, out: str = "position") -> DataFrame:
    """Keys with their 0-based place in the seeded shuffle."""
    keyed = rows.withColumn("_h", order_key(seed, F.col(key)))
    return with_rank(keyed, ["_h", key], out=out).withColumn(out, F.col(out) - 1).drop("_h")


def length_batches(rows: DataFrame, key: str, length: str | Column, seed: int = SEED,
                   batch: int = BATCH_ROWS, mega: int = MEGA_BATCHES) -> DataFrame:
    """Add ``mega`` and ``batch``: shuffled groups, sorted by length inside, cut into batches.

    A group has ``batch * mega`` rows, so the window never holds more than that.
    """
    length = F.col(length) if isinstance(length, str) else length
    placed = shuffled(rows.withColumn("_len", length), key, seed)
    placed = placed.withColumn("mega", F.floor(F.col("position") / (batch * mega)).cast("long"))
    inside = Window.partitionBy("mega").orderBy(F.col("_len").desc(), F.col("position"))
    place = F.row_number().over(inside) - 1
    return placed.withColumn(
        "batch", (F.col("mega") * mega + F.floor(place / batch)).cast("long")
    ).drop("_len")
