"""Lookup joins on keys whose frequencies differ wildly (words, bigrams)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the rows of a lookup table that are broadcast.
HEAD_ROWS = 20_000


def lookup(
    facts: DataFrame, table: DataFrame, on: Sequence[str], frequency: str, head_rows: int = HEAD_ROWS
) -> DataFrame:
    """Left join of ``facts`` with a table that has unique keys and a frequency.

    A key is broadcast if it makes up at least one ``head_rows``-th of all occurrences.
    No more than ``head_rows`` keys can, whatever the table's size. All other rows are
    joined by an ordinary shuffle, where no key of the table can be hot. A key that is frequent in ``facts`` but not in
    the table is not known here, and its rows meet in one partition unless adaptive execution splits it.
    """
    on = list(on)
    total = table.agg(F.sum(frequency)).scalar()
    head = table.where(F.col(frequency) * head_rows >= total).withColumn("_hit", F.lit(True))
    tried = facts.join(F.broadcast(head), on, "left")
    hits = tried.where(F.col("_hit")).drop("_hit")
    misses = tried.where(F.col("_hit").isNull()).select(*facts.columns)
    return hits.unionByName(misses.join(table, on, "left"))
