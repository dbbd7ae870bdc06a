"""Greedy packing of files into size-bounded shards, exact and distributed.

The rule is sequential: a file opens a new shard when the current shard is not
empty and the file would push it over the limit. A folder may hold billions of
files, so it is cut into blocks in listing order:

1. ``_block_effect``: per block, what it does to *any* incoming fill level. The
   answer only depends on where the first break falls: a list of intervals of
   levels, and what happens to a level that passes without a break;
2. ``_compose``: the effects of ``FAN`` neighbours become that of their union, round by
   round, until one is left per folder. An effect has no more intervals than a shard
   has files, as the first break falls within the first ``limit`` bytes;
3. ``_hand_down``: from the top, each group tells its members their starting levels;
4. ``_number_block``: per block, number the files from the known starting level.

Only ids and sizes travel; text never does.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.ranking import sorted_positions
from corpusloom.session import materialize

BLOCK_ROWS = 100_000
_BLOCK = ["_scope", "_part", "_blk"]
#: Neighbouring effects that a task composes.
FAN = 8
_EFFECT = "above binary, breaks binary, after binary, zero_breaks long, zero_after long, total long"
_NODE = f"_scope string, _node long, {_EFFECT}"
_START = "_scope string, _node long, _level long, _shard long"


@dataclass
class Effect:
    """What a run of files does to the fill level of the shard before it.

    A level above ``above[k]`` (falling), and not above the bound before, sees ``breaks[k]`` breaks and leaves ``after[k]``; a level
    at or below all bounds grows by ``total``. An empty shard is a case of its own, as it never breaks at once.
    """

    above: np.ndarray
    breaks: np.ndarray
    after: np.ndarray
    zero_breaks: int
    zero_after: int
    total: int

    def __call__(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(-self.above, -level, side="right")
        known = at < len(self.above)
        breaks, after = np.zeros_like(level), level + self.total
        breaks[known], after[known] = self.breaks[at[known]], self.after[at[known]]
        empty = level == 0
        breaks[empty], after[empty] = self.zero_breaks, self.zero_after
        return breaks, after

    def then(self, other: Effect) -> Effect:
        more, after = other(self.after)
        # Levels that pass here without a break arrive at the other side larger by the total.
        bound = other.above - self.total
        reached = bound < self.above[-1] if len(self.above) else np.ones(len(bound), bool)
        above, breaks, after = (
            np.concatenate(pair) for pair in (
                (self.above, bound[reached]), (self.breaks + more, other.breaks[reached]), (after, other.after[reached]),
            )
        )
        # What follows a bound that every level is above is never reached; neighbours of the same effect are one interval.
        some = slice(0, int(np.append(above <= 0, True).argmax()) + 1)
        above, breaks, after = above[some], breaks[some], after[some]
        last = np.ones(len(above), bool)
        last[:-1] = (breaks[1:] != breaks[:-1]) | (after[1:] != after[:-1])
        zero_more, zero_after = (int(x[0]) for x in other(np.array([self.zero_after])))
        return Effect(above[last], breaks[last], after[last], self.zero_breaks + zero_more, zero_after, self.total + other.total)

    def row(self) -> dict:
        arrays = {k: getattr(self, k).astype(np.int64).tobytes() for k in ("above", "breaks", "after")}
        return arrays | {"zero_breaks": self.zero_breaks, "zero_after": self.zero_after, "total": self.total}

    @staticmethod
    def of(row) -> Effect:
        arrays = (np.frombuffer(x, np.int64) for x in (row.above, row.breaks, row.after))
        return Effect(*arrays, int(row.zero_breaks), int(row.zero_after), int(row.total))


def _breaks(sums: np.ndarray, limit: int) -> np.ndarray:
    """For each file as shard opener, index of the next opener (``len`` if none in the block).

    ``sums`` has one more entry than files: ``sums[j] - sums[i]`` is the size of files i..j-1.
    """
    n = len(sums) - 1
    at = np.searchsorted(sums, sums[:-1] + limit, side="right") - 1
    # A shard that is still empty takes an oversized file and closes right after it.
    inside = at < n
    empty = inside & (sums[np.minimum(at, n)] == sums[:-1])
    return np.minimum(np.where(empty, at + 1, at), n)


def _first_break(sums: np.ndarray, level: int, limit: int) -> int:
    at = max(int(np.searchsorted(sums, limit - level, side="right")), 1) - 1
    if at < len(sums) - 1 and level + sums[at] == 0:
        at += 1
    return min(at, len(sums) - 1)


def _block_effect(sizes: np.ndarray, limit: int) -> Effect:
    sums = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = len(sizes)
    following = _breaks(sums, limit)
    count = np.zeros(n, dtype=np.int64)
    fill = np.zeros(n, dtype=np.int64)
    total = int(sums[-1])
    for i in range(n - 1, -1, -1):
        j = following[i]
        if j < n:
            count[i], fill[i] = count[j] + 1, fill[j]
        else:
            fill[i] = total - sums[i]
    first = _first_break(sums, 0, limit)
    zero = (int(count[first]) + 1, int(fill[first])) if first < n else (0, total)
    above, breaks, after = [], [], []
    for p in range(min(first + 1, n)):
        effect = (int(count[p]) + 1, int(fill[p]))
        bound = int(limit - sums[p + 1])
        if breaks and (breaks[-1], after[-1]) == effect:
            above[-1] = bound
        else:
            above.append(bound)
            breaks.append(effect[0])
            after.append(effect[1])
    arrays = (np.array(x, np.int64) for x in (above, breaks, after))
    return Effect(*arrays, zero[0], zero[1], total)


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    joint = functools.reduce(Effect.then, map(Effect.of, pdf.sort_values("_node").itertuples()))
    return pd.DataFrame([{"_scope": pdf["_scope"].iloc[0], "_node": int(pdf["_node"].min()) // FAN, **joint.row()}])


def _hand_down(key: tuple, members: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    level, shard = int(start["_level"].iloc[0]), int(start["_shard"].iloc[0])
    members, out = members.sort_values("_node"), []
    for node, row in zip(members["_node"], members.itertuples(), strict=True):
        out.append((key[0], int(node), level, shard))
        breaks, after = Effect.of(row)(np.array([level]))
        level, shard = int(after[0]), shard + int(breaks[0])
    return pd.DataFrame(out, columns=["_scope", "_node", "_level", "_shard"])


def _starts(effects: DataFrame, nodes: int) -> DataFrame:
    """Fill level and shard at the start of each node, from effects of up to ``nodes`` nodes a scope (numbered from 0)."""
    if nodes <= 1:
        return effects.select("_scope", "_node", F.lit(0).cast("long").alias("_level"), F.lit(0).cast("long").alias("_shard"))
    effects = materialize(effects, "effects")
    parent = F.floor(F.col("_node") / FAN).cast("long").alias("_parent")
    joint = effects.groupBy("_scope", parent).applyInPandas(_compose, _NODE)
    above = _starts(joint, -(-nodes // FAN)).withColumnRenamed("_node", "_parent")
    members = effects.withColumn("_parent", parent).groupBy("_scope", "_parent")
    return members.cogroup(above.groupBy("_scope", "_parent")).applyInPandas(_hand_down, _START)


def _number_block(sizes: np.ndarray, level: int, shard: int, limit: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    following = _breaks(sums, limit)
    opens = np.zeros(len(sizes), dtype=np.int64)
    at = _first_break(sums, level, limit)
    while at < len(sizes):
        opens[at] = 1
        at = following[at]
    return shard + np.cumsum(opens)


def pack(files: DataFrame, limit: int, scope: str | None = "folder", order: tuple[str, ...] = ("path",),
         size: str = "bytes", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``shard`` (0-based within each scope value) to ``files``; ``scope=None`` packs all as one."""
    # A null scope is one of its own.
    key = F.lit("") if scope is None else F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit(""))
    placed = sorted_positions(files.withColumn("_scope", key), ["_scope"], list(order))
    placed = placed.withColumn("_blk", F.floor(F.col("_at") / block_rows).cast("long"))

    # A row for each block_rows files: numbering them is no work.
    order_of = Window.partitionBy("_scope").orderBy("_part", "_blk")
    blocks = placed.select(*_BLOCK).distinct().withColumn("_node", (F.row_number().over(order_of) - 1).cast("long"))
    blocks = materialize(blocks, "blocks")
    most = blocks.agg(F.coalesce(F.max("_node"), F.lit(-1)).alias("n")).first()["n"] + 1
    # A task's call takes as many small blocks as make up a large one.
    many = max(1, BLOCK_ROWS // block_rows)
    numbered_blocks = placed.join(blocks, _BLOCK).withColumn("_some", F.floor(F.col("_node") / many))

    def summarize(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_node", "_at"])
        nodes, first = np.unique(pdf["_node"].to_numpy(), return_index=True)
        parts = np.split(pdf[size].to_numpy(), first[1:])
        return pd.DataFrame([{"_scope": key[0], "_node": n, **_block_effect(x, limit).row()} for n, x in zip(nodes.tolist(), parts, strict=True)])

    effects = numbered_blocks.select("_scope", "_some", "_node", "_at", size).groupBy("_scope", "_some").applyInPandas(summarize, _NODE)
    starts = _starts(effects, most).withColumn("_some", F.floor(F.col("_node") / many))

    schema = T.StructType([*placed.schema.fields, T.StructField("shard", T.IntegerType())])
    wide = numbered_blocks.select(*placed.columns, "_some", "_node")

    def number(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf, start = pdf.sort_values(["_node", "_at"]), start.sort_values("_node")
        first = np.unique(pdf["_node"].to_numpy(), return_index=True)[1]
        parts = zip(np.split(pdf[size].to_numpy(), first[1:]), start["_level"], start["_shard"], strict=True)
        pdf["shard"] = np.concatenate([_number_block(x, int(level), int(shard), limit) for x, level, shard in parts])
        return pdf.drop(columns=["_some", "_node"])

    numbered = wide.groupBy("_scope", "_some").cogroup(starts.groupBy("_scope", "_some")).applyInPandas(number, schema)
    return numbered.select(*files.columns, "shard")


def global_numbers(packed: DataFrame, scope: str, scope_order: str) -> DataFrame:
    """Make per-scope shard numbers one sequence, scopes in ``scope_order``."""
    # One row per folder; folders are an argument list, so this window is small.
    counts = packed.groupBy(scope).agg(F.min(scope_order).alias("_o"), (F.max("shard") + 1).alias("_n"))
    before = Window.orderBy("_o", scope).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(scope, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return packed.join(offsets, scope).withColumn("shard", (F.col("shard") + F.col("_base")).cast("int")).drop("_base")


def packing_summary(packed: DataFrame, scope: str) -> DataFrame:
    return packed.groupBy(scope, "shard").agg(
        F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes")
    )
