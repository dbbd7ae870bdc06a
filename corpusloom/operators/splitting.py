"""Text splitting. Everything stays inside the document's row; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import elements, let
from corpusloom.functions.text import strip, words

# Window and chunk sizes in tokens.
WINDOW = 256
OVERLAP = 20
MIN_CHUNK = 100
MAX_CHUNK = 256


def token_windows(tokens: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of token arrays: fixed stride ``size - overlap``; the last may be short."""
    stride = size - overlap

    def cut(bound: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(bound) - size) / stride)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(bound, k * stride + 1, size))
        return F.filter(pieces, lambda w: F.size(w) > 0)

    return let(tokens, cut)


def window_units(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    return F.transform(token_windows(words(text), size, overlap), lambda w: F.array_join(w, " "))


def sentence_units(text: Column) -> Column:
    """Pieces that end after ``.``, ``!`` or ``?`` and whitespace."""
    pieces = F.transform(F.split(text, r"(?<=[.!?])\s+"), strip)
    return F.filter(pieces, lambda s: s != "")


def units(text: Column, mode: str = "sentence") -> Column:
    return {"sentence": sentence_units, "window": window_units}[mode](text)


def explode_chunks(docs: DataFrame, chunks: str | Column, pos: str = "chunk_no", out: str = "chunk") -> DataFrame:
    keep = [c for c in docs.columns if c not in ("text", chunks if isinstance(chunks, str) else None)]
    return docs.select(*keep, F.posexplode(elements(chunks)).alias(pos, out))


def buffered(units_: Column, radius: int = 1) -> Column:
    """Each unit joined with its neighbours."""
    def around(bound: Column, i: Column) -> Column:
        start = F.greatest(i - radius, F.lit(0))
        return F.array_join(F.slice(bound, start + 1, i + radius - start + 1), " ")

    return let(units_, lambda u: F.transform(u, lambda _, i: around(u, i)))


def node_id(doc_id: Column, chunk_no: Column) -> Column:
    """Stable id of a chunk."""
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), chunk_no.cast("string")), 256)


def nodes(chunks: DataFrame) -> DataFrame:
    """``(doc_id, chunk_no, chunk)`` to published columns ``text, file_name, node_id``."""
    return chunks.select(
        "doc_id", "chunk_no", F.col("chunk").alias("text"), "file_name",
        node_id(F.col("doc_id"), F.col("chunk_no")).alias("node_id"),
    )


def merge_short(chunks: Column, minimum: int = MIN_CHUNK) -> Column:
    """Join chunks (token arrays) in order while both sides are under ``minimum`` tokens.

    The fold only carries sizes and group numbers; tokens are put together once at the end.
    """
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))

    def step(acc: Column, chunk: Column) -> Column:
        n = F.size(chunk)
        joins = (acc["at"] > 0) & (n < minimum) & (acc["size"] < minimum)
        return F.struct(
            F.when(joins, acc["size"] + n).otherwise(n).alias("size"),
            F.when(joins, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["at"])).alias("starts"),
            (acc["at"] + 1).alias("at"),
        )

    def regroup(bound: Column) -> Column:
        starts = F.aggregate(bound, start, step, lambda acc: acc["starts"])
        return let(starts, lambda s: F.transform(s, lambda first, i: F.flatten(runs(bound, s, first, i))))

    return let(chunks, regroup)


def runs(items: Column, starts: Column, first: Column, i: Column) -> Column:
    """Slice of ``items`` from the ``i``-th start up to the next start."""
    following = F.coalesce(F.get(starts, i + 1), F.size(items))
    return F.slice(items, first + 1, following - first)


def cut_long(chunks: Column, maximum: int = MAX_CHUNK) -> Column:
    """Cut token arrays longer than ``maximum`` into consecutive pieces."""
    return F.flatten(F.transform(chunks, lambda c: token_windows(c, maximum, 0)))


def bound_sizes(chunks: Column, minimum: int = MIN_CHUNK, maximum: int = MAX_CHUNK) -> Column:
    return cut_long(merge_short(chunks, minimum), maximum)
