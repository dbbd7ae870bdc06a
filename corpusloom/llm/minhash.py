"""Near-duplicates by circulant MinHash, with exact Jaccard verification and without pairs inside large groups.

A document is its set of word shingles. One permutation scatters the hashed shingles over positions; coordinate k of the
signature is the least value of a second permutation shifted circularly by k. Bands of four coordinates make the buckets:
with 32 bands a pair at the threshold of 0.8 shares no bucket with probability 5e-8.

Equal sets are one node. Links are then found in three passes:

1. each node is compared with one hub per bucket, chosen by hash; its best partner (by signature) is verified on full sets;
2. in buckets whose members still lie in different components, members outside the most common one are compared with all of
   other components, in blocks of bounded size, and their best partner is verified;
3. where components still differ, all pairs across them that may reach the threshold are verified on full sets. Shingles that
   no other such node has cannot be shared, which bounds the similarity of a pair exactly; copies that differ from each other by
   their own edits part there.

So a group of many thousand near copies costs a few links a member, plus what its outliers need. Nothing is capped: pairs are
left out only if they are in one component already, if that bound excludes them, or if their signatures agree in fewer than
``MIN_AGREE`` of 128 places (five standard deviations below what 0.8 gives; in the last pass also ``FINE_AGREE`` of 1024).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, map_batches, scramble, word_hashes
from corpusloom.llm.components import components, contract, known_labels
from corpusloom.session import materialize

WIDTH = 4
THRESHOLD = (80, 100)
COORDINATES = 128
BANDS = 32
MIN_AGREE = 78
#: The last pass compares longer signatures of one byte a coordinate, with the same margin.
FINE_COORDINATES = 1024
FINE_AGREE = 756
#: Rows of a block in the second pass.
BLOCK = 1024

_BAND_BYTES = 2 * COORDINATES // BANDS
_U = np.uint64
_MULTIPLIERS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    hashes = word_hashes(words)
    if not words:
        return hashes
    span = min(width, len(words))
    n = len(words) - span + 1
    out = np.full(n, span if span < width else 0, _U)
    for k in range(span):
        out += scramble(hashes[k : k + n] * _MULTIPLIERS[k % 4] + _U(k))
    return np.unique(scramble(out))


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Low 16 bits of each circulant MinHash coordinate."""
    scattered = _permute((shingles >> _U(32)).astype(np.uint32) ^ (shingles & _U(0xFFFFFFFF)).astype(np.uint32))
    out = np.empty(coordinates, np.uint32)
    step = max(1, min(coordinates, 32_768 // len(scattered)))
    for first in range(0, coordinates, step):
        shifts = np.arange(first, min(first + step, coordinates), dtype=np.uint32)
        out[first : first + step] = _permute(scattered[None, :] + shifts[:, None]).min(1)
    return out.astype("<u2")


def _sketch(ids, texts, hashes):
    counts, nodes, sketches = [], [], []
    for text in texts:
        shingles = shingle_set(text)
        counts.append(len(shingles))
        nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
        sketches.append(signature(shingles).tobytes() if len(shingles) else None)
    return ids, hashes, counts, nodes, sketches


def _agreement(left: list[bytes], right: list[bytes]) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(x), "<u2").reshape(-1, COORDINATES) for x in (left, right))
    return (a == b).sum(1)


def _fine_sketch(nodes, sets):
    return nodes, [signature(np.frombuffer(s, _U), FINE_COORDINATES).astype(np.uint8).tobytes() for s in sets]


def _near_hubs(nodes, sketches, hubs, hub_sketches):
    agree = _agreement(sketches, hub_sketches) if nodes else np.zeros(0, int)
    good = np.flatnonzero(agree >= MIN_AGREE).tolist()
    return [nodes[i] for i in good], [hubs[i] for i in good], [int(agree[i]) for i in good]


def _linked(a, left, b, right):
    stay = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
        both = len(np.intersect1d(x, y, assume_unique=True))
        if THRESHOLD[1] * both >= THRESHOLD[0] * (len(x) + len(y) - both):
            stay.append(i)
    return [a[i] for i in stay], [b[i] for i in stay]


def _set_rows(nodes, texts):
    sets = [shingle_set(text) for text in texts]
    good = [i for i, s in enumerate(sets) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == nodes[i]]
    return [nodes[i] for i in good], [sets[i].tobytes() for i in good]


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that reach the threshold on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "left", "b", "right")
    return map_batches(joined, "a binary, b binary", _linked)


def _pairs_of_block(rows: list[tuple], best_only: bool) -> list[tuple[bytes, bytes]]:
    """Pairs across labels in a block, or between two blocks; with ``best_only`` the best partner of each row whose label is
    not the most common one, otherwise all that may reach the threshold."""
    _, low, high, band = rows[0][:4]
    nodes = [row[4] for row in rows]
    label = np.unique(np.array([row[5].hex() for row in rows]), return_inverse=True)[1]
    sketch = np.frombuffer(b"".join(row[6] for row in rows), "<u2").reshape(len(rows), COORDINATES)
    block, size, shared = (np.array([row[k] for row in rows]) for k in (7, 8, 9))
    usual = np.bincount(label).argmax()
    fine = None if best_only else np.frombuffer(b"".join(row[10] for row in rows), np.uint8).reshape(len(rows), -1)
    out = []
    for i in range(len(rows)):
        if best_only:
            if label[i] == usual:
                continue
            others = np.flatnonzero((label != label[i]) & ((block != block[i]) if low < high else True))
        elif low < high and block[i] != low:
            continue
        else:
            # In a block paired with itself each pair comes once; otherwise one row from either block.
            others = np.flatnonzero((label != label[i]) & ((block == high) if low < high else (np.arange(len(rows)) > i)))
        common = np.minimum(shared[others], shared[i])
        others = others[THRESHOLD[1] * common >= THRESHOLD[0] * (size[others] + size[i] - common)]
        same = sketch[others] == sketch[i]
        agree = same.sum(1)
        near = agree >= MIN_AGREE
        if not near.any():
            continue
        if best_only:
            found = [int(others[agree.argmax()])]
        else:
            # A pair that shares several buckets is taken in the first.
            first = same[near].reshape(int(near.sum()), BANDS, -1).all(2).argmax(1)
            found = others[near][first == band]
            found = found[(fine[found] == fine[i]).sum(1) >= FINE_AGREE].tolist()
        out += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for j in found]
    return out


def _cross_pairs(best_only: bool):
    """Over rows sorted by (bucket, block, block)."""
    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs_of_block(rows, best_only) if len(rows) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield from emit(held)
                    held = []
                held.append(row)
        yield from emit(held)

    return run


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_hash)``, one row for each row of ``docs``.

    Words are what ASCII white space separates, A-Z lower-cased. Null, empty and blank texts have an empty set and no link.
    A component is named by its smallest doc_id (null if it has none, or for an unlinked row without id); rows with that id
    are kept, so rows that repeat a doc_id stay or go together. ``text_hash`` is xxhash64 of the text. Other columns are not
    read; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sketches = materialize(
        map_batches(source, "doc_id bigint, text_hash bigint, n_shingles bigint, node binary, sketch binary", _sketch),
        "sketches",
    )
    nodes = materialize(
        sketches.where("node is not null").groupBy("node", "sketch").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"),
            F.max("n_shingles").alias("size"),
        ).select("node", "sketch", "size", F.col("first.doc_id").alias("low_id"), F.col("first.text_hash").alias("text_hash")),
        "nodes",
    )
    bands = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sketch").select(
        "node", "band",
        F.xxhash64("band", F.substring("sketch", F.col("band") * _BAND_BYTES + 1, F.lit(_BAND_BYTES))).alias("bucket"),
    )
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(
        bands.join(shared, "bucket").join(nodes.select("node", "sketch", "size"), "node")
        .select("bucket", "band", "n", "node", "sketch", "size"),
        "members",
    )
    sets = materialize(_full_sets(docs, nodes, members), "sets")
    # Two rounds settle nearly all components; what they leave apart only costs later passes a few needless pairs.
    stars = contract(_links(_best_hubs(members), sets), 2)
    open_rows = _open_rows(members, known_labels(stars))
    own = _own_shingles(open_rows.select("node").distinct(), sets)
    open_rows = open_rows.join(own, "node", "left").withColumn("shared_size", F.col("size") - F.coalesce("own", F.lit(0)))
    # What a node can share must reach the threshold of its own size.
    may = F.col("shared_size") * THRESHOLD[1] >= F.col("size") * THRESHOLD[0]
    open_rows = materialize(open_rows.where(may).drop("own"), "open")
    stars = contract(stars.unionByName(_links(_block_pairs(open_rows, True), sets)), 2)
    still_open = materialize(_open_rows(open_rows.drop("label"), known_labels(stars)), "open")
    fine = map_batches(
        sets.join(still_open.select("node").distinct(), "node").select("node", "shingles"), "node binary, fine binary", _fine_sketch
    )
    pairs = _block_pairs(still_open.join(fine, "node"), False)
    final = components(stars.unionByName(_links(pairs, sets)))
    names = nodes.select("node", "low_id").join(final, "node").groupBy("label").agg(F.min("low_id").alias("component_id"))
    named = nodes.select("node", "low_id").join(
        final.join(names, "label").select("node", "component_id", F.lit(True).alias("linked")), "node", "left"
    ).select("node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low_id")).alias("component_id"))
    return sketches.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_hash",
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _full_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Shingle sets of the nodes that share a bucket, from the text of one document each."""
    wanted = nodes.join(members.select("node").distinct(), "node").select(
        "node", F.col("low_id").alias("_id"), F.col("text_hash").alias("_hash")
    )
    texts = docs.select("doc_id", "text").join(
        wanted, (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    )
    return map_batches(texts.select("node", "text"), "node binary, shingles binary", _set_rows).dropDuplicates(["node"])


def _best_hubs(members: DataFrame) -> DataFrame:
    hubs = members.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("bucket", "node").alias("order"), "node", "sketch")).alias("hub")
    ).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.sketch").alias("hub_sketch"))
    tried = members.join(hubs, "bucket").where("node <> hub").select("node", "sketch", "hub", "hub_sketch")
    near = map_batches(tried, "node binary, hub binary, agree int", _near_hubs, 4096)
    best = near.groupBy("node").agg(F.max(F.struct("agree", "hub")).alias("best"))
    return best.select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node and shingle; the node as two numbers."""
    for batch in batches:
        for node, packed in zip(batch.column(0), batch.column(1), strict=True):
            shingles = np.frombuffer(packed.as_buffer(), np.int64)
            first, last = np.frombuffer(node.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles), pa.array(np.full(len(shingles), first)), pa.array(np.full(len(shingles), last))],
                names=["shingle", "first", "last"],
            )


def _owners(first, last, counts):
    return [np.array(pair, np.int64).tobytes() for pair in zip(first, last, strict=True)], counts


def _own_shingles(open_nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, own)``: how many shingles of an open node no other one has; nodes without any are left out."""
    rows = sets.join(open_nodes, "node").select("node", "shingles").mapInArrow(
        _shingle_rows, "shingle bigint, first bigint, last bigint"
    )
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.min("last").alias("last"))
    owned = single.where("n = 1").groupBy("first", "last").agg(F.count("*").alias("own"))
    return map_batches(owned, "node binary, own bigint", _owners, 4096)


def _open_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets in which labels differ."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return labelled.join(mixed.select("bucket"), "bucket")


def _block_pairs(open_rows: DataFrame, best_only: bool) -> DataFrame:
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = open_rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    keys = ["bucket", "low", "high"]
    ordered = dealt.select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "node",
        "label", "sketch", "block", "size", "shared_size", F.lit(None).cast("binary").alias("fine") if best_only else "fine",
    ).repartition(*keys).sortWithinPartitions(*keys)
    pairs = ordered.mapInArrow(_cross_pairs(best_only), "a binary, b binary")
    return pairs.distinct() if best_only else pairs


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that name their component (its smallest doc_id), with all their columns."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return docs.join(
        kept, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_semi"
    )
