"""N-gram Jaccard join by token-combination prefixes, with exact verification.

The tokens of a document are its word shingles as 64-bit hashes, in ascending order. A pair at the threshold misses at most
``n * 15 / 100`` of either side's tokens, so the first tokens of both must meet. Tokens are classed by how many documents hold
them in their prefix: a rare token is a key by itself; frequent ones are dealt by hash into cells, and any two (or, for the most
frequent, three) tokens of a cell make a key. A cell with p tokens then only stands for p - 1 (p - 2) possible misses, so the
prefix is extended until its cells and rare tokens together stand for one miss more than a pair may have. Such prefixes
share a key (the argument is in :func:`keys_of`). Tokens that nobody else has in a prefix make no key, but stand for a miss.

The number of cells grows with a document's size class; a document whose partners may be of the next class has keys in both.

Documents that share a key are linked without listing all pairs of a group: each is verified against one hub a key; where
components still differ, those outside a key's main component meet the others in blocks: first each verifies its best partner,
then blocks of prefixes tell which nodes may link to others of their key, and blocks of the full sets of these are searched for
links, of which those that join two components are rows. All bounds are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ROWS_AT_ONCE, give_back, map_batches, scramble
from corpusloom.llm.components import components, contract, known_labels
from corpusloom.llm.minhash import shingle_set
from corpusloom.plans.skew import lookup
from corpusloom.session import materialize

THRESHOLD = (85, 100)
#: Documents that hold a token in their prefix: up to the first figure one token makes a key, up to the second two, else three.
CLASSES = (32, 1024)
#: A token with one of this many prefix tokens of a sample is counted as one of the most frequent without a shuffle.
HOT_SHARE = 20_000
#: One document in so many is in that sample, which decides on classes only.
SAMPLE = 64
#: Rows of a block, and pairs of one hub in a task.
BLOCK = 1024
HUB_PAIRS = 4096
#: Keys of more nodes than this are merged with others of nearly the same nodes.
MERGE = 64
#: Sets of up to this size are compared whole, in 16 bits a token, within keys of many nodes.
WHOLE = 4096
#: Tokens of full sets outside the main component in a block, and a quarter of those of all others there.
BLOCK_TOKENS = 1 << 19
NO_END = (1 << 63) - 1
#: Bits of the bitmap that keeps texts out of a join (8 MB, whatever the size of the corpus).
BITMAP_BITS = 1 << 26

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


def needed(n: int) -> int:
    """One more than the tokens of a set of ``n`` that a linked partner may miss."""
    return n * (THRESHOLD[1] - THRESHOLD[0]) // THRESHOLD[1] + 1


def size_classes(n: int) -> list[int]:
    """Classes (powers of two) in which a set of ``n`` may meet a partner: its own and, near its end, the next."""
    own = n.bit_length() - 1
    return list(range(own, (n * THRESHOLD[1] // THRESHOLD[0]).bit_length()))


def cells(size_class: int) -> int:
    """Cells of each frequent class; without any, all tokens are keys by themselves."""
    return needed(1 << size_class) // 4 if size_class > 5 else 0


def prefix_length(n: int) -> int:
    """Tokens that are enough whatever their classes: a cell of pairs loses one of them, a cell of triples two."""
    return min(n, needed(n) + 3 * max(cells(c) for c in size_classes(n)))


def keys_of(n: int, places: list[int], tokens: list[int], classes: list[int]) -> list[int]:
    """Keys of a set of ``n`` from the prefix tokens that others have too: places in the prefix, rising, hashes and classes.

    The prefix ends where the misses it stands for reach ``needed(n)``. Of a linked pair take the side whose prefix ends
    first: it misses fewer tokens than its prefix stands for, so in some cell (or among the single tokens) the partner
    has as many tokens as make a key; they lie before the end of the partner's prefix too, which then has that key.
    """
    out = []
    for size_class in size_classes(n):
        width, need, misses, last = cells(size_class), needed(n), 0, -1
        held: dict[tuple[int, int], list[int]] = {}
        for place, token, kind in zip(places, tokens, classes, strict=True):
            misses += place - last - 1
            if misses >= need:
                break
            last = place
            kind = kind if width else 1
            cell = held.setdefault((kind, token % width if kind > 1 else 0), [])
            cell.append(token)
            misses += len(cell) >= kind
            if misses >= need:
                break
        for (kind, _), found in held.items():
            if len(found) >= kind:
                some = np.array(list(combinations(found, kind)), _U)
                key = np.full(len(some), size_class * 4 + kind, _U)
                for column in some.T:
                    key = scramble(key * _MIX + column)
                out += key.view(np.int64).tolist()
    return out


def _node(shingles: np.ndarray) -> int:
    """Name of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _sketch(ids, texts, hashes):
    counts, nodes, prefixes = [], [], []
    for text in texts:
        shingles = shingle_set(text)
        counts.append(len(shingles))
        nodes.append(_node(shingles) if len(shingles) else None)
        prefixes.append(shingles[: prefix_length(len(shingles))].tobytes() if len(shingles) else None)
    return ids, hashes, counts, nodes, prefixes


def _token_rows(hot: np.ndarray, want_hot: bool):
    """Rows ``(token, node, place)`` of prefixes, either of the tokens in ``hot`` or of the others; a place also holds the set's size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                tokens, nodes, places = [], [], []
                for node, size, prefix in zip(*batch.slice(start, ROWS_AT_ONCE).columns, strict=True):
                    own = np.frombuffer(prefix.as_buffer(), np.int64)
                    at = np.flatnonzero(np.isin(own, hot) == want_hot)
                    tokens.append(own[at])
                    nodes.append(np.full(len(at), node.as_py()))
                    places.append(at + (size.as_py() << 32))
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in (tokens, nodes, places)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "place"])
        give_back()

    return run


def _runs(columns: int, same: int, work: Callable[[list[np.ndarray]], list[pa.Array]], names: list[str]):
    """Pass rows sorted by their first ``same`` columns to ``work``, never with such a group cut in two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            new = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            other = np.zeros(max(len(new[0]) - 1, 0), bool)
            for column in new[:same]:
                other |= column[1:] != column[:-1]
            starts = np.flatnonzero(other) + 1
            if held and any(held[0][k][0] != new[k][0] for k in range(same)):
                starts = np.concatenate([[0], starts])
            if len(starts):
                done = [np.concatenate([h[k] for h in held] + [new[k][: starts[-1]]]) for k in range(columns)]
                yield pa.RecordBatch.from_arrays(work(done), names=names)
                held, new = [], [c[starts[-1] :] for c in new]
            held.append(new)
        if held:
            yield pa.RecordBatch.from_arrays(work([np.concatenate(c) for c in zip(*held, strict=True)]), names=names)
        give_back()

    return run


def _classed(columns: list[np.ndarray]) -> list[pa.Array]:
    """Of rows sorted by token and node, one of each pair where several nodes have the token, with its class."""
    token, node, place = columns
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, place = token[first], node[first], place[first]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(starts, len(token)))
    count = np.repeat(size, size)
    kind = 1 + (count > CLASSES[0]) + (count > CLASSES[1])
    return [pa.array(x[count > 1]) for x in (node, place, token, kind.astype(np.int64))]


def _keys(columns: list[np.ndarray]) -> list[pa.Array]:
    node, place, token, kind = columns
    keys, nodes, sizes = [], [], []
    starts = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        n = int(place[a]) >> 32
        own = keys_of(n, (place[a:b] & 0xFFFFFFFF).tolist(), token[a:b].view(_U).tolist(), kind[a:b].tolist())
        keys += own
        nodes += [int(node[a])] * len(own)
        sizes += [n] * len(own)
    return [pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())]


def _hot_tokens(nodes: DataFrame) -> np.ndarray:
    """Sorted hashes of tokens so frequent in the sample that no task should count them; no more than ``HOT_SHARE``."""
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).mapInArrow(
        _token_rows(np.zeros(0, np.int64), False), "token bigint, node bigint, place bigint"
    )
    counts = some.groupBy("token").count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where((F.col("count") * HOT_SHARE >= total) & (F.col("count") > CLASSES[0])).select("token").collect()
    return np.sort(np.array([row["token"] for row in hot], np.int64))


def _key_rows(nodes: DataFrame) -> DataFrame:
    """``(key, node, size)`` for the documents' prefixes ``(node, size, prefix)``."""
    hot = _hot_tokens(nodes)
    schema = "token bigint, node bigint, place bigint"
    cold = nodes.mapInArrow(_token_rows(hot, False), schema).repartition("token").sortWithinPartitions("token", "node")
    names = ["node", "place", "token", "kind"]
    shared = cold.mapInArrow(_runs(3, 1, _classed, names), "node bigint, place bigint, token bigint, kind bigint")
    if len(hot):
        frequent = nodes.mapInArrow(_token_rows(hot, True), schema).dropDuplicates(["node", "place"])
        shared = shared.unionByName(frequent.select("node", "place", "token", F.lit(3).cast("long").alias("kind")))
    ordered = shared.repartition("node").sortWithinPartitions("node", "place")
    return ordered.mapInArrow(_runs(4, 1, _keys, ["key", "node", "size"]), "key bigint, node bigint, size bigint")


def _linked(a, left, b, right):
    stay = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
        both = len(np.intersect1d(x, y, assume_unique=True))
        if THRESHOLD[1] * both >= THRESHOLD[0] * (len(x) + len(y) - both):
            stay.append(i)
    return [a[i] for i in stay], [b[i] for i in stay]


def _both_ends(pairs: DataFrame, table: DataFrame, *names: dict[str, str]) -> DataFrame:
    """Pairs of a written table with columns of ``table`` for ``a`` and for ``b``; a node with very many pairs is dealt over several tasks."""
    both = pairs
    for end, columns in zip("ab", names, strict=True):
        many = pairs.groupBy(end).agg(F.ceil(F.count("*") / HUB_PAIRS).alias("salts")).where("salts > 1")
        copies = table.select(F.col("node").alias(end), *(F.col(k).alias(v) for k, v in columns.items()))
        if many.isEmpty():  # the usual case; its plan has three tables less
            both = both.join(copies, end)
            continue
        salts = F.coalesce("salts", F.lit(1).cast("long"))
        dealt = both.join(many, end, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts)).drop("salts")
        every = F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")
        both = dealt.join(copies.join(many, end, "left").select(end, *columns.values(), every), [end, "salt"]).drop("salt")
    return both


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a written table that reach the threshold on their full sets."""
    both = _both_ends(pairs, sets, {"shingles": "left"}, {"shingles": "right"})
    return map_batches(both.select("a", "left", "b", "right"), "a bigint, b bigint", _linked)


def _set_rows(nodes, texts):
    sets = [shingle_set(text) for text in texts]
    good = [i for i, s in enumerate(sets) if len(s) and _node(s) == nodes[i]]
    return [nodes[i] for i in good], [sets[i].tobytes() for i in good]


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` from one text for each of ``wanted(node, id, text_hash)``.

    Most texts are not wanted; a bitmap of fixed size keeps nearly all of these out of the join.
    """
    wanted = wanted.withColumn("id", F.coalesce("id", F.lit(0)))
    bit = F.pmod(F.xxhash64("id", "text_hash"), F.lit(BITMAP_BITS)) + 1
    bitmaps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    tried = keyed.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(bitmaps), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(bit) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(bit) % 8 as int))")) != 0
    found = wanted.join(tried.where(hit).select("id", "text_hash", "text"), ["id", "text_hash"])
    once = found.dropDuplicates(["id", "text_hash", "node"]).select("node", "text")
    return map_batches(once, "node bigint, shingles binary", _set_rows)


def _short(nodes, sizes, prefixes):
    """Prefixes in 16 bits a token, which can only make more tokens look shared, and where they end; a whole set has no end."""
    tokens = [np.frombuffer(p, _U) for p in prefixes]
    ends = [int(t[-1] >> _U(1)) if len(t) < n else NO_END for t, n in zip(tokens, sizes, strict=True)]
    return nodes, sizes, ends, [t.astype(np.uint16).tobytes() for t in tokens]


def _whole(nodes, sets):
    sets = [np.frombuffer(s, _U) for s in sets]
    parts = [s if len(s) <= WHOLE else s[: prefix_length(len(s))] for s in sets]
    return _short(nodes, [len(s) for s in sets], parts)


def _allowed(common: np.ndarray, x: tuple, y: tuple) -> np.ndarray:
    """Whether pairs whose prefixes share ``common`` tokens may link; ``x`` and ``y`` are (size, shared size, prefix length, prefix end).

    Of the set whose prefix ends first, all tokens it shares up to there are known.
    """
    rest = [side[0] - side[2] for side in (x, y)]
    rest = np.where(x[3] < y[3], rest[0], np.where(x[3] > y[3], rest[1], np.maximum(*rest)))
    most = np.minimum(np.minimum(common + rest, x[1]), y[1])
    return (THRESHOLD[0] + THRESHOLD[1]) * most >= THRESHOLD[0] * (x[0] + y[0])


def _prefixes_allow(a, size_a, end_a, prefix_a, b, size_b, end_b, prefix_b):
    stay = []
    for i in range(len(a)):
        x, y = (np.frombuffer(p[i], np.uint16) for p in (prefix_a, prefix_b))
        common = min(np.isin(x, y).sum(), np.isin(y, x).sum())
        if _allowed(common, (size_a[i], size_a[i], len(x), end_a[i]), (size_b[i], size_b[i], len(y), end_b[i])):
            stay.append(i)
    return [a[i] for i in stay], [b[i] for i in stay]


def _possible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs of a written table that their prefixes allow to link."""
    sides = [{k: f"{k}_{end}" for k in ("size", "end", "prefix")} for end in "ab"]
    both = _both_ends(pairs, prefixes, *sides)
    return map_batches(
        both.select("a", *sides[0].values(), "b", *sides[1].values()), "a bigint, b bigint", _prefixes_allow
    )


class _Block:
    """Rows of one key: some outside its main component, and part of all others they may link to."""

    def __init__(self, key: int, rows: list[np.ndarray], kind: type) -> None:
        self.key = key
        self.node, self.label, self.size, self.shared, self.minor, self.end = rows[:6]
        self.tokens = [np.frombuffer(p, kind) for p in rows[6]]
        self.length = np.array([len(p) for p in self.tokens])

    def _side(self, at) -> tuple:
        return self.size[at], self.shared[at], self.length[at], self.end[at]

    def partners(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each row in ``x`` those in ``y`` that are in other components when its turn comes and may link, with the tokens
        they share; of full sets, those that do link."""
        tokens = np.concatenate([self.tokens[j] for j in y])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(y)), self.length[y])[order]
        theirs = self._side(y)
        for i in x:
            good = (self.label[y] != self.label[i]) & (~self.minor[y] | (self.node[y] > self.node[i]))
            if not good.any():
                continue
            low, high = (np.searchsorted(tokens, self.tokens[i], side) for side in ("left", "right"))
            spans = high - low
            at = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            common = np.bincount(owner[at], minlength=len(y))
            good &= _allowed(common, self._side(i), theirs)
            if good.any():
                yield i, y[good], common[good]

    def best(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        """The best pair of each row in ``x``, and ``(a, a)`` for whoever else it may link to."""
        for i, partners, common in self.partners(x, y):
            one, others, best = int(self.node[i]), self.node[partners].tolist(), int(np.argmax(common))
            yield max(one, others[best]), min(one, others[best])
            yield from ((other, other) for k, other in enumerate(others) if k != best)

    def possible(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        """Key and node of the rows that may link to another."""
        some = np.zeros(len(self.node), bool)
        for i, partners, _ in self.partners(x, y):
            some[i] = some[partners] = True
        yield from ((self.key, node) for node in self.node[some].tolist())

    def links(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of full sets that join components: fewer than the block has labels."""
        for i, partners, _ in self.partners(x, y):
            for label, at in zip(*np.unique(self.label[partners], return_index=True), strict=True):
                one, other = int(self.node[i]), int(self.node[partners[at]])
                yield max(one, other), min(one, other)
                self.label = np.where(self.label == label, self.label[i], self.label)


def _block_rows(take: Callable, names: list[str]):
    """What ``take`` (a method of :class:`_Block`) finds, over runs of (key, block, part)."""
    def work(columns: list[np.ndarray]) -> list[pa.Array]:
        found: set[tuple[int, int]] = set()
        same = np.ones(len(columns[0]), bool)
        same[0] = False
        for column in columns[:3]:
            same[1:] &= column[1:] == column[:-1]
        starts = np.append(np.flatnonzero(~same), len(same))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            role = columns[3][a:b]
            x, y = np.flatnonzero(role != PARTNER), np.flatnonzero(role != ACTIVE)
            if not len(x) or len(y) < 2 - (PARTNER in role):
                continue
            block = _Block(int(columns[0][a]), [c[a:b] for c in columns[4:]], _U if take is _Block.links else np.uint16)
            found.update(take(block, x, y))
        pairs = list(found)
        return [pa.array([f[k] for f in pairs], pa.int64()) for k in range(2)]

    return _runs(11, 3, work, names)


#: Roles of a row in a block: it looks for partners, is one, or both.
ACTIVE, PARTNER, BOTH = 1, 2, 3


def _cross(full: DataFrame, take: Callable, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """What ``take`` finds in blocks of open rows of keys, with their tokens as ``prefix``."""
    weight = F.lit(int(take is _Block.links))
    blocks = F.ceil(F.greatest(F.col("n_minor") / BLOCK, weight * F.col("minor_tokens") / BLOCK_TOKENS))
    parts = F.ceil(F.greatest(F.col("n") / (4 * BLOCK), weight * F.col("tokens") / (4 * BLOCK_TOKENS)))
    inner = ["node", "label", "size", "shared", "minor", "end", "prefix"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    mine = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    one = (blocks <= 1) & (parts <= 1)
    zero = F.lit(0).cast("long")
    dealt = full.where(one).select(
        "key", zero.alias("block"), zero.alias("part"), F.when(F.col("minor"), BOTH).otherwise(PARTNER).alias("role"), *inner
    ).unionByName(full.where(~one & F.col("minor")).select(
        "key", mine(blocks, 1).alias("block"), every(parts).alias("part"), F.lit(ACTIVE).alias("role"), *inner
    )).unionByName(full.where(~one).select(
        "key", every(blocks).alias("block"), mine(parts, 2).alias("part"), F.lit(PARTNER).alias("role"), *inner
    ))
    order = ["key", "block", "part"]
    sorted_rows = dealt.repartition(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(_block_rows(take, list(names)), ", ".join(f"{name} bigint" for name in names)).distinct()


def _joining(rows: DataFrame, prefixes: DataFrame, own: DataFrame, sets: DataFrame) -> DataFrame:
    """Links on full ``sets`` that join components, from open rows of keys; nodes that are not in ``own`` have none.

    Rows of keys with many nodes bring more than a prefix, so that few full sets are dealt out.
    """
    rows = rows.join(own, "node").withColumn("shared", F.col("size") - F.col("own"))
    rows = rows.where(F.col("shared") * THRESHOLD[1] >= F.col("size") * THRESHOLD[0])
    whole = map_batches(sets.select("node", "shingles"), "node bigint, size bigint, end bigint, prefix binary", _whole)
    some, many = ((F.col("n") > MERGE) == large for large in (False, True))
    tokens = [(some, prefixes), (many, whole)]
    parts = [rows.where(which).join(table.select("node", "end", "prefix"), "node") for which, table in tokens]
    possible = materialize(_cross(parts[0].unionByName(parts[1]), _Block.possible, ("key", "node")), "possible")
    full = sets.select("node", F.lit(NO_END).alias("end"), F.col("shingles").alias("prefix"))
    return _cross(rows.join(possible, ["key", "node"]).join(full, "node"), _Block.links)


def _open_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys with more than one component, and whether they are outside the key's main one."""
    labelled = materialize(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    parts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    of_key = parts.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.max(F.struct("n", "label", "tokens")).alias("main"),
        F.count("*").alias("labels"),
    ).where("labels > 1").select(
        "key", "n", "tokens", (F.col("n") - F.col("main.n")).alias("n_minor"),
        (F.col("tokens") - F.col("main.tokens")).alias("minor_tokens"), F.col("main.label").alias("main"),
    )
    rows = lookup(labelled, materialize(of_key, "keys"), ["key"], "n").where("main is not null")
    return materialize(rows.select("key", "node", "size", "label", "n", "n_minor", "tokens", "minor_tokens", (F.col("label") != F.col("main")).alias("minor")), "open")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, packed in zip(*batch.columns, strict=True):
            shingles = np.frombuffer(packed.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(np.full(len(shingles), node.as_py()))], names=["shingle", "node"])


def _own_shingles(sets: DataFrame) -> DataFrame:
    """``(node, own)``: how many shingles of each of ``sets`` no other of them has."""
    rows = sets.select("node", "shingles").mapInArrow(_shingle_rows, "shingle bigint, node bigint")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    return sets.select("node").join(single.groupBy("node").agg(F.count("*").alias("own")), "node", "left").fillna(0)


def _members(keys: DataFrame) -> DataFrame:
    """``(key, n, node, size)``: the nodes of each key that several have.

    Of keys with the same nodes one stays. Near copies have many keys with nearly the same nodes: keys of more than ``MERGE``
    nodes that agree in the least node of two orders become one, so that a pair is not looked at once a key.
    """
    counts = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("m1"), F.min(F.xxhash64("node", F.lit(2))).alias("m2"),
        F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"),
    ).where("n > 1")
    large = F.col("n") > MERGE
    same = F.xxhash64(large, F.when(large, F.col("m1")).otherwise(F.col("h1")), F.when(large, F.col("m2")).otherwise(F.col("h2")))
    # Small keys of one group are equal but for hash collisions, and then lose nothing: all their nodes go on.
    grouped = materialize(counts.select("key", "n", same.alias("group")), "groups")
    nodes = lookup(keys, grouped, ["key"], "n").where("group is not null").select(F.col("group").alias("key"), "node", "size").distinct()
    nodes = materialize(nodes, "nodes")
    return lookup(nodes, materialize(nodes.groupBy("key").agg(F.count("*").alias("n")), "counts"), ["key"], "n")


def ngram_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, text_hash)``, one row for each row of ``docs``.

    Words are what ASCII white space separates, A-Z lower-cased. Null, empty and blank texts have an empty set and no link.
    A component is named by its smallest doc_id (null if it has none, or for an unlinked row without id). Sets and
    shingles are told apart by 64-bit hashes. ``text_hash`` is xxhash64 of the text. Other columns are not read; an empty table
    gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id bigint, text_hash bigint, size bigint, node bigint, prefix binary"
    sketches = materialize(map_batches(source, schema, _sketch), "sketches")
    keys = materialize(_key_rows(sketches.where("node is not null").select("node", "size", "prefix")), "keys")
    members = materialize(_members(keys), "members")
    hubs = members.groupBy("key").agg(F.max("n").alias("n"), F.min(F.struct("node", "size")).alias("hub"))
    hubs = materialize(hubs.select("key", "n", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")), "hubs")
    names = materialize(
        sketches.where("node is not null").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
        ).select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("text_hash")),
        "names",
    )
    short = map_batches(
        sketches.where("node is not null").select("node", "size", "prefix"), "node bigint, size bigint, end bigint, prefix binary", _short
    )
    prefixes = materialize(short.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "prefixes")
    fits = F.least("size", "hub_size") * THRESHOLD[1] >= F.greatest("size", "hub_size") * THRESHOLD[0]
    tried = lookup(members.select("key", "node", "size"), hubs, ["key"], "n").where((F.col("node") != F.col("hub")) & fits).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # Two rounds settle nearly all components; what they leave apart only costs later passes a few needless pairs.
    stars = contract(_verified(docs, names, materialize(_possible(materialize(tried, "pairs"), prefixes), "pairs")), 2)
    open_rows = _open_rows(members.select("key", "node", "size"), known_labels(stars))
    first = open_rows.withColumn("shared", F.col("size")).join(prefixes.select("node", "end", "prefix"), "node")
    found = materialize(_cross(first, _Block.best), "pairs")
    doubtful = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(_full_sets(docs, names.join(doubtful, "node")), "sets")
    stars = contract(stars.unionByName(_links(found.where("a <> b"), sets)), 2)
    own = materialize(_own_shingles(sets), "own")
    still_open = _open_rows(open_rows.join(own.select("node"), "node", "left_semi").select("key", "node", "size"), known_labels(stars))
    final = components(stars.unionByName(materialize(_joining(still_open, prefixes, own, sets), "pairs")))
    lowest = names.join(final, "node").groupBy("label").agg(F.min("id").alias("component_id"))
    linked = final.join(lowest, "label").select("node", "component_id", F.lit(True).alias("linked"))
    named = names.join(linked, "node", "left").select("node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return sketches.join(named, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash",
    )


def _verified(docs: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of a written table that reach the threshold, with the full sets of their nodes alone."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return _links(pairs, materialize(_full_sets(docs, names.join(nodes, "node")), "sets"))
