"""Sub-word encoding with seeded merge-dropout, and its exact inverse.

Adjacent symbols are merged in the order of an agenda (best piece first, leftmost first). When a candidate comes up, a keyed
hash of (seed, variant, segment, place) may skip it, so encodings vary with the seed and from place to place, yet every run
of a job gives the same ids. What no piece covers becomes UTF-8 byte pieces. Blanks are written as the vocabulary's blank
mark; a blank mark in the text itself goes through byte pieces, so decoding gives back every text.

No piece of the vocabulary spans a blank mark after another character or a line break, so segments between them are encoded on
their own; each line of a text has one of ``VARIANTS`` variants, and a task remembers what it has encoded until it ends.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass

import numpy as np
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, scramble

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
VARIANTS = 4

_MARK = "▁"
_MASK = (1 << 64) - 1
#: Rank of two symbols that make no piece.
_NONE = 1 << 30
#: Characters up to which new segments are merged together; each round of that goes over all of them.
_TOGETHER = 48
_KNOWN_SEGMENTS = 250_000
_SEGMENT = re.compile(f" +[^ {_MARK}]*|[^ {_MARK}]+|{_MARK}")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as text, their ranks in the agenda, and what each id stands for in bytes."""

    ids: dict[str, int]
    ranks: dict[str, int]
    byte_ids: tuple[int, ...]
    content: tuple[bytes, ...]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, byte_ids, content, scores = {}, [0] * 256, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                content.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                content.append(b"")
            else:
                ids[piece] = i
                scores[piece] = model.get_score(i)
                content.append(piece.replace(_MARK, " ").encode())
        order = sorted(ids, key=lambda p: (-scores[p], ids[p]))
        crossing = next((p for p in ids if "\n" in p or _MARK in p.lstrip(_MARK)), None)
        if crossing is not None:
            raise ValueError(f"piece {crossing!r} spans segments")
        return Vocabulary(ids, {p: k for k, p in enumerate(order) if len(p) > 1}, tuple(byte_ids), tuple(content))


class Encoder:
    """Encodes texts; remembers segments. What is new in a slice of texts is merged for all segments together."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> None:
        self.vocabulary, self.seed, self.variants = vocabulary, seed, variants
        self.limit = int(dropout * (1 << 32))
        self.known: list[dict[str, bytes]] = [{} for _ in range(variants)]
        ids, size = vocabulary.ids, len(vocabulary.content)
        self.line_break = array("i", [ids.get("\n", vocabulary.byte_ids[10])]).tobytes()
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for piece, code in ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = code
        self.symbol_of[ord(" ")] = self.symbol_of[ord(_MARK)]
        pairs = sorted(
            (ids[piece[:k]] * size + ids[piece[k:]], rank, ids[piece])
            for piece, rank in vocabulary.ranks.items() for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids
        )
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(column, np.int64) for column in zip(*pairs, strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        known = self.known
        cut = [self._lines(text) for text in texts]
        missing = [{s for lines in cut for v, parts in lines if v == variant for s in parts} for variant in range(self.variants)]
        new = [part - known[v].keys() for v, part in enumerate(missing)]
        if sum(map(len, known)) + sum(map(len, new)) > _KNOWN_SEGMENTS:
            for part in known:
                part.clear()
            new = missing
        for variant, part in enumerate(new):
            if part:
                self._learn(list(part), variant)
        return [self.line_break.join([b"".join(map(known[v].__getitem__, parts)) for v, parts in lines]) for lines in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        content = self.vocabulary.content
        return b"".join([content[i] for i in np.frombuffer(ids, np.int32).tolist()]).decode()[1:]

    def _lines(self, text: str) -> list[tuple[int, list[str]]]:
        """Variant and segments of each line; the variant by keyed hash of the text and the line's number."""
        if not text:
            return []
        lines = f" {text}".split("\n")
        key = np.uint64(xxhash.xxh3_64_intdigest(text.encode(), seed=self.seed))
        places = np.arange(len(lines), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        variants = ((scramble(places + key) >> np.uint64(40)) % np.uint64(self.variants)).tolist()
        return list(zip(variants, map(_SEGMENT.findall, lines), strict=True))

    def keys(self, codes: np.ndarray, lengths: np.ndarray, variant: int) -> np.ndarray:
        """Odd keys of segments, from their code points in a row."""
        begin = np.cumsum(lengths) - lengths
        place = (np.arange(len(codes)) - np.repeat(begin, lengths)).astype(np.uint64)
        mixed = scramble(codes.astype(np.uint64) + (place << np.uint64(32)) + np.uint64(self.seed + 1))
        return scramble(np.add.reduceat(mixed, begin) + np.uint64((variant + 1) * 0xC2B2AE3D27D4EB4F & _MASK)) | np.uint64(1)

    def _learn(self, segments: list[str], variant: int) -> None:
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        lengths = np.array(list(map(len, segments)), np.int64)
        symbols, begin = self.symbol_of[codes], np.cumsum(lengths) - lengths
        keys = self.keys(codes, lengths, variant)
        alone = (np.minimum.reduceat(symbols, begin) < 0) | (lengths > _TOGETHER) | (codes[begin] == ord(_MARK))
        known = self.known[variant]
        for i in np.flatnonzero(alone).tolist():
            known[segments[i]] = array("i", self.merge(segments[i], int(keys[i]))).tobytes()
        rest = [segments[i] for i in np.flatnonzero(~alone).tolist()]
        if rest:
            symbols = symbols[~np.repeat(alone, lengths)].astype(np.int64)
            known.update(zip(rest, self.merge_together(symbols, lengths[~alone], keys[~alone]), strict=True))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of neighbours (``_NONE`` if they make no piece) and the piece."""
        keys = left * len(self.vocabulary.content) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def merge_together(self, symbol: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> list[bytes]:
        """Packed ids of many segments, given as their symbols in a row; each round takes the best candidate of every segment."""
        segment = np.repeat(np.arange(len(lengths)), lengths)
        begin = np.arange(len(symbol)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        stop = begin + 1
        rank, piece = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
        within = np.flatnonzero(segment[1:] == segment[:-1])
        rank[within], piece[within] = self._ranks(symbol[within], symbol[within + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), edge)
            live = (best >> 32) < _NONE
            going = np.repeat(live, np.diff(np.r_[edge, len(symbol)]))
            done.append((segment[~going], symbol[~going]))
            at = best[live] & 0xFFFFFFFF
            mix = (begin[at] + (stop[at] << 21) + (stop[at + 1] << 42) | 1).astype(np.uint64) if len(at) else np.empty(0, np.uint64)
            skipped = (keys[segment[at]] * mix) >> np.uint64(32) < np.uint64(self.limit)
            rank[at[skipped]] = _NONE
            at = at[~skipped]
            symbol[at], stop[at] = piece[at], stop[at + 1]
            going[at + 1] = False
            moved = np.cumsum(going) - 1
            at = moved[at]
            segment, symbol, begin, stop, rank, piece = (x[going] for x in (segment, symbol, begin, stop, rank, piece))
            rank[at] = _NONE
            for left in (at[at > 0] - 1, at[at + 1 < len(symbol)]):
                left = left[segment[left] == segment[left + 1]]
                rank[left], piece[left] = self._ranks(symbol[left], symbol[left + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        packed = ids[np.argsort(owner, kind="stable")].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(lengths)))).tolist()
        return [packed[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def merge(self, segment: str, key: int) -> list[int]:
        """Ids of one segment, with a heap as agenda; the same as :meth:`merge_together`, for long or unusual ones."""
        v, text = self.vocabulary, segment.replace(" ", _MARK)
        if segment == _MARK:
            return [v.byte_ids[b] for b in segment.encode()]
        rank_of, n = v.ranks.get, len(text)
        # The symbol that begins at i ends at stop[i]; before[j] is where the symbol that ends at j begins.
        stop, before, alive = list(range(1, n + 1)), [i - 1 for i in range(n + 1)], [True] * n
        agenda = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := rank_of(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, middle, end = heapq.heappop(agenda)
            if not alive[i] or stop[i] != middle or not alive[middle] or stop[middle] != end:
                continue
            if (key * (i + (middle << 21) + (end << 42) | 1) & _MASK) >> 32 < self.limit:
                continue
            alive[middle] = False
            stop[i], before[end] = end, i
            if i > 0 and (rank := rank_of(text[before[i] : end])) is not None:
                heapq.heappush(agenda, (rank, before[i], i, end))
            if end < n and (rank := rank_of(text[i : stop[end]])) is not None:
                heapq.heappush(agenda, (rank, i, end, stop[end]))
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                code = v.ids.get(text[i : stop[i]])
                out += [v.byte_ids[b] for b in text[i : stop[i]].encode()] if code is None else [code]
        return out


_encoders: dict[tuple, Encoder] = {}


def _encoder(shared, *key) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value, *key[1:])
    return _encoders[key]


def _forget() -> None:
    """Drop the segments at the end of a task: workers that wait or do other work would hold them in the executor's memory."""
    for encoder in _encoders.values():
        for part in encoder.known:
            part.clear()


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_pieces, ids, lossless)`` for each row of ``docs``.

    ``ids`` are little-endian 32-bit integers in a binary; ``lossless`` tells whether decoding gave back the text. Null and empty
    texts have no pieces. Equal texts have equal ids. A vocabulary is read by the driver and sent to the tasks (its file bounds
    its size). Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def work(ids, texts):
        encoder = _encoder(shared, model, dropout, seed)
        packed = encoder.encode_all([text or "" for text in texts])
        same = [encoder.decode(p) == (t or "") for p, t in zip(packed, texts, strict=True)]
        return ids, [len(p) // 4 for p in packed], packed, same

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(source, "doc_id bigint, n_pieces bigint, ids binary, lossless boolean", work, finish=_forget)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (with ``ids`` as :func:`encode` gives them) as ``(doc_id, text)``; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def work(keys, packed):
        encoder = Encoder(shared.value)
        return keys, [None if p is None else encoder.decode(bytes(p)) for p in packed]

    return map_batches(encoded.select("doc_id", "ids"), "doc_id bigint, text string", work)
