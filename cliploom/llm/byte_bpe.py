"""Byte-level BPE encoding and decoding with batched numpy merges.

Texts are split by the vocabulary's pattern.  Every distinct piece of a batch is encoded once:
pieces of similar length share a padded matrix of token ids, and in each round every row merges
its leftmost pair of minimum rank, found by a hashed pair lookup, and is compacted by one column.
A task keeps the pieces it has met in a dictionary of bounded size.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows and
extra columns pass through one by one; any text, control strings included, is ordinary text.
A piece of more than ``WIDE`` bytes (no such word in normal text) is a matrix of its own, in which a
round merges all pairs of the minimum rank where that is the same as merging them one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_made

WIDE = 256
#: Bytes of remembered pieces, and what Python adds to each.
CACHE_BYTES, PIECE_BYTES = 32 << 20, 180
NO_RANK = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def mergeable_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All (left id, right id) whose joined bytes are a token, as packed keys, and that token's id."""
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                merged.append(rank)
    return np.array(keys, np.uint64), np.array(merged, np.int32)


class PairTable:
    """Open-addressing hash table from a packed id pair to the merged token, probed array-wise."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, NO_RANK)
        self.probes = 0
        left = np.arange(len(keys))
        slots = self._slot(keys)
        while len(left):
            self.probes += 1
            free = left[self.values[slots[left]] == NO_RANK]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]] = keys[placed]
            self.values[slots[placed]] = values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = (slots[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Merged token of each key, NO_RANK where the pair does not merge; only open probes go on."""
        slots = self._slot(keys)
        found, out = self.keys[slots], self.values[slots]
        miss = np.flatnonzero(found != keys)
        if not len(miss):
            return out
        miss = miss[out[miss] != NO_RANK]
        slots, wanted = slots[miss], keys[miss]
        out[miss] = NO_RANK
        while len(miss):
            slots = (slots + 1) & (len(self.keys) - 1)
            value, hit = self.values[slots], self.keys[slots] == wanted
            out[miss[hit]] = value[hit]
            go = ~hit & (value != NO_RANK)
            miss, slots, wanted = miss[go], slots[go], wanted[go]
        return out


class ByteBPE:
    """Encoder and decoder of one rank vocabulary."""

    def __init__(self, tokens: list[tuple[bytes, int]], pair_keys: np.ndarray, pair_values: np.ndarray, pattern: str):
        import regex

        self.ranks = dict(tokens)
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(pair_keys, pair_values)
        self.bytes_to_id = np.zeros(256, np.int32)
        for value in range(256):
            self.bytes_to_id[value] = self.ranks[bytes([value])]
        vocabulary = sorted(tokens, key=lambda x: x[1])
        lengths = np.zeros(vocabulary[-1][1] + 1, np.int64)
        for token, rank in vocabulary:
            lengths[rank] = len(token)
        self.token_lengths = lengths
        self.token_starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(token for token, _ in vocabulary), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.get((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))

    def _merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece.  Ranks are kept beside the ids: a merge renews only its two neighbours."""
        count = np.array([len(p) for p in pieces])
        width = int(count.max())
        rows = np.zeros((len(pieces), width), np.int32)
        rows[np.arange(width) < count[:, None]] = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NO_RANK)
        inside = np.arange(width - 1) < (count - 1)[:, None]
        ranks[:, :-1][inside] = self._pair_ranks(rows[:, :-1][inside], rows[:, 1:][inside])
        done: list[bytes] = [b""] * len(pieces)
        alive = np.arange(len(pieces))
        while len(alive):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            finished = best == NO_RANK
            if finished.any():
                ready, sizes = rows[finished].astype("<u4"), count[finished].tolist()
                for i, row, size in zip(alive[finished].tolist(), ready, sizes):
                    done[i] = row[:size].tobytes()
                keep = ~finished
                rows, ranks, count, alive, at, best = rows[keep], ranks[keep], count[keep], alive[keep], at[keep], best[keep]
                if not len(alive):
                    break
                line = np.arange(len(rows))
            # Compact: what stands right of the merged pair moves one column to the left.
            width = int(count.max())
            after = np.arange(width - 1) > at[:, None]
            rows = np.where(after, rows[:, 1:width], rows[:, : width - 1])
            ranks = np.where(after, ranks[:, 1:width], ranks[:, : width - 1])
            rows[line, at] = best
            count = count - 1
            ranks[line, at] = NO_RANK
            go = np.flatnonzero(at + 1 < count)
            ranks[go, at[go]] = self._pair_ranks(best[go], rows[go, at[go] + 1])
            go = np.flatnonzero(at > 0)
            ranks[go, at[go] - 1] = self._pair_ranks(rows[go, at[go] - 1], best[go])
        return done

    def _merge_wide(self, piece: bytes) -> bytes:
        """Ids of one long piece: a matrix of one row.

        A round merges all pairs of the minimum rank, leftmost first, and not only the leftmost one,
        unless a merge would form a pair that ranks before them.
        """
        row = self.bytes_to_id[np.frombuffer(piece, np.uint8)]
        ranks = self._pair_ranks(row[:-1], row[1:])
        while len(ranks) and (best := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == best)
            # Of pairs that overlap one another every second one merges.
            starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
            if len(at) > 1:
                merges = np.zeros(len(row) + 2, bool)
                merges[at + 2] = True
                before, after = at[at > 0], at[at + 2 < len(row)]
                left = np.where(merges[before], best, row[before - 1])
                formed = np.concatenate([self._pair_ranks(left, np.full(len(left), best)), self._pair_ranks(np.full(len(after), best), row[after + 2])])
                if len(formed) and formed.min() < best:
                    at = at[:1]
            keep = np.ones(len(row), bool)
            keep[at + 1] = False
            row[at] = best
            row, ranks = row[keep], np.delete(ranks, at)
            new = at - np.arange(len(at))
            for go in (new[new > 0] - 1, new[new < len(ranks)]):
                ranks[go] = self._pair_ranks(row[go], row[go + 1])
        return row.astype("<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces into the cache, a matrix for each power of two of the length."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = int(whole).to_bytes(4, "little")
            elif len(raw) > WIDE:
                self.cache[piece] = self._merge_wide(raw)
            else:
                by_length.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for length, group in by_length.items():
            step = max(64, 1 << max(0, 18 - length))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                for (piece, _), ids in zip(part, self._merge_matrix([raw for _, raw in part])):
                    self.cache[piece] = ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(text) for text in texts]
        if self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        new = set()
        for pieces in split:
            new.update(pieces)
        new = [piece for piece in new if piece not in self.cache]
        self._learn(new)
        self.cached += sum(len(piece) + len(self.cache[piece]) + PIECE_BYTES for piece in new)
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        lengths = self.token_lengths[tokens]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.pool[np.arange(ends[-1]) + np.repeat(self.token_starts[tokens] - (ends - lengths), lengths)].tobytes()


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_decoded: bool = True) -> DataFrame:
    """Add ``token_ids`` (little-endian uint32 binary) and ``decoded`` (bytes made from those ids), or
    instead of the bytes only ``round_trip``: whether they are the text.

    A map over the input: no shuffle.  The vocabulary (fixed size, some MB) is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    ranks = read_ranks(ranks_path)
    keys, values = mergeable_pairs(ranks)
    model = spark.sparkContext.broadcast((list(ranks.items()), keys, values, pattern))
    last = T.StructField("decoded", T.BinaryType()) if keep_decoded else T.StructField("round_trip", T.BooleanType())

    def maker() -> Callable[[list], list]:
        bpe = ByteBPE(*model.value)

        def make(texts: list) -> list:
            texts = [x or "" for x in texts]
            ids = bpe.encode_batch(texts)
            decoded = map(bpe.decode, ids)
            return [ids, list(decoded) if keep_decoded else [x == t.encode("utf-8", "surrogatepass") for x, t in zip(decoded, texts)]]

        return make

    return with_made(docs, text, [T.StructField("token_ids", T.BinaryType()), last], maker)


def digests(coded: DataFrame) -> DataFrame:
    """The contract's columns from the ids and the decoded bytes."""
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
