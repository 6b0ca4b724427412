"""Byte-level BPE by ranks: encoding through a rank queue on a hierarchical bitmap, and decoding.

Texts are cut into pre-tokens by a pattern.  The pre-tokens that a task has not seen before are laid out as one linked list of
parts, bytes at first, with an end mark after each pre-token.  Every pair of neighbours that forms a known token waits in
the bucket of that token's rank; a bitmap of three levels tells in constant time which bucket is the lowest.  The bucket's
pairs are merged at once, from left to right where they overlap, but for those of which a part has grown meanwhile, and the new
pairs are queued.  Only where a rank's token can be part of one of lower rank, a pre-token has one pair merged at a
time.  So the work follows the number of bytes however they are cut: many short pre-tokens share the queue, and a text
without a single break is no special case.

Nothing is shuffled: encoding and decoding are functions of one column.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 6
CACHED_PIECES = 150_000
CACHED_LENGTH = 64
BLOCK_PIECES = 500_000
BLOCK_CHARS = 2_000_000


class RankQueue:
    """Places by rank: buckets, and a bit for each bucket in words of 64, words of words and so on."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = (ranks + 63) >> WORD_BITS
            self.levels.append([0] * ranks)

    def open(self, rank: int, places: list[np.ndarray]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = places
        for level in self.levels:
            word = rank >> WORD_BITS
            held = level[word]
            level[word] = held | 1 << (rank & 63)
            if held:
                return
            rank = word

    def take(self) -> tuple[int, list[np.ndarray]] | None:
        """The lowest rank and its places, which leave the queue."""
        rank = 0
        for level in reversed(self.levels):
            bits = level[rank]
            if not bits:
                return None
            rank = rank << WORD_BITS | (bits & -bits).bit_length() - 1
        place = rank
        for level in self.levels:
            word = place >> WORD_BITS
            level[word] &= ~(1 << (place & 63))
            if level[word]:
                break
            place = word
        return rank, self.buckets.pop(rank)


class RankTable:
    """Tokens and their ranks, which are their ids: one base64 token and its rank a line."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.end = max(self.tokens) + 1  # stands between pre-tokens
        self.queue = RankQueue(self.end)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # Every way to make a token of two, by (id of the left one, id of the right one).
        ways = [
            (self.ranks[token[:i]] << 32 | self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        table = np.array(sorted(ways), np.int64).reshape(-1, 2)
        self.keys, self.made = np.append(table[:, 0], 1 << 62), np.append(table[:, 1], -1)
        # Tokens that can be part of one of lower rank: making one may call for another merge before the next of its kind.
        parts = np.concatenate([self.keys[:-1] >> 32, self.keys[:-1] & 0xFFFFFFFF])
        self.hasty = set(parts[parts > np.tile(self.made[:-1], 2)].tolist())

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, -1 if none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (none of them empty), as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(piece, -1) for piece in pieces]
        cut = [piece for piece, rank in zip(pieces, whole, strict=True) if rank < 0]
        merged = iter(self.merged(cut) if cut else ())
        return [next(merged) if rank < 0 else rank.to_bytes(4, "little") for rank in whole]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        sizes = np.array([len(piece) for piece in pieces])
        last = np.cumsum(sizes + 1)  # place of the end mark after each pre-token; one more stands before the first
        token = np.full(int(last[-1]) + 1, self.end, np.int64)  # id of the part that begins at a place, -1 if none does any more
        inside = np.ones(len(token), bool)
        inside[last] = inside[0] = False
        token[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, len(token) + 1)
        before = np.arange(-1, len(token) - 1)
        pair = np.append(self.joint(token[:-1], token[1:]), -1)  # rank of that part together with the next one
        self.line_up(np.arange(len(pair)), pair)
        while (lowest := self.queue.take()) is not None:
            rank, parts = lowest
            places = np.sort(np.concatenate(parts))
            valid = pair[places] == rank  # of others, one part has been merged since
            valid[1:] &= places[1:] != places[:-1]
            places = places[valid]
            if rank in self.hasty:
                _, first = np.unique(np.searchsorted(last, places), return_index=True)
                later = np.delete(places, first)
                if len(later):
                    self.queue.open(rank, [later])
                places = places[first]
            elif len(places) > 1:
                places = places[alternate(places[1:] == after[places[:-1]])]
            gone = after[places]
            end = after[gone]
            token[places], token[gone], pair[gone] = rank, -1, -1
            after[places], before[end] = end, places
            near = before[places]
            pair[places] = right = self.joint(token[places], token[end])
            pair[near] = left = self.joint(token[near], token[places])
            self.line_up(np.concatenate([places, near]), np.concatenate([right, left]))
        kept = (token >= 0) & inside
        cuts = 4 * np.concatenate([[0], np.cumsum(kept)[last]])
        packed = token[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def line_up(self, places: np.ndarray, ranks: np.ndarray) -> None:
        """Queue places under their ranks; those without a rank stay out."""
        known = ranks >= 0
        places, ranks = places[known], ranks[known]
        if not len(ranks):
            return
        order = np.argsort(ranks)
        ranks = ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        buckets = self.queue.buckets
        places = places[order]
        for rank, a, b in zip(ranks[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
            if rank in buckets:
                buckets[rank].append(places[a:b])
            else:
                self.queue.open(rank, [places[a:b]])


def alternate(linked: np.ndarray) -> np.ndarray:
    """Which places to merge when some share a part with the one before: every other of a row, from the left."""
    if not linked.any():
        return np.ones(len(linked) + 1, bool)
    at = np.arange(len(linked) + 1)
    begin = np.maximum.accumulate(np.where(np.append(False, linked), 0, at))
    return (at - begin) % 2 == 0


class Coder:
    """Both directions for one rank file.  Short pre-tokens are remembered, in two generations of bounded size."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.table, self.pattern = RankTable(path), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> list[str]:
        """Have all pieces in ``known``; those too long to stay there are returned."""
        if len(self.known) > CACHED_PIECES:
            self.old, self.known = self.known, {}
        fresh = pieces.difference(self.known)
        again = fresh.intersection(self.old)
        self.known.update((piece, self.old[piece]) for piece in again)
        fresh = list(fresh.difference(again))
        if fresh:
            ids = self.table.encode([piece.encode("utf-8", "surrogatepass") for piece in fresh])
            self.known.update(zip(fresh, ids, strict=True))
        return [piece for piece in fresh if len(piece) > CACHED_LENGTH]

    def joined(self, cut: list[list[str]]) -> list[bytes]:
        long = self.learn(set(chain.from_iterable(cut)))
        ids = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in long:
            del self.known[piece]
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        cut, chars = [], 0
        for text in texts:
            if len(text) > BLOCK_CHARS:
                yield from self.joined(cut)
                cut, chars = [], 0
                matches = (m[0] for m in self.pattern.finditer(text))
                yield b"".join(iter(lambda: b"".join(self.joined([list(islice(matches, BLOCK_PIECES))])), b""))
                continue
            cut.append(self.pattern.findall(text))
            chars += len(text)
            if chars > BLOCK_CHARS:
                yield from self.joined(cut)
                cut, chars = [], 0
        yield from self.joined(cut)

    def decode(self, ids: bytes) -> bytes:
        numbers, token_of = np.frombuffer(ids, "<u4"), self.table.tokens.__getitem__
        parts = (numbers[i : i + BLOCK_PIECES].tolist() for i in range(0, len(numbers), BLOCK_PIECES))
        return b"".join(b"".join(map(token_of, part)) for part in parts)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """Set up once in each worker."""
    return Coder(path, pattern)


def pieces_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same cells in arrays of bounded size (a larger cell comes alone), so that little of a batch is held twice."""
    for cells in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(cells):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK_CHARS, side="right")))
            yield cells.slice(begin, end - begin)
            begin = end


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of ``text`` as little-endian unsigned 32-bit integers, in one binary cell.

    The rank file must be readable at ``path`` on every executor.  Null counts as the empty text, which has no ids; a
    text of any length is encoded whole, in memory that grows with that text alone.  Rows stay as they are, whatever
    their other columns are called; repeated rows give repeated results and an empty table an empty one.
    """

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces_of(batches):
            yield pa.array(coder(path, pattern).encode([t or "" for t in texts.to_pylist()]), pa.binary())

    return ids(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ``ids`` (see ``encoded``) stand for; null stays null, an unknown id is an error."""

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = coder(path, pattern).decode
        for cells in pieces_of(batches):
            yield pa.array([None if c is None else decode(c) for c in cells.to_pylist()], pa.binary())

    return raw(ids)


def id_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
