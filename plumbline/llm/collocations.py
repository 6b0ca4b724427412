"""Phrases of two to five words that occur far more often than their parts predict, counted exactly.

Texts are cut into words once and written as word numbers with the words they stand for, block by block.  Phrases are
then counted length by length.  A phrase can be frequent only if both phrases one word shorter are, so each pass counts
just the places where a bitmap holds both; its size follows the number of frequent phrases up to a fixed bound.  Up to three
words, where most candidates are rare, phrases pass a second bitmap first: hashes counted in cells, summed over all tasks,
of which only the full ones matter.  What passes a bitmap wrongly is counted in vain and then found to be rare.

A task counts in a HAT-trie: hash containers of word-id strings hang below a trie of the first words, and one that
grows too large bursts into one container for each next word.  When the trie is full, whole subtrees are spilled, the largest
first, as sorted runs: one compressed cell for each prefix partition (a hash of the language and the first two words).  Runs
meet there and are merged, and only frequent phrases become rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.base import batches, hashes, hinted, mixed
from plumbline.session import materialize, spread

LONGEST = 5
LEAST = 100
TOP = 2000
BURST = 1 << 15
TRIE_ENTRIES = 400_000
TASK_WORDS = 400_000
BATCH_CHARS = 2_000_000
BATCH_ROWS = 20_000
RUN_ROWS = 20_000
BITS_PER_PHRASE = 16
MAX_BITS = 1 << 29
CHARS_PER_CELL = 32
MAX_CELLS = 1 << 27
CELL_BLOCK = 1 << 18
LEAST_PARTS = 256
CHARS_PER_PART = 4_000_000
CELLED = 3  # phrases up to this length pass the cells
NO_LANGUAGE = "und"

BREAK = b"\n"
SEPARATED = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


class Numbers(dict):
    """Running numbers of words; 0 is the break between pieces and -1 the empty string."""

    def __init__(self):
        super().__init__({BREAK: 0, b"": -1})
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = number = len(self.words)
        return number


TOKENS = "lang string, ids binary, n_ids long, words binary, n_bytes long, n long"
CODEC = "zstd"


def tokenized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts, many of a language in a row, as word numbers (int32, 0 for a break) and the words in the order of their numbers."""
    for frame in batches(frames, BATCH_ROWS, BATCH_CHARS):
        for lang, texts in frame.groupby("lang", sort=False)["text"]:
            data = "\n".join(texts).encode("utf-8", "surrogatepass").lower().translate(SEPARATED)
            numbers = Numbers()
            words = data.replace(BREAK, b" \n ").split(b" ")
            ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            ids = ids[ids >= 0]
            if numbers.words:
                ids = ids[(ids > 0) | (np.append(1, ids[:-1]) > 0)]  # one break in a row is enough
                named = BREAK.join(numbers.words)
                packed = [pa.compress(part, CODEC, asbytes=True) for part in (ids.tobytes(), named)]
                row = (lang, packed[0], len(ids), packed[1], len(named), int((ids > 0).sum()))
                yield pd.DataFrame([row], columns=[c.split()[0] for c in TOKENS.split(", ")])


def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """(language, word numbers with a break at the end, words by their numbers, hash at each place) of written tokens."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            ids = np.append(np.frombuffer(pa.decompress(row.ids, 4 * row.n_ids, CODEC), np.int32), 0).astype(np.int64)
            words = [BREAK, *bytes(pa.decompress(row.words, row.n_bytes, CODEC)).split(BREAK)]
            prefix = row.lang.encode() + BREAK
            yield row.lang, ids, words, hashes([prefix + word for word in words])[ids]


class Vocabulary:
    """A task's own numbers for the words of phrases that may be frequent, in each language."""

    def __init__(self):
        self.by_lang: dict[str, dict[bytes, int]] = {}
        self.names: list[tuple[str, bytes]] = []

    def renumbered(self, lang: str, rows: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Phrases given by a row's word numbers, by the task's."""
        known = self.by_lang.setdefault(lang, {})
        used, at = np.unique(rows, return_inverse=True)
        own = np.empty(len(used), "<i4")
        for i, number in enumerate(used.tolist()):
            word = words[number]
            if word not in known:
                known[word] = len(self.names)
                self.names.append((lang, word))
            own[i] = known[word]
        return own[at.reshape(rows.shape)]


class Node(dict):
    """Subtrees by the next word of a phrase: containers (plain dicts from the rest of a phrase to its count) or nodes."""


class HatTrie:
    """Counts of phrases, given as strings of 4-byte word ids; only the first ``depth`` words can be nodes."""

    def __init__(self, depth: int):
        self.depth, self.root, self.entries = depth, {}, 0

    def add(self, keys: Iterable[bytes], counts: Iterable[int]) -> None:
        root, depth = self.root, self.depth
        for key, n in zip(keys, counts, strict=True):
            holder, node, level, rest = None, root, 0, key
            while type(node) is Node:
                holder, word, rest = node, rest[:4], rest[4:]
                node = holder.get(word)
                level += 1
                if node is None:
                    node = holder[word] = {}
            held = node.get(rest)
            if held is not None:
                node[rest] = held + n
                continue
            node[rest] = n
            self.entries += 1
            if len(node) > BURST and level < depth:
                burst = Node()
                for tail, count in node.items():
                    burst.setdefault(tail[:4], {})[tail[4:]] = count
                if holder is None:
                    root = self.root = burst
                else:
                    holder[word] = burst

    def spill(self, leave: int) -> Iterator[tuple[list[bytes], list[int]]]:
        """Take out whole subtrees of the root, the largest first, until at most ``leave`` entries are left."""
        if type(self.root) is not Node:
            if self.entries > leave:
                taken, self.root, self.entries = self.root, {}, 0
                yield list(taken), list(taken.values())
            return
        sized = sorted(((size_of(tree), word) for word, tree in self.root.items()), reverse=True)
        for size, word in sized:
            if self.entries <= leave:
                return
            self.entries -= size
            keys, counts = [], []
            collect(self.root.pop(word), word, keys, counts)
            yield keys, counts


def size_of(tree: dict) -> int:
    return sum(map(size_of, tree.values())) if type(tree) is Node else len(tree)


def collect(tree: dict, prefix: bytes, keys: list[bytes], counts: list[int]) -> None:
    if type(tree) is Node:
        for word, below in tree.items():
            collect(below, prefix + word, keys, counts)
    else:
        keys += [prefix + rest for rest in tree]
        counts += tree.values()


class Bitmap:
    """Whether a phrase's hash may be that of a frequent one."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, np.uint8)
        self.mask = np.uint64(8 * len(self.bits) - 1)

    def may_hold(self, hashed: np.ndarray) -> np.ndarray:
        at = hashed & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def places(ids: np.ndarray, size: int, hashed: np.ndarray, shorter: Bitmap | None, cells: Bitmap | None) -> np.ndarray:
    """Where a phrase of ``size`` words begins that may be frequent."""
    if len(ids) < size:
        return np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(ids == 0)])
    begin = np.flatnonzero(breaks[size:] == breaks[:-size])
    if shorter and len(begin):
        known = shorter.may_hold(mixed(hashed, np.arange(len(ids) - size + 2), size - 1))
        begin = begin[known[begin] & known[begin + 1]]
    if cells and len(begin):
        begin = begin[cells.may_hold(mixed(hashed, begin, size))]
    return begin


def cell_counts(size: int, count: int, least: int, shorter: Broadcast | None):
    """The work of one task: how often a phrase's hash falls into each cell, up to ``least``, in blocks of cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Bitmap(shorter.value) if shorter else None
        held = np.zeros(count, np.uint8)
        limit = min(least, 255)
        for _, ids, _, hashed in rows_of(frames):
            begin = places(ids, size, hashed, known, None)
            at, n = np.unique(mixed(hashed, begin, size) & np.uint64(count - 1), return_counts=True)
            held[at] = np.minimum(held[at] + n, limit)
        for block in range(0, count, CELL_BLOCK):
            part = held[block : block + CELL_BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                dense = len(at) * 5 >= len(part)
                yield pd.DataFrame({"block": [block // CELL_BLOCK], "at": [b"" if dense else at.astype("<u4").tobytes()], "n": [(part if dense else part[at]).tobytes()]})

    return run


def full_cells(size: int, least: int):
    """Blocks of cells, those of a block in a row, to bits of the cells that hold ``least`` in all (255, if that is less)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, total = None, np.zeros(size, np.int64)
        limit = min(least, 255)

        def done() -> pd.DataFrame:
            return pd.DataFrame({"block": [block], "bits": [np.packbits(total >= limit, bitorder="little").tobytes()]})

        for frame in frames:
            for found, at, n in zip(frame["block"], frame["at"], frame["n"], strict=True):
                if found != block:
                    if block is not None:
                        yield done()
                    block, total = found, np.zeros(size, np.int64)
                n = np.frombuffer(n, np.uint8)
                if at:
                    total[np.frombuffer(at, "<u4")] += n
                else:
                    total += n
        if block is not None:
            yield done()

    return run


def cells_of(tokens: DataFrame, size: int, least: int, chars: int, shorter: Broadcast | None) -> Broadcast:
    """Bits of the cells that may hold a frequent phrase.  Cells follow the length of all texts up to a bound (16 MB of bits)."""
    count = CELL_BLOCK
    while count < min(chars // CHARS_PER_CELL, MAX_CELLS):
        count *= 2
    each = tokens.mapInPandas(cell_counts(size, count, least, shorter), "block long, at binary, n binary")
    each = each.repartition("block").sortWithinPartitions("block")
    data = bytearray(count >> 3)
    for row in each.mapInPandas(full_cells(CELL_BLOCK, least), "block long, bits binary").toLocalIterator():
        begin = row["block"] * CELL_BLOCK >> 3
        data[begin : begin + len(row["bits"])] = row["bits"]
    return tokens.sparkSession.sparkContext.broadcast(bytes(data))


def distinct(ids: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of each distinct phrase, its count) among those that begin at the given places."""
    code = ids[begin]
    for i in range(1, size):
        code = pd.factorize(code)[0].astype(np.int64) << 32 | ids[begin + i]
    code, _ = pd.factorize(code)
    counts = np.bincount(code)
    sample = np.empty(len(counts), np.int64)
    sample[code[::-1]] = begin[::-1]
    return ids[sample[:, None] + np.arange(size)], counts


def counted(size: int, parts: int, shorter: Broadcast | None, cells: Broadcast | None):
    """The work of one task: tokens to runs of counted phrases of ``size`` words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmaps = [Bitmap(b.value) if b else None for b in (shorter, cells)]
        known, trie = Vocabulary(), HatTrie(min(size, 2))
        for lang, ids, words, hashed in rows_of(frames):
            begin = places(ids, size, hashed, *bitmaps)
            if len(begin):
                rows, counts = distinct(ids, begin, size)
                rows = known.renumbered(lang, rows, words)
                trie.add(np.ascontiguousarray(rows).view(f"V{4 * size}").ravel().tolist(), counts.tolist())
            if len(known.names) > TASK_WORDS:
                yield from runs(trie, 0, size, parts, known)
                known = Vocabulary()
            elif trie.entries > TRIE_ENTRIES:
                yield from runs(trie, TRIE_ENTRIES // 2, size, parts, known)
        yield from runs(trie, 0, size, parts, known)

    return run


RUNS = "part long, phrases binary, n_bytes long, counts binary"


def runs(trie: HatTrie, leave: int, size: int, parts: int, words: Vocabulary) -> Iterator[pd.DataFrame]:
    """Spilled subtrees, small ones together, as sorted runs of phrases and counts, one row for each prefix partition."""
    keys, counts = [], []
    for more_keys, more_counts in trie.spill(leave):
        keys += more_keys
        counts += more_counts
        while len(keys) >= RUN_ROWS:
            yield sorted_runs(keys[:RUN_ROWS], counts[:RUN_ROWS], size, parts, words)
            del keys[:RUN_ROWS], counts[:RUN_ROWS]
    if keys:
        yield sorted_runs(keys, counts, size, parts, words)


def sorted_runs(keys: list[bytes], counts: list[int], size: int, parts: int, words: Vocabulary) -> pd.DataFrame:
    each = [words.names[i] for i in np.frombuffer(b"".join(keys), "<i4").tolist()]
    entries = []
    for at, n in zip(range(0, len(each), size), counts, strict=True):
        prefix = each[at][0].encode().hex().encode() + BREAK + b" ".join([word for _, word in each[at : at + min(size, 2)]])
        phrase = b" ".join([prefix, *[word for _, word in each[at + 2 : at + size]]])
        entries.append((zlib.crc32(prefix) % parts, phrase, n))
    entries.sort()
    rows = []
    for part, run in groupby(entries, itemgetter(0)):
        _, phrases, numbers = zip(*run, strict=True)
        joined = b"\v".join(phrases)  # a break, so in no word
        rows.append((part, pa.compress(joined, CODEC, asbytes=True), len(joined), np.array(numbers, "<i8").tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])


COUNTED = "lang string, phrase string, n long, hash long"


def merged_runs(least: int):
    """Runs, those of a prefix partition in a row, to the phrases that occur ``least`` times."""

    def read(phrases: bytes, n_bytes: int, counts: bytes) -> Iterator[tuple[bytes, int]]:
        return zip(bytes(pa.decompress(phrases, n_bytes, CODEC)).split(b"\v"), np.frombuffer(counts, "<i8").tolist(), strict=True)

    def merged(held: list) -> pd.DataFrame:
        totals = ((phrase, sum(n for _, n in same)) for phrase, same in groupby(heapq.merge(*[read(*run) for run in held]), itemgetter(0)))
        split = ((*phrase.split(BREAK), n) for phrase, n in totals if n >= least)
        frequent = [(bytes.fromhex(lang.decode()), phrase, n) for lang, phrase, n in split]
        flat = [lang + BREAK + word for lang, phrase, _ in frequent for word in phrase.split(b" ")]
        sizes = np.array([phrase.count(b" ") + 1 for _, phrase, _ in frequent], np.int64)
        hashed = mixed(hashes(flat), np.cumsum(sizes) - sizes, int(sizes[0])) if frequent else np.zeros(0, np.uint64)
        rows = [(lang.decode(), phrase.decode(), n) for lang, phrase, n in frequent]
        return pd.DataFrame(rows, columns=["lang", "phrase", "n"]).assign(hash=hashed.view(np.int64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []
        for frame in frames:
            for found, *packed in frame.itertuples(index=False):
                if found != part and held:
                    yield merged(held)
                    held = []
                part = found
                held.append(packed)
        if held:
            yield merged(held)

    return run


def phrase_counts(tokens: DataFrame, size: int, least: int, parts: int, shorter: Broadcast | None, cells: Broadcast | None) -> DataFrame:
    """(lang, phrase, n, hash) of the phrases of ``size`` words that occur ``least`` times and pass both bitmaps."""
    each = tokens.mapInPandas(counted(size, parts, shorter, cells), RUNS)
    return each.repartition("part").sortWithinPartitions("part").mapInPandas(merged_runs(least), COUNTED)


def bitmap_of(frequent: DataFrame, count: int) -> Broadcast:
    """The hashes of frequent phrases as a bitmap: 16 bits a phrase in full powers of two, 64 MB at most."""
    size = 1 << 15
    while size < min(count * BITS_PER_PHRASE, MAX_BITS):
        size *= 2
    place = F.col("hash").bitwiseAND(F.lit(size - 1)) + 1
    each = frequent.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    parts = each.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    data = bytearray(size >> 3)
    for row in parts:
        data[(row["bucket"] - 1) << 12 : row["bucket"] << 12] = row["bits"]
    return frequent.sparkSession.sparkContext.broadcast(bytes(data))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    lang = F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE))
    texts = spread(docs.where("text is not null").select(lang.alias("lang"), "text"))
    tokens = materialize(texts.mapInPandas(tokenized, TOKENS), "tokens")
    totals = materialize(tokens.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    chars = 6 * (totals.agg(F.sum("n")).first()[0] or 0)
    parts = max(LEAST_PARTS, chars // CHARS_PER_PART)
    levels: list[DataFrame] = []
    shorter = None
    for size in range(1, longest + 1):
        cells = cells_of(tokens, size, least, chars, shorter) if size <= CELLED else None
        levels.append(materialize(phrase_counts(tokens, size, least, parts, shorter, cells), f"phrases-{size}"))
        for bitmap in filter(None, (shorter, cells)):
            bitmap.unpersist()
        count = levels[-1].count()
        if not count:
            break
        shorter = bitmap_of(levels[-1], count)
    out = None
    for i, level in enumerate(levels, 1):
        level = level.select("lang", "phrase", F.lit(i).alias("size"), F.col("n").alias("a"))
        out = level if out is None else out.unionByName(level)
    return out, totals


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with the cut that scores lowest: (lang, phrase, size, a, l, r, n, score).

    Products are decimals of 38 digits and the division is a whole one, so scores are exact up to 10**13 words.
    """
    table = hinted(frequent.select("lang", "phrase", "a"))
    words = F.split("phrase", " ")
    cut = frequent.where("size > 1").select("lang", "phrase", "size", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    cut = cut.join(table.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cut = cut.join(table.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cut = cut.join(hinted(totals), "lang")
    exact = {c: f"cast({c} as decimal(19, 0))" for c in "anlr"}
    cut = cut.withColumn("score", F.expr(f"(1000 * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})"))
    best = cut.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def outermost(candidates: DataFrame) -> DataFrame:
    """Candidates that lie in no longer one that is as frequent.

    A longer phrase holds a shorter one through phrases of every length between, none of them rarer, so one word more
    is all that needs a look.
    """
    words = F.split("phrase", " ")
    inner = [F.slice(words, i, F.col("size") - 1) for i in (1, 2)]
    longer = candidates.where("size > 2").select("lang", F.explode(F.array(*inner)).alias("w"), "a")
    longer = longer.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    joined = candidates.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score: (lang, rank, phrase, a, l, r, n, score).

    ``docs`` has lang and text; a null lang is ``und``, a null or empty text has no words.  Texts are read whole,
    whatever their length, and repeated rows count each time.  Ties go to the more frequent phrase, then to the lesser in byte order.
    An empty table, or one without a frequent phrase, gives no rows.  Other columns are left out.
    """
    frequent, totals = frequent_phrases(docs, least, longest)
    kept = outermost(materialize(scored(frequent, totals), "candidates"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
