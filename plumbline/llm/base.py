"""Helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x20\\x09-\\x0D]+"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else.  ``lower`` does just that on plain ASCII and is faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table may be broadcast: its rows and its bytes are counted, not guessed.

    Count a table from ``materialize``, so that nothing is computed twice.
    """
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    flat = [F.lit(16 * len(df.columns))] + [F.size(c) * 24 for c, kind in df.dtypes if kind.startswith("array")]
    width = sum(text + flat[1:], flat[0])
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else as it is for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc, key_id, key_text): whole rows as one column, so that no name of theirs can clash, and what tells them apart."""
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without rows whose doc_id and text hash are in the written table ``gone`` (doc_id, digest); null equals null."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_text"))
    same = F.col("key_id").eqNullSafe(F.col("gone_id")) & (F.col("key_text") == F.col("gone_text"))
    return wrapped(docs).join(hinted(gone, 1_000_000), same, "left_anti").select("doc.*")


def fold(ids: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % n


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, equal in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64
)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads near ones apart."""
    x = (x ^ (x >> np.uint64(32))) * MIX[3]
    x = (x ^ (x >> np.uint64(29))) * MIX[0]
    return x ^ (x >> np.uint64(32))


def lowered_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D) with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def batches(frames: Iterator[pd.DataFrame], rows: int, chars: int, text: str = "text"):
    """The same rows in frames of bounded rows and characters (a longer text comes alone)."""
    for frame in frames:
        if not len(frame):
            continue
        ends = frame[text].str.len().fillna(0).astype("int64").cumsum().to_numpy()
        begin = 0
        while begin < len(frame):
            before = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, before + chars, side="right"))
            end = min(max(end, begin + 1), begin + rows)
            yield frame.iloc[begin:end]
            begin = end


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node for every node of an undirected graph: (node, component).

    Each round gives a node the least label among itself and its neighbours, then lets it take its
    label's label, so chains shorten by doubling.  Rounds are written tables and end when no label
    moves.  A hub costs one combined row per task.  An edgeless graph gives no rows.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "graph")
    labels = materialize(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other")
        near = near.groupBy("node").agg(F.min("component").alias("found"))
        low = labels.join(near, "node").select("node", F.least("component", "found").alias("found"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("found"), F.col("component").alias("further"))
        step = low.join(jump, "found", "left").select("node", "was", F.least("found", F.coalesce("further", "found")).alias("component"))
        step = materialize(step, "labels")
        moved = step.where("component <> was").limit(1).count()
        labels = step.select("node", "component")
        if not moved:
            return labels


def flat_sets(items: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of many word lists at once: (token hashes, item of each, tokens per item).

    Tokens are distinct in their item and sorted by item, then hash.  An item of fewer than ``size`` words has one token
    of all its words, an empty one none.
    """
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    h = hashes([w for words in items for w in words])
    ends = np.cumsum(lengths)
    found, owner = [], []
    if len(h) >= size:
        item = np.repeat(np.arange(len(items)), lengths)[: len(h) - size + 1]
        begin = np.flatnonzero(np.arange(len(item)) + size <= ends[item])
        found.append(mixed(h, begin, size))
        owner.append(item[begin])
    for width in range(1, size):
        short = np.flatnonzero(lengths == width)
        found.append(mixed(h, ends[short] - width, width))
        owner.append(short)
    token, item = np.concatenate(found), np.concatenate(owner)
    order = by_item(token, item)
    token, item = token[order], item[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (item[1:] != item[:-1])
    token, item = token[fresh], item[fresh]
    return token, item, np.bincount(item, minlength=len(items))


def by_item(token: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The order by item, then token: one sort of a key with most bits of both, unless those tie for different tokens."""
    if len(item) and int(item.max()) < 1 << 20:
        key = (item.astype(np.uint64) << np.uint64(44)) | (token >> np.uint64(20))
        order = np.argsort(key)
        tie = key[order[1:]] == key[order[:-1]]
        if not (tie & (token[order[1:]] != token[order[:-1]])).any():
            return order
    return np.lexsort((token, item))


def mixed(h: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """One hash for ``width`` consecutive word hashes from each place in ``begin``."""
    out = np.full(len(begin), width, np.uint64)
    for i in range(width):
        out = scramble(out * MIX[1] + h[begin + i])
    return out


def set_hashes(token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set in the form of ``flat_sets``; 0 for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        begin = (np.cumsum(sizes) - sizes)[some]
        spread = scramble(token)
        total = np.add.reduceat(spread, begin) * MIX[1] + sizes[some].astype(np.uint64)
        crossed = np.bitwise_xor.reduceat(scramble(spread + MIX[2]), begin)
        out[some] = scramble(total + crossed * MIX[2])
    return out.view(np.int64)


COUNTERS = 1 << 18


def counter_of(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64(COUNTERS - 1)).astype(np.int64)


def prefixes(token: np.ndarray, item: np.ndarray, sizes: np.ndarray, counters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each prefix token, its place in its set's order): the ``length`` rarest tokens of each set.

    Rarity is the count of the token's counter; ties go by the hash, so all sets share one order.
    """
    count = counters[counter_of(token)]
    narrow = len(sizes) < 1 << 20 and int(count.max(initial=0)) < 1 << 40
    # Tokens of an item are sorted already, so a stable sort keeps ties in the order of the hash.
    order = np.argsort((item << 40) | count, kind="stable") if narrow else np.lexsort((token, count, item))
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(token)) - begin[item]  # items stay where they are, each in its own order
    keep = place < length[item]
    return order[keep], place[keep]


def counter_rows(counters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first counter, counts) in parts of bounded size, for a table that ``summed_counters`` adds up."""
    for part in range(0, COUNTERS, 1 << 16):
        held = counters[part : part + (1 << 16)]
        if held.any():
            yield part, held


def summed_counters(parts: DataFrame) -> np.ndarray:
    """Sums of (part, counts) rows of all tasks; the result has a fixed size."""
    each = parts.select("part", F.posexplode("counts").alias("at", "count")).where("count > 0")
    rows = each.groupBy((F.col("part") + F.col("at")).alias("at")).agg(F.sum("count").alias("count")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["count"].to_numpy(np.int64)
    return out
