"""N-gram Jaccard join with signature trees: components of documents whose shingle sets are nearly equal.

Every step is exact up to 64-bit hashes of words, shingles and sets.  Documents with one set are one class.
Classes meet in buckets: a class goes to the bucket of each token in its prefix, the rarest tokens of
which two sets that link must share one, and there to the size bands in which a partner can be.  Rarity
comes from counters of a fixed number, so common shingles never form buckets where rarer ones will do.

In a bucket all members are first compared with one pivot.  Groups of near copies become components that way at
linear cost.  A bucket whose members are then in several components is searched with a signature tree:
its nodes hold the union of their members' token bitmaps and the range of their sizes, and pairs
of nodes are followed only while the greatest overlap they allow is enough and their members are not
yet all in one component.  A bucket gives its pairs to be verified while they are no more than its members.  One with more is
searched again with the members' exact sets at hand: a pair is verified on the spot, and each link found joins
two components of the bucket, so it gives fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.base import (
    COUNTERS,
    WORD,
    batches,
    connected_components,
    counter_of,
    counter_rows,
    flat_sets,
    hinted,
    lowered_words,
    prefixes,
    set_hashes,
    summed_counters,
    without,
    wrapped,
)
from plumbline.session import materialize

HOT_COUNT = 20_000
BATCH_CHARS = 1_500_000
LEAF = 16
FANOUT = 8
BLOCK = 1_000
BLOCK_TOKENS = 2_000_000
PIVOTS = 3
CLASS_SALTS = 8
PARTNERS_PER_CELL = 2_000


def needed(n: np.ndarray | int, percent: int):
    """Least overlap that a set of n tokens must have with any set it links to."""
    return -(-percent * n // 100)


def least_overlap(a, b, percent: int):
    """Least overlap with 100 * overlap >= percent * union for sets of a and b tokens."""
    return -(-percent * (a + b) // (100 + percent))


def bitmaps(token: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set a bit per token hash, at least eight bits a token; widths are powers of two, so one folds onto another."""
    out, at = [], 0
    for n in sizes.tolist():
        bits = max(64, 1 << (8 * n - 1).bit_length()) if n else 0
        held = np.zeros(bits, np.uint8)
        if n:
            held[(token[at : at + n] & np.uint64(bits - 1)).astype(np.int64)] = 1
        out.append(np.packbits(held, bitorder="little").tobytes())
        at += n
    return out


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap narrowed to ``width`` bytes."""
    return bits if len(bits) == width else np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def band(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of linking sets are in one band or in two neighbouring ones."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def class_rows(size: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(COUNTERS, np.int64)
        for frame in batches(frames, 2_000, BATCH_CHARS):
            token, _, sizes = flat_sets([lowered_words(x) for x in frame["text"]], size)
            counters += np.bincount(counter_of(token), minlength=COUNTERS)
            own = {"doc_id": frame["doc_id"].astype("Int64"), "digest": frame["digest"], "n": sizes, "cls": set_hashes(token, sizes)}
            yield pd.DataFrame({**own, "sig": bitmaps(token, sizes), "part": None, "counts": None})
        for part, held in counter_rows(counters):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "digest": [0], "n": [0], "cls": [0], "sig": [None], "part": [part], "counts": [held]})

    return rows


def posting_rows(shared, size: int, percent: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, seen = shared.value, set()
        for frame in batches(frames, 2_000, BATCH_CHARS):
            token, item, sizes = flat_sets([lowered_words(x) for x in frame["text"]], size)
            cls = set_hashes(token, sizes)
            fresh = np.array([n > 0 and c not in seen for c, n in zip(cls.tolist(), sizes.tolist(), strict=True)], bool)
            if len(seen) < 200_000:  # copies in one task need not be told twice
                seen.update(cls[fresh].tolist())
            length = np.where(fresh, sizes - needed(sizes, percent) + 1, 0)
            at, _ = prefixes(token, item, sizes, counters, length)
            salts = 1 + counters[counter_of(token[at])] // HOT_COUNT
            of = item[at]
            yield pd.DataFrame({"token": token[at].view(np.int64), "cls": cls[of], "n": sizes[of].astype(np.int32), "salts": salts.astype(np.int32)})

    return rows


def member_sets(size: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 2_000, BATCH_CHARS):
            token, _, sizes = flat_sets([lowered_words(x) for x in frame["text"]], size)
            yield pd.DataFrame({"cls": frame["cls"].to_numpy(), "tokens": np.split(token.view(np.int64), np.cumsum(sizes)[:-1])})

    return rows


@dataclass
class Node:
    low: int
    high: int
    bits: np.ndarray
    components: set
    begin: int
    end: int
    parts: list


class SignatureTree:
    """Members in the order of size (then bitmap), in leaves of LEAF, under nodes of FANOUT parts."""

    def __init__(self, classes: np.ndarray, components: np.ndarray, sizes: np.ndarray, signatures: list[bytes]):
        order = np.lexsort((classes, sizes))
        self.classes, self.components, self.sizes = classes[order], components[order], sizes[order].astype(np.int64)
        maps = [np.frombuffer(signatures[i], np.uint8) for i in order]
        width = min(map(len, maps))
        self.bits = np.stack([folded(m, width) for m in maps])
        level = []
        for begin in range(0, len(order), LEAF):
            end = min(begin + LEAF, len(order))
            level.append(self.node(begin, end, []))
        while len(level) > 1:
            level = [self.node(part[0].begin, part[-1].end, part) for part in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))]
        self.root = level[0]

    def node(self, begin: int, end: int, parts: list) -> Node:
        bits = np.bitwise_or.reduce(self.bits[begin:end] if not parts else np.stack([p.bits for p in parts]), axis=0)
        inside = set(self.components[begin:end].tolist()) if not parts else set().union(*[p.components for p in parts])
        return Node(int(self.sizes[begin]), int(self.sizes[end - 1]), bits, inside, begin, end, parts)

    def links(self, sets: dict, percent: int) -> Iterator[tuple[int, int]]:
        """Classes that link by their exact sets and join two components that no link before has joined."""
        for i, j in self.pairs(percent):
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if self.components[x] == self.components[y]:
                    continue
                a, b = int(self.classes[x]), int(self.classes[y])
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    self.components[self.components == self.components[y]] = self.components[x]
                    yield min(a, b), max(a, b)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that may link and are in different components, by dual traversal from the root."""
        todo = [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            if len(a.components) == 1 and a.components == b.components:
                continue
            if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
                continue
            # No member of a shares with one of b more tokens than it has bits in both unions plus what shares a bit.
            common = int(np.bitwise_count(a.bits & b.bits).sum())
            spare = max(a.high - int(self.least_bits(a)), 0)
            if common + spare < least_overlap(a.low, b.low, percent):
                continue
            if not a.parts and not b.parts:
                yield self.leaf_pairs(a, b, percent)
            elif a is b:
                todo += [(a.parts[i], a.parts[j]) for i in range(len(a.parts)) for j in range(i, len(a.parts))]
            elif not b.parts or (a.parts and a.end - a.begin >= b.end - b.begin):
                todo += [(p, b) for p in a.parts]
            else:
                todo += [(a, p) for p in b.parts]

    def least_bits(self, a: Node) -> int:
        return np.bitwise_count(self.bits[a.begin : a.end]).sum(1).min()

    def leaf_pairs(self, a: Node, b: Node, percent: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.meshgrid(np.arange(a.begin, a.end), np.arange(b.begin, b.end), indexing="ij")
        i, j = i.ravel(), j.ravel()
        fresh = (i < j) & (self.components[i] != self.components[j])
        i, j = i[fresh], j[fresh]
        keep = possible(self.bits[i], self.bits[j], self.sizes[i], self.sizes[j], percent)
        return i[keep], j[keep]


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m tokens with these bitmaps can link: a bit of one that the other lacks is a token it lacks."""
    least = least_overlap(n, m, percent)
    only_x = np.bitwise_count(x & ~y).sum(1)
    only_y = np.bitwise_count(y & ~x).sum(1)
    return (only_x <= n - least) & (only_y <= m - least)


def few_pairs(tree: SignatureTree, percent: int) -> list[tuple[int, int]] | None:
    """The pairs that a tree lets through, or None as soon as they outnumber its members."""
    out = []
    for i, j in tree.pairs(percent):
        if len(out) + len(i) > len(tree.classes):
            return None
        a, b = tree.classes[i], tree.classes[j]
        out += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)
    return out


def tree_search(percent: int, exact: bool):
    """Over rows sorted by bucket, many small buckets to a frame: (dense, x, y, i, j).

    Without sets: pairs (x, y) to verify, or a dense row with token x, band y and block (i, j) for a bucket of too many.
    With sets: the links (x, y) of each bucket.
    """
    columns = ["token", "band", "i", "j"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = frame[columns].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.zeros(0, np.int64)
            if not len(begin):
                continue
            held = frame.iloc[begin[-1] :]  # its rows may go on in the next frame
            yield from found(frame, begin[:-1], begin[1:])
        if held is not None and len(held):
            yield from found(held.reset_index(drop=True), np.array([0]), np.array([len(held)]))

    def found(frame: pd.DataFrame, begins: np.ndarray, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        cls, component, n = (frame[c].to_numpy() for c in ("cls", "component", "n"))
        sig, where = frame["sig"].to_numpy(), frame[columns].to_numpy()
        out = []
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            if end - begin < 2:
                continue
            at = begin + np.unique(cls[begin:end], return_index=True)[1]
            tree = SignatureTree(cls[at], component[at], n[at], sig[at])
            if exact:
                pairs = tree.links(dict(zip(cls[at].tolist(), frame["tokens"].to_numpy()[at], strict=True)), percent)
            else:
                pairs = few_pairs(tree, percent)
            if pairs is None:
                out.append((True, *where[begin].tolist()))
            else:
                out += [(False, a, b, 0, 0) for a, b in pairs]
        if out:
            yield pd.DataFrame(out, columns=["dense", "x", "y", "i", "j"])

    return search


def filter_pairs(percent: int):
    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fine = []
            for x, y, n, m in zip(frame["sig_a"], frame["sig_b"], frame["n_a"], frame["n_b"], strict=True):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                width = min(len(p), len(q))
                fine.append(bool(possible(folded(p, width)[None], folded(q, width)[None], np.array([n]), np.array([m]), percent)[0]))
            yield frame.loc[fine, ["a", "b"]]

    return keep


def verified(percent: int):
    def verify(key, hubs: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        links = []
        if len(hubs):
            hub = hubs["hub"].iloc[0]
            for b, tokens in zip(others["b"], others["tokens"], strict=True):
                both = len(np.intersect1d(hub, tokens, assume_unique=True))
                if 100 * both >= percent * (len(hub) + len(tokens) - both):
                    links.append(b)
        return pd.DataFrame({"a": np.full(len(links), key[0], np.int64), "b": np.array(links, np.int64)})

    return verify


class Join:
    """The steps over one table of documents; each leaves a written table for the next."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
        spark = docs.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        schema = "doc_id long, digest long, n int, cls long, sig binary, part int, counts array<long>"
        both = materialize(self.docs.mapInPandas(class_rows(size), schema), "shingled")
        self.rows = both.where("part is null").select("doc_id", "digest", "n", "cls", "sig")
        self.counters = summed_counters(both.where("part is not null").select("part", "counts"))
        first = F.min(F.struct("doc_id", "digest")).alias("first")
        classes = self.rows.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), first)
        self.classes = materialize(classes, "classes")

    def buckets(self) -> DataFrame:
        """(token, band, salt, salts, cls, n) of the buckets in which two classes may meet."""
        shared = self.docs.sparkSession.sparkContext.broadcast(self.counters)
        rows = self.docs.select("text").mapInPandas(posting_rows(shared, self.size, self.percent), "token long, cls long, n int, salts int")
        near = Window.partitionBy("token", "salt").orderBy("cls")
        salted = rows.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("cls"), F.col("salts"))).otherwise(0).cast("int"))
        met = salted.withColumn("before", F.lag("cls").over(near)).withColumn("after", F.lead("cls").over(near))
        met = met.where((F.col("salts") > 1) | (F.col("before") != F.col("cls")) | (F.col("after") != F.col("cls")))
        low = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / self.percent)) + 1e-9).cast("int")
        both = met.select("token", "salt", "salts", "cls", "n", F.explode(F.array(low, low + 1)).alias("band"))
        return materialize(both.distinct(), "buckets")

    def star_pairs(self, buckets: DataFrame) -> DataFrame:
        """(a, b): the members of a bucket with its pivots, and the pivots of a salted bucket with the first of them.

        Each of PIVOTS orders has its own pivot in a bucket.
        """
        pivot = F.first(F.struct("cls", "n"))
        found = []
        for turn in range(PIVOTS):
            order = F.xxhash64("cls", F.lit(turn))
            inside = Window.partitionBy("token", "band", "salt").orderBy(order, "cls").rowsBetween(Window.unboundedPreceding, 0)
            found.append(buckets.withColumn("pivot", pivot.over(inside)).select("pivot", "cls", "n"))
        heads = buckets.where("salts > 1").groupBy("token", "band", "salt").agg(F.min(F.struct("cls", "n")).alias("head")).select("token", "band", "head.cls", "head.n")
        across = Window.partitionBy("token", "band").orderBy("cls").rowsBetween(Window.unboundedPreceding, 0)
        pairs = heads.withColumn("pivot", pivot.over(across)).select("pivot", "cls", "n")
        for more in found:
            pairs = pairs.unionByName(more)
        pairs = pairs.where((F.col("pivot.cls") != F.col("cls")) & self.sizes_fit(F.col("pivot.n"), F.col("n")))
        return pairs.select(F.least("pivot.cls", "cls").alias("a"), F.greatest("pivot.cls", "cls").alias("b")).distinct()

    def sizes_fit(self, n, m):
        return (100 * F.least(n, m).cast("long")) >= (self.percent * F.greatest(n, m).cast("long"))

    def signed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bitmaps allow enough overlap."""
        side = lambda c: self.classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(filter_pairs(self.percent), "a long, b long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cls, tokens) of the classes in ``wanted`` (cls), each from one document that has it."""
        chosen = materialize(wanted.join(self.classes, "cls").select("cls", F.col("first.doc_id").alias("d"), F.col("first.digest").alias("g")), "chosen")
        same = self.docs["doc_id"].eqNullSafe(F.col("d")) & (self.docs["digest"] == F.col("g"))
        texts = self.docs.join(hinted(chosen, 1_000_000), same).select("cls", "text")
        return materialize(texts.mapInPandas(member_sets(self.size), "cls long, tokens array<long>").dropDuplicates(["cls"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs that link, by exact intersection.  One set a pair is shuffled; hubs' sets go once to each cell."""
        pairs = materialize(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct())
        cells = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS_PER_CELL).cast("int").alias("cells"))
        cells = materialize(cells, "cells")
        sized = pairs.join(cells, "a").withColumn("cell", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int"))
        others = sized.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "cell", "b", "tokens")
        hubs = cells.join(sets.withColumnRenamed("cls", "a"), "a").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        hubs = hubs.select(F.col("a").alias("hub_id"), F.col("cell").alias("hub_cell"), F.col("tokens").alias("hub"))
        found = hubs.groupBy("hub_id", "hub_cell").cogroup(others.groupBy("a", "cell")).applyInPandas(verified(self.percent), "a long, b long")
        return materialize(found, "links")

    def open_links(self, buckets: DataFrame, components: DataFrame, done: DataFrame) -> DataFrame:
        """Links between different components that the signature trees of unsettled buckets find."""
        own = components.select(F.col("node").alias("cls"), "component")
        named = buckets.select("token", "band", "cls", "n").join(own, "cls", "left")
        named = materialize(named.withColumn("component", F.coalesce("component", "cls")), "named")
        alike = [F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("cls")).alias("p"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("q")]
        sizes = named.groupBy("token", "band").agg(*alike, F.sum("n").alias("tokens"), F.min("component").alias("x"), F.max("component").alias("y")).where("members > 2 and x <> y")
        # Near copies share many tokens: buckets with the same members are searched once.
        once = sizes.groupBy("members", "p", "q", "tokens").agg(F.min(F.struct("token", "band")).alias("bucket"))
        blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("tokens") / BLOCK_TOKENS)).cast("int")
        unsettled = once.select("bucket.token", "bucket.band", blocks.alias("blocks"))
        rows = named.join(unsettled, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        rows = materialize(rows.select("token", "band", "i", "j", "cls", "component", "n"), "searched")
        signatures = self.classes.select("cls", "sig")
        found = materialize(self.searched(rows.join(signatures, "cls"), False), "tree-pairs")
        pairs = found.where("not dense").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        links = self.links(pairs.join(done, ["a", "b"], "left_anti"))
        dense = found.where("dense").select(F.col("x").alias("token"), F.col("y").cast("int").alias("band"), "i", "j")
        if not dense.limit(1).count():
            return links
        crowded = materialize(rows.join(hinted(materialize(dense, "dense")), ["token", "band", "i", "j"]), "crowded")
        sets = self.sets(crowded.select("cls").distinct())
        more = self.searched(crowded.join(signatures.join(sets, "cls"), "cls"), True)
        return links.unionByName(materialize(more.select(F.col("x").alias("a"), F.col("y").alias("b")), "tree-links")).distinct()

    def searched(self, rows: DataFrame, exact: bool) -> DataFrame:
        key = ["token", "band", "i", "j"]
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(*key, "cls", "component", "n", "sig", *["tokens"] * exact).repartition(tasks, *key).sortWithinPartitions(*key)
        return dealt.mapInPandas(tree_search(self.percent, exact), "dense boolean, x long, y long, i int, j int")

    def components(self) -> DataFrame:
        """(cls, component): the smallest doc_id of the component of every class that is not alone."""
        buckets = self.buckets()
        first = materialize(self.signed(self.star_pairs(buckets)), "star-pairs")
        near = connected_components(self.links(first))
        more = self.open_links(buckets, near, first)
        # Later links count once between two components, however many members they join.
        own = lambda c: near.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
        parts = more.join(own("a"), "a", "left").join(own("b"), "b", "left")
        ends = [F.coalesce("part_a", "a"), F.coalesce("part_b", "b")]
        bridges = parts.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
        far = connected_components(bridges).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        labelled = self.classes.join(near, self.classes["cls"] == near["node"], "left").withColumn("part", F.coalesce("component", "cls"))
        labelled = labelled.join(far, "part", "left").where("copies > 1 or node is not null or whole is not null")
        labelled = labelled.select("cls", F.coalesce("whole", "part").alias("part"), "least")
        least = labelled.groupBy("part").agg(F.min("least").alias("component"))
        return materialize(labelled.join(least, "part").select("cls", "component"), "components")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of distinct ``size``-word shingles; a
    shorter text is one shingle.  ``component_id`` is the smallest doc_id reachable, null ids left out.  Null, empty and
    blank texts have no shingles and link with nothing: they are their own components.  Repeated rows
    each keep a row.  ``digest`` is the text's xxhash64.  Other columns are ignored.
    """
    join = Join(docs, size, percent)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(CLASS_SALTS)).cast("int")
    parts = join.components().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))))
    rows = join.rows.select("doc_id", "digest", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls")).withColumn("salt", salt)
    empty = rows.where("cls is null").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"))
    full = rows.where("cls is not null").join(parts, ["cls", "salt"], "left")
    return full.select("doc_id", "digest", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).unionByName(empty)


def one_per_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component kept, the one of least doc_id; all columns stay.

    Of repeated rows of that document one stays.  Rows with null doc_id stay unless a component with an id
    holds them.  Documents without words all stay.
    """
    found = jaccard_components(docs, size, percent)
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    extra = found.where(~own & (F.col("n_shingles") > 0)).select("doc_id", "digest").distinct()
    left = without(docs, materialize(extra, "extra"))
    return first_of_repeated(left)


def first_of_repeated(docs: DataFrame) -> DataFrame:
    """One of several rows with the same id and text that has words; what else they hold decides, so reruns agree."""
    rows = wrapped(docs).where(F.col("doc.text").rlike(WORD))
    key = [F.col("key_id").alias("doc_id"), F.col("key_text").alias("digest")]
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest")
    twice = materialize(twice, "repeated")
    if not twice.limit(1).count():
        return docs
    same = F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_text") == F.col("digest"))
    again = rows.join(hinted(twice, 1_000_000), same, "left_semi")
    kept = again.groupBy("key_id", "key_text").agg(F.min("doc").alias("kept")).select("kept.*")
    return without(docs, twice).unionByName(kept)
