"""Line deduplication by an exact set-similarity join over the shingles of lines.

A line is removed if an earlier line has nearly its set of word shingles.  Equal sets are one class whose first
line stands for it.  Classes meet at the tokens of their prefixes in one global order by rarity; the
length filter, the positional filter and an exact intersection follow.  Rarity comes from counters of a
fixed number, so any size of corpus has one order that fits in memory.

Each class is first held against the earliest class of every bucket it is in.  Only classes that this leaves
in place meet the other, earlier members, so groups of copies cost one comparison a member and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.base import COUNTERS, batches, counter_of, counter_rows, flat_sets, hinted, prefixes, set_hashes, summed_counters
from plumbline.llm.secrets import let
from plumbline.session import materialize

BATCH_CHARS = 3_000_000
HOT_COUNT = 20_000
PIVOTS = 3


def words_by_line(text: str | None) -> list[list[bytes]]:
    """Words between ASCII white space, A-Z in lower case, of each line; lines end at line feeds."""
    if not text:
        return []
    return [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def lines_of(frame: pd.DataFrame, size: int):
    cut = [words_by_line(x) for x in frame["text"]]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    doc = np.repeat(np.arange(len(cut)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    token, item, sizes = flat_sets([words for lines in cut for words in lines], size)
    return doc, number, token, item, sizes


def line_rows(size: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(COUNTERS, np.int64)
        for frame in batches(frames, 2_000, BATCH_CHARS):
            doc, number, token, _, sizes = lines_of(frame, size)
            counters += np.bincount(counter_of(token), minlength=COUNTERS)
            some = sizes > 0
            own = {"doc_id": frame["doc_id"].astype("Int64").array[doc[some]], "digest": frame["digest"].to_numpy()[doc[some]], "line": number[some]}
            yield pd.DataFrame({**own, "cls": set_hashes(token, sizes)[some], "part": None, "counts": None})
        for part, held in counter_rows(counters):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "digest": [0], "line": [0], "cls": [0], "part": [part], "counts": [held]})

    return rows


def needed(n, percent: int):
    return -(-percent * n // 100)


def posting_rows(shared, size: int, percent: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, seen = shared.value, set()
        for frame in batches(frames, 2_000, BATCH_CHARS):
            _, _, token, item, sizes = lines_of(frame, size)
            cls = set_hashes(token, sizes)
            fresh = np.array([n > 0 and c not in seen for c, n in zip(cls.tolist(), sizes.tolist(), strict=True)], bool)
            if len(seen) < 1_000_000:
                seen.update(cls[fresh].tolist())
            length = np.where(fresh, sizes - needed(sizes, percent) + 1, 0)
            at, place = prefixes(token, item, sizes, counters, length)
            salts = 1 + counters[counter_of(token[at])] // HOT_COUNT
            of = item[at]
            columns = {"token": token[at].view(np.int64), "cls": cls[of], "n": sizes[of].astype(np.int32), "place": place.astype(np.int32)}
            yield pd.DataFrame({**columns, "salts": salts.astype(np.int32)})

    return rows


def line_sets(size: int):
    """(cls, tokens) of the lines named in ``wanted``, an array of line numbers beside the text."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 2_000, BATCH_CHARS):
            cut = []
            for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
                lines = words_by_line(text)
                cut += [lines[i] for i in wanted]
            token, _, sizes = flat_sets(cut, size)
            yield pd.DataFrame({"cls": set_hashes(token, sizes), "tokens": np.split(token.view(np.int64), np.cumsum(sizes)[:-1])})

    return rows


def checked(percent: int):
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["tokens_a"], frame["tokens_b"], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[keep, ["b"]]

    return check


class LineJoin:
    """The steps over one table of documents; each leaves a written table for the next."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        schema = "doc_id long, digest long, line int, cls long, part int, counts array<long>"
        both = materialize(self.docs.mapInPandas(line_rows(size), schema), "lines")
        self.lines = both.where("part is null").select("doc_id", "digest", "line", "cls")
        self.counters = summed_counters(both.where("part is not null").select("part", "counts"))
        first = F.min(self.place()).alias("first")
        self.classes = materialize(self.lines.groupBy("cls").agg(first), "line-classes")

    @staticmethod
    def place() -> Column:
        """The order of lines: by document id, null last, then by text hash, then by line."""
        return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "line")

    def buckets(self) -> DataFrame:
        """(token, salt, salts, cls, n, place) of tokens that two classes have in their prefixes."""
        shared = self.docs.sparkSession.sparkContext.broadcast(self.counters)
        schema = "token long, cls long, n int, place int, salts int"
        rows = self.docs.select("text").mapInPandas(posting_rows(shared, self.size, self.percent), schema)
        rows = rows.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("cls"), F.col("salts"))).otherwise(0).cast("int"))
        near = Window.partitionBy("token", "salt").orderBy("cls")
        met = rows.withColumn("before", F.lag("cls").over(near)).withColumn("after", F.lead("cls").over(near))
        met = met.where((F.col("salts") > 1) | (F.col("before") != F.col("cls")) | (F.col("after") != F.col("cls")))
        met = met.drop("before", "after").distinct()
        return materialize(met.join(self.classes, "cls"), "line-buckets")

    def fits(self, n: Column, i: Column, m: Column, j: Column) -> Column:
        """Length filter, and positional filter: what can still follow the shared token in the common order."""
        least = F.ceil(self.percent * (n + m).cast("long") / F.lit(100 + self.percent))
        lengths = 100 * F.least(n, m).cast("long") >= self.percent * F.greatest(n, m).cast("long")
        # The token may be the second or a later one they share, so what precedes it counts too.
        return lengths & (F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= least)

    def first_pairs(self, buckets: DataFrame) -> DataFrame:
        """(a, b), a the earlier: the members of a bucket with its pivots, the earliest being one; of a salted bucket also
        the earliest of each salt and of all."""
        row = F.struct("first", "cls", "n", "place")
        heads = buckets.where("salts > 1").groupBy("token", "salt").agg(F.min(row).alias("h")).select("token", "h.*")
        sources = [(heads, ["token"], [F.col("first")])]
        for turn in range(PIVOTS):  # the earliest, then some others, each by an order of its own
            sources.append((buckets, ["token", "salt"], [F.xxhash64("cls", F.lit(turn)) if turn else F.col("first")]))
        met = []
        for df, keys, order in sources:
            over = Window.partitionBy(*keys).orderBy(*order, "cls").rowsBetween(Window.unboundedPreceding, 0)
            met.append(df.select(F.first(row).over(over).alias("p"), row.alias("q")))
        pairs = met[0]
        for more in met[1:]:
            pairs = pairs.unionByName(more)
        pairs = pairs.where("p.cls <> q.cls").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
        pairs = pairs.where(self.fits(F.col("p.n"), F.col("p.place"), F.col("q.n"), F.col("q.place")))
        return materialize(pairs.select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b")).distinct(), "first-pairs")

    def other_pairs(self, buckets: DataFrame, found: DataFrame, done: DataFrame) -> DataFrame:
        """(a, b) for classes b still in place: all earlier members of their buckets that pass the filters."""
        # Buckets with the same members are searched once: any token that two sets share will do for the filters.
        alike = [F.bit_xor(F.xxhash64("cls")).alias("p"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("q")]
        crowded = buckets.groupBy("token").agg(F.count(F.lit(1)).alias("members"), *alike).where("members > 2")
        once = crowded.groupBy("members", "p", "q").agg(F.min("token").alias("token")).select("token")
        met = materialize(buckets.join(once, "token"), "crowded")
        open_ = met.join(hinted(found, 1_000_000), met["cls"] == found["b"], "left_anti")
        left = met.select("token", F.col("first").alias("f"), F.col("cls").alias("a"), F.col("n").alias("m"), F.col("place").alias("j"))
        earlier = F.col("f") < F.col("first")
        pairs = left.join(open_, "token").where(earlier & self.fits(F.col("m"), F.col("j"), F.col("n"), F.col("place")))
        pairs = pairs.select("a", F.col("cls").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        return materialize(pairs, "other-pairs")

    def matched(self, pairs: DataFrame) -> DataFrame:
        """(b): later classes whose pair is similar, by exact intersection of the two lines' sets."""
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        chosen = ends.join(self.classes, "cls").select("first.doc_id", "first.digest", "first.line")
        chosen = chosen.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(F.collect_list("line").alias("wanted"))
        chosen = materialize(chosen, "chosen-lines")
        same = self.docs["doc_id"].eqNullSafe(F.col("d")) & (self.docs["digest"] == F.col("g"))
        texts = self.docs.join(hinted(chosen, 1_000_000), same).select("text", "wanted")
        sets = materialize(texts.mapInPandas(line_sets(self.size), "cls long, tokens array<long>").dropDuplicates(["cls"]), "line-sets")
        side = lambda c: sets.select(F.col("cls").alias(c), F.col("tokens").alias(f"tokens_{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").select("b", "tokens_a", "tokens_b")
        return materialize(met.mapInPandas(checked(self.percent), "b long").distinct(), "matched")

    def removed(self) -> DataFrame:
        """(doc_id, digest, removed): the sorted numbers, from 0, of the lines that go from each document."""
        buckets = self.buckets()
        first = self.first_pairs(buckets)
        found = self.matched(first)
        more = self.matched(self.other_pairs(buckets, found, first))
        later = materialize(found.unionByName(more).distinct(), "later")
        kept = self.classes.join(later, self.classes["cls"] == later["b"], "left_anti")
        firsts = kept.select("first.doc_id", "first.digest", "first.line", F.lit(True).alias("stays"))
        # A class that stays keeps its first line only, so all lines but those go.
        key = ["doc_id", "digest", "line"]
        marked = self.lines.select(*key, F.lit(None).cast("boolean").alias("stays")).unionByName(firsts)
        gone = marked.groupBy(*key).agg(F.max("stays").alias("stays")).where("stays is null")
        return gone.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def deduplicated_lines(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): text without its repeated lines, n_lines, n_removed, removed.

    A line goes if an earlier one, in any document, has a set of ``size``-word shingles with
    100 * |A & B| >= percent * |A | B|; a shorter line is one shingle.  Earlier means a smaller doc_id (null last), then the
    smaller text hash, then the smaller line number; an earlier line counts even if it goes itself.
    Lines without words all stay.  Rows with one doc_id and one text are one document given twice, and
    fare alike.  Null texts stay null with 0 lines.  ``removed`` counts lines from 0.  Other columns are ignored.
    """
    join = LineJoin(docs, size, percent)
    gone = materialize(join.removed().select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "removed"), "removed")
    same = join.docs["doc_id"].eqNullSafe(F.col("d")) & (join.docs["digest"] == F.col("g"))
    full = join.docs.join(hinted(gone), same, "left")
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    stay = F.array_except(F.sequence(F.lit(0), count - 1), "removed")
    cut = let(F.split("text", "\n", -1), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut)
    return full.select(
        "doc_id",
        text.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )
