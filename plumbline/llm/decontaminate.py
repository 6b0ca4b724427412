"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.base import ascii_lower, hinted, small, without
from plumbline.session import materialize

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLOCK_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    """Lower-cased words (ASCII letters, ASCII digits and everything beyond ASCII); null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def item_windows(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window, n): each run of ``window`` item words; a shorter item is one window."""
    words = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)))
    cut = words.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at"), window).alias("window"))
    return cut.select("item_id", "window", F.size("window").alias("n"), F.array_join("window", " ").alias("window_id"))


def anchored_windows(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct window with its rarest word in ``docs``, the necessary prefix.

    A window occurs only where all of its words do, so the prefix that an occurrence cannot miss is
    one word long.  Words are ordered by how often the documents hold them, then by code point;
    windows with a word that no document holds are gone.
    """
    distinct = windows.select("window_id", "window", "n").distinct()
    tokens = distinct.select("window_id", F.posexplode("window").alias("offset", "word"))
    vocabulary = materialize(tokens.select("word").distinct(), "benchmark-words")
    held = docs.select(F.explode(words_of(F.col(text))).alias("word"))
    held = held.join(hinted(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    rarest = F.min(F.struct("held", "word", "offset")).alias("rarest")
    prefix = tokens.join(held, "word").groupBy("window_id").agg(rarest, F.count(F.lit(1)).alias("known"))
    kept = distinct.join(prefix, "window_id").where("known = n")
    return kept.select("window_id", "window", "n", F.col("rarest.word").alias("anchor"), F.col("rarest.offset").alias("offset"))


def occurrences(docs: DataFrame, anchors: DataFrame, text: str = "text", block: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, digest, n_words, start, n, window_id): every occurrence of a window in a document.

    Besides, each document has one row with null window_id, found by the empty word at its end, so that no
    second pass is needed for documents without an occurrence.  ``digest`` tells rows of one
    doc_id with different texts apart.  Windows are broadcast; beyond ``block`` of them, or beyond the
    byte bound, they are taken in blocks, each against all documents.
    """
    n = anchors.count()
    blocks = -(-n // block) or 1
    if n and not small(anchors, block * blocks):
        blocks = max(blocks, -(-n // (block // 8)))
    source = docs.select("doc_id", F.xxhash64(text).alias("digest"), words_of(F.col(text)).alias("w"))
    ended = source.select("doc_id", "digest", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "anchor"))
    marker = anchors.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("window_id"),
        F.array().cast("array<string>").alias("window"),
        F.lit(0).alias("n"),
        F.lit("").alias("anchor"),
        F.lit(0).alias("offset"),
    )
    found = []
    for i in range(blocks):
        part = anchors if blocks == 1 else anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == i)
        part = part.unionByName(marker) if i == 0 else part
        start = F.col("at") - F.col("offset")
        fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
        same = F.slice("w", start + 1, F.col("n")) == F.col("window")
        hit = ended.join(F.broadcast(part), "anchor").where(F.col("window_id").isNull() | (fits & same))
        found.append(hit.select("doc_id", "digest", F.size("w").alias("n_words"), start.alias("start"), "n", "window_id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, item_ids (sorted as text), n_items.

    A document word is hit if it lies inside an occurrence of a window of a benchmark item.  The join is by the
    rarest word of each window; length and position bounds and the exact comparison of all window words follow.

    Null or empty texts have no words and no hits.  Null doc_ids and repeated rows keep their rows.
    A benchmark row with null item_id hits words but is in no list of items.  Empty inputs give
    zeros or no rows.  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    windows = materialize(item_windows(benchmark.select("item_id", "text"), window), "windows")
    anchors = materialize(anchored_windows(docs, windows), "anchors")
    found = materialize(occurrences(docs, anchors), "occurrences")
    key = ["doc_id", "digest"]
    before = Window.partitionBy(*key).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    marked = F.col("window_id").isNull()
    spans = found.withColumn("fresh", F.when(marked, 0).otherwise(fresh))
    totals = spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("fresh").alias("n_hit"),
        F.sum(marked.cast("int")).alias("copies"),
    )
    items = windows.select("window_id", "item_id").where("item_id is not null").distinct()
    named = found.where(~marked).select(*key, "window_id").distinct().join(items, "window_id")
    named = named.groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    named = named.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "item_ids")
    joined = totals.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    every = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return every.select("doc_id", "n_words", "n_hit", ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs; all columns stay.

    Row by row as in ``contamination``: rows with one doc_id and one text share their fate.
    """
    slim = docs.select("doc_id", "text")
    windows = materialize(item_windows(benchmark.select("item_id", "text"), window), "windows")
    anchors = materialize(anchored_windows(slim, windows), "anchors")
    found = occurrences(slim, anchors).where("window_id is not null")
    return without(docs, materialize(found.select("doc_id", "digest").distinct(), "contaminated"))
