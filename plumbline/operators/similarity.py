"""TF-IDF similarity between a review and its business.

Weights follow the smooth form: raw term counts, ``idf = ln((1 + n) / (1 + df)) + 1`` and unit-length
vectors, over words and neighbouring word pairs.

Many reviews share one business text, so each distinct business text is one row of a dictionary with the
number of reviews that use it: it is cleaned, cut into words and counted once, and its terms enter the
document frequencies with that number.  Reviews carry only the 128-bit key of their text.

Terms are 64-bit numbers (``functions/counting.py``), counted over batches of rows inside tasks, so a business or
source that owns a third of all reviews costs nothing extra.  What is shuffled is one document-frequency row per
distinct term of a batch, and then either nothing (the term table and the dictionary are small enough to broadcast,
which is checked) or the postings of terms that are not hot, and reviews of businesses that are not hot.  Frequencies and
postings move packed, as binary arrays of a bucket of terms, and never as rows of their own.  A term is hot
when it holds more than one part in ``HOT_TERMS`` of all postings, so there can never be more than ``HOT_TERMS`` of
them and broadcasting those is always safe.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from plumbline.functions.counting import (
    FREQUENCIES,
    POSTINGS,
    SUMS,
    added_sums,
    frequencies,
    frequent,
    packed_frequencies,
    summed_frequencies,
    term_number,
    weighed_postings,
    weighed_sums,
    word_numbers,
)
from plumbline.functions.ngrams import let, pair_sums, tally, tally_pair, word_ngrams, words
from plumbline.operators.lookup import BROADCAST_ROWS, MAX_HOT_KEYS, lookup_join
from plumbline.session import materialize

# Term tables of at most this many rows are broadcast whole (about 100 bytes each).
BROADCAST_TERMS = 1_000_000
HOT_TERMS = 100_000
# Postings of a bucket of terms, about; a task holds a bucket.  There are fewer where tasks would be idle.
BUCKET_POSTINGS, LEAST_POSTINGS = 1 << 23, 1 << 17


def term_rows(df: DataFrame, terms: Column, *carry: str) -> DataFrame:
    """One row per row and distinct term: ``(carry..., term, cnt)``."""
    counted = df.select(*carry, tally(terms).alias("t"))
    rows = counted.select(*carry, F.col("t.counts").alias("_counts"), F.posexplode("t.terms"))
    return rows.select(*carry, F.col("col").alias("term"), F.get("_counts", "pos").alias("cnt"))


def ngram_counts(df: DataFrame, text: str, key: str = "review_id") -> DataFrame:
    """One row per document and word n-gram: ``(key, term, cnt)``."""
    return term_rows(df, word_ngrams(F.col(text)), key)


def text_key(*texts: str) -> Column:
    """16 bytes that stand for the texts of a row; null is not the empty text."""
    parts = [F.col(t).cast("string") for t in texts]
    named = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat(*named)))


def dictionary(df: DataFrame, *texts: str) -> DataFrame:
    """``(texts..., uses)``: each distinct combination of the texts once, and in how many rows it stands.

    Copies collapse in the task that reads them, so a text that stands in a third of all rows is moved
    once a task.
    """
    return df.groupBy(*texts).agg(F.count(F.lit(1)).alias("uses"))


def _frequencies(*term_sets: DataFrame) -> DataFrame:
    """``(term, df)`` over rows ``(terms, uses)``: a set of distinct terms and how many documents it stands for."""
    rows = [t.select(F.explode(F.array_distinct("terms")).alias("term"), "uses") for t in term_sets]
    together = rows[0]
    for more in rows[1:]:
        together = together.unionByName(more)
    return together.groupBy("term").agg(F.sum("uses").alias("df"))


def doc_freq(df: DataFrame, *texts: str, shared: tuple[str, ...] = ()) -> DataFrame:
    """In how many documents a term occurs, when each text column of each row is one document.

    Columns named in ``shared`` hold few distinct texts; each of these is cut into terms once.
    """
    one = F.lit(1).cast("long").alias("uses")
    own = [df.select(word_ngrams(F.col(t)).alias("terms"), one) for t in texts]
    of_shared = [dictionary(df, t).select(word_ngrams(F.col(t)).alias("terms"), "uses") for t in shared]
    return _frequencies(*own, *of_shared)


def smooth_idf(df: Column, n_docs: Column | int) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def idf_weights(df: DataFrame, *texts: str, shared: tuple[str, ...] = ()) -> DataFrame:
    """``(term, df, idf)`` over all documents of the text columns."""
    n_docs = df.agg((F.count(F.lit(1)) * (len(texts) + len(shared))).alias("n"))
    frequencies = doc_freq(df, *texts, shared=shared)
    return frequencies.withColumn("idf", smooth_idf(F.col("df"), n_docs.scalar()))


def corpus_cosine(
    df: DataFrame,
    left: str,
    right: str,
    key: str = "review_id",
    terms: DataFrame | None = None,
    n_docs: int | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
    hot_terms: int = HOT_TERMS,
    broadcast_texts: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(key, cosine_to_business)``, with idf fitted on both columns of all rows.

    ``key`` must tell rows apart: postings of equal keys count as one document.  ``right`` is the column
    whose texts many rows share.

    Give ``terms`` and ``n_docs`` to score against a frozen term table.  Rows in which neither text
    has a term are absent; with terms in one text only the cosine is 0.
    """
    table = materialize(
        df.select(
            F.col(key),
            words(F.col(left)).alias("_words"),
            text_key(right).alias("_biz"),
            F.col(right).alias("_right"),
        ),
        "cleaned",
    )
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    texts = dictionary(table, "_right").select(
        text_key("_right").alias("_biz"), "uses", word_ngrams(F.col("_right")).alias("_terms")
    ).withColumn("_holds", has("_terms"))
    scored = dictionary_cosine(
        table.drop("_right"), materialize(texts, "dictionary"), key, terms, n_docs,
        broadcast_terms, hot_terms, broadcast_texts,
        carry={"_any": has("_words") | F.coalesce("_holds", F.lit(False))},
    )
    return scored.filter("_any").drop("_any")


def dictionary_cosine(
    reviews: DataFrame,
    texts: DataFrame,
    key: str,
    terms: DataFrame | None = None,
    n_docs: int | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
    hot_terms: int = HOT_TERMS,
    broadcast_texts: int = BROADCAST_ROWS,
    max_hot_texts: int = MAX_HOT_KEYS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``(key, carry..., cosine_to_business)`` for every row of ``reviews``.

    ``reviews`` is a written table with ``key``, ``_words`` and ``_biz``; ``texts`` is the written
    dictionary ``(_biz, uses, _terms, ...)``.  ``carry`` names expressions over a review and its
    dictionary row that are returned too.

    Words of a review move at most once, to their dictionary row, and only if the dictionary is too
    large to broadcast and the business is not hot.
    """
    carry = carry or {}
    own = reviews.select(word_numbers(F.col("_words")).alias("_ids"), F.lit(1).cast("long").alias("uses"))
    theirs = F.transform("_terms", term_number)
    buckets = _buckets(reviews)
    if terms is None:
        shared = texts.select(theirs.alias("_ids"), "uses")
        counted = [
            rows.mapInArrow(packed_frequencies(frequencies(pairs), buckets), FREQUENCIES)
            for rows, pairs in ((own, True), (shared, False))
        ]
        fitted, least = counted[0].unionByName(counted[1]), 2
        n_docs = 2 * (texts.agg(F.sum("uses")).first()[0] or 0)
    elif n_docs is None:
        raise ValueError("a frozen term table needs the number of documents it was fitted on")
    else:
        numbers = terms.select(term_number(F.col("term")).alias("id"), F.col("df").cast("long").alias("df"))
        fitted, least = numbers.mapInArrow(packed_frequencies(iter, buckets), FREQUENCIES), 0
    weights = materialize(fitted.groupBy("bucket").applyInArrow(summed_frequencies(least), FREQUENCIES), "term-table")

    table = TermWeights.of(weights, n_docs, broadcast_terms, hot_terms, buckets)
    none = F.lit(None).cast("array<bigint>").alias("_other")
    norms = table.sums(texts.select("_biz", theirs.alias("_ids"), none), "_biz", False)
    dim = texts.withColumn("_other", theirs).drop("uses", "_terms").join(
        norms.select("_biz", F.col("norm").alias("_rr")), "_biz", "left")
    dim = materialize(dim, "numbered-dictionary")

    joined = lookup_join(reviews, dim, "_biz", broadcast_texts, max_hot_texts, written=True)
    rows = joined.select(
        key, "_rr", *[c.alias(name) for name, c in carry.items()], word_numbers(F.col("_words")).alias("_ids"), "_other")
    sums = table.sums(rows, key, True, "_rr", *carry)
    size = F.sqrt("norm") * F.sqrt(F.coalesce("_rr", F.lit(0.0)))
    cosine = F.when(size > 0, F.col("shared") / size).otherwise(F.lit(0.0))
    return sums.select(key, *carry, cosine.alias("cosine_to_business"))


def _buckets(reviews: DataFrame) -> int:
    """How many buckets the terms of rows with ``_words`` are dealt to."""
    postings = 2 * (reviews.agg(F.sum(F.size("_words"))).first()[0] or 0)
    cores = reviews.sparkSession.sparkContext.defaultParallelism
    return max(1 + postings // BUCKET_POSTINGS, min(2 * cores, 1 + postings // LEAST_POSTINGS))


@dataclass
class TermWeights:
    """Squared idf of terms: at hand for the whole table if it is small, else for hot terms, the rest bucket by bucket.

    What is left of a part of rows is packed, a row for a bucket, and meets the frequencies of its bucket in one task; the
    sums of each row come back packed too.
    """

    terms: DataFrame
    n_docs: int
    known: Broadcast
    whole: bool
    buckets: int

    @classmethod
    def of(cls, terms: DataFrame, n_docs: int, broadcast_terms: int, hot_terms: int, buckets: int) -> "TermWeights":
        """``terms`` is a written table of ``FREQUENCIES``; what reaches the driver is at most one of the two bounds."""
        n, total = terms.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        whole = n <= broadcast_terms
        hot = terms.mapInArrow(frequent(0 if whole else -(-total // hot_terms)), "id long, df long").toPandas()
        weights = (np.log((n_docs + 1.0) / (hot["df"].to_numpy(float) + 1.0)) + 1.0) ** 2
        context = terms.sparkSession.sparkContext
        return cls(terms, n_docs, context.broadcast((hot["id"].to_numpy(np.int64), weights)), whole, buckets)

    def sums(self, rows: DataFrame, key: str, pairs: bool, *carry: str) -> DataFrame:
        """``(key, shared, norm, carry...)``: weighed sums over the terms of each key; ``carry`` is equal in rows of a key.

        ``rows`` holds ``_ids``, with ``pairs`` words in order, else terms, and ``_other``, terms to be met.
        """
        once = (math.log((self.n_docs + 1.0) / 2.0) + 1.0) ** 2 if self.whole else None
        kept = rows.select(key, *carry).schema
        own = StructType([StructField(f.name, f.dataType) for f in kept]).add("shared", "double").add("norm", "double")
        schema = StructType(list(own.fields))
        for name, kind in POSTINGS.items():
            schema = schema.add(name, kind)
        run = weighed_sums(pairs, [key, *carry], self.known, once, to_arrow_schema(schema), self.buckets)
        found = rows.mapInArrow(run, schema)
        if self.whole:
            found = found.select(*own.names)
        else:  # read twice, and counting costs more than writing
            found = materialize(found, "postings")
            postings = found.filter("bucket is not null").select("part", "bucket", "ids", "times", "rows", "cnt", "at", "met")
            sums = postings.groupBy("bucket").cogroup(self.terms.select("bucket", "ids", "df").groupBy("bucket"))
            sums = sums.applyInArrow(weighed_postings(self.n_docs), SUMS)
            counted = found.filter("bucket is null").select("part", "row", *own.names)
            both = counted.groupBy("part").cogroup(sums.groupBy("part"))
            found = both.applyInArrow(added_sums(to_arrow_schema(own)), own)
        return found.groupBy(key).agg(
            F.sum("shared").alias("shared"), F.sum("norm").alias("norm"), *[F.max(c).alias(c) for c in carry])


def pair_cosine(left: Column, right: Column) -> Column:
    """Cosine with idf fitted on just these two texts: a shared term weighs 1, any other
    ``ln(3/2) + 1``.  Row-local: no shuffle, so it also serves streams."""
    lone = (F.log(F.lit(1.5)) + 1.0) * (F.log(F.lit(1.5)) + 1.0)

    def finish(s: Column) -> Column:
        ll = (s["ll"] - s["shared_ll"]) * lone + s["shared_ll"]
        rr = (s["rr"] - s["shared_rr"]) * lone + s["shared_rr"]
        norm = F.sqrt(ll) * F.sqrt(rr)
        return F.when(norm > 0, s["dot"] / norm).otherwise(F.lit(0.0))

    pair = tally_pair(word_ngrams(left), word_ngrams(right))
    return F.coalesce(let(let(pair, pair_sums), finish), F.lit(0.0))
