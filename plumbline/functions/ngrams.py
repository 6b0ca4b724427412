"""Word and character n-grams, counted inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.patterns import SPACE, WORD

_TOKEN = WORD + "{2,}"

# Sorts before every character a term can hold.
_MARK = "\x01"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``; the optimizer cannot inline it into inner loops."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rest(array: Column) -> Column:
    """All but the first element."""
    return F.slice(array, F.lit(2), F.size(array))


def words(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def with_pairs(tokens: Column) -> Column:
    """An array of words, then all pairs of neighbours joined by a space."""
    pairs = F.zip_with(tokens, _rest(tokens), lambda a, b: F.concat(a, F.lit(" "), b))
    # zip_with pads the shorter side with null, so the last pair is null.
    return F.concat(tokens, F.array_compact(pairs))


def word_ngrams(text: Column) -> Column:
    """All words of a text, then all pairs of neighbours joined by a space."""
    return let(words(text), with_pairs)


def spaced_words(text: Column) -> Column:
    """What stands between white space, lower-cased."""
    return F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: F.length(w) > 0)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside space-padded words.

    A padded word no longer than n gives itself once, and no longer n-grams follow.
    """
    tokens = spaced_words(text)

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        sizes = F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length(padded))))
        return F.flatten(
            F.transform(
                sizes,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)),
                    lambda i: F.substring(padded, i, n),
                ),
            )
        )

    return F.flatten(F.transform(tokens, grams))


def tally(terms: Column) -> Column:
    """``struct<terms, counts>``: the distinct terms in order, and how often each occurs.

    Sorting makes equal terms neighbours; the length of each run is its count.  Takes time
    n log n and no shuffle, however long the array is.
    """

    def run_lengths(ordered: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(
            positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )
        ends = let(starts, lambda s: F.zip_with(
            s, F.concat(_rest(s), F.array(F.size(ordered))), lambda a, b: b - a
        ))
        return F.struct(F.array_distinct(ordered).alias("terms"), ends.alias("counts"))

    none = F.struct(
        F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("counts")
    )
    return F.when(F.size(terms) > 0, let(F.sort_array(terms), run_lengths)).otherwise(none)


def mark_right(terms: Column) -> Column:
    """Mark terms of the right-hand text; the mark sorts right behind the bare term."""
    return F.transform(terms, lambda t: F.concat(t, F.lit(_MARK)))


def is_marked(term: Column) -> Column:
    return term.endswith(_MARK)


def left_count(terms: Column, counts: Column, i: Column) -> Column:
    """Count of the same term in the left-hand text, for the marked term at position ``i``.

    If the left text has the term, it is the entry just before.
    """
    same = F.concat(F.get(terms, i - 1), F.lit(_MARK)) == F.get(terms, i)
    return F.when((i > 0) & same, F.get(counts, i - 1)).otherwise(F.lit(0))


def tally_pair(left: Column, right: Column) -> Column:
    """``tally`` of two arrays in one sorted list, terms of the right one marked."""
    return tally(F.concat(left, mark_right(right)))


def pair_sums(pair: Column) -> Column:
    """Of a ``tally_pair``: squared counts per side, those of shared terms, and the dot product."""
    terms, counts = pair["terms"], pair["counts"]
    positions = F.sequence(F.lit(0), F.size(terms) - 1)
    marked = F.filter(positions, lambda i: is_marked(F.get(terms, i)))

    def add(acc: Column, i: Column) -> Column:
        r = F.get(counts, i).cast("long")
        cl = left_count(terms, counts, i).cast("long")
        shared = F.when(cl > 0, r * r).otherwise(F.lit(0))
        return F.struct(
            (acc["rr"] + r * r).alias("rr"),
            (acc["shared_ll"] + cl * cl).alias("shared_ll"),
            (acc["shared_rr"] + shared).alias("shared_rr"),
            (acc["dot"] + cl * r).alias("dot"),
        )

    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("rr", "shared_ll", "shared_rr", "dot")])
    all_squares = F.aggregate(
        counts, F.lit(0).cast("long"), lambda acc, c: acc + c.cast("long") * c.cast("long")
    )
    sums = let(F.aggregate(marked, zero, add), lambda s: F.struct(
        (all_squares - s["rr"]).alias("ll"), *[s[c].alias(c) for c in
                                               ("rr", "shared_ll", "shared_rr", "dot")]
    ))
    return F.when(F.size(terms) > 0, sums)
