"""Policies of any size: phrases as a table, met by words.

``rules.any_phrase`` tries every phrase on every text, which suits a policy of a few dozen.  Here each
phrase is keyed by the one of its pairs of neighbouring words that fewest texts hold (a phrase of one word by
that word), so a text meets only phrases whose rarest pair it has, however frequent their words are.  An
exact test of the whole phrase follows, with the meaning of ``any_phrase``: whole words, any letter case.

Keys are 64-bit numbers; two of one number only give candidates in vain.  The dictionary has one row a key and is
joined by ``lookup_join``: broadcast if its counted rows and bytes allow, else shuffled with frequent keys split off.
Only row numbers and keys move, and if the policy's keys may be broadcast only those of the policy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ngrams import let
from plumbline.functions.patterns import WORD, any_phrase, ignore_case
from plumbline.functions.text import is_ascii, norm_rules
from plumbline.operators.lookup import BROADCAST_ROWS, MAX_HOT_KEYS, fits, lookup_join
from plumbline.session import materialize

PHRASE_KINDS = ("keyword", "cue", "off_topic")
# Put where a word begins and ends, so that a phrase of whole words is a substring.
BEGIN, END = "\x01", "\x02"
SHARP_S = "ƻ"
# Where upper and lower case of text functions and of regular expressions may follow different releases of Unicode, and a
# mark (U+0345) whose upper case is a letter.
UNEVEN_LETTERS = r"[\x{19B}\x{264}\x{345}\x{1C80}-\x{1C8F}\x{2C2F}\x{2C5F}\x{A7C0}-\x{A7FF}\x{10000}-\x{1EFFF}]"
# Phrases without any word cannot be keyed and are tried on every text.
MAX_WORDLESS = 200


def folded(text: Column) -> Column:
    """A text in which letters are equal whenever a match in any letter case could make them equal.

    Letters such as long s only meet their fellows in upper case, sharp s only in lower case.  The empty
    text between both keeps the optimizer from taking one of them for idle.
    """
    return F.upper(F.concat(F.lower(F.translate(text, "İ", "i")), F.lit("")))


def folded_words(text: Column) -> Column:
    """Distinct words of the folded text."""
    return F.array_distinct(_in_order(text))


def _in_order(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD + "+"), F.lit(0))


def _pair_numbers(words: Column) -> Column:
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.array_compact(pairs)


def text_keys(text: Column, lone: bool) -> Column:
    """Distinct numbers of the pairs of neighbouring words of a text and, with ``lone``, of its words."""
    numbers = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    return let(_in_order(text), lambda w: F.array_distinct(
        F.concat(_pair_numbers(w), numbers(w)) if lone else _pair_numbers(w)))


def phrase_keys(pattern: Column) -> Column:
    """Numbers of a phrase's pairs of neighbouring words, or of its only word."""
    return let(_in_order(pattern), lambda w: F.when(
        F.size(w) > 1, F.array_distinct(_pair_numbers(w))).otherwise(F.transform(w, lambda x: F.xxhash64(x))))


def _single(text: Column) -> Column:
    """Sharp s, which folding would make two letters, as one letter without case that stands for it."""
    return F.translate(text, "ßẞ", SHARP_S * 2)


def is_plain(text: Column) -> Column:
    """Folding has put one character in each one's place, none of them turning into a letter, so equal folded is equal in any letter case."""
    taken = text.contains(BEGIN) | text.contains(END)
    even = (F.length(folded(_single(text))) == F.length(text)) & ~text.contains(SHARP_S) & ~text.rlike(UNEVEN_LETTERS)
    return ~taken & (is_ascii(text) | even)


def marked_words(text: Column) -> Column:
    """The folded text with marks where words begin and end."""
    return F.regexp_replace(folded(_single(text)), f"({WORD}+)", f"{BEGIN}$1{END}")


def marked_phrase(pattern: Column) -> Column:
    """What a marked text holds if and only if it holds the phrase: before and behind other characters stands a word."""
    before = F.when(pattern.rlike(f"^{WORD}"), F.lit("")).otherwise(F.lit(END))
    after = F.when(pattern.rlike(f"{WORD}$"), F.lit("")).otherwise(F.lit(BEGIN))
    return F.concat(before, marked_words(pattern), after)


def whole_words(pattern: Column) -> Column:
    """The regular expression of a phrase that begins and ends where a word does."""
    before = F.when(pattern.rlike(f"^{WORD}"), f"(?<!{WORD})").otherwise(f"(?<={WORD})")
    after = F.when(pattern.rlike(f"{WORD}$"), f"(?!{WORD})").otherwise(f"(?={WORD})")
    quoted = F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(ignore_case("")), before, F.lit("\\Q"), quoted, F.lit("\\E"), after)


def phrase_rows(policy: DataFrame) -> DataFrame:
    """Distinct ``(kind, category, pattern)`` of a policy table that are phrases; null and empty ones go."""
    rows = policy.filter(F.col("kind").isin(*PHRASE_KINDS) & (F.length("pattern") > 0))
    return rows.select("kind", F.lower("category").alias("category"), "pattern").distinct()


def phrase_dictionary(
    held: DataFrame, patterns: DataFrame, keys: Callable[[Column], Column] = folded_words
) -> DataFrame:
    """``(word, patterns)``: each phrase under the one of its ``keys`` that fewest rows of ``held`` have.

    With each phrase comes whether it is plain, and its marked form if it is, else its folded one.
    ``held`` has one row ``(row, word)`` per row and distinct key.  Ties go to the first key.
    """
    by_word = patterns.select("pattern", F.explode(keys(F.col("pattern"))).alias("word"))
    # Combined in the task that reads the words, so a frequent word sends one row a task.
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    rated = by_word.join(counts, "word", "left")
    rarest = rated.groupBy("pattern").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "word")).alias("best")
    )
    found = rarest.filter("best.texts > 0")  # a phrase whose word no text holds is nowhere
    form = F.when(F.col("plain"), marked_phrase(F.col("pattern"))).otherwise(folded(F.col("pattern")))
    formed = found.withColumn("plain", is_plain(F.col("pattern"))).withColumn("form", form)
    return formed.groupBy(F.col("best.word").alias("word")).agg(
        F.collect_list(F.struct("pattern", "plain", "form")).alias("patterns")
    )


def phrase_matches(
    table: DataFrame,
    policy: DataFrame,
    text: str,
    key: str,
    broadcast_words: int = BROADCAST_ROWS,
    max_hot_words: int = MAX_HOT_KEYS,
) -> DataFrame:
    """``(key, matched)`` of the rows that hold a phrase: the sorted distinct patterns in ``text``.

    ``table`` is written and ``key`` tells its rows apart.  Null and empty texts hold nothing; repeated
    phrases count once.  Other columns are ignored.
    """
    patterns = materialize(phrase_rows(policy).select("pattern").distinct(), "phrases")
    wordless = patterns.filter(F.size(folded_words(F.col("pattern"))) == 0).limit(MAX_WORDLESS + 1).collect()
    if len(wordless) > MAX_WORDLESS:
        raise ValueError(f"more than {MAX_WORDLESS} phrases hold no word")

    numbers = materialize(patterns.select(F.explode(phrase_keys(F.col("pattern"))).alias("word")).distinct(), "phrase-keys")
    lone = not patterns.filter(F.size(_in_order(F.col("pattern"))) == 1).isEmpty()
    held = table.select(key, F.explode(text_keys(F.col(text), lone)).alias("word"))
    if fits(numbers, broadcast_words):
        held = held.join(F.broadcast(numbers), "word", "left_semi")
    held = materialize(held.select(key, "word"), "held-keys")
    words = materialize(phrase_dictionary(held, patterns, phrase_keys), "phrase-words")
    met = lookup_join(held, words, "word", broadcast_words, max_hot_words, written=True)
    # A phrase has one key, so it comes once a row; a row has at most every phrase of the policy.
    candidates = met.filter("patterns is not null").groupBy(key).agg(
        F.flatten(F.collect_list("patterns")).alias("_patterns")
    )
    whole = table.select(key, text).join(candidates, key)

    def holds(t: Column, p: Column) -> Column:
        """Substrings decide between plain texts and phrases; else they spare regular expressions, which are compiled one by one."""
        bare = F.when(p["plain"], F.replace(F.translate(p["form"], BEGIN + END, ""), F.lit(SHARP_S), F.lit("SS"))).otherwise(p["form"])
        full = F.when(t["plain"], folded(F.col(text))).otherwise(t["form"])
        tried = F.contains(full, bare) & F.rlike(F.col(text), whole_words(p["pattern"]))
        return F.when(t["plain"] & p["plain"], F.contains(t["form"], p["form"])).otherwise(tried)

    forms = let(is_plain(F.col(text)), lambda plain: F.struct(
        plain.alias("plain"), F.when(plain, marked_words(F.col(text))).otherwise(folded(F.col(text))).alias("form")))
    exact = let(forms, lambda t: F.filter("_patterns", lambda p: holds(t, p)))
    found = whole.select(key, F.transform(exact, lambda p: p["pattern"]).alias("matched"))
    found = materialize(found, "matched")  # a filter on what was found would find it twice
    if wordless:
        tests = [F.when(any_phrase(F.col(text), [r[0]]), F.lit(r[0])) for r in wordless]
        found = found.unionByName(table.select(key, F.array_compact(F.array(*tests)).alias("matched")))
        found = found.groupBy(key).agg(F.flatten(F.collect_list("matched")).alias("matched"))
    return found.filter(F.size("matched") > 0).select(key, F.sort_array("matched").alias("matched"))


def phrase_counts(
    df: DataFrame,
    policy: DataFrame,
    keep: tuple[str, ...] = ("review_id",),
    broadcast_words: int = BROADCAST_ROWS,
) -> DataFrame:
    """``keep`` and, per review, how many phrases of each kind its text holds.

    ``ads_phrases`` counts keywords, ``rant_phrases`` cues, and ``offtopic_phrases`` those words foreign to a
    category that the business has; a phrase foreign to two such categories counts once.  A label of the
    rule set is a count above 0.  Every review comes out once, without matches with zeros.
    """
    table = materialize(
        df.select(
            *keep,
            norm_rules(F.col("review_text")).alias("_text"),
            norm_rules(F.col("biz_cats")).alias("_cats"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "cleaned",
    )
    rows = materialize(phrase_rows(policy), "policy")
    matched = phrase_matches(table, rows, "_text", "_row", broadcast_words)
    hits = matched.select("_row", F.explode("matched").alias("pattern"))
    # A row a pattern: the kinds it has, and the categories it is foreign to.
    kinds = rows.groupBy("pattern").agg(
        F.collect_set("kind").alias("kinds"),
        F.collect_set(F.when(F.col("kind") == "off_topic", F.col("category"))).alias("foreign"),
    )
    named = lookup_join(materialize(hits, "hits"), materialize(kinds, "kinds"), "pattern", written=True)
    per_row = named.groupBy("_row").agg(
        F.sum(F.array_contains("kinds", "keyword").cast("long")).alias("ads_phrases"),
        F.sum(F.array_contains("kinds", "cue").cast("long")).alias("rant_phrases"),
        F.collect_list(F.when(F.size("foreign") > 0, F.col("foreign"))).alias("_foreign"),
    )
    off = F.filter("_foreign", lambda ks: F.exists(ks, lambda k: F.contains("_cats", k)))
    zero = F.lit(0).cast("long")
    return table.drop("_text").join(per_row, "_row", "left").select(
        *keep,
        F.coalesce("ads_phrases", zero).alias("ads_phrases"),
        F.coalesce("rant_phrases", zero).alias("rant_phrases"),
        F.coalesce(F.size(off).cast("long"), zero).alias("offtopic_phrases"),
    )
