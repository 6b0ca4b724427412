r"""Regular expressions with one meaning for all scripts.

Java's ``\w``, ``\s``, ``\d`` and ``\b`` differ from the Unicode definitions that policies are
written against, and change between Java releases.  So every class is spelled out here, and
policy patterns are rewritten to these classes before they reach Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common characters come first and rare ones sit behind one range test, because a class is tried
# part by part for every character of every text.
WORD = r"[0-9A-Za-z_\p{L}\p{N}]"
DIGIT = r"\p{Nd}"
RARE_SPACES = (
    r"[\x{85}-\x{3000}&&[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
)
SPACE = rf"[ \x09-\x0D\x1C-\x1F{RARE_SPACES}]"
UNPLAIN_SPACE = rf"[\x09-\x0D\x1C-\x1F{RARE_SPACES}]"
NON_SPACE = rf"[!-~[^ \x09-\x0D\x1C-\x1F{RARE_SPACES}]]"
STARTS = f"(?<!{WORD})(?={WORD})"
ENDS = f"(?<={WORD})(?!{WORD})"
BOUNDARY = f"(?:{STARTS}|{ENDS})"

_ESCAPES = {
    r"\w": WORD,
    r"\d": DIGIT,
    r"\s": SPACE,
    r"\S": NON_SPACE,
    r"\b": BOUNDARY,
}

# Letters that fold to ASCII i and s without being lower-cased to them.
_FOLDING_LETTERS = ("ı", "ſ")


def unicode_regex(pattern: str) -> str:
    r"""Rewrite ``\w \d \s \S \b`` to explicit Unicode classes."""
    return re.sub(r"\\.", lambda m: _ESCAPES.get(m.group(), m.group()), pattern, flags=re.S)


def ignore_case(pattern: str) -> str:
    return f"(?iu){pattern}"


def _bounded(words: str) -> str:
    left = f"(?<!{WORD})" if re.match(r"\w", words[0]) else f"(?<={WORD})"
    right = f"(?!{WORD})" if re.match(r"\w", words[-1]) else f"(?={WORD})"
    return left + re.sub(r"([^\w\s])", r"\\\1", words) + right


def any_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """Does lower-cased ``text`` hold one of the phrases as whole words?

    Substring search is many times cheaper than a regex, so it runs first and the regex of a phrase only sees
    rows that hold it; rows with a letter whose case folding the substring search cannot see meet all phrases.
    """
    phrases = [p for p in phrases if p]
    if not phrases:
        return F.lit(False)
    regex = text.rlike(ignore_case("(?:" + "|".join(_bounded(p) for p in phrases) + ")"))
    if not all(p.isascii() for p in phrases):
        return regex
    single = [text.contains(p.lower()) & text.rlike(ignore_case(_bounded(p))) for p in phrases]
    folds = reduce(or_, [text.contains(n) for n in _FOLDING_LETTERS])
    return reduce(or_, [*single, folds & regex])


def any_regex(text: Column, regexes: Iterable[str]) -> Column:
    r"""Does ``text`` hold a match of one of the regexes, in any letter case?

    A pattern framed by ``\b`` is tried without the frame first: that is a necessary condition and
    spares the boundary test at each character.
    """
    hits = []
    for pattern in regexes:
        full = text.rlike(ignore_case(unicode_regex(pattern)))
        framed = pattern.startswith(r"\b") and pattern.endswith(r"\b") and "|" not in pattern
        if framed:
            core = text.rlike(ignore_case(unicode_regex(pattern[2:-2])))
            full = core & full
        hits.append(full)
    return reduce(or_, hits) if hits else F.lit(False)


def count_regex(text: Column, pattern: str, gate: str | None = None) -> Column:
    """Number of matches; ``gate`` is a cheap regex that every matching row satisfies."""
    found = F.regexp_count(text, F.lit(pattern))
    return found if gate is None else F.when(text.rlike(gate), found).otherwise(F.lit(0))
