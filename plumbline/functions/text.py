"""Text cleaning."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.patterns import SPACE, UNPLAIN_SPACE

_EDGE_SPACE = f"^{SPACE}+|{SPACE}+$"
# White space that is not already one plain space between words.
_UNEVEN_SPACE = f"(?:{UNPLAIN_SPACE}| (?={SPACE})){SPACE}*"

# Invisible characters dropped by each variant.
ZERO_WIDTH_ALL = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
ZERO_WIDTH_BUT_2060 = r"[\x{200B}-\x{200D}\x{FEFF}]"

# Ways to hide a dot, and what they stand for, in order of replacement.
DISGUISED_DOTS = (("[dot]", "."), ("(dot)", "."), (" d0t ", "."), (" dot ", "."))

# Words that stand for a missing cell.
NULL_WORDS = ("nan", "none", "null")


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves accented letters taken apart for this form.
    texts = values.to_pylist()
    return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts], pa.string())


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


# Characters that stay as they are under compatibility composition, whatever stands next to them.
# Not all there are: the common letters of large scripts, typographic punctuation and emoji.
STABLE_CHARACTERS = (
    r"\x{00}-\x{7F}\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
    r"\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}"
    r"\x{5D0}-\x{5EA}\x{621}-\x{64A}\x{660}-\x{669}\x{E01}-\x{E30}"
    r"\x{200B}-\x{200D}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2022}\x{2060}\x{20AC}"
    r"\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
    r"\x{FEFF}\x{1F300}-\x{1FAFF}"
)


def nfkc(c: Column) -> Column:
    """Compatibility composition.

    Rows of stable characters, nearly all rows in practice, travel to the UDF as null, which costs
    next to nothing.
    """
    unstable = ~is_ascii(c) & c.rlike(f"[^{STABLE_CHARACTERS}]")
    return F.coalesce(_nfkc(F.when(unstable, c)), c)


def strip(c: Column) -> Column:
    """Trim every kind of white space; ``trim`` alone knows plain spaces only."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def squash(c: Column) -> Column:
    """One plain space between words, none at the ends."""
    return F.trim(F.regexp_replace(c, _UNEVEN_SPACE, " "))


def drop_zero_width(c: Column, which: str = ZERO_WIDTH_ALL) -> Column:
    return F.when(is_ascii(c), c).otherwise(F.regexp_replace(c, which, ""))


def reveal_dots(c: Column) -> Column:
    for disguise, dot in DISGUISED_DOTS:
        c = F.replace(c, F.lit(disguise), F.lit(dot))
    return c


def norm_rules(c: Column) -> Column:
    """Form that the rules match against: composed, visible, single-spaced, lower-case."""
    text = nfkc(F.coalesce(c, F.lit("")))
    return reveal_dots(F.lower(squash(drop_zero_width(text))))


def norm_clean(c: Column) -> Column:
    """As ``norm_rules`` but letter case and dots stay, and U+2060 is kept."""
    text = nfkc(F.coalesce(c, F.lit("")))
    return squash(drop_zero_width(text, ZERO_WIDTH_BUT_2060))


def norm_ingest(c: Column) -> Column:
    """Light form for raw files: no composition, so no Python at all."""
    return squash(drop_zero_width(F.coalesce(c, F.lit(""))))


def blank_null_words(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(F.lower(strip(text)).isin(*NULL_WORDS), F.lit("")).otherwise(text)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
