"""Casting, keys and alias choice for single cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import strip

# Fixed value: the RFC 4122 name space for URLs, as hex.
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def coerce_stars(c: Column, clip: bool = False) -> Column:
    """Whole stars; anything that is not a number counts as 0.

    The detour through double keeps '4.7' as 4: a direct cast to int would give null.
    """
    number = strip(c.cast("string")).try_cast("double")
    finite = F.when(~F.isnan(number), number)
    stars = F.coalesce(finite, F.lit(0.0)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(5), stars)) if clip else stars


def coerce_label(c: Column) -> Column:
    """0 or 1 out of booleans, numbers or their text; missing and unreadable count as 0."""
    word = F.lower(c.cast("string"))
    number = F.when(word == "true", 1.0).when(word == "false", 0.0)
    number = F.coalesce(number, strip(word).try_cast("double"), F.lit(0.0))
    number = F.when(F.isnan(number), F.lit(0.0)).otherwise(number)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).cast("int")


def hash_business_id(name: Column, digits: int = 12) -> Column:
    return F.substring(F.md5(F.coalesce(name, F.lit(""))), 1, digits)


def content_review_id(*parts: Column) -> Column:
    """Key made from the content, so that re-running a task yields the same key."""
    cells = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    sized = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in cells]
    return F.md5(F.concat(*sized))


def name_uuid(name: Column, namespace: str = UUID_NAMESPACE_URL) -> Column:
    """Version-5 UUID of ``name``: SHA-1 over name space and name, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    marked = F.lower(F.hex(variant.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        marked,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def review_uuid(user: Column, business: Column, ts: Column) -> Column:
    """UUID of ``user_business_ts``; an empty user, business or zero time becomes u, g or t."""
    stamp = F.when(F.coalesce(ts, F.lit(0)) != 0, ts.cast("string")).otherwise(F.lit("t"))
    return name_uuid(
        F.concat(
            or_default(user, "u"), F.lit("_"), or_default(business, "g"), F.lit("_"), stamp
        )
    )


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def first_truthy(*aliases: Column, zero_is_empty: bool = False) -> Column:
    """First alias that is neither null nor empty.

    With ``zero_is_empty`` a numeric zero is skipped too, which matters for coordinates.  A JSON
    value that is empty by nature (``[]``, ``{}``, ``false``) is always skipped.
    """
    empty = ("", "[]", "{}", "false")
    kept = []
    for c in aliases:
        keep = ~c.isin(*empty)
        if zero_is_empty:
            keep = keep & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0.0)
        kept.append(F.when(keep, c))
    return F.coalesce(*kept)


def join_categories(c: Column) -> Column:
    """A JSON list becomes ``a, b, c``; plain text stays; missing becomes empty."""
    listed = F.array_join(F.from_json(c, "array<string>"), ", ")
    return F.coalesce(F.when(c.startswith("["), listed), c, F.lit(""))


def md5_bucket(c: Column, buckets: int) -> Column:
    """Stable bucket from the first 32 bits of the digest; the same in any SQL engine."""
    return F.pmod(md5_number(c), F.lit(buckets)).cast("int")


def md5_number(c: Column) -> Column:
    head = F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, 8)
    return F.conv(head, 16, 10).cast("bigint")
