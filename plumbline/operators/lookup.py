"""Left lookup joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

# Lookup tables of at most this many rows and bytes are broadcast whole.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
MAX_HOT_KEYS = 1_000


def fits(dim: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast, by its rows and the bytes of its cells."""
    cells = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in dim.columns]
    n, total = dim.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(cells[1:], cells[0])), F.lit(0))).first()
    return n <= rows and total <= size


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    broadcast_rows: int = BROADCAST_ROWS,
    max_hot_keys: int = MAX_HOT_KEYS,
    written: bool = False,
) -> DataFrame:
    """``facts`` left-joined with ``dim``, whose ``key`` is unique.

    A small ``dim`` (rows and bytes are counted, not guessed) is broadcast.  Otherwise ``facts`` is
    written once, as three passes need it, and keys that own more than one part
    in ``max_hot_keys`` of the facts join by broadcast, as at most that many can exist, and
    only the others are shuffled.  ``written`` says that both sides are tables already.
    """
    dim = dim if written else materialize(dim, "lookup")
    if fits(dim, broadcast_rows):
        return facts.join(F.broadcast(dim), key, "left")
    facts = facts if written else materialize(facts, "facts")
    counts = materialize(facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * max_hot_keys > total).select(key)
    is_hot = facts.join(F.broadcast(hot), key, "left_semi")
    is_cold = facts.join(F.broadcast(hot), key, "left_anti")
    hot_dim = F.broadcast(dim.join(F.broadcast(hot), key, "left_semi"))
    return is_hot.join(hot_dim, key, "left").unionByName(is_cold.join(dim, key, "left"))
