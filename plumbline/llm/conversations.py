"""Repair of conversation structure by the cheapest edits, found run by run.

A repaired conversation is empty or reads ``system? (user assistant)+``.  Each of its rows is kept, given the role that is due,
or deleted, and rows without text may be inserted.  A row is one symbol: what its role begins with, whether its
text is cut short, or that it has to go.  A symbol's effect on the cheapest cost to go, from each of four states, is a min-plus
matrix.  Equal consecutive symbols are a run, and a run is crossed by the matrix's binary powers, which are kept.
Going forward again, each row takes the least letter among its cheapest edits, so the audit is the ASCII-least one.

On Spark: rows are ordered by range, so one conversation may span many tasks; each task hands on one character a row,
and a conversation's characters meet in one row, as its audit must.  Texts travel once more, and are hashed as
they stream by in the order of turns; a conversation is never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
GONE = "x"  # the symbol of rows that have to be deleted
DELETE, REROLE, INSERT, CUT_SHORT = 4, 3, 3, 3
BLOCK = 4096
CHUNK = 1 << 20

# What is due next: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
DUE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NEVER = 1 << 60
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def insertions(state: int) -> list[tuple[int, int]]:
    """(state, cost) after no, one and two inserted rows; a third would undo the first."""
    out = [(state, 0)]
    for n in (1, 2):
        out.append((DUE[out[-1][0]][1], n * INSERT))
    return out


END: Vector = tuple(min(cost for t, cost in insertions(s) if t in (0, 3)) for s in range(4))


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of each edit that uses up a row, in ASCII order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        extra = CUT_SHORT if symbol.isupper() else 0
        if (symbol.lower(), state) in KEPT:
            found.append(("K", extra, KEPT[symbol.lower(), state]))
        found.append(("R", REROLE + extra, DUE[state][1]))
    return found


@lru_cache(maxsize=4096)
def power(symbol: str, bit: int) -> Matrix:
    """Cheapest costs from state to state over ``2 ** bit`` rows of one symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return tuple(tuple(min(half[s][k] + half[k][t] for k in range(4)) for t in range(4)) for s in range(4))
    rows = [[NEVER] * 4 for _ in range(4)]
    for s in range(4):
        for mid, cost in insertions(s):
            for _, more, t in edits(symbol, mid):
                rows[s][t] = min(rows[s][t], cost + more)
    return tuple(map(tuple, rows))


def before(matrix: Matrix, after: Vector) -> Vector:
    return tuple(min(row[t] + after[t] for t in range(4)) for row in matrix)


def advance(symbol: str, rows: int, after: Vector) -> Vector:
    """Costs to go before a run, from those after it."""
    for bit in range(rows.bit_length()):
        if rows >> bit & 1:
            after = before(power(symbol, bit), after)
    return after


def levelled(costs: Vector) -> Vector:
    low = min(costs)
    return tuple(c - low for c in costs)


@lru_cache(maxsize=1 << 16)
def one_back(symbol: str, after: Vector) -> Vector:
    return levelled(before(power(symbol, 0), after))


@lru_cache(maxsize=1 << 16)
def choice(symbol: str, state: int, after: Vector) -> tuple[str, int]:
    """The least letters among the cheapest ways over one row, and the state they lead to."""
    left = before(power(symbol, 0), after)
    letters = ""
    while True:
        ways = [(letter, t) for letter, cost, t in edits(symbol, state) if cost + after[t] == left[state]]
        role_free = DUE[state][1]
        if INSERT + left[role_free] == left[state]:
            ways.append(("I", role_free))
        letter, state_after = min(ways)
        letters, state = letters + letter, state_after
        if letter != "I":
            return letters, state


def audited(symbols: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation given by its rows' symbols."""
    runs = [(symbol, len(list(same))) for symbol, same in groupby(symbols)]
    costs, after = END, []
    for symbol, rows in reversed(runs):
        after.append(costs)
        costs = advance(symbol, rows, costs)
    letters, state = [], 0
    for (symbol, rows), costs_after in zip(runs, reversed(after), strict=True):
        while rows:
            block = min(rows, BLOCK)
            rows -= block
            stack = [levelled(advance(symbol, rows, costs_after))]
            for _ in range(block - 1):
                stack.append(one_back(symbol, stack[-1]))
            while stack:
                said, state = choice(symbol, state, stack.pop())
                letters.append(said)
    while END[state]:
        letters.append("I")
        state = DUE[state][1]
    return costs[0], "".join(letters)


def steps(symbols: str, audit: str) -> Iterator[tuple[str, str]]:
    """(letter, role that is due) of every edit but the deletion of rows that had to go."""
    state, rows = 0, iter(symbols)
    for letter in audit:
        role, due = DUE[state]
        symbol = GONE if letter == "I" else next(rows)
        if letter == "K":
            state = KEPT[symbol.lower(), state]
        elif letter != "D":
            state = due
        if letter == "I" or symbol != GONE:
            yield letter, role


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) damaged by a checksum of their key, with ``copies`` (0 to 2) of each.

    Nulls count as one space.  One in twenty each: dropped, emptied, robbed of its sentence ends, repeated, said to be the user's.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(code == 4, F.lit("user")).otherwise(said[2]).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(said[3], ".!?", "")).otherwise(said[3]).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


ORDER = ("conv", "has_turn", "turn", "role", "digest")


def marked_rows(rows: DataFrame) -> DataFrame:
    """One written row per conversation, turn, role and text, with its copies, faults and symbol.

    The first row of a role and text is told by a minimum that is combined before it is shuffled; it meets its row by the whole
    key, so neither a text nor a conversation that owns a third of all rows is a hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    keyed = rows.select(
        F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
        F.col("copies").cast("long").alias("copies"),
    )
    single = keyed.groupBy(*ORDER).agg(F.sum("copies").alias("copies"), F.min("text").alias("text"))
    firsts = keyed.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("at"))
    firsts = firsts.select("conv", "at.has_turn", "at.turn", "role", "digest", F.lit(True).alias("first"))
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    short = ~F.substring(stripped, -1, 1).isin(".", "!", "?")
    blank = stripped == ""
    first = F.coalesce(F.col("first"), F.lit(False))
    symbol = F.when(blank | ~first, F.lit(GONE)).when(short, F.upper(kind)).otherwise(kind)
    marked = single.join(firsts, list(ORDER), "left").select(
        *ORDER, "text", "copies", blank.alias("blank"), symbol.alias("symbol"), initial.alias("initial")
    )
    return materialize(marked, "marked-rows")


PART = "conv string, part long, seq long, symbols string, blank long, duplicate long, truncated long, illegal long, initials string, turns long, low long, high long"
LEGAL = ("su", "ua", "au")


def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, summed up as one row for each conversation that a task sees (more for a very long one)."""
    task, done, open_ = TaskContext.get().partitionId(), [], None
    for frame in frames:
        for row in frame.itertuples(index=False):
            if open_ is None or open_["conv"] != row.conv or len(open_["symbols"]) >= CHUNK:
                seq = 0 if open_ is None or open_["conv"] != row.conv else open_["seq"] + 1
                if open_ is not None:
                    done.append(open_)
                open_ = dict(conv=row.conv, part=task, seq=seq, symbols=bytearray(), blank=0, duplicate=0, truncated=0, illegal=0, initials=["", ""], turns=0, low=None, high=None)
            add(open_, row)
        if len(done) >= BLOCK:
            yield finished(done)
            done = []
    if open_ is not None:
        done.append(open_)
    if done:
        yield finished(done)


def add(part: dict, row) -> None:
    n = row.copies
    if not n:
        return  # a conversation of which nothing is left is still named
    part["symbols"] += (row.symbol + GONE * (n - 1)).encode()
    if row.blank:
        part["blank"] += n
    else:
        part["duplicate"] += n - (row.symbol != GONE)
        part["truncated"] += row.symbol.isupper()
    initial = row.initial or "-"
    known = part["initials"]
    part["illegal"] += n - 1 + (known[1] != "" and known[1] + initial not in LEGAL)
    part["initials"] = [known[0] or initial, initial]
    if row.has_turn and part["high"] != row.turn:
        part["turns"] += 1
        part["low"] = row.turn if part["low"] is None else part["low"]
        part["high"] = row.turn


def finished(done: list[dict]) -> pd.DataFrame:
    rows = pd.DataFrame(done)
    rows["symbols"] = [bytes(s).decode() for s in rows["symbols"]]
    rows["initials"] = ["".join(x) for x in rows["initials"]]
    return rows.astype({"low": "Int64", "high": "Int64"})


VERDICT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, symbols string"


def verdicts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A conversation's parts, in order, to its counts and its cheapest repair."""
    for frame in frames:
        rows = []
        for conv, found in zip(frame["conv"], frame["parts"], strict=True):
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            low = high = last = None
            turns, symbols = 0, []
            for p in found:
                symbols.append(p["symbols"])
                for name in total:
                    total[name] += p[name]
                if p["initials"]:
                    total["illegal"] += last is not None and last + p["initials"][0] not in LEGAL
                    last = p["initials"][1]
                if p["low"] is not None:
                    turns += p["turns"] - (p["low"] == high)
                    low, high = p["low"] if low is None else low, p["high"]
            joined = "".join(symbols)
            cost, audit = audited(joined)
            rows.append((conv, 0 if low is None else high - low + 1 - turns, *total.values(), cost, audit, joined))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERDICT.split(", ")])


REPAIR = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Digest:
    """sha256 of the repaired rows, fed row by row."""

    def __init__(self, symbols: str, audit: str):
        self.steps = steps(symbols, audit)
        self.hash, self.begun = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.begun = True

    def row(self, role: str | None, text: str | None) -> None:
        """The next row that need not go, after what is inserted before it; no row stands for the end."""
        for letter, due in self.steps:
            if letter == "I":
                self.put(due, "")
                continue
            if letter != "D":
                self.put(role if letter == "K" else due, text)
            return


def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each conversation's verdict is followed by its rows in order; the digest is made as they come."""
    names = [c.split()[0] for c in REPAIR.split(", ")]
    verdict = digest = None
    for frame in frames:
        done = []
        for row in frame.itertuples(index=False):
            if row.kind:
                digest.row(row.role, row.text)
                continue
            if digest is not None:
                digest.row(None, None)
                done.append((*verdict, digest.hash.hexdigest()))
            verdict = [getattr(row, c) for c in names[:-1]]
            verdict[1:-1] = map(int, verdict[1:-1])
            digest = Digest(row.symbols, row.audit)
        if done:
            yield pd.DataFrame(done, columns=names)
    if digest is not None:
        digest.row(None, None)
        yield pd.DataFrame([(*verdict, digest.hash.hexdigest())], columns=names)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """Counts of faults, the cheapest repair's cost and audit, and a digest of the repaired rows, per conversation.

    ``rows`` has conv_id, turn (a whole number), role, text and ``copies`` of each row; 0 keeps the conversation in the result without
    the row.  Rows stand by turn, nulls first, rows of one turn by role and then by the digest of their text.
    Nulls in role and text count as one space; null ids are one conversation.  Repeated rows are copies.  A conversation
    without rows has zeros, an empty audit and the digest of the empty text; an empty table gives no rows.  Texts may be of any length.
    Other columns are left out.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    marked = marked_rows(rows)
    narrow = marked.select(*ORDER, "copies", "blank", "symbol", "initial").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    each = narrow.drop("role", "digest").mapInPandas(parts, PART)
    whole = each.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "seq", *[c.split()[0] for c in PART.split(", ")[3:]]))).alias("parts"))
    found = materialize(whole.mapInPandas(verdicts, VERDICT), "verdicts")
    texts = marked.where((F.col("symbol") != GONE) & (F.col("copies") > 0)).select(*ORDER, "text", F.lit(1).alias("kind"))
    stream = found.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:]).drop("has_turn", "turn", "digest")
    done = stream.mapInPandas(hashed, REPAIR)
    original = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind)
    return done.select(original.alias("conv_id"), *[c.split()[0] for c in REPAIR.split(", ")[1:]])
