"""Conversation repair against a plain search over all edits, and over whole tables row by row."""

import functools
import hashlib
import itertools
import random
import zlib

import pyarrow.parquet as pq
import pytest

from plumbline.llm import conversations, queries
from plumbline.llm.conversations import audited, damaged, repaired_conversations

SF = "/root/testdata/sf0.01"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_repair(symbols):
    """(cost, audit, roles) by trying every edit at every row."""

    @functools.lru_cache(None)
    def best(i, last, inserted):
        found = [(0, "", ())] if i == len(symbols) and last in ("", "a") else []
        due = "a" if last == "u" else "u"
        if inserted < 3:
            cost, audit, roles = best(i, due, inserted + 1)
            found.append((cost + 3, "I" + audit, (due, *roles)))
        if i < len(symbols):
            cost, audit, roles = best(i + 1, last, 0)
            found.append((cost + 4, "D" + audit, (None, *roles)))
            symbol = symbols[i]
            extra = 3 if symbol.isupper() else 0
            for letter, role, price in (("K", symbol.lower(), 0), ("R", "u", 3), ("R", "a", 3)):
                if symbol != "x" and (last, role) in AFTER:
                    cost, audit, roles = best(i + 1, role, 0)
                    found.append((cost + price + extra, letter + audit, (role, *roles)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    for i in reversed(range(len(symbols) + 1)):  # from the end, so that no call goes deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def plain_table(rows):
    """The query's rows for (conv_id, turn, role, text) in plain Python."""
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = "user" if code == 4 else said[2], "" if code == 1 else said[3]
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        groups.setdefault(conv, []).extend([(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1))
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = {r[0] for r in held} - {None}
        count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        seen, symbols = set(), ""
        for i, (_, role, text) in enumerate(held):
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
            count["illegal"] += i > 0 and held[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit, roles = plain_repair(symbols)
        lines, at = [], 0
        for letter, role in zip(audit, roles, strict=True):
            name = {"u": "user", "a": "assistant"}.get(role)
            text = ""
            if letter != "I":
                _, kept, text = held[at]
                name = kept if letter == "K" else name
                at += 1
            if letter != "D":
                lines.append(f"{name}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *count.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    found = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    assert df.count() == len(found)
    return found


def test_cheapest_and_least_on_all_short_rows():
    for length in range(5):
        for row in itertools.product("suaoxSUAO", repeat=length):
            assert audited("".join(row)) == plain_repair("".join(row))[:2]


def test_long_runs():
    rng = random.Random(4)
    for _ in range(300):
        row = "".join(rng.choice("suaoxSUAO") * rng.choice((1, 1, 2, 9, 40)) for _ in range(rng.randint(1, 8)))
        assert audited(row) == plain_repair(row)[:2]
    assert audited("ua" * 70_000) == (0, "KK" * 70_000)
    cost, audit = audited("u" * 200_001)
    assert len(audit.replace("I", "")) == 200_001 and cost == 3 * 100_000 + 3


def test_a_block_boundary_inside_a_run(monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 3)
    for row in ("u" * 10, "s" + "A" * 11, "uU" * 5 + "x" * 8):
        assert audited(row) == plain_repair(row)[:2]


def test_whole_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert as_dict(queries.QUERIES["op12_conversations"](spark, SF)) == plain_table(rows)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark):
    long_text = "word " * 200_000 + "end."
    rows = [
        (None, None, None, None), (None, 1, "user", "hi."), (None, 1, "user", "hi."), (1, None, "user", "a."), (1, None, "assistant", "b."),
        (1, 5, "", "no role."), (1, 9, "User", "capital."), (2, 0, "user", None), (3, 0, "system", long_text), (3, 1, "user", long_text),
        (4, 2, "user", "same."), (4, 2, "user", "other."), (4, 2, "user", "same."), (4, -3, "assistant", " \t "), (5, 1, "user", "x!\n\n"),
    ]
    rows += [(10 + i, t, "user" if t % 2 == 0 else "assistant", f"t{t} .") for i in range(60) for t in range(i % 4)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as kind", "3 as digest", "4 as copies")
    assert as_dict(repaired_conversations(damaged(frame))) == plain_table(rows)


def test_empty_table(spark):
    assert repaired_conversations(damaged(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 7])
def test_a_conversation_over_many_tasks(spark, monkeypatch, chunk):
    """One conversation owns most rows, many of them with one text; it is ordered by range over several tasks."""
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(0, t, rng.choice(("user", "assistant")), "ok." if rng.random() < 0.3 else f"said {rng.randrange(500)}" + rng.choice(".!? ")) for t in range(700)]
    rows += [(i, t, "user", f"{t}.") for i in range(1, 40) for t in range(3)]
    assert as_dict(repaired_conversations(damaged(spark.createDataFrame(rows, SCHEMA).repartition(8)))) == plain_table(rows)
