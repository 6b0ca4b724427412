"""Byte-level BPE against the tiktoken library, and back."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import bpe, queries
from tests.llm.conftest import LONG

SF = "/root/testdata/sf0.01"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


def test_whole_table(spark, library):
    found = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(found) == len(docs)
    for doc in docs:
        ids, row = packed(library, doc["text"]), found[doc["doc_id"]]
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_hard_texts(library):
    coder = bpe.coder(PATH, PATTERN)
    rng = np.random.default_rng(7)
    parts = [" ", "  ", "\n", "\t", " \n", "'s", "don't", "a", "Wort", "été", "\xa0", " ", "12", "½", "<|endoftext|>", "日本", "\x00", "\x1c", "\U0001F600", "é", "ﷺ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(600)]
    texts += ["a" * 100_001, "ab" * 30_000, "".join(map(chr, rng.integers(97, 123, 60_000))), " " * 50_000, "\U0001F600" * 9_000, "Größe" * 9_000]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids == packed(library, text), text[:80]
        assert coder.decode(ids) == text.encode()


def test_blocks_of_a_long_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 60)
    coder = bpe.coder(PATH, PATTERN)
    texts = ["The quick brown fox, it's 12 o'clock \n\n already. " * n for n in (1, 0, 9, 1, 1, 5)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids == packed(library, text) and coder.decode(ids) == text.encode()


def test_pieces_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_LENGTH", 6)
    coder = bpe.Coder(PATH, PATTERN)
    for text in ("one two three four five six one two unheardof one seven unheardof".split()) * 3:
        assert list(coder.encode([text, text + " one"])) == [packed(library, text), packed(library, text + " one")]
        assert len(coder.known) <= 5


def test_any_bytes(library):
    table = bpe.RankTable(PATH)
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.integers(0, 256, rng.integers(1, 40)).astype("u1")) for _ in range(2000)]
    pieces += [bytes(rng.choice(list(b"aeiounst"), rng.integers(1, 60)).astype("u1")) for _ in range(2000)]
    for piece, ids in zip(pieces, table.encode(pieces), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library._core_bpe.encode_single_piece(piece)


def test_a_lower_rank_found_on_the_way(tmp_path):
    """A merge may open a pair of lower rank, which comes before the places left in its bucket."""
    tokens = [bytes([i]) for i in range(256)]
    tokens += [b"abc", b"xa", b"bc", b"cb", b"bcx", b"abca", b"ca"]
    rng = np.random.default_rng(9)
    for _ in range(20):
        rng.shuffle(tokens)
        path = tmp_path / "ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        ranks = {t: i for i, t in enumerate(tokens)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [bytes(rng.choice(list(b"abcx"), rng.integers(1, 12)).astype("u1")) for _ in range(300)]
        for piece, ids in zip(pieces, bpe.RankTable(path).encode(pieces), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own._core_bpe.encode_single_piece(piece), piece


def test_queue_order():
    queue, rng = bpe.RankQueue(300_000), np.random.default_rng(1)
    ranks = rng.choice(300_000, 500, replace=False).tolist()
    for rank in ranks:
        queue.open(rank, [rank + 1])
    assert [queue.take() for _ in ranks] == [(r, [r + 1]) for r in sorted(ranks)] and queue.take() is None


def test_odd_rows(spark, odd, empty, library):
    def coded(df):
        ids = df.withColumn("ids", bpe.encoded(F.col("text"), PATH, PATTERN))
        return ids.withColumn("back", bpe.decoded(F.col("ids"), PATH, PATTERN))

    found = coded(odd).collect()
    assert len(found) == odd.count() and found[0].asDict().keys() >= {"digest", "doc", "n", "token"}
    for row in found:
        assert bytes(row.ids) == packed(library, row.text) and bytes(row.back) == (row.text or "").encode()
    assert any(row.text == LONG for row in found) and coded(empty).collect() == []
