"""Token ids in framed binary records, with an offset index beside each file.

A shard is a run of records, one per document in ascending order of id:

    uint64  payload length, little-endian
    uint32  masked crc32 of those eight bytes
    payload 1 byte: bytes per token id (2 or 4), plus 128 if the document's id is null
            int64 document id
            token ids, little-endian
    uint32  masked crc32 of the payload

and its index has one entry of three uint64 per record: the record's byte offset, its first token's place in the shard, its
number of tokens.  Masking rotates a checksum and adds a constant, so that a checksum of data that hold
checksums is not degenerate.  A reader may fetch any record with one seek.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.base import MIX, batches, hashes, scramble
from plumbline.session import fresh_path, materialize

MASK_DELTA = 0xA282EAD8
CACHED_PIECES = 500_000
BATCH_CHARS = 500_000
BULK = 1_000
LINE_END = re.compile(r"\n|\s$")
CUT = re.compile(r"[!-~] ")
READ_BYTES = 8 << 20
SHARDS = "shard long, path string, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


class Encoder:
    """Encodes texts with a tokenizer file; pieces seen before come from a bounded cache.

    Byte-level pre-tokenization always starts a new run at a space that follows a character other than white
    space, so a text's ids are those of its pieces between such spaces.  A piece is named by what follows its space, or
    by a tuple if it has none.
    """

    def __init__(self, path: str, piecewise: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piecewise = piecewise
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.reset()

    def reset(self) -> None:
        self.codes: dict[str | tuple[str], int] = {}  # pieces of the batch at hand
        self.count = 0
        self.known = np.zeros(0, np.int64)  # sorted hashes of kept pieces, and the code of each
        self.known_codes = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.begins = np.zeros(1 << 18, np.int64)
        self.sizes = np.zeros(1 << 18, np.int64)
        self.used = 0

    def keep(self, pieces: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        base, n = self.count, len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + n > len(self.sizes):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[base : base + n] = sizes
        self.begins[base : base + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.codes.update(zip(pieces, range(base, base + n), strict=True))
        self.count += n

    def code_of(self, hashed: np.ndarray) -> np.ndarray:
        """Codes of kept pieces by their hash, -1 for others."""
        if not len(self.known):
            return np.full(len(hashed), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return np.where(self.known[at] == hashed, self.known_codes[at], -1)

    def gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in a row, end of each piece)."""
        sizes = self.sizes[code]
        ends = np.cumsum(sizes)
        within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.ids[np.repeat(self.begins[code], sizes) + within], ends

    def coded(self, pieces: list) -> None:
        """Encode pieces, many to a text: a line break between two pieces is a run of its own."""
        texts = [p[0] if type(p) is tuple else " " + p for p in pieces]
        bulk = [i for i, t in enumerate(texts) if t.strip() and not LINE_END.search(t)] if len(self.newline) == 1 else []
        left = set(range(len(pieces))).difference(bulk)
        groups = [bulk[i : i + BULK] for i in range(0, len(bulk), BULK)]
        joined = ["\n".join([texts[i] for i in g]) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            cut = np.flatnonzero(ids == self.newline[0])
            if len(cut) != len(group) - 1:
                left.update(group)
                continue
            sizes = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            self.keep([pieces[i] for i in group], np.delete(ids, cut), sizes)
        rest = sorted(left)
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            self.keep([pieces[i]], np.array(found.ids, np.uint32), np.array([len(found.ids)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.piecewise:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(texts) == 1 and len(texts[0]) > BATCH_CHARS:
            return [np.concatenate([self.gathered([part])[0] for part in parts(texts[0], BATCH_CHARS)])]
        return self.gathered(texts)

    def gathered(self, texts: list[str]) -> list[np.ndarray]:
        raw = [x.encode() for x in texts]
        data = b"".join(raw)
        starts = np.cumsum([0, *map(len, raw)])
        begin, first = piece_starts(np.frombuffer(data, np.uint8), starts)
        end = np.append(begin[1:], len(data))
        head = begin + ~first
        place, distinct = pd.factorize(piece_hashes(data, head, end, first))
        sample = np.empty(len(distinct), np.int64)
        sample[place[::-1]] = np.arange(len(place))[::-1]
        code = self.code_of(distinct)
        kept, used = self.count, self.used
        missing = np.flatnonzero(code < 0)
        if kept > CACHED_PIECES and len(missing) * 2 > len(distinct):
            self.reset()  # the texts have changed
            missing, kept, used = np.arange(len(distinct)), 0, 0
        if len(missing):
            at = sample[missing]
            cut = [data[i:j].decode() for i, j in zip(head[at].tolist(), end[at].tolist(), strict=True)]
            pieces = [(x,) if alone else x for x, alone in zip(cut, first[at].tolist(), strict=True)]
            self.codes.clear()
            self.coded(list(set(pieces)))
            code[missing] = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
            if kept <= CACHED_PIECES:
                every, codes = np.append(self.known, distinct[missing]), np.append(self.known_codes, code[missing])
                order = np.argsort(every)
                self.known, self.known_codes = every[order], codes[order]
        ids, ends = self.gather(code[place])
        if kept > CACHED_PIECES:  # full: what this batch taught is forgotten again
            self.count, self.used = kept, used
        self.codes.clear()
        bounds = np.concatenate([[0], ends])[np.searchsorted(begin, starts)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def parts(text: str, size: int) -> Iterator[str]:
    """A long text in parts of ``size`` characters or a little more, so that no array grows with it.

    Cuts stand before a space that follows a visible ASCII character, where a piece begins anyway.
    """
    begin = 0
    while len(text) - begin > size and (cut := CUT.search(text, begin + size - 1)):
        yield text[begin : cut.start() + 1]
        begin = cut.start() + 1
    yield text[begin:]


def piece_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each piece, whether its first character is its own).  ``starts`` has the place of each text, and the end.

    A space opens a piece unless it begins its text or follows white space, ASCII controls counted as such; it is then left
    out of the piece's name.  A stop or comma between a letter and white space is a piece of its own, and so is a
    single line break between visible characters, for these are runs of their own in any text.
    """
    mark = np.zeros(len(data) + 1, bool)
    space = np.flatnonzero(data == 32)
    one, two, three = (data[np.maximum(space - i, 0)] for i in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    wide |= ((three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80)) & (one == 0x80)
    mark[space[(one > 32) & ~wide]] = True
    opens = np.zeros(len(data) + 1, bool)
    opens[starts] = True
    at = np.flatnonzero((data == 44) | (data == 46))
    after = np.where(opens[at + 1], 32, np.append(data, 32)[at + 1])
    low = data[np.maximum(at - 1, 0)] | 32
    plain = (low >= 97) & (low <= 122) & (data[np.maximum(at - 1, 0)] < 128)
    blank = (after == 32) | (after >= 9) & (after <= 13)
    opens[at[~opens[at] & (plain | latin(data, at - 1)) & blank]] = True
    at = np.flatnonzero(data == 10)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~opens[at] & ~opens[at + 1]]
    visible = lambda i: (data[i] > 32) & (data[i] < 127)
    at = at[(visible(at - 1) | latin(data, at - 1)) & (visible(at + 1) | (data[at + 1] == 0xC3))]
    opens[at] = opens[at + 1] = True
    begin = np.flatnonzero((mark | opens)[:-1])
    return begin, opens[begin]


def latin(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at ``last`` is one of the letters from U+00C0 to U+00FF."""
    one, two = data[np.maximum(last, 0)], data[np.maximum(last - 1, 0)]
    return (last > 0) & (two == 0xC3) & (one >= 0x80) & (one <= 0xBF) & (one != 0x97) & (one != 0xB7)


FACTOR = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2 ** 64
BYTE_VALUES = scramble(np.arange(1, 257, dtype=np.uint64) * MIX[0])
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of FACTOR and of its inverse up to ``n``."""
    if len(POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            POWERS[i] = np.cumprod(full)
    return POWERS


def piece_hashes(data: bytes, head: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch head:end, told apart by whether it begins a text.

    A polynomial over byte values from running sums; long stretches, where such polynomials are weak, are hashed as
    a whole.
    """
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
    size = (end - head).astype(np.uint64)
    h = (sums[end] - sums[head]) * down[head]
    long = np.flatnonzero(size > 64)
    if len(long):
        h[long] = hashes([data[i:j] for i, j in zip(head[long].tolist(), end[long].tolist(), strict=True)])
    return scramble(h + MIX[1] * size + MIX[2] * first).view(np.int64)


ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, piecewise: bool) -> Encoder:
    """One encoder per Python worker and tokenizer; its cache outlives tasks."""
    if (path, piecewise) not in ENCODERS:
        ENCODERS[path, piecewise] = Encoder(path, piecewise)
    return ENCODERS[path, piecewise]


def is_byte_level(path: str) -> bool:
    """Whether the file's pre-tokenizer is plain byte level, for which pieces may be encoded alone."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    spaced = any(" " in t for t in added) or any(t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spaced


def shard_writer(folder: str, tokenizer: str, piecewise: bool, end_id: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        final, mine = f"{root}/{shard:08d}", f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
        encode = encoder(tokenizer, piecewise).encode
        out, index, offset, n_docs, n_tokens = None, None, 0, 0, 0
        for frame in batches(frames, 2_000, BATCH_CHARS):
            if out is None:
                out, index = store.open_output_stream(mine + ".rec"), store.open_output_stream(mine + ".idx")
            chunk, entries = [], []
            for doc, ids in zip(frame["doc_id"], encode([x or "" for x in frame["text"]]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                width = 2 if int(ids.max()) < 1 << 16 else 4
                absent = doc is None or doc != doc
                head = struct.pack("<Bq", width | 128 * absent, 0 if absent else int(doc))
                record = framed(head + ids.astype(f"<u{width}").tobytes())
                chunk.append(record)
                entries.append(struct.pack("<3Q", offset, n_tokens, len(ids)))
                offset += len(record)
                n_tokens += len(ids)
            n_docs += len(frame)
            out.write(b"".join(chunk))
            index.write(b"".join(entries))
        if out is not None:
            out.close()
            index.close()
            for kind in (".idx", ".rec"):  # a second attempt writes the same bytes
                store.move(mine + kind, final + kind)
            yield pd.DataFrame({"shard": [shard], "path": [f"{shard:08d}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards under ``folder``; returns the written manifest.

    Shards are ranges of (doc_id, text hash, row), so one id that owns many rows is still split, and their numbers ascend with
    the ids, null ids first.  A null text is an empty one: its record holds the end id alone.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    order = ["doc_id", "digest", "row"]
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    write = shard_writer(folder, tokenizer, is_byte_level(tokenizer), end_id)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return materialize(dealt.mapInPandas(write, SHARDS), "manifest")


def numbered(manifest: DataFrame) -> DataFrame:
    """The manifest with the tokens of all earlier shards: one narrow row per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def records_of(store, path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record, checksums verified, from reads of bounded size."""
    with store.open_input_stream(path) as stream:
        held, at = b"", 0
        while True:
            more = stream.read(READ_BYTES)
            held += more
            begin = 0
            while len(held) - begin >= 12:
                length, crc = struct.unpack_from("<QI", held, begin)
                if masked(held[begin : begin + 8]) != crc:
                    raise ValueError(f"{path}: damaged length at byte {at + begin}")
                if len(held) - begin < 16 + length:
                    break
                payload = held[begin + 12 : begin + 12 + length]
                if masked(payload) != struct.unpack_from("<I", held, begin + 12 + length)[0]:
                    raise ValueError(f"{path}: damaged record at byte {at + begin}")
                yield at + begin, payload
                begin += 16 + length
            held, at = held[begin:], at + begin
            if not more:
                if held:
                    raise ValueError(f"{path}: cut off at byte {at}")
                return


def decoded(payload: bytes) -> tuple[int | None, np.ndarray]:
    flag, doc = struct.unpack_from("<Bq", payload)
    return None if flag & 128 else doc, np.frombuffer(payload, f"<u{flag & 127}", offset=9)


def fetch(folder: str, shard: str, n: int) -> tuple[int | None, np.ndarray]:
    """Record ``n`` of a shard, by its index: one seek in each file."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{shard}.idx") as index:
        offset, _, _ = struct.unpack("<3Q", index.read_at(24, 24 * n))
    with store.open_input_file(f"{root}/{shard}.rec") as records:
        length = struct.unpack("<Q", records.read_at(8, offset))[0]
        return decoded(records.read_at(length, offset + 12))


def shard_reader(folder: str):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for path, first in zip(frame["path"], frame["first"], strict=True):
                rows = []
                for _, payload in records_of(store, f"{root}/{path}.rec"):
                    doc, ids = decoded(payload)
                    rows.append((doc, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    first += len(ids)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return read


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record in the shards of a manifest."""
    tasks = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = numbered(manifest).select("path", "first").repartition(tasks)
    return dealt.mapInPandas(shard_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the token ids of all ``docs`` and return what the files then hold, one row per document.

    ``docs`` needs doc_id and text; other columns are ignored.  Null or empty texts give the end id alone; null ids come first;
    repeated rows are repeated records; no rows give no files and no rows.
    """
    folder = folder or fresh_path(docs.sparkSession, "records")
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    return read_records(write_records(docs, folder, tokenizer, end_id), folder)
