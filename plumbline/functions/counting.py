"""Terms as 64-bit numbers, counted with numpy over batches of rows inside tasks.

A word's number is Spark's ``xxhash64`` of it, a pair's that of its two words' numbers; both sides compute the same.
Counting sorts numbers of a batch, not strings of a row, so it costs a small part of what array functions do.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks carry these functions with them, so rules need no package on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A batch is worked in parts of about so many list entries; a longer row is one part.
PART = 2_000_000
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def word_numbers(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def term_number(term: Column) -> Column:
    """Number of a word, or of a pair of words joined by a space."""
    first, second = F.substring_index(term, " ", 1), F.substring_index(term, " ", -1)
    return F.when(F.contains(term, F.lit(" ")), F.xxhash64(F.xxhash64(first), F.xxhash64(second))).otherwise(F.xxhash64(term))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hashed(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """``xxhash64`` of longs, as Spark computes it."""
    h = (seed + _P[4] + np.uint64(8)) ^ (_turned(x * _P[1], 31) * _P[0])
    h = _turned(h, 27) * _P[0] + _P[3]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def pair_numbers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs of words with the given numbers."""
    return _hashed(right.view(np.uint64), _hashed(left.view(np.uint64), np.uint64(42))).view(np.int64)


def parts(batches: Iterator[pa.RecordBatch], column: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that lists of ``column`` hold about ``size`` entries together, by default ``PART``."""
    size = size or PART
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // size
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for begin, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(begin, end - begin)


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of lists, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def numbered(column: pa.Array, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all rows and the row of each; with ``pairs`` the lists hold words in order and pairs are added."""
    found, row = entries(column)
    if not pairs:
        return found, row
    beside = row[1:] == row[:-1]
    added = pair_numbers(found[:-1][beside], found[1:][beside])
    return np.concatenate([found, added]), np.concatenate([row, row[1:][beside]])


def tallied(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) in order, and how often each occurs."""
    key = row * max(codes, 1) + code
    key.sort()
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    rows, names = np.divmod(key[new], max(codes, 1))
    return rows, names, np.diff(np.append(new, len(key)))


def frequencies(pairs: bool):
    """``(id, df)`` of each part: rows that hold a term, each row as often as ``uses`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_ids"):
            ids, row = numbered(batch["_ids"], pairs)
            code, names = pd.factorize(ids)
            rows, held, _ = tallied(row, code, len(names))
            uses = batch["uses"].to_numpy(zero_copy_only=False)[rows]
            df = np.bincount(held, uses, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"id": pa.array(names), "df": pa.array(df)})

    return run


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each number; it never falls as numbers without sign rise."""
    return ((ids.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _cuts(ids: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets that numbers in order (without sign) fall into, and where."""
    there = bucket_of(ids, buckets)
    ends = [*np.flatnonzero(np.diff(there, prepend=-1)).tolist(), len(there)]
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        yield int(there[begin]), slice(begin, end)


def _unpacked(table: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in table[column]]


# Frequencies of the terms of a bucket: numbers in order without sign, how often each occurs, their number and the sum.
FREQUENCIES = "bucket int, ids binary, df binary, n long, total long"


def _frequencies_row(bucket: int, ids: np.ndarray, df: np.ndarray) -> tuple:
    return bucket, ids.astype("<i8").tobytes(), df.astype("<i8").tobytes(), len(ids), int(df.sum())


def _frequencies_table(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]


def packed_frequencies(counted, buckets: int):
    """``FREQUENCIES`` of what ``counted`` gives for a task, a row for a bucket of each of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in counted(batches):
            ids = batch["id"].to_numpy(zero_copy_only=False)
            df = pc.fill_null(batch["df"], 1).to_numpy(zero_copy_only=False)
            order = np.argsort(ids.view(np.uint64))
            ids, df = ids[order], df[order]
            rows = [_frequencies_row(bucket, ids[at], df[at]) for bucket, at in _cuts(ids, buckets)]
            yield pa.RecordBatch.from_arrays(_frequencies_table(rows), names=["bucket", "ids", "df", "n", "total"])

    return run


def summed_frequencies(least: int):
    """One row of ``FREQUENCIES`` for a bucket: terms that occur ``least`` times or more, over all its rows."""

    def run(table: pa.Table) -> pa.Table:
        ids, df = (np.concatenate(_unpacked(table, c, "<i8")) for c in ("ids", "df"))
        order = np.argsort(ids.view(np.uint64))
        ids, df = ids[order], df[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
        ids, df = ids[new], np.add.reduceat(df, new) if len(new) else df
        ids, df = ids[df >= least], df[df >= least]
        row = _frequencies_row(table["bucket"][0].as_py(), ids, df)
        return pa.Table.from_arrays(_frequencies_table([row]), names=["bucket", "ids", "df", "n", "total"])

    return run


def frequent(least: int):
    """``(id, df)`` of terms of ``FREQUENCIES`` that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, df = (np.frombuffer(batch[c][i].as_buffer(), "<i8") for c in ("ids", "df"))
                kept = df >= least
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[kept]), "df": pa.array(df[kept])})

    return run


# Postings of a part's terms in a bucket, in order: steps from one term's number to the next, rows of each term, row in the part, count;
# and of those that ``_other`` holds: place, product.  Whole numbers take as few bytes as the largest needs.
POSTINGS = {"part": "long", "row": "integer", "bucket": "integer", "ids": "binary", "times": "binary", "rows": "binary", "cnt": "binary", "at": "binary", "met": "binary"}


def small(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, which the first one tells."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    cut = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + cut.tobytes()


def whole(cell: pa.Scalar, begin: int = 0) -> np.ndarray:
    """What ``small`` made and stands from ``begin`` on, as numbers without sign."""
    data = np.frombuffer(cell.as_buffer(), np.uint8)[begin:]
    out = np.zeros(((len(data) - 1) // int(data[0]), 8), np.uint8)
    out[:, : data[0]] = data[1:].reshape(-1, data[0])
    return out.view("<u8").ravel()


def weighed_sums(pairs: bool, carry: list[str], known, other: float | None, schema: pa.Schema, buckets: int):
    """Per row one row with its sums over terms of known weight, and ``POSTINGS`` of terms of unknown weight, a row for a bucket of a part.

    ``known`` is a broadcast of term numbers and weights.  ``other`` is the weight of all other terms, or none if it is not
    known.  ``shared`` is the count times that in ``_other``, ``norm`` the squared count.  A row is found by ``part`` and ``row``.
    """
    index = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not index:
            index.append(pd.Index(known.value[0]))
        weights = np.append(known.value[1], np.nan if other is None else other)
        task = TaskContext.get().partitionId() << 32
        for part, batch in enumerate(parts(batches, "_ids"), task):
            ids, row = numbered(batch["_ids"], pairs)
            there, row_there = entries(batch["_other"])
            code, names = pd.factorize(np.concatenate([ids, there]))
            rows, held, cnt = tallied(row, code[: len(ids)], len(names))
            shared = np.zeros(len(rows))
            if len(there) and len(rows):
                rows_t, held_t, cnt_t = tallied(row_there, code[len(ids) :], len(names))
                key, key_t = rows * len(names) + held, rows_t * len(names) + held_t
                at = np.minimum(np.searchsorted(key, key_t), len(key) - 1)
                same = key[at] == key_t
                shared[at[same]] = cnt[at[same]] * cnt_t[same].astype(float)
            norm = cnt.astype(float) ** 2
            w = weights[index[0].get_indexer(names)][held]  # -1, not found, is the last
            cold = np.flatnonzero(np.isnan(w))
            w[cold] = 0.0
            n = batch.num_rows
            sums = {"shared": np.bincount(rows, shared * w, n), "norm": np.bincount(rows, norm * w, n)}
            place = {"part": pa.array(np.full(n, part)), "row": pa.array(np.arange(n))}
            yield _filled(schema, n, {c: batch[c] for c in carry} | {c: pa.array(v) for c, v in sums.items()} | place)
            if len(cold):
                found = names[held[cold]]
                order = np.argsort(found.view(np.uint64))
                found, cold = found[order], cold[order]
                yield _postings(schema, part, buckets, found, rows[cold], cnt[cold], shared[cold])

    return run


def _postings(schema: pa.Schema, part: int, buckets: int, ids, rows, cnt, shared) -> pa.RecordBatch:
    columns: dict[str, list] = {c: [] for c in ("bucket", "ids", "times", "rows", "cnt", "at", "met")}
    for bucket, cut in _cuts(ids, buckets):
        met = np.flatnonzero(shared[cut])
        found = ids[cut].view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        steps, times = np.diff(found[new], prepend=np.uint64(0)), np.diff(np.append(new, len(found)))
        # The first step, from 0, would widen all others.
        ids_cell = int(steps[0]).to_bytes(8, "little") + small(steps[1:])
        cells = (ids_cell, *[small(a) for a in (times, rows[cut], cnt[cut], met)], shared[cut][met].astype("<f8").tobytes())
        for name, cell in zip(columns, (bucket, *cells), strict=True):
            columns[name].append(cell)
    n = len(columns["bucket"])
    return _filled(schema, n, {"part": pa.array(np.full(n, part))} | {c: pa.array(v) for c, v in columns.items()})


# Sums of the rows of a part over the terms of a bucket: rows and their norms, rows and their shared sums.
SUMS = "part long, rows binary, norm binary, sharing binary, shared binary"


def weighed_postings(n_docs: int):
    """``SUMS`` of each part that has ``POSTINGS`` in a bucket; a term without a frequency occurs once."""

    def run(postings: pa.Table, frequencies: pa.Table) -> pa.Table:
        known, df = (np.concatenate([np.zeros(0, np.int64), *_unpacked(frequencies, c, "<i8")]) for c in ("ids", "df"))
        known = known.view(np.uint64)
        out: dict[str, list] = {c: [] for c in ("rows", "norm", "sharing", "shared")}
        for cell, *cells, met in zip(*[postings[c] for c in ("ids", "times", "rows", "cnt", "at", "met")], strict=True):
            times, rows, cnt, at = (whole(c).astype(np.int64) for c in cells)
            met = np.frombuffer(met.as_buffer(), "<f8")
            first = np.frombuffer(cell.as_buffer(), "<u8", 1)
            ids = np.cumsum(np.concatenate([first, whole(cell, 8)]), dtype=np.uint64)
            found = np.ones(len(ids))
            if len(known):
                place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                found = np.where(known[place] == ids, df[place], 1.0)
            w = np.repeat((np.log((n_docs + 1.0) / (found + 1.0)) + 1.0) ** 2, times)
            norm, shared = np.bincount(rows, cnt.astype(float) ** 2 * w), np.bincount(rows[at], met * w[at])
            # Only rows with terms in the bucket, so what moves on grows no faster than the postings.
            own, sharing = np.flatnonzero(norm), np.flatnonzero(shared)
            arrays = (own.astype("<i4"), norm[own], sharing.astype("<i4"), shared[sharing])
            for name, cell in zip(out, arrays, strict=True):
                out[name].append(cell.tobytes())
        names = ["part", *out]
        return pa.Table.from_arrays([postings["part"], *[pa.array(v, pa.binary()) for v in out.values()]], names=names)

    return run


def added_sums(schema: pa.Schema):
    """Rows of a part with ``SUMS`` of all buckets added to those they bring."""

    def run(rows: pa.Table, sums: pa.Table) -> pa.Table:
        at = rows["row"].to_numpy()
        place = np.zeros(len(at), np.int64)
        place[at] = np.arange(len(at))
        total = {c: rows[c].to_numpy().copy() for c in ("shared", "norm")}
        for name, named in (("norm", "rows"), ("shared", "sharing")):
            for where, values in zip(_unpacked(sums, named, "<i4"), _unpacked(sums, name, "<f8"), strict=True):
                total[name][place[where]] += values
        columns = [pa.chunked_array([pa.array(total[f.name])]) if f.name in total else rows[f.name] for f in schema]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _filled(schema: pa.Schema, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the schema; columns not given are null."""
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
