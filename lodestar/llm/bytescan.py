"""Word and hash primitives over Arrow string columns, without a Python object for each text.

Texts are handled as slices of one byte buffer, a few MB at a time.  Hashes are
polynomial over bytes or words modulo 2**64 with random coefficients, read off a
prefix sum, and then mixed; they are the same on every machine and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that separate words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
CHUNK = 1 << 20
#: Bytes whose hashes are summed at once, however long a text is.
SLICE = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = -(-n // SLICE) * SLICE
            f = np.full(n, BASE, U)
            b = np.full(n, INVERSE, U)
            f[0] = b[0] = 1
            self.up, self.down = np.cumprod(f, dtype=U), np.cumprod(b, dtype=U)
        return self.up, self.down


_powers = _Powers()


def give_back() -> None:
    """Returns what this worker no longer uses to the system: workers are kept for later stages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def streamed(f: Callable) -> Callable:
    """For mapInArrow and iterator functions: memory is given back when the task's rows are through."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def grouped(f: Callable) -> Callable:
    """For applyInArrow: memory is given back after each group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            give_back()

    return run


def cogrouped(f: Callable) -> Callable:
    """For applyInArrow of two: memory is given back after each group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            give_back()

    return run


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """n+1 prefix sums from which span() reads the hash of any span."""
    up, _ = _powers.get(len(values) + 1)
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal spans have equal hashes wherever they stand."""
    _, down = _powers.get(len(p))
    return (p[end] - p[start]) * down[start]


def windows(p: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all spans of n values, by start."""
    _, down = _powers.get(len(p))
    return (p[n:] - p[:-n]) * down[: len(p) - n]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of about ``size`` bytes each; a text is never cut."""
    data, off = strings(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and for each text the number of words before it (n+1)."""
    w = ~SPACE[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    at = off[:-1][off[:-1] < off[1:]]  # texts that are not empty
    first[at] = w[at]
    ends = off[1:][off[:-1] < off[1:]] - 1
    last[ends] = w[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A slice of the bytes at a time; words are cut by none."""
    out, i, n = np.empty(len(start), U), 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        a = int(start[i])
        out[i:j] = mixed(span(prefix(BYTE_CODE[data[a : end[j - 1]]]), start[i:j] - a, end[i:j] - a))
        i = j
    return out


def owner(counts: np.ndarray) -> np.ndarray:
    """0 0 0 1 1 ...: the text of each item, from texts' item counts."""
    return np.repeat(np.arange(len(counts)), counts)


def runs_in(counts: np.ndarray) -> np.ndarray:
    """0 1 2 0 1 ...: the place of each item within its text."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Items at which a window of n items of one text starts, and the windows of each text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    return np.repeat(first[:-1], counts) + runs_in(counts), counts


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` items lie in a window of n items that starts at one of ``starts``."""
    d = np.bincount(starts, minlength=total + 1)[: total + 1].astype(np.int64)
    d -= np.bincount(np.minimum(starts + n, total), minlength=total + 1)[: total + 1]
    return np.cumsum(d[:-1]) > 0


def gaps(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising whole numbers as one byte each, and what does not fit: rows of (place, high part).

    first: which of them start anew, as the first of a text does.
    """
    d = values.astype(np.int64)
    d[1:] -= np.where(first[1:], 0, values[:-1])
    wide = np.flatnonzero(d > 255)
    return (d & 255).astype(np.uint8), np.stack([wide, d[wide] >> 8], 1).astype(np.int64)


def ungap(low: np.ndarray, wide: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What gaps() took, with the number of values of each text."""
    d = low.astype(np.int64)
    d[wide[:, 0]] += wide[:, 1] << 8
    total = np.cumsum(d)
    before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
    return total - np.repeat(before, counts)


def same_key(sorted_: np.ndarray) -> np.ndarray:
    """Whether each item of a sorted array equals the one before it."""
    out = np.zeros(len(sorted_), bool)
    out[1:] = sorted_[1:] == sorted_[:-1]
    return out


def xxhash64(ids: np.ndarray) -> np.ndarray:
    """Spark's function of that name, of longs.  Fixed values: the primes of that hash, and Spark's seed."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << U(n)) | (x >> U(64 - n))
    h = U(42 + int(p5) + 8) ^ turned(ids.astype(np.int64).view(U) * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))).view(np.int64)


def part_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The part of n of each id, as F.pmod(F.xxhash64(id), n) has it."""
    return np.mod(xxhash64(ids), n)


def binary_rows(values: list) -> pa.Array:
    return pa.array([v if isinstance(v, bytes) else np.ascontiguousarray(v).tobytes() for v in values], pa.binary())


#: Stands for a null id; such rows come first.
NO_ID = np.iinfo(np.int64).min


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def items(table: pa.Table, name: str, kind: type | str) -> np.ndarray:
    """The items of a binary column of dealt(), one row's after the other's."""
    if str(kind).startswith("runs:"):
        return np.repeat(items(table, name, kind[5:]), items(table, f"{name}_n", "<i4"))
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def read(table: pa.Table, columns: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: items(table, c, kind) for c, kind in columns.items()}


def stored(columns: dict[str, str]) -> list[str]:
    """The names of the binary columns that hold some: those of kind runs: have their runs' lengths beside them."""
    return [x for c, kind in columns.items() for x in ([c, f"{c}_n"] if str(kind).startswith("runs:") else [c])]


def dealt(bucket: np.ndarray, values: dict[str, np.ndarray], columns: dict[str, str], key: str = "bucket") -> pa.RecordBatch:
    """One row for each bucket that has items: the bucket, and its items' columns as binary.

    columns: names and kinds; runs:kind for one in which equal values are neighbours.
    """
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(~same_key(bucket))
    ends = np.append(at[1:], len(bucket))[: len(at)]
    rows = [pa.array(bucket[at].astype(np.int32), pa.int32())]

    def cut(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
        return pa.array([v[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())

    for c, kind in columns.items():
        v = values[c][order]
        if str(kind).startswith("runs:"):
            new = ~same_key(v)
            new[at] = True
            where = np.flatnonzero(new)
            first, last = np.searchsorted(where, at), np.searchsorted(where, ends)
            rows.append(cut(v[where].astype(kind[5:]), first, last))
            rows.append(cut(np.diff(np.append(where, len(v))).astype(np.int32), first, last))
        else:
            rows.append(cut(v.astype(kind, copy=False), at, ends))
    return pa.RecordBatch.from_arrays(rows, names=[key, *stored(columns)])


def dealt_table(bucket: np.ndarray, values: dict[str, np.ndarray], columns: dict[str, str], key: str = "part") -> pa.Table:
    return pa.Table.from_batches([dealt(bucket, values, columns, key)])


def schema_of(columns: dict[str, str], key: str = "bucket") -> str:
    return ", ".join([f"{key} int", *(f"{c} binary" for c in stored(columns))])


#: Buckets that one pass deals to: with more, a batch would have too few items for each.
FAN = 4096


def levels(n: int, fan: int = FAN) -> tuple[int, int]:
    """(buckets of the first pass, buckets that the second cuts each into)."""
    return min(n, fan), -(-n // fan)


def bucket_of(h: np.ndarray, coarse: int) -> np.ndarray:
    return (h % U(coarse)).astype(np.int64)


def by_bucket(blocks, columns: dict[str, str], hashes: Callable, coarse: int, fine: int):
    """Rows of dealt() grouped by bucket, of which there are coarse x fine, without an upper bound.

    columns: the items' columns and kinds.  hashes: from a dict of them to the numbers
    that bucket_of() was given.  The second pass cuts the first one's buckets, each
    read by many tasks.
    """
    if fine == 1:
        return blocks.groupBy("bucket")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            got = read(t, columns)
            name, kind = next((c, k) for c, k in columns.items() if not k.startswith("runs:"))
            counts = np.array([len(x) for x in t[name].to_pylist()], np.int64) // np.dtype(kind).itemsize
            own = np.repeat(t["bucket"].to_numpy(), counts).astype(np.int64)
            yield dealt(own * fine + ((hashes(got) // U(coarse)) % U(fine)).astype(np.int64), got, columns)

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > 16 * CHUNK:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    from pyspark.sql import functions as F

    salted = blocks.repartition("bucket", F.pmod(F.xxhash64(next(iter(columns))), F.lit(fine))).sortWithinPartitions("bucket")
    return salted.mapInArrow(streamed(again), schema_of(columns)).groupBy("bucket")


def volume(df) -> int:
    """Bytes Spark expects of a DataFrame, or of its sources if they are less: no job for files.

    Sources of unknown size are measured.
    """
    from pyspark.sql import functions as F

    plan = df._jdf.queryExecution().optimizedPlan()
    size, leaves = int(str(plan.stats().sizeInBytes())), plan.collectLeaves()
    n = min(size, sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))
    if n < 1 << 60:
        return n
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")), F.lit(8 * len(df.columns)))
    return df.select(width.alias("n")).agg(F.sum("n")).first()[0] or 0


def parts(df, part_bytes: int, least: int = 12) -> int:
    """A number of parts that follows the data's volume without an upper bound.

    Beyond 50,000 of them, parts grow too, up to ten times.
    """
    n = volume(df)
    return max(least, -(-n // min(max(part_bytes, n // 50_000), 10 * part_bytes)))
