"""Exact substring deduplication over a sparse, range-partitioned suffix array.

A repeat is a string of ``length`` bytes that starts at two or more places.  Sorting
every suffix of a corpus would move each byte hundreds of times, so suffixes are
sampled by content first.  Every window of ``length`` bytes has one anchor, the
smallest hash among its substrings of half that length; equal windows have equal
anchors, so no repeat is missed.  Each anchor owns a run of neighbouring windows.

1. Anchors are dealt by hash.  One whose half-length string stands nowhere else owns
   no repeat.  Anchors that own equal stretches of text own only repeats: their
   stretches are fetched, and settled if the digests of their bytes, of 128 bits, agree.
   Should any not agree, all anchors that stand twice are sorted as below.
2. What is left, where texts agree around an anchor but not over its whole stretch,
   is fetched and sorted as a suffix array: suffixes are range-partitioned by their
   leading bytes between sampled splitters, with document and position as the last
   keys, so that a leading string shared by very many is cut into several ranges.
   Each range is sorted by multikey quicksort, eight bytes a key; neighbours that
   agree over half the length form a group, and their windows are compared, first by
   hash and then as bytes.
3. Groups that share the first or the last leading bytes of a range may go on in other
   ranges, however many such groups there are: their windows are compared across ranges
   as well, by two hashes of 64 bits.

An anchor that very many texts share is dealt once from each chunk of texts, and its
other stretches in the chunk go straight to the sorted suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .scratch import Scratch, small_batches

#: What becomes of an anchor: compared with all others of its key, known to be a repeat, or sorted in any case.
COMPARED, KNOWN, SORTED = 0, 1, 2
#: more: the chunk has other stretches with this key.
ANCHORS = {"docs": "<i8", "places": "<i4", "before": "<i2", "extra": "<i2", "state": "|u1", "copied": "|u1", "more": "|u1", "keys": "<u8", "stretches": "<u8"}
PARTED = {"docs": "<i8", "places": "<i4", "before": "<i2", "extra": "<i2", "open": "|u1"}
RUNS = {"docs": "<i8", "starts": "<i8", "extra": "<i4"}
CONFIRMED = RUNS | {"sure": "|u1"}
TOLD = {"hash1": "<u8", "hash2": "<u8", "told_docs": "<i8", "told_starts": "<i8"}
DIGESTS = {"high": "<u8", "low": "<u8", "same_docs": "<i8", "same_starts": "<i8", "same_extra": "<i4", "twice": "|u1"}
SUFFIX = "lead binary, doc long, start long, offset int, more int, stretch binary"
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PLACE = np.uint64((1 << 31) - 1)


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} binary" for c in columns)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, in steps that double."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, place, first window, windows more, key, stretch hash) of each anchor of a chunk."""
    k = length // 2
    at, counts = B.window_starts(off, length)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    p = B.prefix(B.BYTE_CODE[data])
    h = B.mixed(B.windows(p, k))
    least = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - k + 1)
    anchor = (least[at] & PLACE).astype(np.int64)
    doc = B.owner(counts)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    extra = np.diff(np.append(first, len(at))) - 1
    place, start = anchor[first], at[first]
    stretch = B.mixed(B.span(p, start, start + extra + length) ^ B.mixed(((place - start) * 4096 + extra).astype(np.uint64), 5))
    return doc[first], place, start, extra, h[place], stretch


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, bytes, offsets, place of the first byte in its text) of about 2 MB.

    A longer text comes in several pieces that together have each of its windows once.
    """
    most = 2 * B.CHUNK
    for i, j, data, off in B.chunks(column, most):
        if len(data) <= most:
            yield i, j, data, off, 0
        else:
            for a in range(0, len(data) - length + 1, most):
                piece = data[a : a + most + length - 1]
                yield i, j, piece, np.array([0, len(piece)]), a


def _anchor_blocks(length: int, coarse: int, bits: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = B.ids_of(batch.column(0))
            for i, j, data, off, base in _pieces(batch.column(1), length):
                doc, place, start, extra, key, stretch = anchors(data, off, length)
                if not len(doc):
                    continue
                if bits < 64:
                    stretch = stretch & B.U((1 << bits) - 1)
                order = np.lexsort((stretch, key))
                same_key = B.same_key(key[order])
                same = same_key & B.same_key(stretch[order])
                several = same.copy()
                several[:-1] |= same[1:]
                copied, state = np.zeros(len(doc), np.uint8), np.full(len(doc), COMPARED, np.uint8)
                copied[order[several]] = 1
                state[order[same]] = KNOWN
                # of a key's distinct stretches the first is compared with those elsewhere, the others are sorted
                state[order[same_key & ~same]] = SORTED
                more = np.zeros(len(doc), np.uint8)
                lead = order[~same_key]
                more[lead] = np.add.reduceat((same_key & ~same).astype(np.int64), np.flatnonzero(~same_key)) > 0
                ids = all_ids[i:j][doc]
                h = np.where(state == COMPARED, B.mixed(key, 3), B.mixed(ids.view(np.uint64), 4))
                columns = (ids, (place - off[doc] + base).astype(np.int32), (place - start).astype(np.int16), extra.astype(np.int16), state, copied, more, key, stretch)
                yield B.dealt(B.bucket_of(h, coarse), dict(zip(ANCHORS, columns, strict=True)), ANCHORS)

    return blocks


def _anchor_hash(c: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(c["state"] == COMPARED, B.mixed(c["keys"], 3), B.mixed(c["docs"].astype(np.int64).view(np.uint64), 4))


def _settle(parts: int, all_open: bool):
    """Of a bucket's anchors: repeats over their whole stretch, and those to be looked at closer.

    all_open: the latter are all whose key stands twice.
    """

    def settle(t: pa.Table) -> pa.Table:
        c = B.read(t, ANCHORS)
        x = np.flatnonzero(c["state"] == COMPARED)
        key, stretch = c["keys"][x], c["stretches"][x]
        order = np.lexsort((stretch, key))
        same_key = B.same_key(key[order])
        same = same_key & B.same_key(stretch[order])
        whole = same.copy()
        whole[:-1] |= same[1:]
        repeat = np.zeros(len(x), bool)
        repeat[order[whole]] = True
        repeat |= c["copied"][x] > 0
        # one anchor of each stretch, of keys that have several stretches here or in a chunk
        group = np.cumsum(~same_key) - 1 if len(x) else np.zeros(0, np.int64)
        stretches = np.bincount(group, ~same) + (np.bincount(group, c["more"][x][order]) > 0) if len(x) else np.zeros(0)
        lead = order[~same & (stretches[group] > 1)] if len(x) else order
        if all_open:
            twice = same_key.copy()
            twice[:-1] |= same_key[1:]
            own = np.zeros(len(x), bool)
            own[order[twice]] = True
            out = np.concatenate([x[own | (c["copied"][x] > 0) | (c["more"][x] > 0)], np.flatnonzero(c["state"] != COMPARED)])
            columns = {k: c[k][out] for k in ("docs", "places", "before", "extra")} | {"open": np.ones(len(out), np.uint8)}
            return B.dealt_table(np.mod(columns["docs"], parts), columns, PARTED)
        known, straight = np.flatnonzero(c["state"] == KNOWN), np.flatnonzero(c["state"] == SORTED)
        settled = np.concatenate([x[repeat], known, straight[c["copied"][straight] > 0]])
        out = np.concatenate([settled, x[lead], straight])
        open_ = np.zeros(len(out), np.uint8)
        open_[len(settled) :] = 1
        columns = {k: c[k][out] for k in ("docs", "places", "before", "extra")} | {"open": open_}
        return B.dealt_table(np.mod(columns["docs"], parts), columns, PARTED)

    return settle


def _digest(data: bytes | memoryview) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


FETCHED = f"{SUFFIX}, part int, {_columns(RUNS)}, bucket int, {_columns(DIGESTS)}"


def _padded(tables: list[pa.Table], schema: str) -> pa.Table:
    """The tables one below the other, with nulls for the columns they lack."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.concat_tables(tables, promote_options="default").select(names)


def _empty(schema: str) -> pa.Table:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.table([pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")], names=[c.split()[0] for c in schema.split(", ")])


def _fetch(length: int, parts: int, coarse: int):
    """The stretches of open anchors, and what the digests of the others say within this part."""

    def fetch(documents: pa.Table, found: pa.Table) -> pa.Table:
        c = B.read(found, PARTED)
        data, off = B.strings(documents["text"])
        keys = B.ids_of(documents["key"]) if documents.num_rows else np.zeros(0, np.int64)
        by_key = np.argsort(keys, kind="stable")
        row = by_key[np.minimum(np.searchsorted(keys[by_key], c["docs"]), max(len(keys) - 1, 0))] if len(keys) else np.zeros(len(c["docs"]), np.int64)
        start = c["places"].astype(np.int64) - c["before"]
        view = memoryview(data)
        tables = [_empty(FETCHED)]
        out: list[list] = [[] for _ in range(6)]
        for x in np.flatnonzero(c["open"]).tolist():
            a = int(off[row[x]] + start[x])
            stretch = bytes(view[a : a + int(c["extra"][x]) + length])
            before = int(c["before"][x])
            for column, v in zip(out, (stretch[before : before + 16], int(c["docs"][x]), int(start[x]), before, int(c["extra"][x]), stretch), strict=True):
                column.append(v)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        tables.append(pa.table([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[v.split()[0] for v in SUFFIX.split(", ")]))
        x = np.flatnonzero(c["open"] == 0)
        if len(x):
            at = (off[row[x]] + start[x]).tolist()
            both = np.array([_digest(view[a : a + e + length]) for a, e in zip(at, c["extra"][x].tolist(), strict=True)], np.uint64)
            order = np.lexsort((both[:, 1], both[:, 0]))
            same = B.same_key(both[order, 0]) & B.same_key(both[order, 1])
            twice = same.copy()
            twice[:-1] |= same[1:]
            sure = x[order[twice]]
            columns = {"docs": c["docs"][sure], "starts": start[sure], "extra": c["extra"][sure].astype(np.int32)}
            tables.append(B.dealt_table(np.mod(columns["docs"], parts), columns, RUNS))
            # each digest once, for the other parts
            one = order[~same]
            values = (both[one, 0], both[one, 1], c["docs"][x[one]], start[x[one]], c["extra"][x[one]].astype(np.int32), twice[~same].astype(np.uint8))
            tables.append(B.dealt_table(B.bucket_of(both[one, 0], coarse), dict(zip(DIGESTS, values, strict=True)), DIGESTS, "bucket"))
        return _padded(tables, FETCHED)

    return fetch


def _confirm(parts: int):
    """Stretches whose digest another part has too (sure), and those that stand alone after all."""

    def confirm(t: pa.Table) -> pa.Table:
        c = B.read(t, DIGESTS)
        order = np.lexsort((c["low"], c["high"]))
        same = B.same_key(c["high"][order]) & B.same_key(c["low"][order])
        twice = same.copy()
        twice[:-1] |= same[1:]
        sure = np.zeros(len(order), bool)
        sure[order[twice]] = True
        settled = c["twice"] > 0
        keep = {"docs": c["same_docs"], "starts": c["same_starts"], "extra": c["same_extra"], "sure": sure.astype(np.uint8)}
        new = np.flatnonzero(~settled)
        out = B.dealt_table(np.mod(keep["docs"][new], parts), {k: v[new] for k, v in keep.items()}, CONFIRMED)
        return out.append_column("wrong", pa.array([int((np.frombuffer(x, np.uint8) == 0).sum()) for x in out["sure"].to_pylist()], pa.int32()))

    return confirm


def multikey_sort(data: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings of ``size`` bytes; returns the order, and whether each equals the one before.

    One key of eight bytes at a time: only strings that agree so far are sorted on.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order, tied = np.arange(len(start)), np.zeros(len(start), bool)
    tied[1:] = True
    for at in range(0, size, 8):
        live = tied.copy()
        live[:-1] |= tied[1:]
        x = np.flatnonzero(live)
        if not len(x):
            break
        width = min(8, size - at)
        word = np.zeros((len(x), 8), np.uint8)
        word[:, :width] = padded[(start[order[x]] + at)[:, None] + np.arange(width)]
        word = word.view(">u8").ravel().astype(np.uint64)
        segment = np.cumsum(~tied[x])
        by = np.lexsort((word, segment))
        order[x] = order[x][by]
        word, segment = word[by], segment[by]
        tied[x] = B.same_key(word) & B.same_key(segment)
    return order, tied


def _agree(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` bytes at a and at b are the same bytes."""
    out = np.empty(len(a), bool)
    span, step = np.arange(length), max(1, (1 << 21) // length)
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        out[i : i + step] = (data[x[:, None] + span] == data[y[:, None] + span]).all(1)
    return out


def same_windows(data: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows are neighbours, and whether each equals the one before, as bytes."""
    by = np.argsort(h, kind="stable")
    same = B.same_key(h[by])
    pairs = np.flatnonzero(same)
    wrong = pairs[~_agree(data, at[by[pairs - 1]], at[by[pairs]], length)]
    if len(wrong):  # different windows with one hash: told apart by their bytes
        groups = np.cumsum(~same)
        for g in np.unique(groups[wrong]):
            x = np.flatnonzero(groups == g)
            known = {}
            own = np.array([known.setdefault(data[a : a + length].tobytes(), len(known)) for a in at[by[x]].tolist()])
            o = np.argsort(own, kind="stable")
            by[x] = by[x[o]]
            same[x] = B.same_key(own[o])
    return by, same


RANGES = f"part int, {_columns(RUNS)}, bucket int, {_columns(TOLD)}"


def _sorted_range(length: int, parts: int, coarse: int):
    """Sorts one range of suffixes and compares the windows of each group."""
    half = length // 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        doc, start, before, extra = (t[c].to_numpy().astype(np.int64) for c in ("doc", "start", "offset", "more"))
        size = extra + length
        data = np.frombuffer(b"".join(t["stretch"].to_pylist()), np.uint8)
        at = np.cumsum(size) - size
        order, tied = multikey_sort(data, at + before, half)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(~tied) - 1
        # ranges are cut by lead, then document: all groups of the first and the last lead may go on in other ranges
        shared = min(half, len(t["lead"][0].as_py()))
        lead = data[(at + before)[:, None] + np.arange(shared)]
        edge = (lead == lead[order[0]]).all(1) | (lead == lead[order[-1]]).all(1)
        owner = B.owner(extra + 1)
        shift = B.runs_in(extra + 1)
        place = at[owner] + shift
        raw = B.windows(B.prefix(B.BYTE_CODE[data]), length)[place]
        by, same = same_windows(data, place, B.mixed(raw ^ B.mixed(group[owner].astype(np.uint64), 7)), length)
        twice = same.copy()
        twice[:-1] |= same[1:]
        repeat = np.zeros(len(raw), bool)
        repeat[by[twice]] = True
        # neighbouring repeats of one stretch as one run
        gone = np.flatnonzero(repeat)
        first = gone[np.flatnonzero(np.append(True, (np.diff(gone) != 1) | (owner[gone[1:]] != owner[gone[:-1]])))] if len(gone) else gone
        until = np.append(np.searchsorted(gone, first)[1:], len(gone))
        n = until - np.searchsorted(gone, first)
        runs = {"docs": doc[owner[first]], "starts": start[owner[first]] + shift[first], "extra": (n - 1).astype(np.int32)}
        # each window of an edge once, for the other ranges
        tell = by[~same]
        tell = tell[edge[owner[tell]]]
        h1 = B.mixed(raw[tell], 8)
        h2 = B.mixed(B.windows(B.prefix(B.mixed(B.BYTE_CODE[data], 9)), length)[place[tell]], 10)
        told = dict(zip(TOLD, (h1, h2, doc[owner[tell]], start[owner[tell]] + shift[tell]), strict=True))
        out = _padded([_empty(RANGES), B.dealt_table(np.mod(runs["docs"], parts), runs, RUNS), B.dealt_table(B.bucket_of(h1, coarse), told, TOLD, "bucket")], RANGES)
        yield from out.to_batches(4096)

    return compare


def _meet(parts: int):
    """Windows from the ends of ranges that some other range has too."""

    def meet(t: pa.Table) -> pa.Table:
        c = B.read(t, TOLD)
        order = np.lexsort((c["hash2"], c["hash1"]))
        same = B.same_key(c["hash1"][order]) & B.same_key(c["hash2"][order])
        same[:-1] |= same[1:]
        gone = order[same]
        runs = {"docs": c["told_docs"][gone], "starts": c["told_starts"][gone], "extra": np.zeros(len(gone), np.int32)}
        return B.dealt_table(np.mod(runs["docs"], parts), runs, RUNS)

    return meet


def removed_spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal runs that intervals [a, b) of documents cover."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    base = doc * (int(b.max(initial=0)) + 2)  # so that no document's interval reaches the next one's
    ends = np.maximum.accumulate(b + base) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] + base[1:] > ends[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(a)) - 1
    return doc[at], a[at], (ends[last] - base[last]) if len(at) else b


def _reports(length: int):
    def reports(documents: pa.Table, found: pa.Table) -> pa.Table:
        c = B.read(found, RUNS)
        data, off = B.strings(documents["text"])
        ids = documents["doc_id"].to_pylist()
        keys = B.ids_of(documents["key"]) if documents.num_rows else np.zeros(0, np.int64)
        order = np.argsort(c["docs"], kind="stable")
        docs = c["docs"][order]
        lo, hi = np.searchsorted(docs, keys, "left"), np.searchsorted(docs, keys, "right")
        hit = order[np.repeat(lo, hi - lo) + B.runs_in(hi - lo)]
        own = B.owner(hi - lo)
        a = c["starts"][hit]
        b = a + c["extra"][hit] + length
        fits = b <= np.diff(off)[own]
        doc, a, b = removed_spans(own[fits], a[fits], b[fits])
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        view, rows = memoryview(data), []
        for k, (x, y) in enumerate(zip(off.tolist(), off[1:].tolist(), strict=False)):
            s, e = a[first[k] : first[k + 1]].tolist(), b[first[k] : first[k + 1]].tolist()
            sha = hashlib.sha256()
            for p, q in zip([x, *[x + v for v in e]], [*[x + v for v in s], y], strict=True):
                sha.update(view[p:q])
            rows.append((ids[k], y - x, sum(e) - sum(s), len(s), sha.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in REPORT.split(", ")])

    return reports


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sure ones of confirm()'s rows."""
    for b in batches:
        t = pa.Table.from_batches([b])
        counts = np.array([len(x) for x in t["sure"].to_pylist()], np.int64)
        part = np.repeat(t["part"].to_numpy(), counts)
        sure = B.items(t, "sure", "|u1") > 0
        yield B.dealt(part[sure], {k: B.items(t, k, v)[sure] for k, v in RUNS.items()}, RUNS, "part")


def keyed(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(key, doc_id, text): key is a hash of the id, one to one, where ids are unique and not null; else of id and text, to 64 bits."""
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    again = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    return rows.select((F.xxhash64("doc_id", "text") if again else F.xxhash64("doc_id")).alias("key"), "doc_id", "text")


def dedup(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", length: int = 200, fan: int = B.FAN, hash_bits: int = 64, only: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """What is left of each document's bytes without the strings that repeat.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else,
    in the same document or another, is removed; strings are judged on the input.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256.  Null texts are empty.  Every row is a document of its own, also where
    ids repeat or are null; equal rows repeat each other.  An empty table stays empty.
    ``length`` is even, from 16 to 4096; texts are below 2 GB.

    fan, hash_bits: the buckets of a pass, and the bits by which stretches are first
    compared; results do not depend on them.  only: "stretches" or "suffixes" leaves
    out what the other step finds, to see what each contributes.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    if length % 2 or not 16 <= length <= 4096:
        raise ValueError("length must be even and from 16 to 4096")
    parts = B.parts(docs, 6 << 20)
    coarse, fine = B.levels(B.parts(docs, 8 << 20), fan)
    rows = keyed(docs, id_, text)
    parted = rows.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    blocks = rows.select("key", "text").mapInArrow(B.streamed(_anchor_blocks(length, coarse, hash_bits)), B.schema_of(ANCHORS))

    def fetched(all_open: bool) -> DataFrame:
        """The rows of fetch() for the anchors that settle() lets through."""
        settled = scratch.save(B.by_bucket(blocks, ANCHORS, _anchor_hash, coarse, fine).applyInArrow(B.grouped(_settle(parts, all_open)), B.schema_of(PARTED, "part")))
        out = scratch.save(parted.groupBy("part").cogroup(settled.groupBy("part")).applyInArrow(B.cogrouped(_fetch(length, parts, coarse)), FETCHED))
        scratch.drop(settled)
        return out

    first = fetched(False)
    confirm = B.by_bucket(first.filter("bucket IS NOT NULL").select("bucket", *DIGESTS), DIGESTS, lambda c: c["high"], coarse, fine)
    confirmed = scratch.save(confirm.applyInArrow(B.grouped(_confirm(parts)), f"{B.schema_of(CONFIRMED, 'part')}, wrong int"))
    whole = confirmed.mapInArrow(_whole, B.schema_of(RUNS, "part")).unionByName(first.filter("part IS NOT NULL").select("part", *RUNS))
    if confirmed.filter("wrong > 0").limit(1).count():  # different stretches have met in their hashes
        first = fetched(True)
    suffixes = first.filter("stretch IS NOT NULL").select(*[c.split()[0] for c in SUFFIX.split(", ")])
    scratch.release()
    ranges = B.parts(first, 1 << 20)
    compared = suffixes.repartitionByRange(ranges, "lead", "doc", "start").mapInArrow(B.streamed(_sorted_range(length, parts, coarse)), RANGES)
    compared = scratch.save(compared)
    told = B.by_bucket(compared.filter("bucket IS NOT NULL").select("bucket", *TOLD), TOLD, lambda c: c["hash1"], coarse, fine)
    sorted_ = told.applyInArrow(B.grouped(_meet(parts)), B.schema_of(RUNS, "part")).unionByName(compared.filter("part IS NOT NULL").select("part", *RUNS))
    found = {None: whole.unionByName(sorted_), "stretches": whole, "suffixes": sorted_}[only]
    return parted.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(B.cogrouped(_reports(length)), REPORT)
