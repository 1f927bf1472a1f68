"""A log-structured index of window fingerprints for incremental substring deduplication.

A window is ``n`` consecutive words of one document.  The index holds sorted immutable
runs: tables of the hashes of all windows seen so far, by bucket, each with the place
where its window stood first.  A batch of documents is ingested so:

1. Its windows' hashes are sorted and merge-joined with the runs, bucket by bucket.  New
   hashes become a new run; when ``fanout`` runs are there already, all become one.
2. A hash seen before points to an earlier place.  Neighbouring matches that point to
   neighbouring places are one stretch of text; a digest of its words, of 128 bits, is
   taken from the earlier document and held against the later one's words.
3. Where they differ, two windows have met in their hash by chance: all windows with
   that hash are compared by their words.
4. The words of repeated windows are removed.

Batches follow the documents' order, so what is removed does not depend on how
documents are dealt to batches.  Hashes travel in blocks of thousands for each bucket,
and a block holds a window once, however often its texts repeat it, so no window is hot.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .scratch import Scratch, shared_dir, small_batches

#: Windows of a chunk; to: where an equal one stood earlier in the chunk, or NOWHERE.
WINDOWS = {"docs": "runs:<i8", "starts": "<i4", "hashes": "<u8", "to_docs": "runs:<i8", "to_starts": "<i4"}
#: A later window and the earlier one of its hash.
MATCHES = {"to_docs": "<i8", "to_starts": "<i4", "docs": "<i8", "starts": "<i4"}
#: A stretch of several windows from ``starts`` on, and a digest of what it should be; no digest: known by its words.
STRETCHES = {"docs": "<i8", "starts": "<i4", "windows": "<i4", "high": "<u8", "low": "<u8", "known": "|u1"}
RUN = "bucket int, n int, hashes binary, run_docs binary, run_starts binary"
#: Hashes in a row of a run.
ROW = 1 << 16
NOWHERE = -1
REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string, open binary"
KEPT = REPORT + ", kept string"


def planes(v: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that bytes which hardly change compress."""
    return v.view(np.uint8).reshape(len(v), -1).T.tobytes()


def numbers(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def run_rows(bucket: int, hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """Rows of RUN of some sorted distinct hashes: the differences of neighbours, and their places."""
    out = []
    for a in range(0, len(hashes), ROW):
        h = hashes[a : a + ROW]
        step = np.diff(h, prepend=np.uint64(0))
        out.append((bucket, len(h), planes(step), planes(docs[a : a + ROW].astype("<i8")), planes(starts[a : a + ROW].astype("<i4"))))
    return out


def read_runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, documents, starts) of rows of RUN, one after the other."""
    rows = table.select(["hashes", "run_docs", "run_starts"]).to_pylist()
    none = np.zeros(0, np.int64)
    hashes = [np.cumsum(numbers(r["hashes"], "<u8"), dtype=np.uint64) for r in rows]
    return np.concatenate(hashes or [none.astype(np.uint64)]), np.concatenate([numbers(r["run_docs"], "<i8") for r in rows] or [none]), np.concatenate([numbers(r["run_starts"], "<i4") for r in rows] or [none])


def window_blocks(n: int, coarse: int, bits: int, turn: int = 0, turns: int = 1):
    """Maps (doc_id, text) to blocks of windows for each bucket whose number leaves ``turn`` when divided by ``turns``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = B.ids_of(batch.column(0))
            for i, j, data, off in B.chunks(batch.column(1), 2 * B.CHUNK):
                start, end, first = B.words(data, off)
                at, counts = B.window_starts(first, n)
                if not len(at):
                    continue
                code = B.word_hashes(data, start, end)
                del start, end
                hashes = B.mixed(B.windows(B.prefix(code), n)[at])
                if bits < 64:
                    hashes &= B.U((1 << bits) - 1)
                doc, pos = all_ids[i:j][B.owner(counts)], B.runs_in(counts)
                if turns > 1:
                    some = B.bucket_of(hashes, coarse) % turns == turn
                    hashes, doc, pos = hashes[some], doc[some], pos[some]
                order = np.argsort(hashes, kind="stable")
                several = B.same_key(hashes[order])
                several[:-1] |= several[1:].copy()
                m = order[several]
                m = m[np.lexsort((pos[m], doc[m], hashes[m]))]
                same = B.same_key(hashes[m])
                lead = m[np.maximum.accumulate(np.where(same, 0, np.arange(len(m))))] if len(m) else m
                # equal windows of this chunk: the earliest goes to the index, the others point to it
                to_docs, to_starts = np.zeros(len(hashes), np.int64), np.full(len(hashes), NOWHERE, np.int64)
                to_docs[m[same]], to_starts[m[same]] = doc[lead[same]], pos[lead[same]]
                copy = (to_starts == pos) & (to_docs == doc)  # the same place of a row with the same id
                keep = np.flatnonzero(~copy)
                columns = {"docs": doc[keep], "starts": pos[keep], "hashes": hashes[keep], "to_docs": to_docs[keep], "to_starts": to_starts[keep]}
                yield B.dealt(B.bucket_of(columns["hashes"], coarse), columns, WINDOWS)

    return blocks


def merge(new: dict[str, np.ndarray], old: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Merge-joins a bucket's windows with its runs.

    Returns which of the windows are first of their hash, sorted by it; the matches; and
    the places of the runs' hashes among ``old`` in sorted order.
    """
    h, docs, starts = old
    x = np.flatnonzero(new["to_starts"] == NOWHERE)
    x = x[np.lexsort((new["starts"][x], new["docs"][x], new["hashes"][x]))]
    # sorted lists one after the other: a stable sort merges them, earlier ones first
    keys = np.concatenate([h, new["hashes"][x]])
    order = np.argsort(keys, kind="stable")
    same = B.same_key(keys[order])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
    all_docs, all_starts = np.concatenate([docs, new["docs"][x]]), np.concatenate([starts, new["starts"][x]])
    hit = order[same]
    to = lead[same]
    later = hit >= len(h)
    differs = (all_docs[hit] != all_docs[to]) | (all_starts[hit] != all_starts[to])
    hit, to = hit[later & differs], to[later & differs]
    chunk = np.flatnonzero(new["to_starts"] != NOWHERE)
    matches = {
        "docs": np.concatenate([all_docs[hit], new["docs"][chunk]]), "starts": np.concatenate([all_starts[hit], new["starts"][chunk]]),
        "to_docs": np.concatenate([all_docs[to], new["to_docs"][chunk]]), "to_starts": np.concatenate([all_starts[to], new["to_starts"][chunk]]),
    }
    first = order[~same]
    return x[first[first >= len(h)] - len(h)], matches, first[first < len(h)]


def stretches(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(an order of matches, the first of each stretch in it): neighbours that point to neighbours."""
    shift = c["starts"].astype(np.int64) - c["to_starts"]
    order = np.lexsort((c["starts"], shift, c["to_docs"], c["docs"]))
    new = np.ones(len(order), bool)
    if len(order):
        d, t, s, x = (v[order] for v in (c["docs"], c["to_docs"], shift, c["starts"]))
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (x[1:] != x[:-1] + 1)
    return order, np.flatnonzero(new)


class _Words:
    """The words of a part's documents, read once each."""

    def __init__(self, documents: pa.Table):
        self.data, self.off = B.strings(documents["text"])
        self.keys = B.ids_of(documents["doc_id"]) if documents.num_rows else np.zeros(0, np.int64)
        self.order = np.argsort(self.keys, kind="stable")
        self.row, self.start, self.end, self.text = -1, None, None, b""

    def rows(self, doc: int) -> list[int]:
        lo, hi = np.searchsorted(self.keys[self.order], [doc, doc + 1]) if doc < np.iinfo(np.int64).max else (np.searchsorted(self.keys[self.order], doc), len(self.order))
        return self.order[lo:hi].tolist()

    def load(self, row: int) -> None:
        if row != self.row:
            self.row, text = row, self.data[self.off[row] : self.off[row + 1]]
            self.start, self.end, _ = B.words(text, np.array([0, len(text)]))
            self.text = memoryview(text.tobytes())

    def digest(self, row: int, first: int, n: int) -> tuple[int, int] | None:
        """Of n words of a document from ``first`` on."""
        self.load(row)
        return None if first + n > len(self.start) else _digest(self.text, self.start[first : first + n], self.end[first : first + n])


def _digests(n: int, parts: int):
    """Of each stretch, as its words stand in the earlier document, for the later one's part."""

    def digests(documents: pa.Table, found: pa.Table) -> pa.Table:
        c = B.read(found, MATCHES)
        words, rows = _Words(documents), []
        order, first = stretches(c)
        order_ends = np.append(first[1:], len(order))
        by = np.argsort(c["to_docs"][order[first]], kind="stable") if len(first) else first
        for a, z in zip(first[by].tolist(), order_ends[by].tolist(), strict=True):
            x = order[a]
            for row in words.rows(int(c["to_docs"][x])):
                if (d := words.digest(row, int(c["to_starts"][x]), z - a + n - 1)) is not None:
                    rows.append((int(c["docs"][x]), int(c["starts"][x]), z - a, *d, 0))
        columns = {k: np.array([r[i] for r in rows], np.dtype(kind)) for i, (k, kind) in enumerate(STRETCHES.items())}
        return B.dealt_table(B.part_of(columns["docs"], parts), columns, STRETCHES)

    return digests


def _digest(data: memoryview, start: np.ndarray, end: np.ndarray) -> tuple[int, int]:
    """Of words, joined by one space."""
    d = hashlib.blake2b(b" ".join([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _reports(n: int, with_text: bool):
    names = [x.split()[0] for x in (KEPT if with_text else REPORT).split(", ")]

    def reports(documents: pa.Table, found: pa.Table) -> pa.Table:
        c = B.read(found, STRETCHES)
        order = np.lexsort((c["windows"], c["starts"], c["docs"]))
        docs = c["docs"][order]
        first_word, windows, high, low, known = (c[k][order].tolist() for k in ("starts", "windows", "high", "low", "known"))
        ids, keys = documents["doc_id"].to_pylist(), B.ids_of(documents["doc_id"]) if documents.num_rows else np.zeros(0, np.int64)
        out: list[list] = [[] for _ in range(6)]
        for i, j, data, off in B.chunks(documents["text"]):
            start, end, first = B.words(data, off)
            view = memoryview(data.tobytes())
            lo, hi = np.searchsorted(docs, keys[i:j], "left"), np.searchsorted(docs, keys[i:j], "right")
            change, open_ = np.zeros(len(start) + 1, np.int64), {}
            for k in np.flatnonzero(hi > lo).tolist():
                base, total = int(first[k]), int(first[k + 1] - first[k])
                sure, rest = set(), set()
                for x in range(int(lo[k]), int(hi[k])):
                    at, size = (first_word[x], windows[x]), windows[x] + n - 1
                    if at[0] + size > total or at in sure:
                        continue
                    a, b = base + at[0], base + at[0] + size
                    if known[x] or _digest(view, start[a:b], end[a:b]) == (high[x], low[x]):
                        sure.add(at)
                        change[a] += 1
                        change[b] -= 1
                    else:
                        rest.add(at)
                if rest := [w for a, m in sorted(rest - sure) for w in range(a, a + m)]:
                    open_[k] = np.array(rest, "<i4").tobytes()
            gone = np.cumsum(change[:-1]) > 0
            text = np.append(data, np.uint8(0x20))
            s, e = start[~gone], end[~gone]
            doc = np.searchsorted(off, s, "right") - 1
            mask = np.zeros(len(data) + 1, np.int8)
            mask[s] = 1
            mask[e] -= 1  # words never touch
            mask = np.cumsum(mask, dtype=np.int8).astype(bool)
            joint = e[:-1][doc[:-1] == doc[1:]]  # a space behind each kept word but a text's last
            mask[joint] = True
            text[joint] = 0x20
            kept = text[mask].tobytes()
            ends = np.concatenate([[0], np.cumsum(mask)])[off]
            total, removed = np.diff(first), np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            for k in range(j - i):
                own = kept[ends[k] : ends[k + 1]]
                row = (ids[i + k], int(total[k]), int(removed[k]), hashlib.sha256(own).hexdigest(), open_.get(k), own.decode("utf-8", "replace") if with_text else None)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.table([pa.array(v, k) for v, k in zip(out[: len(names)], kinds, strict=False)], names=names)

    return reports


class FingerprintIndex:
    """The index in a folder, and the operations on it.

    ``ingest`` takes a batch of documents that come after all earlier ones and returns
    its report; ``compact`` merges all runs into one.  The folder holds the runs, the
    texts (unless ``texts`` gives a table of all documents, now and later) and a list of
    them, replaced last in each step: a later session that opens the folder goes on
    where the last finished step ended.  Without a path the folder lies in the shared
    one and goes with the session.

    parts: buckets of the hash space and parts of the documents, fixed when the index is
    made; fan: buckets of one pass (see bytescan.by_bucket).  turns: a batch is merged a share of
    the buckets at a time, so that shuffles never hold all runs at once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, n: int = 20, parts: int = 64, fanout: int = 4, fan: int = B.FAN, bits: int = 64, turns: int = 2, texts: DataFrame | None = None):
        self.spark, self.scratch = spark, Scratch(spark)
        self.path = path or f"{self.scratch.root}/index"
        self.n, self.parts, self.fanout, self.fan, self.bits, self.texts = n, parts, fanout, fan, bits, texts
        self.version, self.runs, self.documents, self.turns, self.last = 0, [], [], turns, None
        known = [int(s.getPath().getName()) for s in self._list("state") if self._exists(f"state/{s.getPath().getName()}/_SUCCESS")]
        if known:
            self.version = max(known)
            state = json.loads(spark.read.text(f"{self.path}/state/{self.version}").first()[0])
            self.runs, self.documents, self.n, self.parts, self.bits, self.fan, self.turns = (state[k] for k in ("runs", "documents", "n", "parts", "bits", "fan", "turns"))
            self.last = state.get("last")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _list(self, path: str) -> list:
        fs, p = self._fs(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _finish(self, runs: list[str], documents: list[str]) -> None:
        """Makes the step's tables the index's, then deletes what it no longer names."""
        self.version += 1
        state = {"runs": runs, "documents": documents, "n": self.n, "parts": self.parts, "bits": self.bits, "fan": self.fan, "turns": self.turns, "last": self.last}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state/{self.version}")
        for old in set(self.runs) - set(runs):
            fs, p = self._fs(old)
            fs.delete(p, True)
        self.runs, self.documents = runs, documents

    def _write(self, df: DataFrame, kind: str, suffix: str = "") -> str:
        name = f"{kind}/{self.version + 1}{suffix}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in names])

    def _runs(self, names: list[str]) -> DataFrame:
        return self._read(names, RUN).filter("hashes IS NOT NULL")

    def _part(self, column: str = "doc_id"):
        return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(B.NO_ID))), F.lit(self.parts)).cast("int").alias("part")

    def ingest(self, docs: DataFrame, *, id_: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
        """A batch's report: doc_id, n_words, n_removed, kept_sha256 (and kept, the remaining words).

        An id that is not above all ids of the index is an error: what is removed would depend on the order of calls.
        """
        small_batches(self.spark)
        scratch, n, parts = self.scratch, self.n, self.parts
        rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
        own = F.coalesce("doc_id", F.lit(B.NO_ID))
        first, last = rows.agg(F.min(own), F.max(own)).first()
        if first is not None and self.last is not None and first <= self.last:
            raise ValueError(f"a batch begins at id {first}, but the index holds ids up to {self.last}")
        coarse, fine = B.levels(parts, self.fan)
        whole = len(self.runs) >= self.fanout * self.turns
        def join(blocks: pa.Table, stored: pa.Table) -> pa.Table:
            bucket = (blocks if blocks.num_rows else stored)["bucket"][0].as_py()
            new, old = B.read(blocks, WINDOWS), read_runs(stored)
            first, matches, before = merge(new, old)
            found = B.dealt_table(B.part_of(matches["to_docs"], parts), matches, MATCHES)
            h, d, s = new["hashes"][first], new["docs"][first], new["starts"][first]
            if whole:
                h, d, s = (np.concatenate([v[before], w]) for v, w in zip(old, (h, d, s), strict=True))
                order = np.argsort(h, kind="stable")
                h, d, s = h[order], d[order], s[order]
            run = run_rows(bucket, h, d, s)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            table = pa.table([pa.array([r[i] for r in run], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RUN.split(", ")])
            return pa.concat_tables([table, found], promote_options="default").select([x.split()[0] for x in f"{RUN}, {B.schema_of(MATCHES, 'part')}".split(", ")])

        # the run and the matches are one table, written once
        schema = f"{RUN}, {B.schema_of(MATCHES, 'part')}"
        turns = self.turns
        run = []
        for turn in range(turns):
            blocks = rows.mapInArrow(B.streamed(window_blocks(n, coarse, self.bits, turn, turns)), B.schema_of(WINDOWS))
            grouped = B.by_bucket(blocks, WINDOWS, lambda c: c["hashes"], coarse, fine)
            old = self._runs([r for r in self.runs if r.endswith(f"-{turn}")])
            run.append(self._write(grouped.cogroup(old.groupBy("bucket")).applyInArrow(B.cogrouped(join), schema), "runs", f"-{turn}"))
            scratch.release()
        matches = self._read(run, schema).filter("part IS NOT NULL").select("part", *B.stored(MATCHES))
        documents = [*self.documents, self._write(rows, "documents")] if self.texts is None else []
        everything = self._read(documents, "doc_id long, text string") if self.texts is None else self.texts.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
        earlier = self._leaders(everything, matches)
        digests = scratch.save(earlier.select("doc_id", "text", self._part()).groupBy("part").cogroup(matches.groupBy("part")).applyInArrow(B.cogrouped(_digests(n, parts)), B.schema_of(STRETCHES, "part")))
        out = self._report(rows, digests, with_text)
        if out.filter("open IS NOT NULL").limit(1).count():
            out = self._report(rows, digests.unionByName(self._compared(rows, everything, out)), with_text)
        self.last = self.last if last is None else last
        self._finish(run if whole else [*self.runs, *run], documents)
        scratch.drop(digests)
        scratch.release()
        return out.drop("open")

    #: Up to so many ids of earlier documents, 8 bytes each, are broadcast; beyond, both sides are shuffled.
    MOST_BROADCAST = 2_000_000

    def _leaders(self, documents: DataFrame, matches: DataFrame) -> DataFrame:
        """The documents that some match points to: a batch's ids go to the documents' parts in blocks, each id once."""
        parts, kinds = self.parts, {"to_docs": "<i8"}

        def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.unique(B.items(pa.Table.from_batches([b]), "to_docs", "<i8"))
                yield B.dealt(B.part_of(own, parts), {"to_docs": own}, kinds, "part")

        def distinct(found: pa.Table) -> pa.Table:
            return pa.table({"id": np.unique(B.items(found, "to_docs", "<i8"))})

        blocks = matches.select("to_docs").mapInArrow(B.streamed(ids), B.schema_of(kinds, "part"))
        wanted = self.scratch.save(blocks.groupBy("part").applyInArrow(B.grouped(distinct), "id long"))
        wanted = F.broadcast(wanted) if wanted.count() <= self.MOST_BROADCAST else wanted
        return documents.join(wanted, F.coalesce("doc_id", F.lit(B.NO_ID)) == F.col("id"), "left_semi")

    def _report(self, rows: DataFrame, found: DataFrame, with_text: bool) -> DataFrame:
        out = rows.withColumn("part", self._part()).groupBy("part").cogroup(found.groupBy("part")).applyInArrow(B.cogrouped(_reports(self.n, with_text)), KEPT if with_text else REPORT)
        return self.scratch.save(out)

    def _compared(self, rows: DataFrame, documents: DataFrame, out: DataFrame) -> DataFrame:
        """Stretches, of one window each, of open windows that stand earlier too: by their words."""
        n, parts, bits = self.n, self.parts, self.bits

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = B.ids_of(batch.column(0))
                for i, _, data, off in B.chunks(batch.column(1)):
                    start, end, first = B.words(data, off)
                    at, counts = B.window_starts(first, n)
                    if not len(at):
                        continue
                    hashes = B.mixed(B.windows(B.prefix(B.word_hashes(data, start, end)), n)[at])
                    if bits < 64:
                        hashes &= B.U((1 << bits) - 1)
                    words = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                    text = [b" ".join(words[k : k + n]) for k in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[i + B.owner(counts)]), pa.array(B.runs_in(counts).astype(np.int32)), pa.array(text, pa.binary())], names=["h", "doc", "start", "words"])

        def open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, places = B.ids_of(b.column(0)), [np.frombuffer(x, "<i4") for x in b.column(1).to_pylist()]
                sizes = np.array([len(p) for p in places], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([np.zeros(0, "<i4"), *places]))], names=["doc", "start"])

        def packed(table: pa.Table) -> pa.Table:
            one, none = np.ones(table.num_rows, np.int32), np.zeros(table.num_rows, np.uint64)
            columns = {"docs": table["doc"].to_numpy(), "starts": table["start"].to_numpy(), "windows": one, "high": none, "low": none, "known": one.astype(np.uint8)}
            return B.dealt_table(B.part_of(columns["docs"], parts), columns, STRETCHES)

        schema = "h long, doc long, start int, words binary"
        open_ = out.filter("open IS NOT NULL").select("doc_id", "open").mapInArrow(B.streamed(open_places), "doc long, start int").distinct()
        late = self.scratch.save(rows.mapInArrow(B.streamed(windows), schema).join(open_, ["doc", "start"]))
        every = documents.mapInArrow(B.streamed(windows), schema).join(late.select("h").distinct(), "h", "left_semi")
        first = every.groupBy("words").agg(F.min(F.struct("doc", "start")).alias("first"))
        again = late.join(first, "words").filter("first.doc < doc OR (first.doc = doc AND first.start < start)").select("doc", "start").distinct()
        return again.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(parts))).groupBy("shard").applyInArrow(B.grouped(packed), B.schema_of(STRETCHES, "part"))

    def compact(self) -> None:
        """Merges all runs into one; of a hash the earliest run's place stays."""

        def merged(stored: pa.Table) -> pa.Table:
            h, d, s = read_runs(stored)
            order = np.argsort(h, kind="stable")
            order = order[~B.same_key(h[order])]
            rows = run_rows(stored["bucket"][0].as_py(), h[order], d[order], s[order])
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RUN.split(", ")])

        if len(self.runs) > self.turns:
            whole = []
            for turn in range(self.turns):
                own = self._runs([r for r in self.runs if r.endswith(f"-{turn}")])
                whole.append(self._write(own.groupBy("bucket").applyInArrow(B.grouped(merged), RUN), "runs", f"-{turn}"))
                self.scratch.release()
            self._finish(whole, self.documents)


def dedup(
    docs: DataFrame, *, id_: str = "doc_id", text: str = "text", n: int = 20, batches: int = 4, fanout: int = 2, with_text: bool = False, fan: int = B.FAN, bits: int = 64, path: str | None = None
) -> DataFrame:
    """Every document without the words of windows that start earlier in the corpus.

    Returns doc_id, n_words, n_removed, kept_sha256 (and kept, the remaining words,
    with ``with_text``).  Earlier: a smaller id, or the same document and an earlier
    start.  Null and empty texts have no words.  Null ids come first.  Rows that share
    an id count as copies of one document: windows at one place of them are one window.
    An empty table stays empty.

    The documents are ingested in ``batches`` of rising ids into a FingerprintIndex for
    this call, or in ``path``.  An index in a path keeps the texts, and a later call with
    that path goes on with it: the documents of former calls are the earlier ones, and
    ids that are not above all of theirs are an error.  bits: of the hashes; results do
    not depend on them.
    """
    spark = docs.sparkSession
    index = FingerprintIndex(spark, path, n=n, parts=B.parts(docs, 6 << 20), fanout=fanout, fan=fan, bits=bits, texts=None if path else docs)
    quantiles = [k / batches for k in range(1, batches)]
    cuts = docs.select(F.col(id_).cast("double").alias("i")).approxQuantile("i", quantiles, 0.02) if quantiles else []
    bounds = sorted({int(c) for c in cuts})
    out = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        own = F.col(f"`{id_}`").cast("long")
        some = F.coalesce(own <= high, F.lit(True)) if high is not None else F.lit(True)  # null ids come first
        batch = docs.filter(some if low is None else some & (own > low))
        found = index.ingest(batch, id_=id_, text=text, with_text=with_text)
        out = found if out is None else out.unionByName(found)
    return out
