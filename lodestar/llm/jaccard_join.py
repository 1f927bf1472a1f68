"""Jaccard self-join of documents' word n-grams with prefix filters under several global orders.

1. Shingles are dealt to buckets as 32-bit fingerprints; each bucket finds which of
   them are shared at all.  A document can only have a partner if at least
   threshold x its shingles are shared; most have not, and go no further.
2. Documents with equal sets form one class.  Classes' shingles are counted, now
   exactly, for the first global order: rare shingles first.
3. A class's prefix under an order is what must contain a common shingle with any
   partner.  Classes that share a prefix shingle of the first order and are of similar
   size, directly or in a chain, form a neighbourhood.
4. In a neighbourhood larger than a block, classes are first compared with one leader
   each, the one of their least shingle under a random order, a few times over: most of
   a large group of near copies joins its leaders' star, in linear time.
5. Neighbourhoods are cut into blocks, those of a large star into blocks of their own.
   Each pair of blocks that are not of one star is a task.  Of its pairs only those
   survive that share prefix shingles under every order; their intersections are counted
   as matrix products, and a spanning forest of the links is all that leaves the task.
6. Components of the links; copies follow their class.

Shingles are compared as 64-bit hashes.  One that very many documents share leaves a
chunk of documents once, so no bucket has more of it than there are chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .graph import Forest, components
from .scratch import Scratch, free_names, small_batches

#: A shingle to be looked up; one whose document has counted it already; a document's number of such.
ASKED, COUNTED, COUNT = 0, 1, 2
PRINTS = {"docs": "runs:<i8", "values": "<u4", "state": "|u1"}
SHARED = {"docs": "<i8", "counts": "<i4"}
PARTIAL = {"parts": "runs:<i4", "hashes": "<u8", "dfs": "<i4"}
KNOWN = {"hashes": "<u8", "dfs": "<i4"}
#: Classes of rising sizes that share a token, chained, with the least and the largest; or a link (bucket by the first's id).
CHAINS = {"hashes": "<u8", "docs": "<i8", "low": "<i4", "high": "<i4", "to": "<i8"}
SETS = "doc_id long, n_shingles long, key1 long, key2 long, shingles binary"
NONE = np.iinfo(np.int64).min


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) a chunk at a time.

    Words are lower-cased A-Z.  A text with fewer than n words has one shingle, its
    whole sequence; a text without words has none.
    """
    for i, j, data, off in B.chunks(column, 2 * B.CHUNK):
        data = B.LOWER[data]
        start, end, first = B.words(data, off)
        p = B.prefix(B.word_hashes(data, start, end))
        words = np.diff(first)
        at, counts = B.window_starts(first, n)
        h = B.mixed(B.windows(p, n)[at], n) if len(at) else np.zeros(0, np.uint64)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        sets = []
        for k in range(j - i):
            if words[k] >= n:
                s = np.sort(h[cuts[k] : cuts[k + 1]])
                sets.append(s[~B.same_key(s)])
            elif words[k]:
                sets.append(B.mixed(B.span(p, first[k : k + 1], first[k + 1 : k + 2]), int(words[k])))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield i, sets


def required(size: np.ndarray | int, num: int, den: int):
    """The fewest common shingles that a set of this size needs with any partner."""
    return -(-size * num // den)


def _sets_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _several(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order, whether each equals the one before, whether it has an equal) of hashes."""
    order = np.argsort(h, kind="stable")
    same = B.same_key(h[order])
    several = same.copy()
    several[:-1] |= same[1:]
    return order, same, several


def _survivors(docs: DataFrame, n: int, num: int, den: int, id_: str, text: str, fan: int) -> DataFrame:
    """All documents with their set's size; for those that may have a partner, the set."""
    parts = B.parts(docs, 6 << 20)
    coarse, fine = B.levels(parts, fan)
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = B.ids_of(batch.column(0))
            for i, sets in shingle_sets(batch.column(1), n):
                sizes = np.array([len(s) for s in sets])
                if not sizes.sum():
                    continue
                h = np.concatenate(sets)
                doc = B.owner(sizes)
                order, same, several = _several(h)
                state = np.full(len(h), ASKED, np.uint8)
                state[order[several]] = COUNTED
                gone = np.zeros(len(h), bool)
                gone[order[same]] = True
                counts = np.bincount(doc[order[several]], minlength=len(sets))
                keep, some = np.flatnonzero(~gone), np.flatnonzero(counts)
                own = ids[i : i + len(sets)]
                columns = {
                    "docs": np.concatenate([own[doc[keep]], own[some]]), "values": np.concatenate([(h[keep] >> np.uint64(32)).astype(np.uint32), counts[some].astype(np.uint32)]),
                    "state": np.concatenate([state[keep], np.full(len(some), COUNT, np.uint8)]),
                }
                yield B.dealt(B.bucket_of(np.concatenate([h[keep], B.mixed(own[some].view(np.uint64), 4)]), coarse), columns, PRINTS)

    def shared(table: pa.Table) -> pa.Table:
        c = B.read(table, PRINTS)
        x = np.flatnonzero(c["state"] != COUNT)
        order, _, several = _several(c["values"][x])
        hit = x[order[several]]
        hit = hit[c["state"][hit] == ASKED]
        count = np.flatnonzero(c["state"] == COUNT)
        who, at = np.unique(np.concatenate([c["docs"][hit], c["docs"][count]]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(hit)), c["values"][count]]), len(who)).astype(np.int32)
        return B.dealt_table(B.part_of(who, parts), {"docs": who, "counts": total}, SHARED)

    def sets(documents: pa.Table, found: pa.Table) -> pa.Table:
        c = B.read(found, SHARED)
        known, at = np.unique(c["docs"], return_inverse=True)
        total = np.bincount(at, c["counts"], len(known))
        ids, keys = documents["doc_id"].to_pylist(), B.ids_of(documents["doc_id"])
        out: list[list] = [[] for _ in range(5)]
        for i, sets in shingle_sets(documents["text"], n):
            for k, s in enumerate(sets):
                x = int(np.searchsorted(known, keys[i + k]))
                common = total[x] if x < len(known) and known[x] == keys[i + k] else 0
                may = len(s) and common >= required(len(s), num, den)
                key1, key2 = (int(B.mixed(s, 11).sum().view(np.int64)), int(B.mixed(s, 12).sum().view(np.int64))) if may else (None, None)
                for column, v in zip(out, (ids[i + k], len(s), key1, key2, s.tobytes() if may else None), strict=True):
                    column.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "key1", "key2", "shingles"])

    def again(c: dict[str, np.ndarray]) -> np.ndarray:
        """What the second pass deals by: the fingerprint, as its bucket's number has used the other bits."""
        return np.where(c["state"] == COUNT, B.mixed(c["docs"].view(np.uint64), 4), c["values"].astype(np.uint64) * np.uint64(coarse))

    prints = rows.mapInArrow(B.streamed(fingerprints), B.schema_of(PRINTS))
    counts = B.by_bucket(prints, PRINTS, again, coarse, fine).applyInArrow(B.grouped(shared), B.schema_of(SHARED, "part"))
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(B.NO_ID))), F.lit(parts)).cast("int")
    return rows.withColumn("part", part).groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(B.cogrouped(sets), SETS)


def _neighbours(classes: DataFrame, num: int, den: int, scratch: Scratch, fan: int) -> tuple[DataFrame, DataFrame]:
    """(classes with their sets and prefixes, links of classes that share a prefix shingle of the first order)."""
    parts = B.parts(classes, 8 << 20)
    coarse, fine = B.levels(parts, fan)
    placed = scratch.save(classes.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "shingles"))

    def tokens(table: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets_of(table["shingles"])]), return_counts=True)
        part = np.full(len(h), table["part"][0].as_py(), np.int32)
        return B.dealt_table(B.bucket_of(h, coarse), {"parts": part, "hashes": h, "dfs": n.astype(np.int32)}, PARTIAL, "bucket")

    def frequencies(table: pa.Table) -> pa.Table:
        c = B.read(table, PARTIAL)
        _, at = np.unique(c["hashes"], return_inverse=True)
        df = np.bincount(at, c["dfs"])[at] if len(at) else np.zeros(0)
        some = np.flatnonzero(df > 1)  # a shingle of one class links nothing
        return B.dealt_table(c["parts"][some], {"hashes": c["hashes"][some], "dfs": np.minimum(df[some], 1 << 30).astype(np.int32)}, KNOWN)

    def prefixes(table: pa.Table, found: pa.Table) -> pa.Table:
        c = B.read(found, KNOWN)
        order = np.argsort(c["hashes"])
        known, dfs = c["hashes"][order], c["dfs"][order]
        rows = []
        for doc, s in zip(table["doc_id"].to_pylist(), _sets_of(table["shingles"]), strict=True):
            at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
            hit = known[at] == s if len(known) else np.zeros(len(s), bool)
            v, df = s[hit], dfs[at[hit]]
            # shingles of this class alone come first of all
            p = len(s) - required(len(s), num, den) + 1 - (len(s) - len(v))
            if p > 0 and len(v):
                rows.append((doc, len(s), v[np.lexsort((v, df))[:p]].tobytes(), s.tobytes()))
        kinds = {"doc_id": pa.int64(), "size": pa.int64(), "prefix": pa.binary(), "shingles": pa.binary()}
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})

    def chained(h: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, whether each follows the one before in a chain): runs of one token whose sizes come near enough.

        Where two neighbours by size are too far apart, so are all pairs across them.
        """
        order = np.lexsort((doc, low, h))
        same = B.same_key(h[order])
        token = np.cumsum(~same)
        base = token * (int(high.max(initial=0)) + 1)  # no token's sizes reach the next one's
        top = (np.maximum.accumulate(high[order] + base) - base) if len(order) else high
        near = same.copy()
        near[1:] &= top[:-1] * den >= low[order][1:] * num
        return order, near

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = _sets_of(batch.column(2))
            sizes = np.array([len(p) for p in prefix], np.int64)
            if not sizes.sum():
                continue
            h, own = np.concatenate(prefix), B.owner(sizes)
            doc, size = B.ids_of(batch.column(0))[own], batch.column(1).to_numpy()[own]
            yield B.dealt(*_links_and_runs(h, doc, size, size, chained, coarse), CHAINS)

    def chains(table: pa.Table) -> pa.Table:
        c = B.read(table, CHAINS)
        x = c["to"] == NONE
        order, near = chained(c["hashes"][x], c["docs"][x], c["low"][x].astype(np.int64), c["high"][x].astype(np.int64))
        d, at = c["docs"][x][order], np.flatnonzero(near)
        a, b = np.concatenate([d[at - 1], c["docs"][~x]]), np.concatenate([d[at], c["to"][~x]])
        known, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(known))
        for x, y in np.unique(np.stack([where[: len(a)], where[len(a) :]], 1), axis=0).tolist():
            forest.join(x, y)
        links = forest.links()
        return pa.table({"a": known[links[:, 0]], "b": known[links[:, 1]]})

    partial = placed.groupBy("part").applyInArrow(B.grouped(tokens), B.schema_of(PARTIAL))
    known = B.by_bucket(partial, PARTIAL, lambda c: c["hashes"], coarse, fine).applyInArrow(B.grouped(frequencies), B.schema_of(KNOWN, "part"))
    prefix = scratch.save(placed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(B.cogrouped(prefixes), "doc_id long, size long, prefix binary, shingles binary"))
    scratch.drop(placed)
    runs = prefix.select("doc_id", "size", "prefix").mapInArrow(B.streamed(starts), B.schema_of(CHAINS))
    links = B.by_bucket(runs, CHAINS, lambda c: c["hashes"], coarse, fine).applyInArrow(B.grouped(chains), "a long, b long")
    return prefix, links


def _links_and_runs(h: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, chained, coarse: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Buckets and CHAINS items: each run of classes as one item, and the links within runs."""
    order, near = chained(h, doc, low, high)
    first = np.flatnonzero(~near)
    ends = np.append(first[1:], len(order))
    lead = order[first]
    follows = np.flatnonzero(near)
    a, b = doc[order[follows - 1]], doc[order[follows]]
    pair = np.unique(np.stack([a, b], 1), axis=0)
    n = len(lead)
    top = np.maximum.reduceat(high[order], first) if n else high
    hashes = np.concatenate([h[lead], B.mixed(pair[:, 0].astype(np.int64).view(np.uint64), 5)])
    assert len(ends) == n
    return B.bucket_of(hashes, coarse), {
        "hashes": hashes, "docs": np.concatenate([doc[lead], pair[:, 0]]), "low": np.concatenate([low[lead], np.zeros(len(pair), np.int64)]),
        "high": np.concatenate([top, np.zeros(len(pair), np.int64)]), "to": np.concatenate([np.full(n, NONE), pair[:, 1]]),
    }


def _alike(a: bytes, b: bytes, num: int, den: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return common * den >= (len(x) + len(y) - common) * num


def _stars(members: DataFrame, num: int, den: int, scratch: Scratch, rounds: int) -> DataFrame:
    """(doc_id, star): classes with one star reach each other by links; a star is named by one of its classes.

    members: (hood, doc_id, shingles).  In each round every class that names a star, at
    first each its own, is compared with the leader of its least shingle under a random
    order: of the classes with that shingle one of the largest star.  If they link, its
    star becomes part of the leader's, which is larger, or as large with a smaller name.
    """
    keys = [f"m{k}" for k in range(rounds)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets_of(b.column(1))
            least = [pa.array([int(B.mixed(s, 40 + k).min().view(np.int64)) for s in sets], pa.int64()) for k in range(rounds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *least, b.column(1)], names=["doc_id", *keys, "shingles"])

    rows = scratch.save(members.select("doc_id", "shingles").mapInArrow(B.streamed(sketch), ", ".join(["doc_id long", *(f"{k} long" for k in keys), "shingles binary"])))
    star = scratch.save(rows.select("doc_id", F.col("doc_id").alias("star")).distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([_alike(x, y, num, den) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["doc_id", "to"])

    for key in keys:
        sizes = star.groupBy("star").agg(F.count(F.lit(1)).alias("size"))
        known = rows.select("doc_id", key).join(star, "doc_id").join(sizes, "star")
        best = F.max(F.struct("size", (-F.col("star")).alias("name"), (-F.col("doc_id")).alias("who"))).alias("x")
        lead = known.groupBy(key).agg(best).select(key, (-F.col("x.who")).alias("lead"), (-F.col("x.name")).alias("to"))
        asks = known.filter("star = doc_id").join(lead, key).filter("to <> star").select("doc_id", "lead", "to")
        tries = asks.join(rows.select("doc_id", "shingles"), "doc_id").join(rows.select(F.col("doc_id").alias("lead"), F.col("shingles").alias("theirs")), "lead")
        joined = tries.select("doc_id", "to", "shingles", "theirs").mapInArrow(B.streamed(verify), "doc_id long, to long")
        joined = scratch.save(joined.groupBy(F.col("doc_id").alias("star")).agg(F.min("to").alias("to")))
        new = star.join(joined, "star", "left").select("doc_id", F.coalesce("to", "star").alias("star"))
        new = scratch.save(new)
        scratch.drop(star)
        star = new
    return star


def _block_links(num: int, den: int, orders: int):
    """Verifies the pairs of blocks in a shard of tasks."""

    def rows_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), B.owner(np.array([len(s) for s in sets], np.int64))

    def products(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
        """Sizes of all intersections, as products of 0/1 matrices over shared shingles."""
        (lv, lr), (rv, rr) = rows_of(left), rows_of(right)
        common = np.intersect1d(lv, rv)
        out = np.zeros((len(left), len(right)), np.float32)
        if not len(common):
            return out
        lk, rk = (np.minimum(np.searchsorted(common, v), len(common) - 1) for v in (lv, rv))
        lo, ro = common[lk] == lv, common[rk] == rv
        lk, lr, rk, rr = lk[lo], lr[lo], rk[ro], rr[ro]
        for at in range(0, len(common), width):
            x, y = (lk >= at) & (lk < at + width), (rk >= at) & (rk < at + width)
            w = min(width, len(common) - at)
            m, o = np.zeros((len(left), w), np.float32), np.zeros((len(right), w), np.float32)
            m[lr[x], lk[x] - at] = 1
            o[rr[y], rk[y] - at] = 1
            out += m @ o.T
        return out

    def hash_prefix(s: np.ndarray, k: int) -> np.ndarray:
        p = len(s) - required(len(s), num, den) + 1
        return s[np.argpartition(B.mixed(s, 20 + k), p - 1)[:p]] if p < len(s) else s

    def verify(ids: np.ndarray, side: np.ndarray, star: np.ndarray, sets: list, firsts: list) -> np.ndarray:
        left = np.flatnonzero(side != 1)
        right = left if (side == 2).all() else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return np.zeros((0, 2), np.int64)
        size = np.array([len(s) for s in sets])
        a, b = size[left][:, None], size[right][None, :]
        may = (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (ids[left][:, None] != ids[right][None, :]) & (star[left][:, None] != star[right][None, :])
        if may.any():
            may &= products([firsts[i] for i in left], [firsts[i] for i in right]) > 0
        for k in range(1, orders):
            if not may.any():
                break
            x, y = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            common = products([hash_prefix(sets[left[i]], k) for i in x], [hash_prefix(sets[right[i]], k) for i in y])
            may[np.ix_(x, y)] &= common > 0
        if not may.any():
            return np.zeros((0, 2), np.int64)
        x, y = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        left, right, may = left[x], right[y], may[np.ix_(x, y)]
        common = np.rint(products([sets[i] for i in left], [sets[i] for i in right])).astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - common
        x, y = np.nonzero(may & (common * den >= union * num))
        known, at = np.unique(np.concatenate([ids[left[x]], ids[right[y]]]), return_inverse=True)
        forest = Forest(len(known))
        for p, q in zip(at[: len(x)].tolist(), at[len(x) :].tolist(), strict=True):
            forest.join(p, q)
        return known[forest.links()]

    def links(shard: pa.Table) -> pa.Table:
        keys = ["hood", "lo", "hi"]
        shard = shard.sort_by([(k, "ascending") for k in keys])
        at = np.append(np.flatnonzero(~shard.select(keys).to_pandas().duplicated().to_numpy()), shard.num_rows)
        ids, side, star = (shard[c].to_numpy() for c in ("doc_id", "side", "star"))
        out = [np.zeros((0, 2), np.int64)]
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            part = shard.slice(a, b - a)
            out.append(verify(ids[a:b], side[a:b], star[a:b], _sets_of(part["shingles"]), _sets_of(part["prefix"])))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return links


def _tasks(placed: DataFrame, block: int, shards: int) -> DataFrame:
    """Each class once for each pair of blocks that it takes part in.

    placed: (hood, doc_id, star, shingles, prefix).  Stars larger
    than a block have blocks of their own, which are not compared with one another;
    the other classes of a neighbourhood share blocks.
    """
    stars = placed.groupBy("hood", "star").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    rows = placed.join(stars, ["hood", "star"], "left")
    rest = rows.filter("size IS NULL").groupBy("hood").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    none = F.lit(None).cast("long")
    kinds = rest.select("hood", none.alias("own"), "blocks").unionByName(stars.select("hood", F.col("star").alias("own"), F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    blocks = kinds.select("hood", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no"))
    blocks = blocks.select("hood", F.col("own").alias("their"), F.xxhash64(F.coalesce("own", F.lit(-1).cast("long")), "no").alias("other"))
    name = F.coalesce("own", F.lit(B.NO_ID)).alias("name")
    mine = rows.withColumn("own", F.when(F.col("size").isNotNull(), F.col("star"))).withColumn("name", name).join(kinds.select("hood", name, "blocks"), ["hood", "name"])
    mine = mine.withColumn("me", F.xxhash64(F.coalesce("own", F.lit(-1).cast("long")), F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")))
    both = mine.join(blocks, "hood").filter("own IS NULL OR their IS NULL OR own <> their")
    tasks = both.select(
        "hood", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"), "doc_id", "star",
        F.when(F.col("me") == F.col("other"), 2).when(F.col("me") < F.col("other"), 0).otherwise(1).alias("side"), "shingles", "prefix",
    )
    return tasks.withColumn("shard", F.pmod(F.xxhash64("hood", "lo", "hi"), F.lit(shards)).cast("int"))


def join(
    docs: DataFrame, *, id_: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, orders: int = 3, block: int = 256, rounds: int = 4, fan: int = B.FAN, scratch: Scratch | None = None
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Two documents link when 100 |A and B| >= percent |A or B|, A and B being their
    sets of n-word shingles.  component_id is the smallest id reachable by links.
    Null and empty texts have no shingles and link with nothing, nor do rows with null
    ids.  Rows with one id are one node: each has its own n_shingles, and all have the
    component that any of them reaches.  An empty table stays empty.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    num, den = percent // math.gcd(percent, 100), 100 // math.gcd(percent, 100)
    sets = scratch.save(_survivors(docs, n, num, den, id_, text, fan))
    scratch.release()
    key = ["key1", "key2", "n_shingles"]
    index = scratch.save(sets.select("doc_id", *key))
    members = index.filter("key1 IS NOT NULL AND doc_id IS NOT NULL")
    leads = members.groupBy(*key).agg(F.min("doc_id").alias("lead"))
    classes = sets.filter("shingles IS NOT NULL AND doc_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("doc_id", "shingles")).alias("x")).select("x.*")
    classes = scratch.save(classes)
    scratch.drop(sets)
    scratch.release()
    prefix, near = _neighbours(classes, num, den, scratch, fan)
    hoods = scratch.save(components(near, scratch).select(F.col("root").alias("hood"), F.col("node").alias("doc_id")))
    scratch.release()
    placed = hoods.join(prefix.select("doc_id", "prefix", "shingles"), "doc_id")
    large = hoods.groupBy("hood").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block)
    stars = None
    if large.limit(1).count():
        star = _stars(placed.join(large, "hood", "left_semi"), num, den, scratch, rounds)
        placed = placed.join(star, "doc_id", "left").withColumn("star", F.coalesce("star", "doc_id"))
        stars = star.filter("star <> doc_id").select(F.col("doc_id").alias("a"), F.col("star").alias("b"))
    else:
        placed = placed.withColumn("star", F.col("doc_id"))
    shards = B.parts(prefix, 4 << 20, 24)
    links = _tasks(placed, block, shards).groupBy("shard").applyInArrow(B.grouped(_block_links(num, den, orders)), "a long, b long")
    if stars is not None:
        links = links.unionByName(stars)
    roots = components(links, scratch)
    scratch.release()
    reach = leads.join(roots, leads["lead"] == roots["node"], "left").select(*key, F.coalesce("root", "lead").alias("component_id"))
    found_ = members.join(reach, key).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return index.select("doc_id", "n_shingles").join(found_, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


#: Up to so many ids of copies, 8 bytes each, are broadcast; beyond, both sides are shuffled.
MOST_BROADCAST = 2_000_000


def keep_representatives(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", scratch: Scratch | None = None, **settings) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; columns as they were.

    Null and empty texts and null ids stay; rows with one id stay or go together; an
    empty table stays empty.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    found = join(docs, id_=id_, text=text, scratch=scratch, **settings).filter("component_id <> doc_id")
    (copy,) = free_names(docs, "__copy")
    found = scratch.save(found.select(F.col("doc_id").alias(copy)).distinct())
    found = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    return docs.join(found, F.col(f"`{id_}`") == F.col(copy), "left_anti")
