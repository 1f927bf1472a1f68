"""The trie of all conversations' prefixes, from globally sorted turn arrays.

Equal conversations are merged first, so that however many there are of one, a single
row of them is sorted.  A conversation is the string of its turns' digests; these
strings are range-partitioned and sorted, so that the conversations with a common
prefix stand together.  Each range is swept once with a stack: where neighbours agree
in their first d turns, the nodes below d close and are let out.

The nodes that hold a range's first or its last conversation may go on in other ranges.
Their part of the counts is kept as the range's spine.  When all ranges are swept, each
spine is compared with its neighbours' ends, which says who counts a shared node as its
own, and the parts of one node are added up.  Spines are as few as ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytescan as B
from .scratch import Scratch, small_batches

#: Bytes that stand for a turn: the first half of the SHA-256 of its role and text.
TURN = 16
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SPINE = "pid int, first binary, last binary, left int, depths array<int>, n array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>, words array<int>, ends array<string>"
PART = "node binary, parent binary, depth int, n long, least long, children long, leaves long, saved long, ends string"


def node_key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * TURN]).digest()[:TURN] if depth else b""


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginnings."""
    lo, hi = 0, min(len(a), len(b)) // TURN
    if a[: hi * TURN] == b[: hi * TURN]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo * TURN : mid * TURN] == b[lo * TURN : mid * TURN] else (lo, mid)
    return lo


class Open:
    """A node on the stack, and what its closed descendants have told it."""

    __slots__ = ("children", "closed", "depth", "ends", "leaves", "least", "n", "on_left", "saved", "words")

    def __init__(self, depth: int, words: int, on_left: bool):
        self.depth, self.words, self.on_left = depth, words, on_left
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.closed = None, None, []

    def meet(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None or least < self.least else self.least


def sweep(pid: int, rows: Iterator[tuple[bytes, list, int, int, str]], flush: int = 50_000) -> Iterator[tuple[str, list]]:
    """('node', rows of NODE) and at last ('spine', one row of SPINE), from one range's sorted rows.

    A row: path, words of each turn, number of conversations, the smallest of them,
    digest of all of them.  Closed nodes know their parents' smallest member, unless the
    parent is on the spine: then they have its key.
    """
    first = last = None
    stack, spine_left, out = [], [], []

    def close() -> None:
        x = stack.pop()
        if stack:
            stack[-1].meet(x.n, x.least)
        if x.on_left:
            settle(x, node_key(first, x.depth))
            spine_left.append(x)
            return
        leaf = not x.children
        x.leaves += leaf
        x.saved += (x.n - 1) * x.words
        up = stack[-1]
        up.children += 1
        up.leaves += x.leaves
        up.saved += x.saved
        settle(x, None)
        up.closed.append((x.least, x.depth, x.n, x.children, x.leaves, x.saved, x.ends or NOTHING))

    def settle(x: Open, key: bytes | None) -> None:
        """Lets out the closed children: their parent is known now, or by key if it is on the spine."""
        for least, depth, n, children, leaves, saved, ends in x.closed:
            out.append((least, depth, None if key is not None else x.least, key, n, children, leaves, saved, ends))
        x.closed.clear()

    for path, words, n, least, ends in rows:
        depth = len(path) // TURN
        if first is None:
            first, stack = path, [Open(0, 0, True)]
            keep = 0
        else:
            keep = common(last, path)
            while len(stack) - 1 > keep:
                close()
        for d in range(keep, depth):
            stack.append(Open(d + 1, words[d], last is None))
        stack[-1].meet(n, least)
        stack[-1].ends = ends
        last = path
        if len(stack[0].closed) > flush:
            settle(stack[0], b"")
        if len(out) > flush:
            yield "node", out
            out = []
    if first is None:
        return
    # the rest of the stack is the right spine; counts go up, all else waits for the neighbours
    right = []
    while stack:
        x = stack.pop()
        if stack:
            stack[-1].meet(x.n, x.least)
        settle(x, node_key(last, x.depth))
        right.append(x)
    yield "node", out
    spine = [*spine_left, *right]
    yield "spine", [(pid, first, last, len(spine_left), *[[getattr(x, a) for x in spine] for a in ("depth", "n", "least", "children", "leaves", "saved", "words", "ends")])]


def stitch(first: bytes, last: bytes, before: bytes | None, after: bytes | None, left: int, spine: list[dict]) -> Iterator[tuple]:
    """A range's parts of the nodes of its spine, as rows of PART.

    spine: deepest first, the first ``left`` on the first conversation's side only; the
    topmost of these hangs on a node that both sides share.  A node that the range before
    has too is counted there as a child and with its words; here only what hangs below it.
    """
    seen = common(before, first) if before is not None else -1
    extends = after is not None and len(after) > len(last) and after.startswith(last)
    told: dict[int, list] = {}  # depth of a node: its children on the spine, and their children, leaves, saved
    beside: dict[int, list] = {}  # the same from the left side's topmost node
    for i, x in enumerate(spine):
        path, depth = (first if i < left else last), x["depth"]
        below = told.pop(depth, [0, 0, 0, 0])
        if i >= left and depth in beside:
            below = [a + b for a, b in zip(below, beside.pop(depth), strict=True)]
        children, leaves, saved = x["children"] + below[1], x["leaves"] + below[2], x["saved"] + below[3] + x["n"] * x["words"]
        own = depth > seen or not path.startswith(first[: depth * TURN])
        if own:
            leaves += not (x["children"] or below[0] or (extends and len(last) == depth * TURN and path == last))
            saved -= x["words"]
        yield node_key(path, depth), node_key(path, depth - 1) if depth else None, depth, x["n"], x["least"], children, leaves, saved, x["ends"]
        (beside if i == left - 1 else told)[depth - 1] = [1, int(own), leaves, saved]


def trie(df: DataFrame, *, id_: str = "conv_id", path: str = "path", words: str = "words", ends: str = "ends", parts: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the trie of ``df``'s paths, from the root: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``df``: a row for each distinct path: binary, TURN bytes for each turn; the words of
    each turn; n, the number of its conversations, ``id_``, the smallest of them, and
    ``ends``, a digest of all.  saved_tokens: over a node's subtree, the words of each
    node's last turn times its conversations but one.  No rows give no nodes.
    """
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession)
    small_batches(spark)
    rows = df.select(path, words, "n", id_, ends)
    parts = parts or B.parts(rows, 8 << 20)
    sorted_ = rows.repartitionByRange(parts, path).sortWithinPartitions(path).withColumn("pid", F.spark_partition_id())

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = [0]

        def each() -> Iterator[tuple]:
            for b in batches:
                if b.num_rows:
                    pid[0] = b.column(5)[0].as_py()
                yield from zip(*[b.column(i).to_pylist() for i in range(5)], strict=True)

        rows_ = each()
        head = next(rows_, None)
        if head is None:
            return
        for kind, found in sweep(pid[0], (r for part in ((head,), rows_) for r in part)):
            for s in range(0, len(found), 50_000):
                some = found[s : s + 50_000]
                nodes = struct(some if kind == "node" else [None] * len(some), NODE)
                spines = struct(some if kind == "spine" else [None] * len(some), SPINE)
                yield pa.RecordBatch.from_arrays([nodes, spines], names=["node", "spine"])

    both = scratch.save(sorted_.mapInArrow(B.streamed(swept), f"node struct<{NODE.replace(' ', ':').replace(',:', ',')}>, spine struct<{SPINE.replace(' ', ':').replace(',:', ',')}>"))
    nodes, spines = both.filter("node is not null").select("node.*"), both.filter("spine is not null").select("spine.*")
    # as many rows as there are ranges
    order = Window.orderBy("pid")
    spines = spines.withColumns({"before": F.lag("last").over(order), "after": F.lead("first").over(order)})

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                spine = [dict(zip(("depth", "n", "least", "children", "leaves", "saved", "words", "ends"), x, strict=True)) for x in zip(*[r[c] for c in ("depths", "n", "least", "children", "leaves", "saved", "words", "ends")], strict=True)]
                found = list(stitch(r["first"], r["last"], r["before"], r["after"], r["left"], spine))
                columns = zip(*found, strict=True)
                types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PART.split(", ")])

    parts_ = spines.mapInArrow(B.streamed(stitched), PART)
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    spine = scratch.save(parts_.groupBy("node", "parent", "depth").agg(*sums, F.min("least").alias("least"), F.max("ends").alias("ends")))
    up = spine.select(F.col("node").alias("parent"), F.col("least").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = spine.join(up, "parent", "left").select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    under = nodes.filter("parent is not null").drop("parent_conv_id").join(up, "parent").withColumnRenamed("above", "parent_conv_id")
    return own.unionByName(nodes.filter("parent is null").select(columns)).unionByName(under.select(columns))


def struct(rows: list, schema: str) -> pa.Array:
    """Rows (or nulls) of a schema as an Arrow struct column."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [x.split(" ", 1) for x in schema.split(", ")]
    columns = zip(*[r if r is not None else (None,) * len(fields) for r in rows], strict=True) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields], mask=pa.array([r is None for r in rows], pa.bool_()))


def turn_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def turns(df: DataFrame, *, id_: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order, as an array of (turn, digest in hex, words).

    Null turns come first; turns with one number are ordered by the digest.  Null roles
    and texts are empty, rows without an id are left out.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.filter(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(turn).alias("turn"), who.alias("role"), said.alias("text"))
    # the role's length keeps (a, bc) and (ab, c) apart
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * TURN)
    each = rows.select("id", F.struct(F.col("turn"), digest.alias("digest"), turn_words(F.col("text")).alias("words")).alias("t"))
    return each.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, *, every: int = 20, heads: int = 4) -> DataFrame:
    """(id, turns) with the first h turns of conversation id - id % every in place of the own first h.

    h is crc32 of the id in decimals, modulo ``heads``; a base conversation that is absent gives no turns.
    """
    base = convs.filter(F.col("id") % every == 0).select(F.col("id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % heads).cast("int")
    rows = convs.withColumn("h", h).withColumn("base", F.col("id") - F.col("id") % every).join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(1)))).otherwise(none)
    return rows.select("id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), own).alias("turns"))


def distinct_paths(convs: DataFrame, scratch: Scratch, piece_bytes: int = B.CHUNK) -> DataFrame:
    """(path, words, n, conv_id, ends): a row for each distinct sequence of turns.

    ends is the SHA-256 of the conversations' ids in rising order.  The ids are sorted
    over all tasks and written out in pieces, which are hashed one after the other as a
    stream: the ids of one path are never held together.
    """
    paths = convs.select("id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = scratch.save(paths.withColumn("key", F.unhex(F.sha2("path", 256))))
    merged = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("id").alias("conv_id"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size, out, total = None, None, [], 0, [], 0
        for b in batches:
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key or size > piece_bytes:
                    if held:
                        out.append((key, first, ",".join(held).encode()))
                        total += size
                    key, first, held, size = k, i, [], 0
                held.append(str(i))
                size += len(held[-1]) + 1
            if len(out) > 4096 or total > B.CHUNK:
                yield piece(out)
                out, total = [], 0
        if held:
            out.append((key, first, ",".join(held).encode()))
        if out:
            yield piece(out)

    def piece(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, done = None, None, []
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["key", "ends"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends"])

    n = B.parts(rows.select("key", "id"), 8 << 20)
    lists = rows.select("key", "id").repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(B.streamed(pieces), "key binary, first long, ids binary")
    ends = lists.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(B.streamed(hashed), "key binary, ends string")
    return merged.join(ends, "key").drop("key")


def conversation_trie(df: DataFrame, *, id_: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 20, heads: int = 4, parts: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The prefix trie of rebuilt conversations; columns as in trie().

    Nulls and ties in ``turn`` as in turns(), rebuilding as in rebuilt().  A
    conversation that is left without turns is a member of the root.  Repeated rows
    are turns of their own.  A conversation is one row of 16 bytes a turn; texts are
    read once and not moved.  Further columns are ignored, whatever their names; an
    empty table, or one without ids, gives no rows.
    """
    scratch = scratch or Scratch(df.sparkSession)
    small_batches(df.sparkSession)
    own = scratch.save(turns(df, id_=id_, turn=turn, role=role, text=text))
    return trie(distinct_paths(rebuilt(own, every=every, heads=heads), scratch), parts=parts, scratch=scratch)
