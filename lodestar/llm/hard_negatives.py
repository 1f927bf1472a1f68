"""Hard negatives by ball trees: the best inner products inside a window of scores.

Rows are dealt into blocks of one label each, of rows that lie near each other if there
are many.  A block's task builds a ball tree over its rows and asks it for a batch of
anchors at a time.  The inner product of an anchor with any row of a ball lies within
the anchor's length times the ball's radius of its product with the ball's centre; a
ball is left out if all of that lies outside the anchor's window of scores, or strictly
below the anchor's k-th best so far.

The whole block is a ball too.  Before rows move, anchors are compared with the blocks'
balls in the same way, and go only where something may be found.  Both comparisons are
of tiles of bounded size: so many anchors with so many blocks, or with one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytescan as B
from . import vectors as V
from .scratch import Scratch, small_batches

BLOCK = ["length", "label", "cell", "part"]
BLOCK_TYPE = "length int, label long, cell int, part int"
#: Below all scores; and scores beyond this in magnitude count as this.
NONE, MOST = -(1 << 62), 1 << 56
#: Whole numbers up to this are exact in double precision.
EXACT = float(1 << 53)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers, in single precision where that holds them exactly."""
    small = np.abs(x).max(1, initial=0) <= 1 << 24
    return pa.array([(r.astype(np.float32) if s else r).tobytes() for r, s in zip(x, small.tolist(), strict=True)], pa.binary())


def unpacked(values: list, length: int) -> np.ndarray:
    out = np.empty((len(values), length))
    for i, v in enumerate(values):
        out[i] = np.frombuffer(v, np.float32 if len(v) == 4 * length else np.float64)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        top = np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max())  # bounds all partial sums too
    if top < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.array([[min(MOST, max(-MOST, int(v))) for v in r] for r in whole(a) @ whole(b).T], np.int64).reshape(len(a), len(b))


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, radius) of a ball that holds all rows."""
    with np.errstate(over="ignore"):
        centre = x.mean(0)
        return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + 1e-9)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of each q's scores with rows of each ball; rounding and overflow only widen them."""
    with np.errstate(over="ignore", invalid="ignore"):
        mid, reach = q @ centre.T, np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
        slack = 1 + 1e-9 * (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((centre * centre).sum(1))[None, :] + reach)
        lower, upper = mid - reach - slack, mid + reach + slack
    return np.where(lower < MOST, lower, np.where(np.isnan(lower), -np.inf, MOST)), np.where(upper > -MOST, upper, np.where(np.isnan(upper), np.inf, -MOST))


class Best:
    """The k best (score, row) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, ids: np.ndarray):
        self.k, self.ids = k, ids
        self.score, self.row = np.full((queries, k), NONE, np.int64), np.zeros((queries, k), np.int64)

    def kth(self, at: np.ndarray) -> np.ndarray:
        return self.score[at, -1]

    def meet(self, at: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        """Scores of some queries with some rows; NONE where a row does not count."""
        s = np.concatenate([self.score[at], scores], 1)
        r = np.concatenate([self.row[at], np.broadcast_to(rows, scores.shape)], 1)
        least = np.partition(s, s.shape[1] - self.k, 1)[:, s.shape[1] - self.k]
        q, c = np.nonzero((s >= least[:, None]) & (s > NONE))
        order = np.lexsort((self.ids[r[q, c]], -s[q, c], q))
        q, c = q[order], c[order]
        place = B.runs_in(np.bincount(q, minlength=len(at)))
        keep = place < self.k
        q, c, place = q[keep], c[keep], place[keep]
        self.score[at] = NONE
        self.score[at[q], place], self.row[at[q], place] = s[q, c], r[q, c]


class Tree:
    """A ball tree of a block's rows, halved across their widest extent down to leaves."""

    def __init__(self, x: np.ndarray, leaf: int = 64):
        self.x, self.order = x, np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, end, left, right (-1 in a leaf)
        centres, radii = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, z, up, side = todo.pop()
            own, centre_radius = self.order[a:z], ball(x[self.order[a:z]])
            centres.append(centre_radius[0])
            radii.append(centre_radius[1])
            me = len(self.nodes)
            self.nodes.append((a, z, -1, -1))
            if up >= 0:
                p = self.nodes[up]
                self.nodes[up] = (p[0], p[1], me, p[3]) if side == 0 else (p[0], p[1], p[2], me)
            if z - a > leaf and centre_radius[1] > 0:
                mid, pts = (z - a) // 2, x[own]
                with np.errstate(over="ignore", invalid="ignore"):
                    far = pts[((pts - centre_radius[0]) ** 2).sum(1).argmax()]
                    other = pts[((pts - far) ** 2).sum(1).argmax()]
                    self.order[a:z] = own[np.argpartition(pts @ (other - far), mid)]
                todo += [(a + mid, z, me, 1), (a, a + mid, me, 0)]
        self.centre, self.radius = np.array(centres), np.array(radii)

    def search(self, best: Best, q: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, skip: np.ndarray | None = None) -> int:
        """Meets all rows that may count; returns how many products were taken.

        Query i asks with vector q[of[i]] for scores from low[i] to high[i], ends included;
        ``skip``: a row for each vector that does not count, or -1.
        """
        lower, upper = bounds(q, self.centre, self.radius)
        taken, todo = 0, [(0, np.arange(len(of)))]
        while todo:
            node, at = todo.pop()
            up = upper[of[at], node]
            at = at[(up >= np.maximum(low[at], best.kth(at))) & (lower[of[at], node] <= high[at])]
            if not len(at):
                continue
            a, z, left, right = self.nodes[node]
            if left >= 0:
                # the ball that promises more is searched first, so that the other one meets a higher k-th
                first, then = (left, right) if upper[of[at], left].sum() >= upper[of[at], right].sum() else (right, left)
                todo += [(then, at), (first, at)]
                continue
            vectors, inverse = np.unique(of[at], return_inverse=True)
            rows = self.order[a:z]
            scores = products(q[vectors], self.x[rows])
            taken += scores.size
            if skip is not None:
                scores[skip[vectors][:, None] == rows[None, :]] = NONE
            scores = scores[inverse]
            scores[(scores < low[at, None]) | (scores > high[at, None])] = NONE
            best.meet(at, scores, rows)
        return taken


FOUND = "anchor long, place int, id long, row long, score long"


def _search(k: int, leaf: int):
    """One block (rows without ``ask``) and a batch of anchors, each with its windows."""

    def run(tile: pa.Table) -> pa.Table:
        length, ask = int(tile["length"][0].as_py()), tile["ask"].to_numpy()
        x = unpacked(tile["v"].to_pylist(), length)
        uid, ids = tile["uid"].to_numpy(), tile["id"].to_numpy()
        a, c = np.flatnonzero(ask), np.flatnonzero(~ask)
        out = [np.zeros(0, np.int64)] * 5
        if len(a) and len(c):
            windows = [tile["windows"][int(i)].as_py() for i in a]
            of = np.repeat(np.arange(len(a)), [len(w) for w in windows])
            place, low, high = (np.array([w[f] for ws in windows for w in ws], np.int64) for f in ("place", "low", "high"))
            # no anchor is its own positive
            where = {u: i for i, u in enumerate(uid[c].tolist())}
            skip = np.array([where.get(u, -1) for u in uid[a].tolist()], np.int64)
            tree, best = Tree(x[c], leaf), Best(len(of), k, ids[c])
            tree.search(best, x[a], of, low, high, skip)
            q, n = np.nonzero(best.score > NONE)
            row = c[best.row[q, n]]
            out = [uid[a][of[q]], place[q], ids[row], uid[row], best.score[q, n]]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def _route(k: int, same: bool):
    """Anchors and the balls of blocks: which of them may hold one of an anchor's k best."""

    def run(tile: pa.Table) -> pa.Table:
        length, ask = int(tile["length"][0].as_py()), tile["ask"].to_numpy()
        a, c = np.flatnonzero(ask), np.flatnonzero(~ask)
        label, uid = tile["label"].to_numpy(), tile["uid"].to_numpy()
        q, block = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a) and len(c):
            of = unpacked(tile["v"].take(pa.array(a)).to_pylist(), length)
            centre = np.array([np.frombuffer(v.as_py(), np.float64) for v in tile["v"].take(pa.array(c))])
            lower, upper = bounds(of, centre, tile["radius"].to_numpy()[c])
            sizes = tile["size"].to_numpy()[c]
            may = (label[a][:, None] == label[c][None, :]) == same
            go = np.zeros(may.shape, bool)
            windows = [tile["windows"][int(i)].as_py() for i in a]
            for n in range(max(map(len, windows), default=0)):
                has = np.array([len(w) > n for w in windows])
                low, high = (np.array([w[n][f] if len(w) > n else 0 for w in windows], np.int64)[:, None] for f in ("low", "high"))
                # a block that lies inside the window and has k rows beside the anchor bounds the k-th from below
                inside = may & (lower >= low) & (upper <= high) & (sizes > k)[None, :]
                least = np.where(inside, lower, -np.inf).max(1, keepdims=True)
                go |= has[:, None] & may & (lower <= high) & (upper >= np.maximum(low, least))
            q, block = np.nonzero(go)
        found = {"anchor": pa.array(uid[a][q] if len(a) else q, pa.int64()), "length": pa.array(np.full(len(q), length), pa.int32()), "label": pa.array(label[c][block] if len(c) else block, pa.int64())}
        for name in ("cell", "part"):
            found[name] = pa.array(tile[name].to_numpy()[c][block] if len(c) else block, pa.int32())
        return pa.table(found)

    return run


def _pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Up to n unit vectors of the table by length of their lists, a choice that only depends on the rows."""
    out: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("v"), "id", "uid").limit(n).select("length", "v").collect():
        out.setdefault(r.length, []).append(unpacked([r.v], r.length)[0])
    return {k: np.array(v) / np.maximum(np.sqrt((np.array(v) ** 2).sum(1, keepdims=True)), 1e-300) for k, v in out.items()}


def mine(
    df: DataFrame, anchors: Column, *, label: Column | str = "label", id_: str = "vec_id", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, block: int = 8192, batch: int = 4096, leaf: int = 64, most_pivots: int = 1024, scratch: Scratch | None = None,
) -> DataFrame:
    """For each row for which ``anchors`` holds and each of its positives, the best rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x) in double precision, and a score is the
    whole inner product of two rows.  An anchor's positives are the ``positives`` best other
    rows of its label, of negatives there are up to ``negatives``.  Ties go to the smaller
    id.  Where there is nothing inside the window, or no positive, no row comes out; a
    negative positive's score leaves no window.

    Rows with a null id or label, a null vector or null or non-finite components take no
    part; zero vectors do.  Vectors of different lengths have no score and are not
    compared.  Rows with one id are rows of their own: each can be an anchor, a positive
    and a negative of the others, and has its rank.  Scores beyond 2**56 in magnitude
    count as that.  Further columns are ignored, whatever their names; an empty table, or
    one without anchors, gives no rows.

    All rows are searched, exactly.  Only which rows lie in one block is decided with a
    sample: up to ``most_pivots`` rows, the same for the same table.
    """
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession)
    small_batches(spark)
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), v.isNotNull().alias("there"), F.coalesce(finite, F.lit(False)).alias("finite"), scaled.alias("v"))
    rows = rows.filter("there AND finite AND id IS NOT NULL AND label IS NOT NULL").drop("there", "finite").withColumn("uid", F.monotonically_increasing_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("v")
            for some, x in V.by_length(b, at):
                own = b.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([own.column("uid"), own.column("id"), own.column("label"), own.column("asks"), pa.array(np.full(len(some), x.shape[1], np.int32)), packed(np.floor(x))], names=["uid", "id", "label", "asks", "length", "v"])

    rows = scratch.save(rows.mapInArrow(B.streamed(pack), "uid long, id long, label long, asks boolean, length int, v binary"))
    # tiles hold so many bytes at most, however long the vectors are
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(1))).first()
    block, batch = (max(64, min(x, (16 << 20) // (8 * max(1, width)))) if x > 64 else x for x in (block, batch))
    pivots = _pivots(rows, min(most_pivots, n // block)) if n > block else {}

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, values = b.column("length").to_numpy(), b.column("v").to_pylist()
            cell = np.zeros(b.num_rows, np.int32)
            for k, p in pivots.items():
                at = np.flatnonzero(lengths == k)
                if len(at) and len(p) > 1:
                    cell[at] = (unpacked([values[i] for i in at], k) @ p.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    # blocks of at most about ``block`` rows, of one label and cell each
    celled = scratch.save(rows.mapInArrow(B.streamed(file), "uid long, id long, label long, asks boolean, length int, v binary, cell int"))
    counts = celled.groupBy("length", "label", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    filed = celled.join(counts, ["length", "label", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int")).drop("parts")
    filed = scratch.save(filed)
    scratch.drop(rows)
    scratch.drop(celled)
    tasks = max(24, -(-n // block))

    def summary(t: pa.Table) -> pa.Table:
        centre, radius = ball(unpacked(t["v"].to_pylist(), int(t["length"][0].as_py())))
        return pa.table({**{c: t[c].slice(0, 1) for c in BLOCK}, "size": pa.array([len(t)], pa.int64()), "radius": pa.array([radius]), "v": pa.array([centre.tobytes()], pa.binary())})

    balls = scratch.save(filed.select(*BLOCK, "v").repartition(tasks, *BLOCK).groupBy(*BLOCK).applyInArrow(B.grouped(summary), f"{BLOCK_TYPE}, size long, radius double, v binary"))
    window = "array<struct<place:int,low:long,high:long>>"
    none = F.lit(None)

    def best(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """FOUND for ``asked`` (uid, id, label, length, v, windows), no more than k rows of each window."""
        # pages of at most about 512 balls; of one label's only, where those of others cannot be
        keys = ["length", "label"] if same else ["length"]
        pages = balls.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / 512).cast("int").alias("pages"))
        batches = F.greatest(F.lit(1), F.ceil(F.lit(asked.count()) / 2048)).cast("int")
        turn = F.pmod(F.xxhash64("uid"), batches).cast("int")
        columns = ["length", "label", "cell", "part", "page", "turn", "ask", "uid", "size", "radius", "v", "windows"]
        left = balls.join(pages, keys).withColumns({"page": F.pmod(F.xxhash64("label", "cell", "part"), "pages").cast("int"), "turn": F.explode(F.sequence(F.lit(0), batches - 1)), "ask": F.lit(False), "uid": none.cast("long"), "windows": none.cast(window)})
        right = asked.join(pages, keys).withColumns({"page": F.explode(F.sequence(F.lit(0), F.col("pages") - 1)), "turn": turn, "ask": F.lit(True), "cell": F.lit(0), "part": F.lit(0), "size": none.cast("long"), "radius": none.cast("double")})
        groups = [*keys, "page", "turn"]
        routed = left.select(columns).unionByName(right.select(columns)).groupBy(*groups).applyInArrow(B.grouped(_route(k, same)), f"anchor long, {BLOCK_TYPE}")
        routed = scratch.save(routed)
        turns = routed.groupBy(*BLOCK).agg(F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("turns"))
        columns = [*BLOCK, "turn", "ask", "uid", "id", "v", "windows"]
        left = filed.drop("asks").join(turns, BLOCK).withColumns({"turn": F.explode(F.sequence(F.lit(0), F.col("turns") - 1)), "ask": F.lit(False), "windows": none.cast(window)})
        sent = asked.select(F.col("uid").alias("anchor"), "uid", "id", "v", "windows")
        right = routed.join(turns, BLOCK).join(sent, "anchor").withColumns({"turn": F.pmod(F.xxhash64("anchor"), "turns").cast("int"), "ask": F.lit(True)})
        tiles = left.select(columns).unionByName(right.select(columns)).repartition(tasks, *BLOCK, "turn")
        found = tiles.groupBy(*BLOCK, "turn").applyInArrow(B.grouped(_search(k, leaf)), FOUND)
        rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    asked = filed.filter("asks").select("uid", "id", "label", "length", "v")
    anywhere = F.array(F.struct(F.lit(0).alias("place"), F.lit(-MOST).alias("low"), F.lit(MOST).alias("high")))
    pairs = scratch.save(best(asked.withColumn("windows", anywhere), positives, True).select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole numbers s with low * p <= 100 * s <= high * p
    window_of = F.expr(f"struct(place, -(((-{low} * positive_score) - pmod(-{low} * positive_score, 100L)) div 100) as low, (({high} * positive_score) - pmod({high} * positive_score, 100L)) div 100 as high)")
    windows = pairs.groupBy("anchor").agg(F.collect_list(window_of).alias("windows"))
    found = best(asked.join(windows.withColumnRenamed("anchor", "uid"), "uid"), negatives, False)
    own = asked.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    out = found.join(pairs, ["anchor", "place"]).join(own, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
