"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

A vector lies in the cell of its nearest centroid, and is a guest of every earlier cell
whose border is within the greatest distance two linked unit vectors can have; so each
link is seen in the earlier of the cells of its ends, and none is lost.  Cells are cut
into blocks so large that moving a block costs little beside its products; each pair of
blocks is a task of its own, which counts links and lets out a spanning forest of them
instead of pairs.  Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from . import vectors as V
from .graph import Forest, components
from .scratch import Scratch, small_batches


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors; empty cells take vectors that lie far from theirs."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        s = x @ c.T
        cell, best = s.argmax(1), s.max(1)
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        norm = np.sqrt((total * total).sum(1))
        empty = np.flatnonzero(norm < 1e-9)
        c = total / np.maximum(norm, 1e-9)[:, None]
        c[empty] = x[np.argsort(best)[: len(empty)]]
    return c


def guests(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, cell, whether it is the vector's own) of unit vectors.

    A vector at most ``reach`` away from one that lies beyond the plane between two
    centroids is itself at most that far from the plane.  Of two cells the earlier one
    has the guests.
    """
    s = x @ centroids.T
    own = s.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    near = s[np.arange(len(x)), own][:, None] - s <= reach * apart[own] + 1e-9
    near &= np.arange(len(centroids))[None, :] <= own[:, None]
    near[np.arange(len(x)), own] = True
    row, cell = np.nonzero(near)
    return row, cell, own[row] == cell


def _linked(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of two tiles have a cosine of ``least``; x, y: original vectors, a, b: unit ones in single precision."""
    s = a @ b.T
    out = s >= least
    i, j = np.nonzero(np.abs(s - least) <= V.ROUNDING)
    for k in range(0, len(i), 1 << 14):
        p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        out[p, q] = V.cosine(x[p], y[q]) >= least
    return out


def block_links(x: np.ndarray, own: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each row's linked rows, spanning forest of the links as pairs of rows).

    left, right: rows of the two blocks, the same ones for a block with itself.  Two
    guests are not compared: their pair is another cell's.
    """
    unit = V.unit(x.astype(np.float64)).astype(np.float32)
    count, forest, same = np.zeros(len(x), np.int64), Forest(len(x)), left is right
    for i in range(0, len(left), tile):
        p = left[i : i + tile]
        for j in range(i if same else 0, len(right), tile):
            q = right[j : j + tile]
            m = _linked(x[p], unit[p], x[q], unit[q], least)
            m &= own[p][:, None] | own[q][None, :]
            diagonal = same and i == j
            if diagonal:
                np.fill_diagonal(m, False)
            if not m.any():
                continue
            count[p] += m @ weight[q]
            if not diagonal:
                count[q] += weight[p] @ m
            # the first link of each row, then whatever still joins two trees
            some = np.flatnonzero(m.any(1))
            for u, v in zip(p[some].tolist(), q[m[some].argmax(1)].tolist(), strict=True):
                forest.join(u, v)
            while True:
                roots = forest.roots()
                u, v = np.nonzero(m & (roots[p][:, None] != roots[q][None, :]))
                if not len(u):
                    break
                _, one = np.unique(roots[p[u]], return_index=True)
                for y, z in zip(p[u[one]].tolist(), q[v[one]].tolist(), strict=True):
                    forest.join(y, z)
    return count, forest.links()


def dedup(
    df: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", label: str | None = "label", least: float = 0.98,
    cell_rows: int = 16384, most_cells: int = 1024, sample: int = 20_000, block: int = 16384, shard_rows: int = 4096, scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors of one length with equal labels, not null, link when their cosine in double
    precision is ``least`` or more.  n_links counts the other vectors linked directly;
    component_id is the smallest id reachable by links, itself included; kept says
    that it is the vector's own.  Vectors that are null, zero or hold null or
    non-finite components, or whose label or id is null, link with nothing.  Centroids
    are fitted on about ``sample`` vectors, for each length that those have; vectors of
    other lengths are one cell, and cells of any size are compared in full, by blocks.
    Repeated rows are vectors like any other; rows with one id share a component, and
    their links are added up.  An empty table stays empty.
    """
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession)
    small_batches(spark)
    number = V.kind(df, vector)
    rows = df.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("v"), (F.col(label) if label else F.lit(0)).cast("string").alias("label"))
    good = V.usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # equal vectors with one label are one class, known by 128 bits; its smallest id stands for it
    keyed = rows.withColumn("k1", F.when(good, F.xxhash64("label", "v"))).withColumn("k2", F.when(good, F.xxhash64("v", "label", F.lit(1))))
    classes = keyed.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.save(classes)
    n = classes.count()
    share = min(1.0, sample / max(n, 1)) * (1 << 30)
    picked = keyed.filter(F.col("k1").isNotNull() & (F.pmod("k1", F.lit(1 << 30)) < share)).dropDuplicates(["k1", "k2"]).orderBy("k1", "k2").limit(2 * sample)
    lengths: dict[int, list] = {}
    for r in picked.select("v").collect():
        lengths.setdefault(len(r["v"]), []).append(r["v"])
    cells = max(1, min(most_cells, n // cell_rows))
    centroids = {d: kmeans(V.unit(np.array(x, np.float64)), max(1, round(cells * len(x) / sum(map(len, lengths.values()))))) for d, x in lengths.items()}
    reach = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in V.by_length(b, 1):
                c = centroids.get(x.shape[1], np.ones((1, x.shape[1])) / math.sqrt(x.shape[1]))
                row, cell, own = guests(V.unit(x), c, reach)
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array(np.full(len(row), x.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array(own), b.column(2).take(take), b.column(3).take(take), V.packed(x[row], number)],
                    names=["label", "length", "cell", "own", "lead", "weight", "v"],
                )

    leads = keyed.join(classes, ["k1", "k2"]).filter("vec_id = lead").dropDuplicates(["k1", "k2"])
    group = ["label", "length", "cell"]
    placed = leads.select("label", "v", "lead", "weight").mapInArrow(B.streamed(place), "label string, length int, cell int, own boolean, lead long, weight long, v binary")
    placed = scratch.save(placed)
    sizes = placed.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    tasks = placed.join(sizes, group).withColumn("mine", F.pmod(F.xxhash64("lead"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select(
        *group, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "own", "lead", "weight", "v",
    )
    # small cells share a task
    tasks = tasks.withColumn("shard", F.pmod(F.xxhash64(*group, "lo", "hi"), F.lit(max(24, n // shard_rows))).cast("int"))

    def link(shard: pa.Table) -> pa.Table:
        keys = [*group, "lo", "hi"]
        shard = shard.sort_by([(c, "ascending") for c in keys])
        at = np.append(np.flatnonzero(~shard.select(keys).to_pandas().duplicated().to_numpy()), shard.num_rows)
        out = [np.zeros((0, 3), np.int64)]
        for s, e in zip(at.tolist(), at[1:].tolist(), strict=False):
            part = shard.slice(s, e - s)
            side, own, lead, weight = (part[c].to_numpy() for c in ("side", "own", "lead", "weight"))
            left = np.flatnonzero(side != 1)
            right = left if (side == 2).all() else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            count, forest = block_links(V.unpacked(part["v"], number), own, weight, left, right, least)
            some = np.flatnonzero(count)
            out.append(np.stack([lead[some], np.full(len(some), -1), count[some]], 1))
            out.append(np.concatenate([lead[forest], np.zeros((len(forest), 1), np.int64)], 1))
        flat = np.concatenate(out)
        return pa.table({"a": flat[:, 0], "b": flat[:, 1], "n": flat[:, 2]})

    out = scratch.save(tasks.groupBy("shard").applyInArrow(B.grouped(link), "a long, b long, n long"))
    counts = out.filter("n > 0").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "lead")
    roots = components(out.filter("n = 0").select("a", "b"), scratch).withColumnRenamed("node", "lead")
    known = classes.join(counts, "lead", "left").join(roots, "lead", "left").select("k1", "k2", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"), F.coalesce("root", "lead").alias("root"))
    found = keyed.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    found = found.select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
