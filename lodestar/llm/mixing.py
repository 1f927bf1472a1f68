"""Mixing sources to target weights along a time-varying curriculum.

Targets follow the sources' weights, are capped at a multiple of the source's own
size, and what a cap sets free is shared again by weight.  Each source also has a
schedule: how its weight runs over training time.  The schedule is integrated to a
cumulative demand; a document whose words begin where the source has supplied c
words is trained at the time when that demand reaches c.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, free_names

WORD = r"[^\x20\x09-\x0D]+"
#: Order of documents within a source: 60 bits of a hash of the id, which any engine can compute.
HASH_BITS = 60


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """Adds target to one row for each source (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn.  With sources
    ordered by cap over weight, exactly a first part of them is capped: the first
    source whose fair share is not above its cap ends it, and the level found there
    holds for all others.  All sums are of whole numbers, so results repeat exactly.
    The windows run over sources, not documents.
    """
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    s = sizes.withColumn("class", k.cast("int")).withColumn("weight", w).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("at", F.row_number().over(order))
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    fair = F.col("left") * F.col("weight") <= F.col("most") * F.col("weights")
    s = s.withColumn("first", F.min(F.when(fair, F.struct("at", "left", "weights"))).over(everything))
    level = F.col("weight") * F.col("first.left") / F.col("first.weights")
    return s.select("source", "source_size", "class", F.when(F.col("at") < F.col("first.at"), F.col("most").cast("double")).otherwise(level).alias("target"))


def when_supplied(share: Column, knots: Column, n: int) -> Column:
    """The time in [0, 1] at which a schedule has asked for ``share`` of its total.

    knots: the schedule's weights at n evenly spaced times, linear in between,
    scaled so that it integrates to 1.
    """
    width = 1.0 / (n - 1)
    area = [(F.get(knots, F.lit(i)) + F.get(knots, F.lit(i + 1))) * (width / 2) for i in range(n - 1)]
    out, done = F.lit(1.0), [F.lit(0.0)]
    for a in area:
        done.append(done[-1] + a)
    for i in reversed(range(n - 1)):
        y, slope = F.get(knots, F.lit(i)), (F.get(knots, F.lit(i + 1)) - F.get(knots, F.lit(i))) / width
        rest = share - done[i]
        # slope/2 x^2 + y x = rest, in the form that also holds without slope
        x = F.try_divide(2 * rest, y + F.sqrt(F.greatest(y * y + 2 * slope * rest, F.lit(0.0))))
        out = F.when((share < done[i + 1]) | F.lit(i == n - 2), i * width + F.coalesce(x, F.lit(0.0))).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def mix(
    docs: DataFrame, *, id_: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
    schedules: Sequence[Sequence[float]] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)), cap: int = 3, share: float = 1.0, buckets: int = 1024, scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, takes.

    taken: words the mix takes, repeats counted; a source's taken words are its
    target rounded down.  takes: an array of (pass, words, position), position being
    the training time in [0, 1).  Documents come in hash order within a source, whole
    passes first; the last, partial pass ends inside one document.  Null and empty
    texts have size 0 and are never taken.  Repeated rows are documents of their own.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    base = docs.select(F.col(id_).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), h.alias("h"))
    base = scratch.save(base.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << HASH_BITS)) * buckets).cast("int")))
    parts = base.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    goals = targets(base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, cap)
    goals = goals.withColumn("target", F.col("target") * F.lit(float(share)))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(by_bucket), F.lit(0))).drop("n")
    parts = parts.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    parts = parts.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    own = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = base.withColumn("own", own).join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = rows.withColumn("begins", F.col("before") + F.col("own"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", whole)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.floor("target").cast("long") - F.col("passes") * F.col("source_size") - F.col("begins")))
    rows = rows.withColumn("part", part.cast("long"))
    n = max(len(x) for x in schedules)
    curves = F.array(*[F.array(*[F.lit(y) for y in _even(x, n)]) for x in schedules])
    knots = F.element_at(curves, (F.col("class") % len(schedules) + 1).cast("int"))

    def place(e: Column) -> Column:
        return when_supplied(F.try_divide((e * F.col("source_size") + F.col("begins")).cast("double"), F.col("target")), knots, n)

    full = F.when((F.col("passes") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes") - 1, F.lit(0))), lambda e: F.struct(e.alias("pass"), F.col("size").alias("words"), place(e).alias("position"))))
    last = F.when(F.col("part") > 0, F.array(F.struct(F.col("passes").alias("pass"), F.col("part").alias("words"), place(F.col("passes")).alias("position"))))
    none = F.array().cast("array<struct<pass:bigint,words:bigint,position:double>>")
    takes = F.concat(F.coalesce(full, none), F.coalesce(last, none))
    taken = (F.col("passes") * F.col("size") + F.col("part")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), takes.alias("takes"))


def _even(schedule: Sequence[float], n: int) -> list[float]:
    """The schedule at n evenly spaced times, scaled to an integral of 1."""
    at = [i * (len(schedule) - 1) / (n - 1) for i in range(n)]
    y = [schedule[int(x)] + (x - int(x)) * (schedule[min(int(x) + 1, len(schedule) - 1)] - schedule[int(x)]) for x in at]
    area = sum((a + b) / 2 for a, b in zip(y, y[1:], strict=False)) / (n - 1)
    return [v / area for v in y]


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each take, range-sorted by position: the order of training."""
    return mixed.select("doc_id", "source", F.explode("takes").alias("take")).select("doc_id", "source", "take.*").orderBy("position", "doc_id", "pass")


def apply_mix(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", source: str = "source", scratch: Scratch | None = None, **settings) -> DataFrame:
    """``docs`` as often as the mix takes them, in training order; columns as they were.

    A partial take counts as whole from half of the document on, so a source's words
    come within one document of its target.  Documents that the mix never takes go.
    Rows that share an id are told apart by their size and text.
    """
    key, size, n, s, m, at, turn = free_names(docs, "__id", "__size", "__n", "__s", "__m", "__at", "__pass")
    mixed = mix(docs, id_=id_, text=text, source=source, scratch=scratch, **settings)
    twin = F.row_number().over(Window.partitionBy("doc_id", "size").orderBy("source", "taken"))
    mixed = mixed.withColumn("twin", twin).withColumn("take", F.explode("takes")).filter("2 * take.words >= size")
    mixed = mixed.select(F.col("doc_id").alias(key), F.col("size").alias(s), F.col("twin").alias(m), F.col("take.position").alias(at), F.col("take.pass").alias(turn))
    rows = docs.withColumn(size, words(F.col(f"`{text}`")))
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(F.col(f"`{id_}`"), size).orderBy(F.col(f"`{source}`"), F.xxhash64(F.col(f"`{text}`")))))
    joined = rows.join(mixed, F.col(f"`{id_}`").eqNullSafe(F.col(key)) & (F.col(size) == F.col(s)) & (F.col(n) == F.col(m)))
    return joined.orderBy(at, key, turn).select(*[F.col(f"`{c}`") for c in docs.columns])
