"""Models of price changes that are fitted: hidden regimes by expectation and maximisation, volatility by Newton steps.

Series are cut into chunks in order of key and time, written once; every round is a pass
over the chunks.  A series of any length is spread over tasks, and what meets in one
task for a series is a row a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables

#: Values of a chunk at most.
CHUNK = 4096


def chunks(rows: DataFrame, *, key: str = "ticker", order: Sequence[str] = ("ts",), value: str = "r", size: int = CHUNK) -> DataFrame:
    """(key, part, seq, values, whole), written: the series' values in order of (part, seq); whole: the row is all of its series.

    Rows whose value is null or not finite are left out; equal times are ordered by value.
    The first and the last series of a task's part may go on in another one, so they are never called whole.
    """
    tables.ship_code(rows.sparkSession)
    tables.bound_batches(rows.sparkSession)
    v = F.col(value).cast("double")
    kept = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], v.alias("value"))
    by = ["key", *[f"o{i}" for i in range(len(order))], "value"]
    kind = rows.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held_key, held, open_ = None, None, True  # the series that may go on in the next batch, and whether it has begun elsewhere
        for b in batches:
            if not b.num_rows:
                continue
            keys, values, out = b.column(0).to_pylist(), b.column(1).to_numpy(), []
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
                if held is not None and keys[a] == held_key:
                    held = np.concatenate([held, values[a:z]])
                else:
                    if held is not None:
                        out.append((held_key, held, not open_))
                        open_ = False
                    held_key, held = keys[a], values[a:z]
                while len(held) > size:
                    out.append((held_key, held[:size], False))
                    held, open_ = held[size:], True
            if out:
                yield table(out, b.column(0).type, part, seq)
                seq += len(out)
            kind_ = b.column(0).type
        if held is not None:
            yield table([(held_key, held, False)], kind_, part, seq)

    def table(out: list, kind_: pa.DataType, part: int, seq: int) -> pa.RecordBatch:
        columns = [pa.array([k for k, _, _ in out], kind_), pa.array([part] * len(out), pa.int32()), pa.array(range(seq, seq + len(out)), pa.int64()), pa.array([v for _, v, _ in out], pa.list_(pa.float64())), pa.array([w for _, _, w in out])]
        return pa.RecordBatch.from_arrays(columns, names=["key", "part", "seq", "values", "whole"])

    ordered = kept.repartitionByRange(*by).sortWithinPartitions(*by)
    return tables.save(ordered.select("key", "value").mapInArrow(cut, f"key {kind}, part int, seq long, values array<double>, whole boolean"))


def blocks(values: pa.Array, most: int = 1 << 15) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of similar length together: (which, their values one below the other, NaN behind the last), widths being powers of two."""
    lengths = values.value_lengths().to_numpy(zero_copy_only=False)
    widths = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        for at in range(0, len(rows), max(1, most // w)):
            which = rows[at : at + max(1, most // w)]
            out = np.full((len(which), w), np.nan)
            for i, r in enumerate(which):
                out[i, : lengths[r]] = values[int(r)].values.to_numpy()
            yield which.tolist(), out


# ---- regimes ---------------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    """Hidden regimes: mean and spread of a change in each, and moves[i][j], the chance to go from i to j."""

    means: tuple[float, ...]
    spreads: tuple[float, ...]
    moves: tuple[tuple[float, ...], ...]


class Counted:
    """Products of a chain's steps together with expected counts.

    A step is a matrix m with m[i, j] = density of the change in i times the chance to come
    from j.  For each statistic there is a matrix of the same kind whose product with the
    states before and after, over that of m, is the statistic's expected value; two parts
    combine by the product rule.  So one pass gives all counts, whatever lies before and
    after a part.
    """

    def __init__(self, m: np.ndarray, t: np.ndarray, log: np.ndarray):
        self.m, self.t, self.log = m, t, log

    @staticmethod
    def along(chain: Chain, r: np.ndarray) -> Counted:
        """Of (n, steps) changes, the steps being a power of two; a NaN is no step.

        Runs of at most ``RUN`` steps are gone through forth and back, all at once; then runs are combined.
        """
        run = min(Counted.RUN, r.shape[1])
        runs = Counted._of_runs(chain, r.reshape(-1, run))
        return runs.part_shape((len(r), -1)).whole()

    #: Steps whose products are kept at once.
    RUN = 64

    @staticmethod
    def _of_runs(chain: Chain, r: np.ndarray) -> Counted:
        mean, spread, moves = (np.array(x)[..., None] for x in (chain.means, chain.spreads, chain.moves))
        d, n = len(mean), len(r)
        none = np.isnan(r.T)  # (steps, n), series last from here on
        x = np.where(none, 0.0, r.T)[:, None] - mean
        log = -0.5 * (x / spread) ** 2 - np.log(spread) - 0.5 * np.log(2 * np.pi)
        top = log.max(1)
        m = np.exp(log - top[:, None])[:, :, None] * moves.swapaxes(0, 1)
        for i in range(d):
            for j in range(d):
                m[:, i, j][none] = float(i == j)
        before, grown = np.empty((len(m) + 1, d, d, n)), np.zeros((len(m) + 1, n))
        before[0] = np.eye(d)[..., None]
        for k in range(len(m)):
            p = (m[k][:, :, None] * before[k][None]).sum(1)
            most = p.max((0, 1))
            before[k + 1], grown[k + 1] = p / most, grown[k] + np.log(most)
        after, shrunk = np.repeat(np.eye(d)[..., None], n, 2), np.zeros(n)
        t = np.zeros((d, d, d + 2, d, n))  # by state entered, row, statistic, column
        for k in range(len(m) - 1, -1, -1):
            y = m[k][:, :, None] * before[k][None]
            z = y.sum(1)
            y = np.concatenate([y, (x[k][:, None] * z)[:, None], (x[k][:, None] ** 2 * z)[:, None]], 1)
            weight = np.where(none[k], 0.0, np.exp(grown[k] + shrunk - grown[-1]))
            t += (after * weight).swapaxes(0, 1)[:, :, None, None] * y[:, None]
            p = (after[:, :, None] * m[k][None]).sum(1)
            most = p.max((0, 1))
            after, shrunk = p / most, shrunk + np.log(most)
        moved = t[:, :, :d].transpose(4, 2, 0, 1, 3).reshape(n, d * d, d, d)
        rest = t[:, :, d:].transpose(4, 2, 0, 1, 3).reshape(n, 2 * d, d, d)
        return Counted(before[-1].transpose(2, 0, 1), np.concatenate([moved, rest], 1), grown[-1] + np.where(none, 0.0, top).sum(0))

    def part_shape(self, lead: tuple[int, ...]) -> Counted:
        return Counted(self.m.reshape(*lead, *self.m.shape[-2:]), self.t.reshape(*lead, *self.t.shape[-3:]), self.log.reshape(lead))

    def then(self, later: Counted) -> Counted:
        m = later.m @ self.m
        t = later.m[..., None, :, :] @ self.t + later.t @ self.m[..., None, :, :]
        top = m.max((-2, -1))
        return Counted(m / top[..., None, None], t / top[..., None, None, None], self.log + later.log + np.log(top))

    def whole(self) -> Counted:
        """Along the last axis, whose length is a power of two."""
        c = self
        while c.log.shape[-1] > 1:
            c = c.part(slice(0, None, 2)).then(c.part(slice(1, None, 2)))
        return c.part(0)

    def part(self, at) -> Counted:
        lead = (slice(None),) * (self.log.ndim - 1)
        return Counted(self.m[(*lead, at)], self.t[(*lead, at)], self.log[(*lead, at)])

    def expected(self) -> np.ndarray:
        """The log likelihood and the statistics of series that start from equal chances."""
        d = self.m.shape[-1]
        total = self.m.sum((-2, -1))
        return np.concatenate([(self.log + np.log(total / d))[..., None], self.t.sum((-2, -1)) / total[..., None]], -1)


def expected_counts(cut: DataFrame, chain: Chain) -> np.ndarray:
    """Over all series of chunks(): log likelihood, expected moves, and of each regime the sums of deviations and of their squares."""
    d = len(chain.means)
    size = 1 + d * d + 2 * d
    kind = cut.schema["key"].dataType.simpleString()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = [None] * b.num_rows
            for which, r in blocks(b.column("values")):
                c = Counted.along(chain, r)
                flat = np.concatenate([c.log[:, None], c.m.reshape(len(which), -1), c.t.reshape(len(which), -1)], 1)
                for i, row in zip(which, flat, strict=True):
                    out[i] = row
            columns = [b.column("key"), b.column("part"), b.column("seq"), pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "seq", "c"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total = sum(Counted.along(chain, r).expected().sum(0) for _, r in blocks(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    def folded(t: pa.Table) -> pa.Table:
        flat = np.array(t.sort_by([("part", "ascending"), ("seq", "ascending")])["c"].combine_chunks().flatten()).reshape(len(t), -1)
        c = Counted(flat[:, 1 : 1 + d * d].reshape(-1, d, d), flat[:, 1 + d * d :].reshape(len(flat), -1, d, d), flat[:, 0])
        all_ = c.part(0)
        for i in range(1, len(flat)):
            all_ = all_.then(c.part(i))
        return pa.table({"s": pa.array([all_.expected().tolist()])})

    # whole series are summed where they lie; of the others a row for each chunk meets
    products = cut.filter("NOT whole").mapInArrow(reduced, f"key {kind}, part int, seq long, c array<double>")
    each = products.groupBy("key").applyInArrow(folded, "s array<double>").unionByName(cut.filter("whole").select("values").mapInArrow(summed, "s array<double>"))
    sums = each.agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(size)])
    return np.array([x or 0.0 for x in sums.first()])


def improved(chain: Chain, counts: np.ndarray, least: float) -> Chain:
    """The chain that the expected counts are likeliest under; a regime that was never met stays as it is, no spread is below ``least``."""
    d = len(chain.means)
    moves, first, second = counts[1 : 1 + d * d].reshape(d, d), counts[1 + d * d : 1 + d * d + d], counts[1 + d * d + d :]
    met, left = moves.sum(0), moves.sum(1)
    shift = np.divide(first, met, out=np.zeros(d), where=met > 0)
    square = np.divide(second, met, out=np.array(chain.spreads) ** 2, where=met > 0) - shift**2
    chances = np.where(left[:, None] > 0, moves / np.where(left > 0, left, 1.0)[:, None], np.array(chain.moves))
    chances = np.maximum(chances, 1e-12)
    chances /= chances.sum(1, keepdims=True)
    spread = np.sqrt(np.maximum(square, least * least))
    return Chain(tuple((np.array(chain.means) + shift).tolist()), tuple(spread.tolist()), tuple(map(tuple, chances.tolist())))


def starting_chain(mean: float, spread: float, stay: float = 0.95) -> Chain:
    """A regime that rises, one that falls and one that swings, set around all changes."""
    moves = tuple(tuple(stay if i == j else (1 - stay) / 2 for j in range(3)) for i in range(3))
    return Chain((mean + spread / 2, mean - spread / 2, mean), (spread / 2, spread * 3 / 4, spread * 3 / 2), moves)


def fit_regimes(changes: DataFrame, *, rounds: int = 30, close: float = 1e-6, start: Chain | None = None, key: str = "ticker", value: str = "r", size: int = CHUNK) -> tuple[Chain, list[float]]:
    """The chain that all series share, by Baum-Welch, and the log likelihood before each round and at the end.

    Each series starts from equal chances.  Rounds end once one adds less than ``close``
    for a change.  The driver gets the sums only, as many as a model has numbers.  Of no changes, or of equal
    ones, the starting chain with spread 1e-9 at least, or 1 where there are none.
    """
    return fit_with_counts(changes, rounds=rounds, close=close, start=start, key=key, value=value, size=size)[:2]


def fit_with_counts(changes: DataFrame, *, rounds: int, close: float, start: Chain | None = None, key: str = "ticker", value: str = "r", size: int = CHUNK) -> tuple[Chain, list[float], np.ndarray]:
    """fit_regimes(), and the expected counts by the chain that it ends with."""
    cut = chunks(changes, key=key, value=value, size=size)
    x = F.explode("values")
    n, mean, spread = cut.select(x.alias("x")).agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).first()
    least = max(1e-3 * (spread or 0.0), 1e-9)
    chain = start or starting_chain(mean or 0.0, max(spread or 0.0, 1e-9) if n else 1.0)
    seen: list[float] = []
    if not n:
        return chain, [0.0], np.zeros(1 + len(chain.means) * (len(chain.means) + 2))
    for i in range(rounds + 1):
        counts = expected_counts(cut, chain)
        seen.append(float(counts[0]))
        if i == rounds or (i and seen[-1] - seen[-2] < close * n):
            break
        chain = improved(chain, counts, least)
    return chain, seen, counts


# ---- volatility ------------------------------------------------------------------

#: Of a fit's row: the point that is best so far and what is known there, and the next one to try.
STATE = "best array<double>, value double, slope array<double>, bend array<double>, damp double, trial array<double>, begun double, done boolean"
#: The starting point: omega 0.1 of the mean square, alpha 0.1, beta 0.8, as they are searched for (see natural()).
OUTSET = (float(np.log(0.1)), 0.0, float(np.log(8.0)))


def natural(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) omega, alpha, beta of points anywhere, with omega > 0, alpha, beta > 0 and alpha + beta < 1; and the derivatives."""
    e = np.exp(p)
    whole = 1 + e[:, 1] + e[:, 2]
    out = np.stack([e[:, 0], e[:, 1] / whole, e[:, 2] / whole], 1)
    j = np.zeros((len(p), 3, 3))
    j[:, 0, 0] = e[:, 0]
    for a in (1, 2):
        for b in (1, 2):
            j[:, a, b] = out[:, a] * ((a == b) - out[:, b])
    return out, j


def variances(r: np.ndarray, w: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step of (n, steps) changes: (which have one, their squares, states before it); ``at`` is moved along.

    A state is the variance and its derivatives by omega, alpha and beta.
    """
    for t in range(r.shape[1]):
        here = ~np.isnan(r[:, t])
        x = np.where(here, r[:, t], 0.0) ** 2
        yield here, x, at
        beta = w[:, 2]
        after = np.stack([w[:, 0] + w[:, 1] * x + beta * at[:, 0], 1 + beta * at[:, 1], x + beta * at[:, 2], at[:, 0] + beta * at[:, 3]], 1)
        at[here] = after[here]


def likelihoods(r: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, 13) log likelihood, slope and information by omega, alpha and beta of (n, steps) changes, entered in the states ``at``."""
    here = ~np.isnan(r.T)
    x = np.where(here, r.T, 0.0) ** 2
    omega, alpha, beta = w.T
    s, driven = np.empty((len(x), 4, len(r))), omega + alpha * x
    s[0] = at.T
    for t in range(len(x) - 1):
        np.multiply(s[t], beta, out=s[t + 1])
        s[t + 1, 0] += driven[t]
        s[t + 1, 1] += 1
        s[t + 1, 2] += x[t]
        s[t + 1, 3] += s[t, 0]
    v, d = np.maximum(s[:, 0], 1e-300), s[:, 1:]
    log = np.where(here, -0.5 * (np.log(2 * np.pi * v) + x / v), 0.0).sum(0)
    slope = np.einsum("tn,tan->na", np.where(here, 0.5 * (x / v - 1) / v, 0.0), d)
    bend = np.einsum("tan,tbn->nab", np.where(here, 0.5 / v**2, 0.0)[:, None] * d, d)
    return np.concatenate([log[:, None], slope, bend.reshape(-1, 9)], 1)


def carried(w: np.ndarray, own: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The state behind n steps that lead from zeros to ``own``, entered in the state ``at``: all is linear in it."""
    beta = w[2]
    out = own + beta**n * at
    out[3] += n * beta ** (n - 1) * at[0]
    return out


def _likelihood(cut: DataFrame, points: DataFrame, few: bool, few_chunks: bool) -> DataFrame:
    """(key, s): log likelihood, slope and information by omega, alpha and beta at each series' trial point, summed over chunks.

    points: (key, unit, trial); changes count in units of ``unit``.  First each chunk is run
    from zeros, then a series' chunks get the states before them, then each is run from there.
    """
    kind = cut.schema["key"].dataType.simpleString()
    near = F.broadcast if few else lambda d: d
    p = near(points.select(F.col("key").alias("__key"), "unit", "trial"))
    rows = cut.join(p, F.col("key").eqNullSafe(F.col("__key"))).select("key", "part", "seq", F.transform("values", lambda x: x / F.col("unit")).alias("values"), "trial")

    def points_of(b: pa.RecordBatch) -> np.ndarray:
        return np.array(b.column("trial").to_pylist(), float).reshape(-1, 3)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w, out = natural(points_of(b))[0], [None] * b.num_rows
            for which, r in blocks(b.column("values")):
                at = np.zeros((len(which), 4))
                for _ in variances(r, w[which], at):
                    pass
                for i, row in zip(which, at, strict=True):
                    out[i] = row
            n = pa.array(b.column("values").value_lengths(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("key", "part", "seq", "trial")], n, pa.array(out, pa.list_(pa.float64()))], names=["key", "part", "seq", "trial", "n", "own"])

    def entered(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("seq", "ascending")])
        w, at, out = natural(np.array([t["trial"][0].as_py()]))[0][0], np.array([1.0, 0.0, 0.0, 0.0]), []
        for n, own in zip(t["n"].to_pylist(), t["own"].to_pylist(), strict=True):
            out.append(at.tolist())
            at = carried(w, np.array(own), n, at)
        return pa.table({"part": t["part"], "seq": t["seq"], "at": pa.array(out)})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w, start = natural(points_of(b))[0], np.array(b.column("at").to_pylist(), float).reshape(-1, 4)
            out = [None] * b.num_rows
            for which, r in blocks(b.column("values")):
                s = likelihoods(r, w[which], start[which])
                for i, row in zip(which, s, strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.float64()))], names=["key", "s"])

    starts = rows.mapInArrow(alone, f"key {kind}, part int, seq long, trial array<double>, n long, own array<double>").groupBy("key").applyInArrow(entered, "part int, seq long, at array<double>")
    whole = rows.join(F.broadcast(starts) if few_chunks else starts, ["part", "seq"]).select("key", "values", "trial", "at")
    return whole.mapInArrow(summed, f"key {kind}, s array<double>").groupBy("key").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(13)]).alias("s"))


@dataclass
class Search:
    """Of n series: the best point so far and what is known there, and the next one to try; done: no more than ``close`` is promised."""

    best: np.ndarray
    value: np.ndarray
    slope: np.ndarray
    bend: np.ndarray
    damp: np.ndarray
    trial: np.ndarray
    begun: np.ndarray
    done: np.ndarray

    @staticmethod
    def begin(n: int) -> Search:
        return Search(np.tile(OUTSET, (n, 1)), np.full(n, -1e308), np.zeros((n, 3)), np.zeros((n, 3, 3)), np.full(n, 0.01), np.tile(OUTSET, (n, 1)), np.full(n, np.nan), np.zeros(n, bool))

    def at(self, which: np.ndarray) -> Search:
        return Search(*[x[which] for x in vars(self).values()])

    def put(self, which: np.ndarray, part: Search) -> None:
        for mine, its in zip(vars(self).values(), vars(part).values(), strict=True):
            mine[which] = its

    def stepped(self, s: np.ndarray, close: float) -> Search:
        """Takes a trial point if it is better, and sets the next one by a damped Newton step on the expected information."""
        _, j = natural(self.trial)
        taken = s[:, 0] >= self.value
        best = np.where(taken[:, None], self.trial, self.best)
        value = np.where(taken, s[:, 0], self.value)
        slope = np.where(taken[:, None], np.einsum("nab,na->nb", j, s[:, 1:4]), self.slope)
        bend = np.where(taken[:, None, None], np.einsum("nax,nab,nby->nxy", j, s[:, 4:].reshape(-1, 3, 3), j), self.bend)
        damp = np.clip(np.where(taken, self.damp / 4, self.damp * 8), 1e-9, 1e12)
        size = np.einsum("naa->na", bend)
        firm = bend + (damp[:, None] * (size + 1e-9))[:, :, None] * np.eye(3)
        step = np.linalg.solve(firm, slope[:, :, None])[:, :, 0]
        trial = np.clip(best + np.clip(step, -3, 3), -15, 15)
        done = taken & (np.einsum("na,na->n", trial - best, slope) <= close)
        return Search(best, value, slope, bend, damp, trial, np.where(np.isnan(self.begun), s[:, 0], self.begun), done)


def _steps(close: float):
    """Maps (key, unit, n, STATE, s) to (key, unit, n, STATE) a step further; what is done stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                get = lambda c, n, b=b: np.array(b.column(c).to_pylist(), float).reshape(-1, n)
                one = lambda c, get=get: get(c, 1)[:, 0]
                now = Search(get("best", 3), one("value"), get("slope", 3), get("bend", 9).reshape(-1, 3, 3), one("damp"), get("trial", 3), one("begun"), one("done") > 0)
                yield _batch(b.column("key"), b.column("unit"), b.column("n"), now.stepped(get("s", 13), close))

    return run


def _batch(key: pa.Array, unit: pa.Array, n: pa.Array, search: Search) -> pa.RecordBatch:
    columns = [pa.array(x.tolist() if x.ndim == 1 else x.reshape(len(x), -1).tolist(), pa.bool_() if x.dtype == bool else pa.float64() if x.ndim == 1 else pa.list_(pa.float64())) for x in vars(search).values()]
    return pa.RecordBatch.from_arrays([key, unit, n, *columns], names=["key", "unit", "n", *vars(search)])


def _fitted_whole(rounds: int, close: float):
    """Maps (key, values) of whole series to (key, unit, n, STATE), fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for which, r in blocks(b.column("values"), 1 << 16):
                n = (~np.isnan(r)).sum(1)
                unit = np.sqrt(np.nansum(r * r, 1) / n)
                search, left = Search.begin(len(r)), np.flatnonzero(unit > 0)
                r = r / np.where(unit > 0, unit, 1.0)[:, None]
                for _ in range(rounds):
                    now = search.at(left)
                    search.put(left, now.stepped(likelihoods(r[left], natural(now.trial)[0], np.tile([1.0, 0.0, 0.0, 0.0], (len(left), 1))), close))
                    left = left[~search.done[left]]
                    if not len(left):
                        break
                yield _batch(b.column("key").take(pa.array(which)), pa.array(unit), pa.array(n, pa.int64()), search)

    return run


def _short_and_long(cut: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(key, values) of series of ``size`` values at most, and chunks() of the longer ones; few series lie across two parts."""
    parts = cut.filter("NOT whole")
    counts = parts.groupBy(F.col("key").alias("__key")).agg(F.sum(F.size("values")).alias("__n"))
    both = parts.join(counts, F.col("key").eqNullSafe(F.col("__key"))).drop("__key")
    inorder = F.array_sort(F.collect_list(F.struct("part", "seq", "values")))
    joined = both.filter(F.col("__n") <= size).groupBy("key").agg(F.flatten(F.transform(inorder, lambda x: x["values"])).alias("values"))
    return cut.filter("whole").select("key", "values").unionByName(joined), both.filter(F.col("__n") > size).drop("__n")


def fit_garch(changes: DataFrame, *, rounds: int = 30, close: float = 1e-4, key: str = "ticker", value: str = "r", size: int = CHUNK) -> DataFrame:
    """(key, n, omega, alpha, beta, log_likelihood, slope, begun) of each series, by quasi-likelihood of normal changes with mean 0.

    The variance starts at the mean square and goes to omega + alpha r^2 + beta v.  A round
    takes one damped Newton step; a series ends once its last point was taken and the next
    one promises no more than ``close`` in log likelihood.  Series of at most ``size`` values are
    rows, many of which go through all their rounds together in a task; a round of longer
    ones is a pass over their chunks.  Omega is above 0, alpha and beta are, and
    their sum is below 1; slope is the greatest derivative of the log likelihood by a
    change's weight in the search, near 0 at an inner optimum; begun is the log likelihood
    where the search begins.  A series whose changes are all 0 has nulls.
    """
    spark = changes.sparkSession
    cut = chunks(changes, key=key, value=value, size=size)
    kind = cut.schema["key"].dataType.simpleString()
    schema = f"key {kind}, unit double, n long, {STATE}"
    short, long_ = _short_and_long(cut, size)
    # files of few bytes are many rounds of work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fitted = tables.save(short.repartition(parts).mapInArrow(_fitted_whole(rounds, close), schema))
    long_ = tables.save(long_)
    if not long_.isEmpty():
        fitted = fitted.unionByName(_fitted_long(long_, schema, rounds, close))
    e = [F.exp(F.get("best", F.lit(i))) for i in range(3)]
    whole = 1 + e[1] + e[2]
    scale = F.col("n") * F.log("unit")
    found = {
        "omega": e[0] * F.col("unit") * F.col("unit"), "alpha": e[1] / whole, "beta": e[2] / whole, "log_likelihood": F.col("value") - scale,
        "slope": F.array_max(F.transform("slope", F.abs)), "begun": F.col("begun") - scale,
    }
    return fitted.select(F.col("key").alias(key), "n", *[F.when(F.col("unit") > 0, c).alias(name) for name, c in found.items()])


def _fitted_long(cut: DataFrame, schema: str, rounds: int, close: float) -> DataFrame:
    """(key, unit, n, STATE) of series of several chunks, fitted; a round passes over the series that are not done."""
    spark = cut.sparkSession
    x = cut.select("key", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v).alias("q"))
    point = F.array(*[F.lit(p) for p in OUTSET])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    units = x.groupBy("key").agg(F.sqrt(F.sum("q") / F.sum("n")).alias("unit"), F.sum("n").alias("n"))
    begun = {"best": point, "value": F.lit(-1e308), "slope": zeros(3), "bend": zeros(9), "damp": F.lit(0.01), "trial": point, "begun": F.lit(float("nan"))}
    state = tables.save(units.select("key", "unit", "n", *[c.alias(name) for name, c in begun.items()], (F.col("unit") == 0).alias("done")))
    few, few_chunks = tables.is_small(state), tables.is_small(cut)
    last = None
    for _ in range(rounds):
        left = state.filter("NOT done")
        if left.isEmpty():
            break
        found = _likelihood(cut, left, few, few_chunks)
        both = left.join(found.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")))
        path = tables.shared_folder(spark)
        state = tables.save(both.drop("__key").mapInArrow(_steps(close), schema).unionByName(state.filter("done")), path)
        if last:
            tables.delete(spark, last)
        last = path
    return state
