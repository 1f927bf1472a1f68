"""Secret scans: fixed base patterns, and formats inferred from the credentials they find.

The base patterns label credentials.  For each kind a prefix tree of their formats
(see classes) is folded into a probabilistic automaton: two states merge when their
frequencies of ending and of each next class are statistically compatible (Hoeffding
bounds), and so are their successors'.  All other tokens of the corpus, and the parts
of them between marks, are scored by their likelihood under the automata against that
under a background of ordinary tokens; of those well above it the likeliest are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .scratch import Scratch, small_batches

#: The base patterns, their least lengths, and words without which the first cannot match.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "grammar"]

TOKEN = np.zeros(256, bool)
TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_.=-"]] = True
SEGMENT = re.compile(r"[A-Za-z0-9]+")
UP, LOW, HEXDIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UP[0x41:0x5B] = LOW[0x61:0x7B] = HEXDIGIT[0x30:0x3A] = HEXDIGIT[0x61:0x67] = True
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, str]


def classes(token: str) -> str:
    """The token's format, a class for each character.

    Marks stand for themselves and cut the token into segments; a segment's
    characters are all d (digits), l (letters), x (both, hex digits only) or w (both),
    as random characters differ from one credential to the next but their kind does
    not.  Case counts only where a token mixes it: then letters are L, x and w X and W.
    """
    mixed = token.lower() != token and token.upper() != token
    return "".join(s if s in "+/_.=-" else _kind(s, mixed) * len(s) for s in re.split(r"([+/_.=-])", token))


def _kind(segment: str, mixed: bool) -> str:
    digits = sum(c.isdigit() for c in segment)
    kind = "d" if digits == len(segment) else "l" if not digits else "x" if not segment.lower().strip("0123456789abcdef") else "w"
    return kind.upper() if mixed and kind != "d" else kind


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, str]]]:
    """Spans of the base patterns by start and kind, and the credentials in them with their kinds."""
    spans, values = [], []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            spans.append((m.start(), m.end(), "assign"))
            values.append(("assign", m[2]))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            if len(m[0]) >= LEAST[kind]:
                spans.append((m.start(), m.end(), kind))
                values.append((kind, m[0]))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))), values


class Automaton:
    """A probabilistic automaton learned by state merging."""

    def __init__(self, words: list[str], alpha: float = 0.01, floor: float = 1e-4):
        self.bound, self.floor = math.sqrt(0.5 * math.log(2 / alpha)), floor
        self.total, self.ends, self.next = [0], [0], [{}]
        for w in words:
            s = 0
            self.total[0] += 1
            for c in w:
                if c not in self.next[s]:
                    self.total.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.next[s][c] = [len(self.next) - 1, 0]
                edge = self.next[s][c]
                edge[1] += 1
                s = edge[0]
                self.total[s] += 1
            self.ends[s] += 1
        self._merge()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        todo, seen = [(p, q)], set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = self.total[p], self.total[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.next[p].keys() | self.next[q].keys():
                x, y = self.next[p].get(c), self.next[q].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to the automaton at p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.ends[p] += self.ends[q]
            for c, (child, n) in self.next[q].items():
                if c in self.next[p]:
                    self.next[p][c][1] += n
                    todo.append((self.next[p][c][0], child))
                else:
                    self.next[p][c] = [child, n]

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            # the commonest state on the border first
            blue.sort(key=lambda e: (self.next[e[0]][e[1]][1], e), reverse=True)
            parent, c = blue.pop(0)
            q = self.next[parent][c][0]
            into = next((p for p in red if self._compatible(p, q)), None)
            if into is None:
                red.append(q)
                blue += [(q, x) for x in sorted(self.next[q])]
            else:
                self.next[parent][c][0] = into
                self._fold(into, q)
                known, border = set(red), set(blue)
                blue += [(p, x) for p in red for x in sorted(self.next[p]) if self.next[p][x][0] not in known and (p, x) not in border]
        self.states = len(red)

    def log_likelihood(self, word: str) -> float:
        """Of the whole token, its end included; an unseen step or end costs the floor, and the step leads nowhere else."""
        s, out = 0, 0.0
        for c in word:
            edge = self.next[s].get(c)
            if edge is None:
                out += math.log(self.floor)
                continue
            out += math.log(max(edge[1] / self.total[s], self.floor))
            s = edge[0]
        return out + math.log(max(self.ends[s] / self.total[s], self.floor))


@dataclass(frozen=True)
class FormatModel:
    """Automata by kind, the background's class bigrams, and the least and most characters of a credential."""

    automata: dict[str, Automaton]
    background: dict[tuple[str, str], float]
    margin: float = 6.0
    least: int = 16
    most: int = 512
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        # whether words of one case, and of both, may be credentials, by length; longer ones are scored each
        likely = [[n > self.most or (n >= self.least and self.score(w[:n]) >= self.margin) for n in range(self.most + 2)] for w in ("a" * self.most, "Aa" * self.most)]
        object.__setattr__(self, "letters", np.array(likely))

    def score(self, token: str) -> float:
        """Log-likelihood of the likeliest format over that of ordinary tokens."""
        w = classes(token)
        if (out := self.known.get(w)) is None:
            best = max((a.log_likelihood(w) for a in self.automata.values()), default=-math.inf)
            plain = sum(self.background.get(x, math.log(1e-4)) for x in zip("^" + w, w + "$", strict=True))
            if len(self.known) >= 1 << 16:
                self.known.clear()
            out = self.known[w] = best - plain
        return out

    def credentials(self, token: str) -> list[tuple[int, int]]:
        """(start, end) of the likeliest parts of a token, or of all of it, that do not overlap.

        Parts begin and end with a segment (see classes) or with the token; all of
        ``least`` to ``most`` characters are scored, and the whole token if longer.
        """
        segments = [m.span() for m in SEGMENT.finditer(token)]
        starts, ends = sorted({0, *(a for a, _ in segments)}), sorted({len(token), *(b for _, b in segments)})
        parts = [(a, b) for a in starts for b in ends[bisect_left(ends, a + self.least) : bisect_right(ends, a + self.most)]]
        if len(token) > self.most:
            parts.append((0, len(token)))
        likely = [(v, b - a, a, b) for a, b in parts if (v := self.score(token[a:b])) >= self.margin]
        out: list[tuple[int, int]] = []
        for _, _, a, b in sorted(likely, key=lambda x: (-x[0], -x[1], x[2])):
            if all(b <= x or y <= a for x, y in out):
                out.append((a, b))
        return sorted(out)


def _runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of true bytes within a text."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[off] = True
    before, after = np.concatenate([[False], mask[:-1]]), np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (cut[:-1] | ~before)), np.flatnonzero(mask & (cut[1:] | ~after)) + 1


def _candidates(data: np.ndarray, off: np.ndarray, model: FormatModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of maximal runs of token characters that may hold a likely part.

    A run of letters only has one part, known by its length and by whether it mixes
    case: most words are settled without a look at them.
    """
    start, end = _runs(TOKEN[data], off)
    keep = end - start >= model.least
    start, end = start[keep], end[keep]
    size, low, up = end - start, *(np.concatenate([[0], np.cumsum(x[data])]) for x in (LOW, UP))
    low, up = low[end] - low[start], up[end] - up[start]
    keep = (low + up < size) | model.letters[((low > 0) & (up > 0)).astype(int), np.minimum(size, model.most + 1)]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(off, start, "right") - 1


def _may_hold_base(data: np.ndarray, off: np.ndarray) -> set[int]:
    """Texts that could hold a match of a base pattern."""
    raw = data.tobytes()
    low, found = raw.lower(), []
    for hay, word in [*((low, w) for w in ASSIGN_WORDS), (raw, b"AKIA")]:
        at = hay.find(word)
        while at >= 0:
            found.append(at)
            at = hay.find(word, at + 1)
    start, end = _runs(HEXDIGIT[data], off)
    places = np.concatenate([np.array(found, np.int64), start[end - start >= LEAST["hex"]]])
    return set((np.searchsorted(off, places, "right") - 1).tolist())


def scan(column: pa.Array, model: FormatModel | None) -> Iterator[tuple[int, list[Span]]]:
    """(row, spans) of the rows with any span; offsets count code points of the whole text."""
    found = lru_cache(1 << 16)(model.credentials) if model else None
    for i, j, data, off in B.chunks(column):
        start, end, text = _candidates(data, off, model) if model and model.automata else (np.zeros(0, np.int64),) * 3
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        tokens = defaultdict(list)
        for a, b, t in zip(start.tolist(), end.tolist(), text.tolist(), strict=True):
            first = int(points[a] - points[off[t]])
            tokens[t] += [(first + x, first + y, "grammar") for x, y in found(data[a:b].tobytes().decode())]
        for t in sorted(_may_hold_base(data, off) | {t for t, x in tokens.items() if x}):
            spans, _ = base_spans(data[off[t] : off[t + 1]].tobytes().decode("utf-8", "replace"))
            spans += [s for s in tokens[t] if not any(s[0] < b and a < s[1] for a, b, _ in spans)]
            if spans:
                yield i + t, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def ordinary_steps(data: np.ndarray, off: np.ndarray, known: dict[int, str]) -> Counter:
    """How often one class follows another in the texts' tokens of under LEAST["hex"] characters.

    known: classes by the token's hash, kept between calls.
    """
    start, end = _runs(TOKEN[data], off)
    short = end - start < LEAST["hex"]
    start, end = start[short], end[short]
    steps: Counter = Counter()
    size, low, up = end - start, *(np.concatenate([[0], np.cumsum(x[data])]) for x in (LOW, UP))
    low, up = low[end] - low[start], up[end] - up[start]
    letters = low + up == size
    # tokens of letters only are known by their length and by whether they mix case
    for c, some in (("l", letters & ((low == 0) | (up == 0))), ("L", letters & (low > 0) & (up > 0))):
        n, total = int(some.sum()), int(size[some].sum())
        steps.update({x: k for x, k in (("^" + c, n), (c + c, total - n), (c + "$", n)) if k})
    start, end = start[~letters], end[~letters]
    hashes, lead, n = np.unique(B.word_hashes(data, start, end), return_index=True, return_counts=True)
    out: Counter = Counter()
    for h, i, k in zip(hashes.tolist(), lead.tolist(), n.tolist(), strict=True):
        if (w := known.get(h)) is None:
            if len(known) >= 1 << 17:
                known.clear()
            w = known[h] = classes(data[start[i] : end[i]].tobytes().decode())
        out[w] += k
    for w, k in out.items():
        for x in zip("^" + w, w + "$", strict=True):
            steps["".join(x)] += k
    return steps


def fit(docs: DataFrame, *, text: str = "text", per_kind: int = 400, most_chars: int = 512, **settings) -> FormatModel:
    """Learns formats from the credentials that the base patterns find in all documents.

    About ``per_kind`` distinct credentials of a kind of up to ``most_chars`` characters,
    chosen by their hash, reach the driver as labelled samples.  The background, how
    often one class follows another in ordinary tokens, is counted over the whole texts
    of all documents; a few hundred counts reach the driver.  Null and empty texts and
    repeated credentials add nothing; ties in the hash go by the credential.  Without
    credentials, as in an empty table, nothing is ever added to the base.
    """
    small_batches(docs.sparkSession)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: Counter = Counter()
        known: dict[int, str] = {}
        for batch in batches:
            rows = set()
            for _, _, data, off in B.chunks(batch.column(0)):
                for t in _may_hold_base(data, off):
                    values = base_spans(data[off[t] : off[t + 1]].tobytes().decode("utf-8", "replace"))[1]
                    rows.update(v for v in values if len(v[1]) <= most_chars)
                steps.update(ordinary_steps(data, off, known))
            found = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string()), pa.array([1] * len(found), pa.int64())], names=["kind", "value", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(["step"] * len(steps), pa.string()), pa.array(list(steps), pa.string()), pa.array(list(steps.values()), pa.int64())], names=["kind", "value", "n"])

    rows = docs.select(F.col(text).alias("t")).filter("t IS NOT NULL").mapInArrow(B.streamed(learned), "kind string, value string, n long")
    found = Scratch(docs.sparkSession).save(rows.groupBy("kind", "value").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("value", F.lit(3))))
    by_kind: dict[str, list[str]] = {}
    # the smallest hashes of each kind: TopK per partition, then of those
    for kind in KINDS[:3]:
        got = found.filter(F.col("kind") == kind).orderBy("h", "value").limit(per_kind).collect()
        if got:
            by_kind[kind] = [classes(r["value"]) for r in got]
    counts = {(r["value"][0], r["value"][1]): r["n"] for r in found.filter("kind = 'step'").collect()}  # pairs of classes
    totals: dict[str, float] = defaultdict(float)
    for (a, _), v in counts.items():
        totals[a] += v
    if by_kind:
        settings = {"least": min(LEAST[k] for k in by_kind)} | settings
    return FormatModel({k: Automaton(w) for k, w in by_kind.items()}, {x: math.log(v / totals[x[0]]) for x, v in counts.items()}, **settings)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: FormatModel | None, *, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and kind.  Base
    spans never depend on the model; grammar spans do not overlap them.  Null and
    empty texts have none.  Rows with null or repeated ids are reported like any other.
    """
    small_batches(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            counts = np.zeros((3, b.num_rows), np.int64)
            hashes, listed = [none] * b.num_rows, [""] * b.num_rows
            for row, spans in scan(b.column(1), model):
                base = [s for s in spans if s[2] != "grammar"]
                for _, _, kind in base:
                    counts[KINDS.index(kind), row] += 1
                hashes[row], listed[row] = hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in counts], pa.array(hashes), pa.array(listed)], names=[c.split()[0] for c in SPANS.split(", ")])

    return docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(B.streamed(report), SPANS)


def redact(docs: DataFrame, model: FormatModel | None, *, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of each found secret; all other columns as they were.

    Overlapping spans become one mark.  Null and empty texts stay as they are, repeated
    rows are cleaned alike, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            column = pa.array(s, pa.string(), from_pandas=True)
            out = column.to_pylist()
            for row, spans in scan(column, model):
                parts, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [out[row][at:a], mark]
                    at = max(at, b)
                out[row] = "".join([*parts, out[row][at:]])
            yield pd.Series(out, dtype=object)
        B.give_back()

    cleaned = F.pandas_udf("string")(clean)
    return docs.withColumn(text, cleaned(F.col(f"`{text}`")))
