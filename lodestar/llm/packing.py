"""Best-fit packing of tokenized documents into sequences of fixed size.

Only the histogram of piece lengths, at most ``max_tokens`` numbers, is planned on
the driver: best-fit decreasing over counts gives runs of equal slots.  Each piece
then takes the slot of its rank within its length.  Ranks are counted within salted
buckets, so a length shared by many pieces is spread over many tasks.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bytescan as B
from .scratch import Scratch, small_batches

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
#: Characters that are encoded at once.
CHARACTERS = 400_000
RUN = "length long, first_rank long, per_sequence long, n long, first_sequence long, first_offset long"


#: Characters below this are told apart by table; a word with any beyond is left to the tokenizer as a whole.
TABLE = 0x250
WHITE, LETTER, NUMBER, OTHER, HARD = range(5)
#: White space wherever it stands, and what ends a contraction.
WHITE_CODES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
APOSTROPHE = 0x27


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of characters; the last entry stands for all beyond the table."""
    kinds, lower = np.full(TABLE + 1, HARD, np.uint8), np.arange(TABLE + 1, dtype=np.int64)
    for c in range(TABLE):
        category, low = unicodedata.category(chr(c)), chr(c).lower()
        if c in WHITE_CODES:
            kinds[c] = WHITE
        elif c != APOSTROPHE and not category.startswith(("C", "Z")) and len(low) == 1 and ord(low) < TABLE and unicodedata.normalize("NFC", chr(c)) == chr(c):
            kinds[c] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
            lower[c] = ord(low)
    return kinds, lower


class Tokens:
    """Token ids of texts.

    The tokenizer drops white space and never merges across it, nor across the parts
    into which it splits a word: runs of letters, single digits, runs of marks.  Texts
    are cut into such parts as arrays; a part met before is looked up by a 64-bit hash
    in a sorted table of at most ``most`` parts, a new one is left to the tokenizer's
    model.  Words with characters beyond the table, apostrophes, control characters or
    what might be a special token are given to the tokenizer as they are.
    """

    def __init__(self, path: str, end_id: int, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.end, self.most = self.tokenizer.model, end_id, most
        self.kinds, self.lower = _tables()
        self.code = B.mixed(np.arange(TABLE + 1, dtype=np.uint64), 21)
        self.spelled = {chr(c): "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(TABLE) if self.kinds[c] not in (WHITE, HARD)}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new_keys, self.new_places, self.new_count = [], [], 0
        self.start, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0
        self.count = 0

    def _add(self, lists: list[list[int]]) -> np.ndarray:
        """Places of new parts' ids in the pool."""
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.array([i for x in lists for i in x], np.uint32)
        n = len(lists)
        if self.count + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(len(x), n), np.int64)]) for x in (self.start, self.size))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        at = slice(self.count, self.count + n)
        self.start[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used, self.count = self.used + len(flat), self.count + n
        return np.arange(at.start, at.stop)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.places[at[hit]]
        return out

    def _ids(self, part: str, hard: bool) -> list[int]:
        if hard:
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize("".join(map(self.spelled.__getitem__, part)))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with its end; offsets)."""
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        small = np.minimum(code, TABLE)
        kind = self.kinds[small]
        full = kind != WHITE
        first = full.copy()
        first[1:] &= ~full[:-1]
        last = full.copy()
        last[:-1] &= ~full[1:]
        word_end = np.flatnonzero(last) + 1
        word = np.cumsum(first) - 1
        hard = kind == HARD
        hard[1:] |= (code[1:] == 0x7C) & (code[:-1] == 0x3C)
        slow = np.zeros(len(word_end) + 1, bool)
        slow[word[hard]] = True
        slow_at = slow[word] & full
        split = full & ~slow_at
        split[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start = np.flatnonzero(first | split)
        own = word[start]
        end = np.append(start[1:], len(code))
        end = np.minimum(end, word_end[own]) if len(own) else end[:0]
        value = self.code[self.lower[small]]
        if slow_at.any():
            value[slow_at] = B.mixed(code[slow_at].astype(np.uint64), 22)
        h = B.mixed(B.span(B.prefix(value), start, end))
        keys, lead, item = np.unique(h, return_index=True, return_inverse=True)
        place = self._find(keys)
        absent = np.flatnonzero(place < 0)
        if len(absent):
            if self.count + len(absent) > self.most:
                self._clear()
                place[:] = -1
                absent = np.arange(len(keys))
            x = lead[absent]
            raw = np.where(slow_at, code, self.lower[small]).astype("<u4").tobytes()
            lists = [self._ids(raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass"), s) for a, b, s in zip(start[x].tolist(), end[x].tolist(), slow_at[start[x]].tolist(), strict=True)]
            place[absent] = self._add(lists)
            at = np.searchsorted(self.keys, keys[absent])
            self.keys, self.places = np.insert(self.keys, at, keys[absent]), np.insert(self.places, at, place[absent])
        place = place[item]
        size = self.size[place]
        per_text = np.bincount(np.searchsorted(off, start, "right") - 1, size, len(texts)).astype(np.int64)
        ends = np.cumsum(per_text + 1)
        out = np.empty(int(ends[-1]) if len(texts) else 0, np.uint32)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[~body] = self.end
        out[body] = self.pool[np.repeat(self.start[place] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return out, np.concatenate([[0], ends])


@lru_cache(maxsize=2)
def tokens(path: str, end_id: int) -> Tokens:
    """One cache for each Python worker."""
    return Tokens(path, end_id)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", max_tokens: int = 4096, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    A document's tokens end with ``end_id``; only documents longer than
    ``max_tokens`` are cut, the last piece being shorter.  Null and empty texts are
    the end token alone; repeated rows and null ids are packed like any other.
    ``with_ids`` adds the ids themselves, an array of int, for writing sequences.
    """
    small_batches(docs.sparkSession)
    path = tokenizer
    schema = T.StructType([*PIECE.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(path or default_tokenizer(), end_id)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            upto = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHARACTERS, "right")))
                found, off = encoder.encode(texts[at:to])
                rows = []
                for doc, a, b in zip(ids[at:to], off.tolist(), off[1:].tolist(), strict=False):
                    for k, x in enumerate(range(a, b, max_tokens)):
                        own = found[x : min(x + max_tokens, b)]
                        rows.append((doc, k, x - a, len(own), zlib.crc32(own.astype("<u4", copy=False)), *([own] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=False)], names=schema.names)
                at = to

    return docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(B.streamed(cut), schema)


def plan(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Sequences with the same fill are one group.  Lengths are taken from the longest;
    each goes to the group with the least room that still holds it, as often as fits,
    and to new sequences when none does.  Returns runs (length, first rank, pieces
    in each sequence, pieces, first sequence, first offset): ranks follow one
    another, sequence after sequence, each ``length`` behind the one before.
    """
    rooms: list[int] = []  # sorted rooms of the open groups
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, sequences)
    runs, used = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
                fits = room // length
            else:
                room, fits = max_tokens, max_tokens // length
                first, n = used, -(-left // fits)
                used += n
            full = min(n, left // fits)
            over = left - full * fits if full < n else 0
            taken = full * fits + over
            runs.append((length, rank, fits, taken, first, max_tokens - room))
            put(room - fits * length, first, full)
            if over:
                put(room - over * length, first + full, 1)
            put(room, first + full + bool(over), n - full - bool(over))
            rank, left = rank + taken, left - taken
    return runs


def pack(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", max_tokens: int = 4096, tokenizer: str | None = None, end_id: int = 1, salts: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """Pieces with their places: PIECE's columns, sequence_id and offset.

    Every sequence holds at most ``max_tokens`` tokens and is gapless from offset 0.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    pieces = tokenize(docs, id_=id_, text=text, max_tokens=max_tokens, tokenizer=tokenizer, end_id=end_id)
    pieces = scratch.save(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))))
    counts = scratch.save(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_tokens rows at most
    runs = spark.createDataFrame(plan(histogram, max_tokens), RUN)
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    placed = pieces.withColumn("own", rank).join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "salt")
    # the plan's size is bounded by max_tokens, not by the corpus
    inside = (placed["length"] == runs["length"]) & (placed["rank"] >= F.col("first_rank")) & (placed["rank"] < F.col("first_rank") + F.col("n"))
    at = F.col("rank") - F.col("first_rank")
    return placed.join(F.broadcast(runs), inside).select(
        "doc_id", "piece", "start", placed["length"], "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_sequence") * placed["length"]).cast("long").alias("offset"),
    )
