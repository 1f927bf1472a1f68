"""Language identification by compression with per-language dictionaries.

A language is modelled by pieces of its own text as they stand, in lower case, used as
a raw-content zstandard dictionary.  A text is cut into blocks, every block is
compressed with every dictionary, and the language with the smallest total wins:
shared letter sequences cost fewer bytes.  Nothing is taken out of a text; what it
repeats within a block costs little the second time.  Texts whose runner-up is almost as
small are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bytescan as B
from .scratch import free_names, small_batches

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")

#: Settings of the compressor: matches of three letters, a lazy parse.
PARAMETERS = {"window_log": 17, "chain_log": 14, "hash_log": 15, "search_log": 4, "min_match": 3, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY}


def folded(text: str) -> bytes:
    """The whole text in lower case; case says little about a language."""
    return text.lower().encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary text by language.

    ``min_margin``: a language is narrow, and so rejected, when the next one takes less
    than this share more bytes.  A block is compressed behind a short carrier from the dictionary's end, whose
    own size is subtracted: else zstandard would store very short texts as they are
    and all languages would tie.
    """

    dictionaries: dict[str, bytes]
    block_bytes: int = 16384
    carrier_bytes: int = 64
    temperature: float = 0.02
    min_margin: float = 0.002
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}}

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor, bytes, int]]:
        if not self._cache:
            settings = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=False)
            for lang, text in sorted(self.dictionaries.items()):
                d = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c, carrier = zstandard.ZstdCompressor(compression_params=settings, dict_data=d), text[-self.carrier_bytes :]
                self._cache[lang] = (lang, c, carrier, len(c.compress(carrier)))
        return list(self._cache.values())

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """Bytes each language needs for the whole text, smallest first."""
        data = folded(text)
        blocks = [data[i : i + self.block_bytes] for i in range(0, len(data), self.block_bytes)]
        return sorted((sum(len(c.compress(carrier + b)) - own for b in blocks), lang) for lang, c, carrier, own in self.compressors())

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin of the runner-up as a share of the winner)."""
        if text is None or not self.dictionaries or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(text)
        best = max(1, sizes[0][0])
        rest = sum(math.exp(-(n - sizes[0][0]) / (self.temperature * best)) for n, _ in sizes[1:])
        margin = (sizes[1][0] - sizes[0][0]) / best if len(sizes) > 1 else 1.0
        return sizes[0][1], 1.0 / (1.0 + rest), margin


def fit(
    docs: DataFrame, where: Column | None = None, *, text: str = "text", lang: str = "lang", id_: str = "doc_id", sample_docs: int = 400, dictionary_bytes: int = 65536, piece_chars: int = 600, **settings
) -> LanguageModel:
    """Learns one dictionary for each language from rows with text and language.

    About ``sample_docs`` labelled documents of a language, chosen by a hash of the id,
    give one piece of at most ``piece_chars`` each, from a place that the hash chooses
    too; what reaches the driver does not grow with the corpus.  Rows with a null text
    or language teach nothing, equal pieces are used once, and ties in the hash go by
    the text; no row at all gives a model without languages, which predicts ``und``.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(id_), F.lit(7)).alias("h"), (F.lit(True) if where is None else where).alias("w"))
    rows = rows.filter(F.col("w") & F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")).drop("w")
    share = rows.groupBy("l").agg((F.lit(2.0 * sample_docs) / F.count(F.lit(1))).alias("share"))
    # one number for each language, and the model holds a dictionary for each: broadcast
    picked = rows.join(F.broadcast(share), "l").filter(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    at = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.length("t") - piece_chars + 1, F.lit(1))) + 1
    picked = picked.select("l", "h", F.substring("t", at.cast("int"), piece_chars).alias("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    picked = picked.withColumn("n", place).filter(F.col("n") <= sample_docs)
    pieces: dict[str, list[bytes]] = {}
    for r in picked.orderBy("l", "n").collect():
        pieces.setdefault(r["l"], []).append(folded(r["t"]))
    return LanguageModel({lang: _fill(p, dictionary_bytes) for lang, p in pieces.items()}, **settings)


def _fill(pieces: list[bytes], size: int) -> bytes:
    """The first of the pieces that fit, one to a line, the last piece cut."""
    return b"\n".join([*dict.fromkeys(pieces), b""])[:size]


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])


def prediction(model: LanguageModel, text: Column) -> Column:
    """A struct (lang_pred, score, margin) for each text; each text is read whole."""

    @F.pandas_udf(PREDICTION)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([model.predict(t) for t in s], columns=PREDICTION.names)
        B.give_back()

    return score(text)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with one more struct column ``into`` (lang_pred, score, margin).

    Null texts and texts without a letter are ``und`` with score and margin 0.  Languages
    of one size go by name and have margin 0.  Repeated rows get one answer, and an empty
    table stays empty.  A column named as ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(into, prediction(model, F.col(f"`{text}`")))


def is_clear(language: str, model: LanguageModel) -> Column:
    """Whether a column of identify() names a language by a margin that is not narrow."""
    return (F.col(f"{language}.lang_pred") != UNDETERMINED) & (F.col(f"{language}.margin") >= model.min_margin)


def keep_identified(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """Rows whose language is clear, with their columns as they were.

    Rejected: null texts, texts without a letter, and texts whose language is narrow.
    Repeated rows are judged alike; an empty table stays empty.
    """
    (tmp,) = free_names(docs, "__language")
    return identify(docs, model, text=text, into=tmp).filter(is_clear(tmp, model)).select(*[F.col(f"`{c}`") for c in docs.columns])
