"""Tokenizers and text expressions.

Results depend on which tokenizer feeds which score, so each has a name of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

#: Token patterns.
RANK_TOKEN = r"\b[a-zA-Z0-9_\-\$]{2,30}\b"
TERM_TOKEN = r"\b[a-z][a-z0-9]{1,24}\b"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[!?\n])\s+|(?<=[a-zA-Z])\.\s+"
EDGES = r"^\s+|\s+$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def rank_tokens(text: Column) -> Column:
    """Tokens of the sparse ranking, repeats kept."""
    return F.transform(_all(text, RANK_TOKEN), F.lower)


def term_tokens(text: Column) -> Column:
    """Tokens of term weights, without stop words, repeats kept."""
    return F.filter(_all(F.lower(text), TERM_TOKEN), lambda t: ~t.isin(S.STOPWORDS))


def rank_candidates(text: Column) -> Column:
    """As rank_tokens, in the text's own case, for those who lower them later."""
    return _all(text, RANK_TOKEN)


def term_candidates(text: Column) -> Column:
    """As term_tokens, with stop words, for those who drop them later."""
    return _all(F.lower(text), TERM_TOKEN)


def word_set(text: Column) -> Column:
    """Distinct words for overlaps and similarities."""
    return F.array_distinct(_all(F.lower(text), WORD_TOKEN))


def words(text: Column) -> Column:
    return _all(F.lower(text), WORD_TOKEN)


def overlap(query: Column, doc: Column, empty: float | None = 0.5) -> Column:
    """Share of the query's distinct words that the document has."""
    return F.when(F.size(query) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(query, doc)) / F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def content_key(text: Column) -> Column:
    """Hash of lower-cased text with white space evened out."""
    return F.md5(F.regexp_replace(F.regexp_replace(F.lower(text), EDGES, ""), r"\s+", " ").cast("binary"))


def is_phrase(query: Column) -> Column:
    return F.size(F.split(F.regexp_replace(query, EDGES, ""), r"\s+")) > 1


def token_estimate(source: Column, title: Column, content: Column) -> Column:
    """Tokens that one item of context is taken to need."""
    text = F.concat(F.lit("Source: "), source, F.lit(" | Title: "), title, F.lit(" | Content: "), content)
    return (F.floor(F.length(text) / 4) + 10).cast("long")


def news_relevance(title: Column, summary: Column, terms: Sequence[str]) -> Column:
    """2 for a term in the title, else 1 for one in the text, over the number of terms, at most 1."""
    if not terms:
        return F.lit(0.5)
    low, text = F.lower(title), F.lower(F.concat(title, F.lit(" "), summary))
    total = sum((F.when(F.contains(low, F.lit(t.lower())), 2.0).when(F.contains(text, F.lit(t.lower())), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
    return F.least(total / len(terms), F.lit(1.0))


def keyword_sentiment(title: Column) -> Column:
    """bullish or bearish, whichever has more of its words in the title, else neutral."""
    low = F.lower(title)
    bull, bear = (sum((F.contains(low, F.lit(w)).cast("int") for w in words_), F.lit(0)) for words_ in (S.BULLISH_WORDS, S.BEARISH_WORDS))
    return F.when(bull > bear, "bullish").when(bear > bull, "bearish").otherwise("neutral")


def _first_match(rules: dict[str, Column], default: str) -> Column:
    out = None
    for name, test in rules.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def _any_word(text: Column, words_: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words_]), lambda w: F.contains(text, w))


def sector(ticker: Column, query: Column) -> Column:
    """By ticker or by substrings of the query, in the sectors' order."""
    t, q = F.upper(ticker), F.lower(query)
    return _first_match({name: t.isin(tickers) | _any_word(q, words_) for name, (tickers, words_, _, _) in S.SECTORS.items()}, "general_equity")


def horizon(query: Column) -> Column:
    q = F.lower(query)
    return _first_match({name: _any_word(q, words_) for name, words_ in S.HORIZONS.items()}, "medium_term")


def sentences(text: Column) -> Column:
    """Sentences of more than five characters."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, EDGES, "")), lambda s: F.length(s) > 5)


def chunks(text: Column, size: int, stride: int) -> Column:
    """Pieces of ``size`` characters, one every ``stride``."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(stride)), lambda i: F.substring(text, i, F.lit(size)))
