"""What a caller can plug in: research teams that return evidence, and text generators with a fallback.

Remote services are not part of this package; a provider is any callable from prompt
to text, and a team any object with a name and a ``research`` method.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[str], str]


class ResearchTeam(ABC):
    """A source of evidence for a question."""

    name: str

    @abstractmethod
    def research(self, spark: SparkSession, ticker: str, query: str) -> DataFrame:
        """Rows of evidence."""


class TableTeam(ResearchTeam):
    """Evidence of some source types from a table."""

    def __init__(self, name: str, evidence: DataFrame, source_types: Sequence[str]):
        self.name, self.evidence, self.source_types = name, evidence, list(source_types)

    def research(self, spark: SparkSession, ticker: str, query: str) -> DataFrame:
        return self.evidence.filter((F.upper("ticker") == ticker.upper()) & F.col("source_type").isin(self.source_types))


def gather(spark: SparkSession, teams: Sequence[ResearchTeam], ticker: str, query: str) -> DataFrame:
    """All teams' evidence, one after the other; columns that a team lacks are null."""
    out = None
    for team in teams:
        rows = team.research(spark, ticker, query)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no team")
    return out


_FACTORIES: dict[str, Callable[..., Provider]] = {}


def register_provider(name: str, factory: Callable[..., Provider]) -> None:
    _FACTORIES[name.lower().strip()] = factory


def provider(name: str, **settings) -> Provider:
    try:
        return _FACTORIES[name.lower().strip()](**settings)
    except KeyError:
        raise ValueError(f"no provider {name!r}; known: {sorted(_FACTORIES)}") from None


def mock(reply: str = "No model is configured.") -> Provider:
    """Answers everything alike."""
    return lambda prompt: reply


register_provider("mock", mock)


def answers(prompts: DataFrame, ask: Callable[[str], str], *, prompt: str = "prompt") -> DataFrame:
    """Adds answer, from asking within tasks, a row at a time; the same prompt of a task's batch is asked once."""
    @F.pandas_udf("string")
    def asked(batch: pd.Series) -> pd.Series:
        return batch.map({p: ask(p) for p in batch.dropna().unique()})

    return prompts.withColumn("answer", asked(F.col(prompt)))


def with_fallback(names: Sequence[str], **settings) -> Provider:
    """Asks the named providers in turn until one answers; last of all the mock."""

    known, last = dict(_FACTORIES), mock()  # as of now: workers have no register of their own

    def ask(prompt: str) -> str:
        for name in names:
            try:
                if answer := known[name.lower().strip()](**settings.get(name, {}))(prompt):
                    return answer
            except Exception:  # whatever a remote service throws, the next one is asked
                continue
        return last(prompt)

    return ask
