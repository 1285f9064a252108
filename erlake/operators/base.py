"""Extension point for blockers."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tfidf


class Blocker(ABC):
    """Learns from the corpus, then gives (s1, candidate, score, rank) for anchors."""

    @abstractmethod
    def fit(self, corpus: DataFrame) -> Blocker: ...

    @abstractmethod
    def retrieve(self, anchors: DataFrame, top_k: int) -> DataFrame: ...


class CharTfidf(Blocker):
    def __init__(self, column: str = "name_n", low: int = 2, high: int = 5, min_df: int = 2) -> None:
        if not 1 <= low <= high or min_df < 1:
            raise ValueError("1 <= low <= high and min_df >= 1 are needed")
        self.column, self.low, self.high, self.min_df = column, low, high, min_df

    def _texts(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("entity_id").alias("id"), F.col(self.column).alias("text"))

    def fit(self, corpus: DataFrame) -> CharTfidf:
        self.corpus = self._texts(corpus)
        return self

    def retrieve(self, anchors: DataFrame, top_k: int) -> DataFrame:
        if top_k < 1:
            raise ValueError("top_k must be positive")
        return tfidf.top_k(self._texts(anchors), self.corpus, top_k, self.low, self.high, self.min_df)
