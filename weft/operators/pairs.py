"""All 28 features of pairs from what was learned of a training graph: its edges, node statistics and embeddings."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from weft.operators import analytics as A
from weft.operators import embeddings as E
from weft.operators import features as X
from weft.operators.communities import louvain


@dataclass
class PairFeatures:
    """Three tables that go into a bundle along with models: known(u, v), stats(id, ...), vectors(id, z)."""

    known: DataFrame
    stats: DataFrame
    vectors: DataFrame

    @classmethod
    def fit(cls, known: DataFrame, save: Callable[[DataFrame], DataFrame], dim: int = 16) -> PairFeatures:
        """Communities are modularity's at any number of edges, from rounds that end early: a feature, not a partition to keep.

        Each of the four is a loop of short jobs on its own, so they run side by side.
        """
        parts = (
            lambda: A.pagerank(known, save),
            lambda: A.closeness(known, save),
            lambda: louvain(known, save, patience=1, least=1e-3),
            lambda: save(E.node_embeddings(known, save, dim)),
        )
        run = inheritable_thread_target(known.sparkSession)(lambda part: part())
        with ThreadPoolExecutor(len(parts)) as pool:
            rank, close, communities, vectors = pool.map(run, parts)
        return cls(known, save(rank.join(close, "id").join(communities, "id", "left")), vectors)

    def transform(self, pairs: DataFrame, exclude_self_edge: bool = False) -> DataFrame:
        """pairs(u, v, ...) with the sixteen features of topology and the twelve of embeddings."""
        row = self.vectors.select("z").first()
        dim = len(row["z"]) if row else 1
        return E.edge_embedding_features(X.pair_features(self.known, pairs, self.stats, exclude_self_edge), self.vectors, dim)

    def tables(self) -> dict[str, DataFrame]:
        return {"known": self.known, "stats": self.stats, "vectors": self.vectors}
