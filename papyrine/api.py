"""What callers ask: one class over a folder of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import graph, search, trends, vectors
from papyrine.plans import registry
from papyrine.sources.tables import papers, read


class Library:
    """Search, vector, graph and trend queries over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A stored table."""
        return read(self.spark, self.sf_dir, name)

    def search(self, query: str, *, top_k: int = 10, year_from: int | None = None, year_to: int | None = None, tags: Sequence[str] = ()) -> DataFrame:
        """Keyword search with filters, best first."""
        filters = search.Filters(year_from=year_from, year_to=year_to, lists={"tags": list(tags)})
        terms = list(dict.fromkeys(t for t in query.lower().split() if len(t) > 1))
        if not terms:
            raise ValueError("the query has no term of two letters or more")
        weights = {k: search.FIELD_WEIGHTS[k] for k in ("title", "abstract")}
        return search.keyword_search(papers(self.spark, self.sf_dir), terms, filters=filters, weights=weights, top_k=top_k)

    def related(self, vec_id: int, *, top_k: int = 10, label: int | None = None) -> DataFrame:
        """Nearest other vectors by cosine."""
        e = vectors.as_vectors(self.table("embeddings"))
        query = vectors.vector_of(e, vec_id)
        rest = e.where(F.col("vec_id") != vec_id)
        rest = rest if label is None else rest.where(F.col("label") == label)
        return vectors.nearest(rest, query, top_k).select("vec_id", "label", (1 - F.col("distance")).alias("similarity"))

    def neighbourhood(self, node_id: str, depth: int = 2) -> DataFrame:
        """Graph nodes within ``depth`` steps."""
        start = self.spark.createDataFrame([(node_id,)], "node_id string")
        return graph.within(graph.edges(self.spark, self.sf_dir), start, depth)

    def phases(self) -> DataFrame:
        """Time phases of the papers."""
        return trends.fixed_phases(papers(self.spark, self.sf_dir).where("year is not null"), "year")

    def ask(self, name: str) -> DataFrame:
        """A registered query by name."""
        return registry.queries()[name](self.spark, self.sf_dir)

    @staticmethod
    def names() -> Mapping[str, bool]:
        """Registered queries, and whether SQL gives the same rows."""
        sql = registry.oracle_sql()
        return {n: n in sql for n in registry.queries()}
