"""Driver tables, and the roles they play in literature analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters that a query uses reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores where a table has few splits and each row takes long; a large table stays as it is scanned."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 4 * cores else rows.repartition(2 * cores)


#: Rows of a table of whole texts in one part, so that a task's memory is that of so many texts, whatever the table's size.
TEXTS = 2000


def spread_texts(rows: DataFrame, *keys: str) -> DataFrame:
    """A scanned table of whole texts in parts of ``TEXTS`` rows at most on average, two for each core at least; by ``keys``, or evenly."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TEXTS))  # files hold their counts
    return rows.repartition(parts, *keys)


#: Years given to documents, which have none: a null for every eleventh.
FIRST_YEAR, YEARS = 1990, 35

PAPERS_SQL = f"""papers as (select doc_id as paper_id, substr(text, 1, 80) as title, text as abstract, source as journal, lang,
  case when doc_id % 11 = 0 then null else cast({FIRST_YEAR} + doc_id % {YEARS} as int) end as year,
  'https://doi.org/10.1234/Doc.' || doc_id || case when doc_id % 2 = 0 then '.' else '' end as doi, n_chars
  from documents)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: paper_id, title, abstract, journal, lang, year (nullable), doi, tags, n_chars."""
    d = read(spark, sf_dir, "documents")
    year = F.when(F.col("doc_id") % 11 != 0, (F.lit(FIRST_YEAR) + F.col("doc_id") % YEARS).cast("int"))
    doi = F.concat(F.lit("https://doi.org/10.1234/Doc."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".").otherwise(""))
    return d.select(
        F.col("doc_id").alias("paper_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("journal"),
        "lang",
        year.alias("year"),
        doi.alias("doi"),
        F.array("lang", "source").alias("tags"),
        "n_chars",
    )
