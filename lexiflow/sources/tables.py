"""Table-shaped sources: fetched pages and page-wise document assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pattern: scheme://[userinfo@]host[:port]...
HOST_RE = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)"


def pages_source(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Already-fetched pages ``(url, text)``: text lower-cased, a failed page (NULL) is
    the empty text."""
    return pages.select(F.col(url_col).alias("url"),
                        F.lower(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))


def merge_pages(pages: DataFrame, key: str = "url") -> DataFrame:
    """All page texts joined by one space in key order (one row)."""
    return pages.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), " ").alias("text"))


def name_from_url(url) -> Column:
    """Second label of the host name (``www.example.org`` -> ``example``)."""
    host = F.regexp_extract(F.col(url) if isinstance(url, str) else url, HOST_RE, 1)
    return F.try_element_at(F.split(host, "\\."), F.lit(2))


def name_from_path(path) -> Column:
    """Last ``/`` segment of a path."""
    p = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(p, "/"), -1)


def assemble_pages(doc_pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Document text from its readable pages in page order, joined by one space, with
    the number of pages read and in total. Input ``(doc_id, page_no, text, ok)``."""
    part = F.when(F.col("ok"), F.struct("page_no", "text"))
    return doc_pages.groupBy(id_col).agg(
        F.array_sort(F.collect_list(part)).alias("_p"),
        F.count_if(F.col("ok")).alias("n_read"),
        F.count(F.lit(1)).alias("n_total"),
    ).select(id_col, F.array_join(F.transform("_p", lambda x: x["text"]), " ").alias("text"),
             "n_read", "n_total")


def read_parquet(spark, path: str, partitions: int | None = None) -> DataFrame:
    """Parquet scan; ``partitions`` deals the rows out evenly (a shuffle of the table).

    Parquet splits only at row-group boundaries. A caller who knows that a table is one
    large row group gives the number of partitions that the work on it needs; tables
    with row groups of a usual size are read as they are.
    """
    df = spark.read.parquet(path)
    return df if partitions is None else df.repartition(partitions)
