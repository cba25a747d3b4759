"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of characters other than space and \x09-\x0D.
SPACE_CLASS = "[ \\t-\\r]+"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below ``spark.checkpoint.dir`` (shared by all executors)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: File or partition (longer names come later) and row in it.
ROW_ORDER = ("__row_part", "__row_at")


def row_order(docs: DataFrame) -> DataFrame:
    """Add the columns of ``ROW_ORDER``: the place of each row as it was written.

    Spark packs files into partitions by size, so rows read straight from files take file
    name and row number of the file; those of any other plan their partition and row in it.
    """
    part, at = ROW_ORDER
    plan = docs._jdf.queryExecution().analyzed()
    if plan.children().isEmpty() and not plan.metadataOutput().isEmpty():
        meta = docs.metadataColumn("_metadata")
        return docs.withColumns({part: meta["file_path"], at: meta["row_index"]})
    number = F.monotonically_increasing_id()  # partition above 33 bits, row below
    return docs.withColumns({part: F.shiftright(number, 33).cast("string"), at: number.bitwiseAND(F.lit((1 << 33) - 1))})


def fold_ascii(text) -> Column:
    """Lower-case A-Z only. ASCII texts take the byte-wise path of ``lower``."""
    c = F.col(text) if isinstance(text, str) else text
    return (F.when(F.length(c) == F.octet_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, UPPER.lower())))


def words_of(text: Column) -> Column:
    """Array of the words of ``text`` (null text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
