"""Keyterm search over a stream of arriving texts (Structured Streaming).

The query list is prepared once (static, checkpointed); every micro-batch of new texts is
cleaned and counted with the same batch operators inside ``foreachBatch`` and written to
a Parquet table partitioned by batch id with dynamic partition overwrite, so a replayed
batch replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.text import DEFAULT_STOPWORDS, clean_text
from lexiflow.operators.keyterms import keyterm_hits, prepare_queries, query_profile, search_options
from lexiflow.session import cut_lineage


def start_keyterm_stream(spark: SparkSession, source: str, schema: str, raw_queries: DataFrame,
                         out_path: str, id_col: str = "doc_id",
                         fields: Mapping[str, str] | None = None, mode: str = "token",
                         stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                         *, checkpoint: str, available_now: bool = True,
                         max_files_per_trigger: int | None = None):
    """Start the streaming search; returns the ``StreamingQuery``.

    ``source`` is a folder of Parquet files with ``schema``; new files are picked up as
    they arrive. ``available_now=True`` processes what is there and stops. A restart with
    the same ``checkpoint`` folder goes on after the last finished batch.
    """
    fields = dict(fields or {"body": "text"})
    queries = cut_lineage(prepare_queries(raw_queries, stopwords=stopwords))
    opts = search_options(query_profile(queries).first())
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)

    def process(batch: DataFrame, batch_id: int) -> None:
        cleaned = batch.select(F.col(id_col), *[clean_text(F.col(src), stopwords=stopwords, **opts).alias(f)
                                                for f, src in fields.items()])
        hits = keyterm_hits(cleaned, queries, id_col=id_col, fields=list(fields), mode=mode)
        (hits.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
