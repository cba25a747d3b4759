"""Streaming keyterm search equals the batch search; vocabulary mapping keeps order."""

import os
import tempfile

from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import vocabulary as V
from lexiflow.plans import jobs
from lexiflow.streaming import start_keyterm_stream


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="lexiflow-stream-")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["lawful interception handover", "the handover interface", "nothing here", "lawful interception lawful interception"])],
        "doc_id long, text string")
    src = os.path.join(d, "in")
    docs.limit(2).write.parquet(src)
    docs.subtract(docs.limit(2)).write.mode("append").parquet(src)
    raw = spark.createDataFrame([("lawful interception",), ("handover",)], "query string")
    out = os.path.join(d, "out")
    q = start_keyterm_stream(spark, src, "doc_id long, text string", raw, out,
                             checkpoint=os.path.join(d, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(120)
    got = {(r["doc_id"], r["query"], r["cnt"]) for r in spark.read.parquet(out).collect()}
    hits, _, _ = jobs.keyterm_search(docs, raw)
    want = {(r["doc_id"], r["query"], r["cnt"]) for r in hits.collect()}
    assert got == want and len(want) == 4


def test_map_and_normalise_vocabulary(spark):
    docs = spark.createDataFrame([(1, "running dogs ran"), (2, "")], "doc_id long, text string") \
        .select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    lemmas = spark.createDataFrame([("running", "run"), ("ran", "run")], "surface string, normal string")
    got = {r["doc_id"]: r["tokens"] for r in V.map_vocabulary(docs, lemmas).collect()}
    assert got == {1: ["run", "dogs", "run"], 2: []}
    stem = {r["doc_id"]: r["tokens"] for r in
            V.normalise_vocabulary(docs, lambda w: w[:-1] if w.endswith("s") else w).collect()}
    assert stem == {1: ["running", "dog", "ran"], 2: []}
