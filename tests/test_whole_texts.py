"""Queries that use every place of the texts, against brute force on the smoke tables."""

import hashlib

from lexiflow.functions import text as T
from lexiflow.plans import standins as S
from lexiflow.plans.registry import DEFAULT_OPTS, QUERIES, offtopic_docs
from pyspark.sql import functions as F

SMOKE = "/root/testdata/sf0.001"


def test_every_place_of_the_passages(spark):
    cleaned = S.table(spark, SMOKE, "benchmark").select("item_id", T.clean_text(F.col("text"), **DEFAULT_OPTS).alias("t"))
    off = [r.text_clean for r in offtopic_docs(spark, SMOKE).collect()]
    want = set()
    for r in cleaned.collect():
        w = r.t.split()
        want |= {(r.item_id, i) for i in range(len(w) - 1) if not any(f"{w[i]} {w[i + 1]}" in t for t in off)}
    got = [tuple(r) for r in QUERIES["ngram_difference_places"](spark, SMOKE).select("item_id", "position").collect()]
    assert sorted(got) == sorted(want) and any(i > 0 for _, i in want)


def test_every_word_of_the_documents(spark):
    want = {w for r in S.corpus(spark, SMOKE).select(F.lower("text").alias("t")).collect() for w in (r.t or "").split()}
    got = [r.word for r in QUERIES["scan_stopwords_all_words"](spark, SMOKE).collect()]
    assert sorted(got) == sorted(want)


def test_every_file_keeps_its_id_and_text(spark):
    want = [(str(r.item_id), hashlib.md5(f"{r.text}\n".encode()).hexdigest()) for r in S.table(spark, SMOKE, "benchmark").collect()]
    got = [(r.doc_id, r.text_md5) for r in QUERIES["scan_documents_texts"](spark, SMOKE).collect()]
    assert sorted(got) == sorted(want)
