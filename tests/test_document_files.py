"""Named text files: round trip, failed attempts, appends."""

import os

import pytest
from pyspark.sql import functions as F

from lexiflow.sources import document_files as D
from lexiflow.sources import files as FS


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_name string, text string").repartition(3)


def test_round_trip_under_own_names(spark, tmp_path):
    rows = [("spec", "one\n"), ("spec", "two"), ("a b", "é\r\n\n"), ("x/y%z", "slash"), ("", "no name"), (None, "null name"), ("nul", None)]
    path = f"{tmp_path}/docs"
    D.save_documents(frame(spark, rows), path)
    got = D.load_documents(spark, path).collect()
    assert sorted((r.name, r.text) for r in got if r.name) == sorted((n, t or "") for n, t in rows if n)
    assert {r.text for r in got if not r.name} == {"no name", "null name"}
    assert sorted(r["index"] for r in got) == list(range(7))
    names = {f for f in os.listdir(path) if f.endswith(".txt")}
    assert len(names) == 7 and {n.rsplit("_", 1)[0] for n in names} == {"spec", "a b", "x%2Fy%25z", "", "nul"}
    assert all(f"{D.file_name(r.name, r['index'])}" in names for r in got)
    scanned = {r.doc_id: r.text for r in FS.scan_documents(spark, f"{path}/spec_*.txt").collect()}
    assert sorted(scanned.values()) == ["one\n", "two"] and all(k.startswith("spec_") for k in scanned)


def test_a_failed_job_leaves_nothing_that_counts(spark, tmp_path):
    path = f"{tmp_path}/docs"
    D.save_documents(frame(spark, [("kept", "old")]), path)
    bad = spark.range(200).select(F.concat(F.lit("n"), "id").alias("name"), F.col("id").alias("index"),
                                  F.when(F.col("id") == 199, F.raise_error(F.lit("stop"))).otherwise("new").alias("text"))
    with pytest.raises(Exception):
        bad.repartitionByRange(4, "index").write.format(D.FORMAT).mode("append").save(path)
    assert [r.name for r in D.load_documents(spark, path).collect()] == ["kept"]
    D.save_documents(frame(spark, [("later", "new")]), path, mode="append")
    assert {r.name for r in D.load_documents(spark, path).collect()} == {"kept", "later"}
    D.save_documents(frame(spark, [("last", "x")]), path)
    assert [r.name for r in D.load_documents(spark, path).collect()] == ["last"]


def test_no_partition_for_each_document(spark, tmp_path):
    path = f"{tmp_path}/docs"
    D.save_documents(spark.range(500).selectExpr("concat('d', id) as doc_name", "cast(id as string) as text"), path)
    back = D.load_documents(spark, path)
    assert back.count() == 500 and 1 < back.rdd.getNumPartitions() <= 4


def test_empty_table(spark, tmp_path):
    D.save_documents(frame(spark, []), f"{tmp_path}/none")
    assert D.load_documents(spark, f"{tmp_path}/none").collect() == []
