"""Language ID by held-out accuracy and exact code lengths; quality classifier."""

import collections
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import lang_id, quality_classifier


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in lang_id.language_report(docs, per_language=60).collect() if r.held_out]
    assert len(got) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) > 0.97 * len(got)


def brute_cost(train, text, order):
    """Code length of text in bits, byte by byte, from plain dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        b = lang_id.PAD * order + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k:i]][b[i]] += 1
    b, bits = lang_id.PAD * order + text.encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get(b[i - k:i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                bits += math.log2((n + d) / c[b[i]])
                break
            bits += math.log2((n + d) / d)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    train = {"x": ["abra cadabra", "abc"], "y": ["ünder über", "zzz"]}
    rows = spark.createDataFrame([(k, t) for k, v in train.items() for t in v], "lang string, text string")
    for order in (0, 2, 4):
        trees = lang_id.ContextTrees(lang_id.count_grams(rows, order).toPandas(), order)
        index = pd.Index(trees.seen)
        for text in ("abracadabra", "über z", "q", "漢字 abc"):
            b = np.frombuffer(text.encode(), np.uint8)
            out = np.zeros((1, 2))
            lang_id._add_bits(trees, index, b, np.array([0, len(b)]), out)
            assert out[0] == pytest.approx([brute_cost(train[k], text, order) for k in trees.langs])


def test_long_texts_go_block_by_block(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "abcabd"), ("y", "xyz xyz")], "lang string, text string")
    trees = lang_id.ContextTrees(lang_id.count_grams(rows).toPandas())
    index = pd.Index(trees.seen)
    b = np.frombuffer(b"abcabdxyz " * 50, np.uint8)
    whole, parts = np.zeros((1, 2)), np.zeros((1, 2))
    lang_id._add_bits(trees, index, b, np.array([0, len(b)]), whole)
    monkeypatch.setattr(lang_id, "GROUP_BYTES", 64)
    lang_id._add_bits(trees, index, b, np.array([0, len(b)]), parts)
    # a block but the first takes the real bytes before it as its context
    assert parts == pytest.approx(whole)


def test_odd_rows(odd, odd_rows, empty):
    got = lang_id.language_report(odd).collect()
    assert len(got) == len(odd_rows)
    languages = {r[2] for r in odd_rows} - {None}
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in languages | {"und"}
    und = [r for r in odd_rows if not any(c.isalpha() for c in r[1] or "")]
    assert sum(r.lang_pred == "und" for r in got) == len(und)
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    kept = lang_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - len(und)
    assert lang_id.language_report(empty).count() == 0


def test_no_training_rows(odd):
    got = lang_id.language_report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_held_out_rows_never_train(spark):
    import zlib
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "abc def", "held" if i in held else "free") for i in range(100)],
                                 "doc_id long, text string, lang string")
    assert {r.lang for r in lang_id.training_sample(docs).collect()} == {"free"}
    assert {r.doc_id for r in lang_id.language_report(docs).collect() if r.held_out} == set(held)


def test_quality_classifier(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.quality_classifier(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in held) > 0.9 * len(held)


def test_sparse_paths_shrink(spark):
    """A path with one bad document stays near its site, one with many does not."""
    rows = [(i, "w " * 30, "a", "good") for i in range(200)] + [(1000, "w " * 30, "a", "one")]
    rows += [(2000 + i, "w " * 30, "b", "bad") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, site string, path string")
    labels = spark.createDataFrame([(r[0], int(r[3] == "good")) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.quality_classifier(
        docs, labels, F.col("site"), F.col("path")).collect()}
    assert got[0].p_path > 0.8 > 0.2 > got[2000].p_path
    assert got[1000].p_path > 0.5


def test_quality_classifier_odd_rows(odd, odd_rows, empty, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, 0), (9, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.quality_classifier(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(odd_rows) and all(0 < r.p_good < 1 for r in got)
    none = labels.where("false")
    assert quality_classifier.quality_classifier(odd, none, F.col("source"), F.col("lang")).count() == len(odd_rows)
    assert quality_classifier.quality_classifier(empty, none, F.col("source"), F.col("lang")).count() == 0


def test_every_ratio_tells_texts_apart(spark, sample):
    """Each ratio has two bins at least, and words of twice the usual length are evidence by themselves."""
    junk = [(-1, "a"), (-2, "#$% " * 40), (-3, "same line\n" * 40), (-4, "WORD! " * 50), (-5, "x" * 400), (-6, "1234 " * 30)]
    frame = sample.select("doc_id", "text").union(spark.createDataFrame(junk, "doc_id long, text string"))
    bins = quality_classifier.rule_counts(frame).select(quality_classifier._bins().alias("b")).collect()
    assert all(len({r.b[f] for r in bins}) > 1 for f in range(len(quality_classifier.RULES)))
    word = {1: "abcdefg ", 0: "abcdefgabcdefgabcdefgabcdefgab "}
    rows = [(i, word[i % 2] * 60, "s", "p") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, site string, path string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality_classifier.quality_classifier(docs, labels, F.col("site"), F.col("path")).collect()
    assert all((r.evidence > 1) == (r.doc_id % 2 == 1) and abs(r.evidence) > 1 for r in got)


def test_texts_in_no_learned_language_go(spark):
    """Random letters and an unseen script are rejected; all rows of the table stay, and so do short texts."""
    import random
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(10 ** 9 + i, "".join(rng.choice("qxzjkvwbpdfghm ") for _ in range(400)), None, "x", 400) for i in range(20)]
    odd += [(2 * 10 ** 9 + i, "これは学習していない言語で書かれた文書です。" * (2 + i % 5), None, "x", 1) for i in range(20)]
    odd += [(3 * 10 ** 9, "Zq", None, "x", 2), (3 * 10 ** 9 + 1, "12 34", None, "x", 5), (3 * 10 ** 9 + 2, None, None, "x", 0)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r.doc_id for r in lang_id.keep_identified(both).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert got == clean | {3 * 10 ** 9} and len(clean) > 980
