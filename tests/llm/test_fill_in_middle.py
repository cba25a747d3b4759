"""Fill-in-the-middle transformation against a plain version with regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest

from lexiflow.llm import fill_in_middle as M
from lexiflow.llm.queries import QUERIES

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    ends = [m.end() for m in TOKEN.finditer(text)]
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(ends)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut = [0, *ends]
    p, m, s = text[:cut[a]], text[cut[a]:cut[b]], text[cut[b]:]
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def compare(docs, rows):
    got = sorted(map(tuple, M.transformation_report(docs).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)


def test_report_matches_plain_version(spark):
    rng = random.Random(7)
    alphabet = ["a", "é", "日本", "x" * 300, " ", "  ", "\n", "\t\r", "\x0b", "\xa0", "<", "<S", "P>", "word", "\U0001f600"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    rows += [(1000 + i, f"a {m} b") for i, m in enumerate(("<P>", "<S>", "<M>", "<p>", "< P>"))]
    rows += [(2000 + i, t) for i in range(12) for t in (" ", "one", " one", "one ", "\n \n", None, "")]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_odd_and_empty(spark, odd, odd_rows, empty):
    compare(odd, [(r[0], r[1]) for r in odd_rows])
    assert M.transformation_report(empty).collect() == []
    assert M.fill_in_middle(empty).collect() == []
    named = odd.withColumn("form", odd.lang).withColumn("n", odd.len).withColumn("__fim_1", odd.lang)
    assert M.transformation_report(named).count() == len(odd_rows)


def test_registered_query_reads_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(brute(r.doc_id, r.text) for r in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back(spark, odd, odd_rows):
    got = M.fill_in_middle(odd.withColumn("form", odd.lang)).collect()
    assert set(got[0].asDict()) == set(odd.columns) | {"form"}
    back = [(r.doc_id, M.restore(r.text.encode(), r.form).decode()) for r in got]
    assert sorted(back, key=repr) == sorted(((r[0], r[1] or "") for r in odd_rows), key=repr)
    assert any(r.form != "plain" for r in got)


@pytest.mark.parametrize("error", [0, 3, 64, 1000])
def test_index_is_exact_and_within_its_error(error):
    rng = np.random.default_rng(error)
    texts = [np.cumsum(rng.integers(1, step, size)) for size, step in ((1, 5), (2, 9), (5000, 12), (400, 4000), (3, 10 ** 6))]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = M.RankIndex(np.concatenate(texts), first, error)
    assert np.abs(index.residuals.astype(np.int64)).max() <= error
    for i, t in enumerate(texts):
        assert (index.offset(np.full(len(t), i), np.arange(len(t))) == t).all()
    assert len(index) < first[-1]
    steady = M.RankIndex(np.arange(0, 70_000, 7), np.array([0, 10_000]), error)
    assert len(steady) == 1  # a line needs one segment, however long
