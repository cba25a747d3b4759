"""Suffix-array dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from lexiflow.llm import suffix_dedup as S
from lexiflow.llm import words as W

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows, length=200, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in S.removal_report(docs, length=length, **options).collect()]
    want = brute(rows, length)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def corpus(seed, alphabet="abcdefgh é日", unit=1):
    """Copies, edited copies, passages in most texts, runs of one symbol, short texts."""
    rng = random.Random(seed)
    def text(n):
        return "".join(rng.choice(alphabet) for _ in range(n))
    passage = text(45 * unit)
    base = [text(rng.randrange(5, 150) * unit) for _ in range(30)]
    rows = []
    for i in range(90):
        t = rng.choice(base)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice((text(1), "", passage, "a" * 30 * unit, text(20 * unit))) + t[at + rng.randrange(3):]
        rows.append((i, t))
    return rows + [(200, None), (201, ""), (202, "a"), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed,length,gram,alphabet,bucket", [
    (1, 20, 4, "abcdefgh é日", 1 << 20), (2, 20, 8, "ab", 2000), (3, 33, 32, "abcd", 5000), (4, 64, 16, "xyz é", 1 << 14)])
def test_report_matches_brute_force(spark, seed, length, gram, alphabet, bucket):
    want = compare(spark, corpus(seed, alphabet), length, gram=gram, bucket_bytes=bucket)
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_production_length(spark):
    want = compare(spark, corpus(5, unit=10))
    assert any(r[3] > 1 for r in want)


def test_overloaded_buckets(spark, monkeypatch):
    """The same result when most buckets are over their share and windows travel singly."""
    monkeypatch.setattr(S, "HOT", 0)
    rows = corpus(6)
    compare(spark, rows, 20, gram=4, bucket_bytes=3000)


def test_passage_around_one_anchor_in_most_texts(spark):
    """A passage in every text, each with another neighbourhood: no bucket gathers the texts."""
    rng = random.Random(8)
    def text(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(60)
    rows = [(i, text(40) + passage + text(40)) for i in range(600)]
    want = compare(spark, rows, 40, gram=8, bucket_bytes=4000)
    assert all(r[2] >= 60 for r in want)
    # the same by hand: strings that share an anchor are many, windows that share a hash few
    b, offsets = W.text_buffer(S.pa.array([t for _, t in rows]))
    plain = S._Cutter(50, 40, 8).load(b, offsets)
    hot = np.flatnonzero(plain > 4 * np.median(plain))
    assert len(hot)
    load = collections.Counter()
    for x, kind, block in S._Cutter(50, 40, 8, hot).blocks(b, offsets, np.arange(600), np.arange(600)):
        if kind != S.DECIDED:
            load[x] += len(S._unpack(block)[0][0])
    windows = [n for x, n in load.items() if x >= 50]
    assert max(windows) < 3 * np.median(windows)


def test_columns_are_the_sorted_suffixes():
    """Order, common prefixes and transform of every column against sorting."""
    rng = np.random.default_rng(1)
    n, width, limit = 60, 25, 9
    symbols = rng.integers(1, 4, (width, n)).astype(np.uint16)
    symbols[:, 10:14] = symbols[:, [3]]
    for i in range(n):  # strings begin and end in different columns
        a, b = sorted(rng.integers(0, width + 1, 2))
        symbols[:a, i] = 0
        symbols[b:, i] = 0
    group = np.sort(rng.integers(0, 5, n))
    behind = np.arange(n)
    for c, order, common, segment in S.columns(symbols, group, limit):
        assert (segment == symbols[c][behind]).all()
        def suffix(i):
            s = symbols[c:, i].tolist()
            return s[:s.index(0)] if 0 in s else s
        keys = [(group[i], suffix(i)) for i in order]
        assert keys == sorted(keys)
        for k in range(1, n):
            (g, x), (h, y) = keys[k - 1], keys[k]
            same = 0
            while same < min(len(x), len(y), limit) and x[same] == y[same]:
                same += 1
            assert common[k] == (same if g == h else 0)
        behind = order


def test_anchored_strings_hold_every_window():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 19, 20, 21, 500, 3, 80)] + ["a" * 90]
    b, offsets = W.text_buffer(S.pa.array(texts))
    first, end, anchor, _ = S.anchored(b, offsets, 20, 4)
    starts = sorted(x for f, e in zip(first, end) for x in range(f, e - 19))
    want = [int(o) + i for o, t in zip(offsets, texts) for i in range(len(t) - 19)]
    assert starts == want and (first <= anchor).all() and (anchor + 4 <= end).all()


def test_odd_empty_and_kept_columns(spark, odd, odd_rows, empty):
    got = [tuple(r) for r in S.removal_report(odd).collect()]
    assert sorted(got, key=repr) == sorted(brute([(r[0], r[1]) for r in odd_rows], 200), key=repr)
    assert S.removal_report(empty).collect() == [] and S.remove_repeats(empty).collect() == []
    named = odd.withColumn("start", odd.lang).withColumn("bucket", odd.lang)
    left = S.remove_repeats(named)
    assert left.columns == named.columns
    texts = {r.doc_id: r.text for r in left.where("doc_id in (4, 5, 10, 13)").collect()}
    assert texts == {r[0]: r[1] for r in odd_rows if r[0] in texts} and len(texts) == 4


def test_registered_query_reads_all_documents(spark):
    from lexiflow.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(brute([(r.doc_id, r.text) for r in docs], 200))
