"""N-gram Jaccard join and substring dedup against brute force."""

import collections
import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from lexiflow.llm import ngram_join, substring_dedup
from lexiflow.llm import words as W

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, k):
    w = (text or "").translate(FOLD).encode().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, t):
    """Component id of each row by comparing all pairs."""
    sets = [shingles(text, k) for _, text in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and comp[a] != comp[b]:
                both = len(sets[a] & sets[b])
                if both * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - both):
                    old, new = comp[b], comp[a]
                    comp = [new if c == old else c for c in comp]
    ids = collections.defaultdict(list)
    for (i, _), c in zip(rows, comp):
        ids[c] += [i] * (i is not None)
    return [(i, len(s), min(ids[c]) if ids[c] else None) for (i, _), s, c in zip(rows, sets, comp)]


def edited(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def corpus(seed):
    """Chains of near copies, tiny texts, a passage and common words in most texts."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 9, 12, 20, 60, 150, 300)))]
        if rng.random() < 0.6:
            words = words + passage
        for _ in range(rng.randrange(1, 14)):
            rows.append((len(rows), " ".join(words)))
            words = edited(rng, words, rng.choice((0, 0.005, 0.01, 0.02, 0.1)))
            if rng.random() < 0.2:
                words = words[1:] + ["tail"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,t", [(1, 3, Fraction(90, 100)), (2, 5, Fraction(80, 100)), (3, 3, Fraction(1, 2)),
                                      (4, 2, Fraction(95, 100))])
def test_components_match_all_pairs(spark, seed, k, t):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.near_duplicate_report(docs, k=k, threshold=t).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, k, t))
    kept = {r.doc_id for r in ngram_join.drop_near_duplicates(docs, k=k, threshold=t).collect()}
    assert kept == {c for _, _, c in brute_components(rows, k, t)}


def test_large_groups_in_parts(spark, monkeypatch):
    """The same components when groups are cut in parts and joins are not broadcast."""
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "ROW_BROADCAST_BYTES", 0)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.near_duplicate_report(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 3, Fraction(9, 10)))


def test_hot_shingles_change_nothing(spark, monkeypatch):
    """With nearly every shingle taken as hot, keys still lose no link."""
    monkeypatch.setattr(ngram_join.hot_shingles, "__defaults__", (0.0001,))
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = ngram_join.near_duplicate_report(docs, k=5, threshold=Fraction(4, 5)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 5, Fraction(4, 5)))


def test_tree_finds_all_links():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 63, 80).astype(np.uint64) for _ in range(30)]
    sets = []
    for s in base:
        for _ in range(12):
            s = s.copy()
            s[rng.integers(0, 80, rng.integers(0, 6))] = rng.integers(0, 1 << 63)
            sets.append(np.unique(s))
    t = Fraction(9, 10)
    comp = ngram_join.linked_parts(sets, None, t)
    across = ngram_join.linked_parts(sets[:200], sets[200:], t)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 10 * both >= 9 * (len(sets[a]) + len(sets[b]) - both):
                assert comp[a] == comp[b]
                assert across[a] == across[b] or (a < 200) == (b < 200)
    assert 30 <= len(set(comp.tolist())) < len(sets)


def test_odd_rows_near(odd, odd_rows, empty):
    got = ngram_join.near_duplicate_report(odd).collect()
    want = brute_components([r[:2] for r in odd_rows], 3, Fraction(9, 10))
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(want, key=order)
    assert ngram_join.drop_near_duplicates(odd).columns == odd.columns
    assert ngram_join.near_duplicate_report(empty).count() == 0
    assert ngram_join.drop_near_duplicates(empty).count() == 0


def brute_removal(rows, window):
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        i = float("inf") if i is None else i
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (float("inf") if i is None else i):
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def key(x):
    return tuple((v is None, v or 0) for v in x[:3]) + (x[3],)


def test_removal_matches_brute_force(odd, odd_rows, sample):
    for frame, rows in ((odd, [r[:2] for r in odd_rows]), (sample, [(r.doc_id, r.text) for r in sample.collect()])):
        got = [tuple(r) for r in substring_dedup.removal_report(frame).collect()]
        assert sorted(got, key=key) == sorted(brute_removal(rows, 13), key=key)


def test_hot_passage_and_small_groups(spark, monkeypatch):
    """A passage in all texts, repeated within texts, over many groups and runs."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([f"a{rng.randrange(50)}" for _ in range(rng.randrange(40))] + [passage] * rng.choice((1, 1, 2))
                         + [f"b{rng.randrange(5)}" for _ in range(rng.randrange(60))])) for i in range(150)]
    for group, run in ((2000, 4096), (1 << 20, 3)):
        monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
        monkeypatch.setattr(substring_dedup, "MAX_RUN", run)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = [tuple(r) for r in substring_dedup.removal_report(docs, window=6, minimiser=2).collect()]
        assert sorted(got) == sorted(brute_removal(rows, 6))


def passages(n, rng):
    """A passage in every text between words that differ, and some repeats of the passage."""
    passage = " ".join(f"p{i}" for i in range(14))
    return [(i, " ".join([f"a{rng.randrange(10 ** 6)}" for _ in range(12)] + [passage] * rng.choice((1, 1, 2))
                         + [f"b{rng.randrange(10 ** 6)}" for _ in range(12)])) for i in range(n)]


@pytest.mark.parametrize("hot,group", [(0, 8 << 20), (0, 3000), (4, 3000)])
def test_hot_minimisers_travel_by_window(spark, monkeypatch, hot, group):
    """The same result whichever buckets are over their share."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
    rng = random.Random(11)
    rows = passages(120, rng) + [(500 + i, t) for i, (_, t) in enumerate(passages(20, rng))] + [(7, "one two"), (None, "p1 p2 p3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in substring_dedup.removal_report(docs, window=8, minimiser=2, bucket_bytes=3000).collect()]
    assert sorted(got, key=key) == sorted(brute_removal(rows, 8), key=key)


def test_a_minimiser_in_all_texts_gathers_nowhere(spark):
    """Edges of a passage share its minimiser, but no bucket grows with the texts once it is hot."""
    rows = passages(900, random.Random(3))
    b, offsets = W.text_buffer(__import__("pyarrow").array([t for _, t in rows]))
    ids, hasher, n = np.arange(900), W.Hasher(), 40

    def loads(hot):
        out = collections.Counter()
        for x, kind, block in substring_dedup._packets(b, offsets, ids, ids, hasher, n, 8, 2, hot):
            if kind != 1:
                out[x] += len(substring_dedup._unpack(block)[0][0])
        return out

    plain = loads(())
    hot = [x for x, c in plain.items() if c > 4 * np.median(list(plain.values()))]
    assert hot
    after = loads(np.array(hot))
    single = [c for x, c in after.items() if x >= n]
    assert max(single) < 2 * np.median(single) and max(c for x, c in after.items() if x < n) <= max(
        c for x, c in plain.items() if x not in hot)


def test_remove_repeats_gives_texts(odd, odd_rows, empty):
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == odd.columns
    got = collections.Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect())
    assert got == collections.Counter((i, s) for i, _, _, s in brute_removal([r[:2] for r in odd_rows], 13))
    assert substring_dedup.removal_report(empty).count() == 0


def test_super_k_mers_cover_each_window_once():
    text = b"a b c a b d e f a b c a b d e f g h i j k"
    b = np.frombuffer(text, np.uint8)
    s, e, own = W.word_spans(b, np.array([0, len(b)]))
    first, last, _ = substring_dedup._runs(W.Hasher().spans(b, s, e), own, 5, 2)
    windows = [w for x, y in zip(first, last) for w in range(x, y - 4)]
    assert windows == list(range(len(s) - 4))
