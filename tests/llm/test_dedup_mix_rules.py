"""Exact dedup, mixing and quality rules: brute force and defined cases."""

import collections
import hashlib
import re

from lexiflow.llm import exact_dedup, mixing, quality_rules

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def folded(t):
    return (t or "").translate(FOLD)


def test_duplicate_report_matches_grouping(odd, odd_rows):
    got = exact_dedup.duplicate_report(odd).collect()
    groups = collections.defaultdict(list)
    for r in odd_rows:
        groups[folded(r[1])].append(r[0])
    want = collections.Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, max(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_non_ascii_capitals_are_not_folded(spark):
    rows = [(1, "É x"), (2, "é X"), (3, "é x"), (4, "K"), (5, "k")]
    got = {r.doc_id: r.keep_id for r in exact_dedup.duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 3, 3: 3, 4: 4, 5: 5}


def test_exact_dedup_keeps_one_whole_row_of_each_text(odd, odd_rows):
    out = exact_dedup.exact_dedup(odd)
    assert out.columns == odd.columns
    got = out.collect()
    best = {}
    for r in odd_rows:
        key = folded(r[1])
        best[key] = max(best.get(key, -1), -1 if r[0] is None else r[0])
    assert {folded(r.text): -1 if r.doc_id is None else r.doc_id for r in got} == best
    assert len(got) == len(best)


def test_filter_clears_unique_rows_and_no_repeat(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "concat('t', id % 19000) as text")
    size = exact_dedup.filter_size(20_000)
    keyed = exact_dedup.keyed_rows(rows.withColumn(exact_dedup.SHA, exact_dedup._sha(rows["text"])), size)
    probed = exact_dedup.probe(keyed, exact_dedup.repeat_filter(keyed, size), size, 0)
    repeated = probed.where("doc_id % 19000 < 1000")
    assert repeated.where("__dedup_suspect").count() == 2000
    assert probed.where("__dedup_suspect").count() < 4000
    assert exact_dedup.exact_dedup(rows).count() == 19_000


def test_filter_in_slices(spark, odd, odd_rows, monkeypatch):
    """The same rows when the filter is far over one broadcast; no slice gets more than its bound, none shuffles a unique text."""
    rows = spark.range(30_000).selectExpr("id as doc_id", "concat('t', id % 28000) as text")
    whole = sorted(map(tuple, exact_dedup.duplicate_report(rows).collect()))
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 5 * 1088)
    size = exact_dedup.filter_size(30_000)
    assert size.n_slices == 6 and size.per_slice == 5
    assert sorted(map(tuple, exact_dedup.duplicate_report(rows).collect())) == whole
    assert exact_dedup.exact_dedup(rows).count() == 28_000
    keyed = exact_dedup.keyed_rows(rows.withColumn(exact_dedup.SHA, exact_dedup._sha(rows["text"])), size)
    keyed = exact_dedup.sliced(keyed, "test")
    packed = exact_dedup.repeat_filter(keyed, size)
    parts = [exact_dedup.probe(keyed, packed, size, i) for i in range(6)]
    assert sum(p.count() for p in parts) == 30_000
    assert "Exchange hashpartitioning" not in parts[0]._jdf.queryExecution().executedPlan().toString()
    assert packed.count() <= size.n_blocks
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 1)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1 << 11)
    test_duplicate_report_matches_grouping(odd, odd_rows)
    test_exact_dedup_keeps_one_whole_row_of_each_text(odd, odd_rows)


def test_empty_tables(empty):
    assert exact_dedup.duplicate_report(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.pfair_mix(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0


def test_period_is_fair_at_every_slot():
    shares = {"a": 300, "b": 7, "c": 111, "d": 1, "e": 81}
    period = sum(shares.values())
    plan = mixing.period_schedule(shares)
    assert sorted(s for _, _, s in plan) == list(range(period))
    had = dict.fromkeys(shares, 0)
    for s, j, slot in plan:
        assert j == had[s] and j * period // shares[s] <= slot < -(-(j + 1) * period // shares[s])
        had[s] += 1
        assert all(abs(had[x] - (slot + 1) * shares[x] / period) < 1 for x in shares)


def test_mix_places_every_row_once(odd, odd_rows):
    out = mixing.pfair_mix(odd, block_rows=2)
    assert len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert len(got) == len(odd_rows)
    assert len({r.mix_position for r in got}) == len(got)
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    by_source = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.mix_position):
        by_source[r.source].append(r.mix_block)
    assert all(b == [i // 2 for i in range(len(b))] for b in by_source.values())


def test_mixed_order_keeps_the_columns_and_rows(odd, odd_rows):
    out = mixing.mixed_order(odd)
    assert out.columns == odd.columns
    got = out.collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(odd_rows)


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_rule_counts_match_brute_force(odd, odd_rows, sample):
    for frame, rows in ((odd, [(r[0], r[1]) for r in odd_rows]), (sample, [(r.doc_id, r.text) for r in sample.collect()])):
        got = collections.Counter(tuple(r)[:7] for r in quality_rules.quality_rules(frame).collect())
        want = collections.Counter()
        for i, t in rows:
            c = brute_counts(t)
            want[(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
        assert got == want


def test_rules_verdict(sample):
    got = quality_rules.quality_rules(sample).collect()
    assert all(r.kept == (not r.base_failed and r.p_good >= 0.5) for r in got)
    assert sum(r.kept for r in got) > 0.6 * len(got)


def test_em_weighs_rules_by_their_agreement():
    """Two rules agree on a fifth of the documents; a third objects to one in a hundred at random."""
    votes = [((1, 1, 1), 3960), ((1, 1, -1), 40), ((-1, -1, 1), 990), ((-1, -1, -1), 10), ((1, -1, 1), 20), ((-1, 1, 1), 20)]
    prior, acc = quality_rules.estimate(votes)
    assert 0.7 < prior < 0.9
    assert quality_rules.posterior((1, 1, -1), prior, acc) > 0.5 > quality_rules.posterior((-1, -1, 1), prior, acc)
    assert abs(quality_rules.weights(acc[2])[1]) < 0.5 * abs(quality_rules.weights(acc[0])[1])


def test_verdicts_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).collect() if r.doc_id in quality]
    good = [r.kept for r in got if quality[r.doc_id] == 1 and not r.base_failed]
    bad = [r.kept for r in got if quality[r.doc_id] == 0]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.45 * len(bad)
