"""The pipeline on the smoke tables, stage by stage, and the registration."""

import __spark_entry__ as E
import corpus_pipeline as P
from fractions import Fraction

from lexiflow.llm import mixing, packing
from lexiflow.llm.common import ROW_ORDER, row_order, written
from test_near_and_substring import brute_components, FOLD

SMOKE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    frame = P.identify(spark, docs, SMOKE)
    assert frame.columns == columns
    left = {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in frame.collect()} == left
    frame = P.deduplicate(spark, frame, SMOKE)
    best = {}
    for i in left:
        key = rows[i].text.translate(FOLD)
        best[key] = max(i, best.get(key, i))
    assert {r.doc_id for r in frame.collect()} == set(best.values())
    frame = P.drop_near(spark, frame, SMOKE)
    near = brute_components([(i, rows[i].text) for i in sorted(best.values())], 5, Fraction(4, 5))
    kept = {c for _, _, c in near}
    frame = P.mix(spark, frame, SMOKE)
    assert frame.columns == columns and sorted(r.doc_id for r in frame.collect()) == sorted(kept)
    assert {r.doc_id for r in P.pack(spark, frame, SMOKE).collect()} == kept


def test_run_and_stage_list(spark, odd, empty):
    assert [f.__name__ for _, f in P.STAGES] == ["identify", "deduplicate", "drop_near", "mix", "pack"]
    for name, stage in P.STAGES:
        got = stage(spark, empty, SMOKE)
        assert got.collect() == [], name
        assert stage is P.pack or got.columns == empty.columns
    assert P.run(spark, SMOKE).count() > 0


def test_stages_on_odd_rows(spark, odd, odd_rows):
    """Nulls, ties, repeated rows and clashing names through every stage, each with its exact result."""
    frame = P.identify(spark, odd, SMOKE)
    left = [r for r in odd_rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, left))
    frame = P.deduplicate(spark, frame, SMOKE)
    best = {}
    for r in left:
        key = r[1].translate(FOLD)
        if key not in best or (r[0] or -1) > (best[key][0] or -1):
            best[key] = r
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, best.values()))
    frame = P.drop_near(spark, frame, SMOKE)
    near = brute_components([(r[0], r[1]) for r in best.values()], 5, Fraction(4, 5))
    stay = {c for _, _, c in near}
    assert None not in stay and len(stay) < len(best)
    rows = [r for r in best.values() if r[0] in stay]
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, rows))
    frame = P.mix(spark, frame, SMOKE)
    assert frame.columns == odd.columns and sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, rows))
    pieces = P.pack(spark, frame, SMOKE).collect()
    whole = packing.pack_documents(spark.createDataFrame(rows, odd.schema)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == \
        sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole)


def test_all_operators_are_registered():
    names = E.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)


def test_sequences_follow_the_schedule(spark, monkeypatch):
    """A hot source with most rows is spread by its share; sequences in order are documents in schedule order."""
    rows = [(i, f"text {i} " + "word " * (1 + i * 37 % 90), "hot" if i % 10 < 7 else "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    window = 512
    monkeypatch.setattr(packing.pack_in_order, "__defaults__", (*packing.pack_in_order.__defaults__[:-1], window))
    schedule = sorted((r.mix_position, r.doc_id) for r in mixing.pfair_mix(docs).select("doc_id", "mix_position").collect())
    mixed = written(P.mix(spark, docs, SMOKE), "mixed")
    pieces = P.pack(spark, mixed, SMOKE).collect()
    heads = [r for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.piece == 0]
    source = {i: s for i, _, s in rows}
    for at in range(0, len(rows), window):
        there = {i for _, i in schedule[at:at + window]}
        assert {r.doc_id for r in heads[at:at + window]} == there
    shares = mixing.target_shares(docs)
    first = heads[:window]
    for s, n in shares.items():  # within a block of its share of the first window
        got = sum(source[r.doc_id] == s for r in first)
        assert abs(got - window * n / sum(shares.values())) <= mixing.BLOCK_ROWS
    firsts = {}
    place = {i: k for k, (_, i) in enumerate(schedule)}
    for r in heads:
        firsts[r.sequence_id] = min(place[r.doc_id], firsts.get(r.sequence_id, len(rows)))
    assert [firsts[q] for q in sorted(firsts)] == sorted(firsts.values())


def test_order_of_files(spark):
    """Rows of files come in the order written, however Spark packs the files."""
    sizes = (3, 400, 50, 1)
    frame = spark.createDataFrame([(p, "w " * (sizes[p] * 20)) for p in range(4)], "doc_id long, text string")
    back = written(frame.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), "files")
    rows = P.pack(spark, back, SMOKE).where("piece = 0").collect()
    assert len(rows) == 4
    order = row_order(back).collect()
    assert [r.doc_id for r in sorted(order, key=lambda r: (len(r[ROW_ORDER[0]]), r[ROW_ORDER[0]], r[ROW_ORDER[1]]))] == [0, 1, 2, 3]


def test_windows_pack_every_piece(spark, odd, sample):
    for frame in (odd, sample):
        whole = packing.pack_documents(frame, with_ids=True)
        for rows in (7, 4096):
            got = packing.pack_in_order(frame, with_ids=True, window_rows=rows)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, whole.select(names).collect()))
            by_seq = {}
            for r in got.select("sequence_id", "offset", "length").collect():
                by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for parts in by_seq.values():
                at = 0
                for offset, n in sorted(parts):
                    assert offset == at
                    at += n
                assert at <= packing.CAPACITY
    total = sum(r.length for r in packing.pack_documents(sample).collect())
    n = packing.pack_in_order(sample).select("sequence_id").distinct().count()
    assert n <= 1.03 * total / packing.CAPACITY + 1
